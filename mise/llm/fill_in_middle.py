"""Fill-in-middle documents, cut at line boundaries held in a compressed boundary set.

A text's ``n`` lines have ``n + 1`` boundaries (0 and the end of each line, as code point
offsets).  They are kept as a set of 16-bit containers, one for each 65,536 code points that
has any: a sorted array of up to 4,096 values, a bitmap for more, or runs where these
are smaller, with the cardinality before each container.  The k-th boundary is found by binary
search over these cardinalities and a select inside one container, so both cuts of a
text take two look-ups however many lines it has; the text is never split into a list of lines.

The cuts and the form come from the sha256 of ``salt:doc_id`` alone, so a row's result
depends on nothing but its id and text.  ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is
``<S>suffix<P>prefix<M>middle``; a text that is empty or holds a marker stays plain.  ``restored``
rebuilds the text from output and form.

A null text counts as empty (plain, no lines); a null id is hashed as empty text.
Equal rows give equal rows; an empty table gives an empty one.  Bytes that are no UTF-8 count
as one code point each and come back unchanged.  Other columns stay; one that is named like a
new column is replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

SALT = "7"
FIM_PERCENT = 100
SPM_PERCENT = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
CONTAINER = 1 << 16
ARRAY_MAX = 4096
BITMAP_WORDS = CONTAINER // 64


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """1,024 words of 64 bits, with the number of bits before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(CONTAINER, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1


class RunContainer:
    """Maximal runs: first value of each, with the number of values before it."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container_of(values: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for sorted distinct values below 65,536."""
    breaks = np.flatnonzero(np.diff(values) != 1) + 1
    runs = len(breaks) + 1
    if 4 * runs < min(2 * len(values), 8 * BITMAP_WORDS):
        first = np.concatenate(([0], breaks))
        return RunContainer(values[first], np.diff(np.append(first, len(values))))
    return ArrayContainer(values) if len(values) <= ARRAY_MAX else BitmapContainer(values)


class BoundarySet:
    """Ordered set of offsets that are added in ascending order, with select by rank."""

    def __init__(self):
        self.keys: list[int] = []
        self.before: list[int] = []  # values in earlier containers
        self.containers: list = []
        self.size = 0

    def add_container(self, key: int, values: np.ndarray) -> None:
        if len(values):
            self.keys.append(key)
            self.before.append(self.size)
            self.containers.append(container_of(values))
            self.size += len(values)

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = bisect_right(self.before, k) - 1
        return self.keys[at] * CONTAINER + self.containers[at].select(k - self.before[at])


def line_boundaries(text: str) -> BoundarySet:
    """0 and the end of each line of ``text``; a block of 65,536 code points is looked at a time."""
    out, n = BoundarySet(), len(text)
    for key in range(n // CONTAINER + 1):
        low = key * CONTAINER
        # A boundary is the place after a line feed, so a block begins one character early.
        points = np.frombuffer(text[max(0, low - 1):low + CONTAINER - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.flatnonzero(points == 10) + (1 if low == 0 else 0)
        extra = [0] if low == 0 else []
        last = [n - low] if low <= n < low + CONTAINER and n and (not len(ends) or ends[-1] != n - low) else []
        out.add_container(key, np.concatenate((extra, ends, last)).astype(np.int64))
    return out


def digest_of(doc_id: object, salt: str = SALT) -> str:
    return hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()


def transformed(text: str, digest: str) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, prefix and middle in code points, output) by the first four 32-bit numbers of ``digest``."""
    bounds = line_boundaries(text)
    n = bounds.size - 1
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= FIM_PERCENT:
        return n, PLAIN, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = bounds.select(low), bounds.select(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_PERCENT:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that ``transformed`` was given."""
    if form == PLAIN:
        return output
    first, second = (SUFFIX, PREFIX) if form == SPM else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError("the output does not begin with its marker")
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == SPM else one + middle + two


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salt: str = SALT, keep_text: bool = True,
              keep_output: bool = True) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and the sha256 of the
    output and of the text rebuilt from it."""
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
              T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
              T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    if keep_output:
        fields.append(T.StructField("output", T.StringType()))
    # The id's digest travels in front of the text, so that one column holds all that the map needs.
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    both = docs.withColumn("fim_source__", F.concat(digest, F.coalesce(F.col(text).cast("string"), F.lit(""))))

    def make():
        def work(raws: list[bytes | None]) -> list[pa.Array]:
            rows = []
            for raw in raws:
                n, form, prefix, middle, output = transformed(raw[64:].decode("utf-8", "surrogateescape"), raw[:64].decode())
                encoded = _bytes(output)
                rows.append((n, form, prefix, middle, hashlib.sha256(encoded).hexdigest(),
                             hashlib.sha256(_bytes(restored(output, form))).hexdigest(), encoded))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            out = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return [*out, pa.array(columns[6], pa.binary()).view(pa.string())] if keep_output else out
        return work

    return map_rows(both if keep_text else both.drop(text), "fim_source__", fields, make, keep_text=False)
