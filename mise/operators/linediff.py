"""What differs in a failed test: the fewest lines to take out of the reference and to put in.

Lines count as in the verdict (trailing white space cut, blank lines skipped), positions as
in the files.  Only failed tests' bodies are fetched.  A pair of files is one row;
its longest common subsequence of lines is found exactly, in memory that grows with
the longer file and not with the product of both:

* lines that both files begin or end with are kept, lines found in one file only go;
* the rest is split by divide and conquer: lengths of common subsequences of one half with every
  beginning (and of the other half with every end) of the other file say where to cut it.
  A row of lengths is one integer with a bit for each line, updated by a few whole-integer operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .golden import FAIL, latest, _bodies_of, _digest

# --- fixed values -----------------------------------------------------------
TRAILING = " \t\n\x0b\x0c\r"
REMOVED, ADDED = "-", "+"
# ---------------------------------------------------------------------------
# Bit rows of lines that come often are kept, up to so many bytes; others are made when needed.
KEPT_ROWS_BYTES = 64 << 20


def counted_lines(body: str) -> list[tuple[int, str]]:
    """(position in the file, text) of the lines that count."""
    return [(i, t) for i, t in enumerate((raw.rstrip(TRAILING) for raw in body.split("\n")), 1) if t]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with the first 0, 1, ... lines of ``b``."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(b):
        places.setdefault(x, []).append(i)
    kept, most = {}, KEPT_ROWS_BYTES // (len(b) // 8 + 64)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        bits = kept.get(x)
        if bits is None:
            at = places.get(x)
            if at is None:
                continue
            if len(at) == 1:
                bits = 1 << at[0]
            else:
                flags = np.zeros(len(b), np.uint8)
                flags[at] = 1
                bits = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
                if len(kept) < most:
                    kept[x] = bits
        hit = row & bits
        row = ((row + hit) | (row - hit)) & full
    grown = np.unpackbits(np.frombuffer((row ^ full).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate(([0], np.cumsum(grown, dtype=np.int64)))


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in ``a``, in ``b``) of a longest common subsequence, ascending."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            out += [(a0, i) for i in range(b0, b1) if b[i] == a[a0]][:1]
            continue
        mid = (a0 + a1) // 2
        first = _lengths(a[a0:mid], b[b0:b1])
        last = _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int((first + last).argmax())
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def edit_script(reference: str, actual: str) -> list[tuple[str, int, str]]:
    """(side, position, text): lines to remove from the reference and to add from the actual file."""
    ref, act = counted_lines(reference), counted_lines(actual)
    number: dict[str, int] = {}
    both = {t for _, t in ref} & {t for _, t in act}
    a = [(k, number.setdefault(t, len(number))) for k, (_, t) in enumerate(ref) if t in both]
    b = [(k, number.setdefault(t, len(number))) for k, (_, t) in enumerate(act) if t in both]
    pairs = common([x for _, x in a], [x for _, x in b])
    kept_ref, kept_act = {a[i][0] for i, _ in pairs}, {b[j][0] for _, j in pairs}
    return ([(REMOVED, i, t) for k, (i, t) in enumerate(ref) if k not in kept_ref]
            + [(ADDED, i, t) for k, (i, t) in enumerate(act) if k not in kept_act])


EDITS = T.StructType([T.StructField("side", T.StringType()), T.StructField("position", T.LongType()), T.StructField("text", T.StringType())])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        refs, acts = batch.column("ref_body"), batch.column("act_body")
        for i in range(batch.num_rows):
            rows = edit_script(refs[i].as_py(), acts[i].as_py())
            side, position, text = zip(*rows) if rows else ((), (), ())
            own = [pa.array([batch.column(c)[i].as_py()] * len(rows), batch.column(c).type) for c in ("line_no", "url", "ref_file")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(side, pa.string()), pa.array(position, pa.int64()), pa.array(text, pa.string())],
                                             names=["line_no", "url", "ref_file", "side", "position", "text"])


def failed_edits(verdicts: DataFrame, actual: DataFrame, reference: DataFrame, order_col: str | None = None) -> DataFrame:
    """``(line_no, url, ref_file, side, position, text)`` of every failed test.

    ``verdicts`` come from ``golden_diff`` or ``golden_run``; ``actual`` ``(line_no, body)`` and ``reference``
    ``(ref_file, body)`` are the files they compared.  Where one repeats a key the same row
    counts as in the verdict (``golden.latest``).
    """
    failed = verdicts.where(F.col("status") == FAIL).select("line_no", "url", "ref_file")

    def body_of(rows: DataFrame, key: str, name: str) -> DataFrame:
        order = order_col if order_col in rows.columns else None
        wanted = rows.join(failed.select(key).distinct(), key, "left_semi")
        last = latest(wanted, [key], order, _made=_digest(F.col("body")))
        return _bodies_of(wanted, last, [key], order, "_made").select(key, F.col("body").alias(name))

    pairs = failed.join(body_of(actual, "line_no", "act_body"), "line_no").join(body_of(reference, "ref_file", "ref_body"), "ref_file")
    schema = T.StructType([*(pairs.schema[c] for c in ("line_no", "url", "ref_file")), *EDITS.fields])
    return pairs.select("line_no", "url", "ref_file", "ref_body", "act_body").mapInArrow(_edits, schema)
