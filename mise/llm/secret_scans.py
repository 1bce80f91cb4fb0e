"""Secret scans with a recursive decoding worklist.

Every whole text is scanned for three kinds (leftmost, non-overlapping per kind):
``assign`` (a credential name given a value of 6+ characters), ``access`` (an
access key id of 20+ characters) and ``hex`` (24+ hex digits).  Then a worklist
unwraps layers until nothing new comes out: percent escapes, Unicode escapes (``\\u``, ``\\U``, ``\\x``,
octal, ``%u``, numbered and the common named entities) and UTF-16 are decoded in place over
the whole layer, bytes that are no UTF-8 kept as they are;
base64 runs, over line breaks and from each of four alignments, become layers of
their own, and so does every compressed stream (all members that follow each
other, also nested) that begins anywhere in a decoded layer, and a bare deflate stream that
is the whole of one.  Each layer is
rescanned whatever characters it holds, and each layer keeps where its characters
came from, so that spans are given in the text itself.  A layer met before (equal
text and origin) is not unwrapped again.  ``n_layers`` and ``max_depth`` count the
layers that are text without control characters or hold a span.

A null text counts as empty; equal texts have equal spans, an empty table gives an empty one.  Other
columns stay; one that is named like a new one is replaced.  A stream that unfolds beyond ``MAX_LAYER_BYTES`` is
counted in ``n_oversized`` and taken in parts of about that size that end where no
span or run goes on; where there is no such place, or a stream inside runs over
the end of a part, the run gets a span of kind ``unscanned`` and is masked too.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, map_rows

KINDS = ("assign", "access", "hex")
UNSCANNED = "unscanned"  # what a cut stream may still hide; masked like a secret
NAMES = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24+ is found from its first digit
MIN_VALUE, MIN_ACCESS = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# Named entities of characters that stand in spans or around them.
ENTITIES = {"quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">", "colon": ":", "equals": "=", "period": ".", "comma": ",", "sol": "/", "bsol": "\\",
            "plus": "+", "lowbar": "_", "hyphen": "-", "dash": "-", "semi": ";", "num": "#", "percnt": "%", "dollar": "$", "commat": "@", "excl": "!",
            "quest": "?", "ast": "*", "lpar": "(", "rpar": ")", "lsqb": "[", "rsqb": "]", "lcub": "{", "rcub": "}", "verbar": "|", "grave": "`",
            "nbsp": "\xa0", "Tab": "\t", "NewLine": "\n"}
_NAMED = "&(?:" + "|".join(ENTITIES) + ");"
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
                     r"|%u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[0-3][0-7]{2}|" + _NAMED + ")+")
# Hexadecimal by the first five groups, then decimal, octal and named.
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]+)\}|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]+);|(?:%u|\\U)([0-9A-Fa-f]+)"
                        r"|&#([0-9]+);|\\([0-7]{3})|&([A-Za-z]+);")
WIDE = re.compile("(?:[\t\n\r -~]\0){4,}|(?:\0[\t\n\r -~]){4,}")
BREAK = r"[ \t]*+(?:\\r)?(?:\\n|\r?\n|\r)[ \t>]*+"
# a run of 16+ characters, or one that a line break (also an escaped one, or a quoted line) interrupts
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+|[A-Za-z0-9+/_-]++(?=BREAK[A-Za-z0-9+/_-]))(?:BREAK[A-Za-z0-9+/_-]++)*+={0,2}"
                    .replace("BREAK", BREAK))
ESCAPED_BREAK = re.compile(r"\\[rn]")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
MIN_BODY, MIN_BYTES = 16, 12  # the shortest span is an assignment of 12 characters
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")
# bytes without any of these hold neither a span nor a further layer
WORTH = re.compile(rb"(?i:passw|secret|token|api)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|%u|\\[uxU0-3]|&[#A-Za-z]|(?:[ -~]\0){4}|(?:\0[ -~]){4}|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*(?:\\r)?(?:\\n|[\r\n])|"
                   + MAGIC.pattern)
# after these no span, escape or base64 run goes on
SAFE = re.compile(rb"[A-Za-z0-9] (?=[A-Za-z0-9])|[,()!?<|~*@$^`\[\]\x00-\x08\x80-\xff]")
ODD = re.compile("[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f\x7f\udc80-\udcff]")  # a layer with these is not counted as text
STEP, PIECE, OVERLAP = 64, 1 << 16, 1 << 12
MAX_LAYER_BYTES = 64 << 20
MASK = "[SECRET]"


def scan(text: str) -> set[tuple[str, int, int]]:
    """The base spans of one layer: (kind, start, end)."""
    found = {("hex", *m.span()) for m in HEX.finditer(text)}
    if "AKIA" in text:
        found |= {("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS}
    low = text.lower()
    if any(n in low for n in NAMES):
        found |= {("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE}
    return found


class Pieces:
    """Where the characters of a layer decoded in place came from: copied stretches and decoded pieces."""

    def __init__(self, above):
        self.above, self.at, self.spans, self.copied = above, [], [], []

    def put(self, at: int, start: int, end: int, copied: bool) -> None:
        self.at.append(at)
        self.spans.append((start, end))
        self.copied.append(copied)

    def one(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        a, b = self.spans[k]
        return (a + i - self.at[k], a + i - self.at[k] + 1) if self.copied[k] else (a, b)

    def up(self, start: int, end: int):
        return self.one(start)[0], self.one(end - 1)[1], self.above


class Decoded:
    """Where the characters of decoded base64 came from: ``at`` and ``spans`` hold the run's stretches of one line."""

    def __init__(self, above, text: str, at: list[int], spans: list[int], skip: int, n: int):
        self.above, self.text, self.at, self.spans, self.skip, self.n = above, text, at, spans, skip, n
        self.offsets = None

    def place(self, i: int) -> int:
        k = bisect_right(self.at, i) - 1
        return self.spans[k] + i - self.at[k]

    def bytes_up(self, start: int, end: int) -> tuple[int, int]:
        return self.place(self.skip + start // 3 * 4), self.place(min(self.n, self.skip + (end - 1) // 3 * 4 + 4) - 1) + 1

    def up(self, start: int, end: int):
        if not self.text.isascii():
            if self.offsets is None:
                self.offsets = offsets(self.text)
            start, end = int(self.offsets[start]), int(self.offsets[end])
        return *self.bytes_up(start, end), self.above


class Whole:
    """Every character came from the same root span."""

    def __init__(self, start: int, end: int):
        self.span = (start, end)

    def up(self, start: int, end: int):
        return *self.span, None


def offsets(text: str) -> np.ndarray:
    """The byte offset of each character, and the end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    width[(code >= 0xDC80) & (code < 0xDD00)] = 1
    return np.concatenate([[0], np.cumsum(width)])


class Layer:
    """A text (bytes that are no UTF-8 as surrogate escapes), and where its characters came from (None: the root).
    ``partial``: more of the same stream follows.  ``tail``: the root's end of the run with its padding."""

    def __init__(self, text: str, source=None, raw: bytes | None = None, partial: bool = False, tail: int | None = None):
        self.text, self.source, self.raw, self.partial, self.tail = text, source, raw, partial, tail
        self.offsets = None

    def root(self, start: int, end: int) -> tuple[int, int]:
        source = self.source
        while source is not None:
            start, end, source = source.up(start, end)
        return start, end

    def bytes_root(self, start: int, end: int) -> tuple[int, int]:
        if self.offsets is None:
            self.offsets = offsets(self.text)
        a, b = self.root(int(np.searchsorted(self.offsets, start, "right")) - 1, int(np.searchsorted(self.offsets, end)))
        return a, self.tail if self.tail and end == len(self.raw) else b

    def key(self) -> bytes:
        origin = "" if self.source is None else "{}:{}".format(*self.root(0, len(self.text)))
        return hashlib.sha256(f"{origin}|{self.text}".encode("utf-8", "surrogatepass")).digest()


def in_place(layer: Layer, rx: re.Pattern, decode) -> Layer | None:
    """``layer`` with each match of ``rx`` replaced by its decoded pieces (character, offset, width)."""
    if not rx.search(layer.text):
        return None
    text, source, at, n = [], Pieces(layer.source), 0, 0

    def copy(a: int, b: int) -> int:
        if a < b:
            text.append(layer.text[a:b])
            source.put(n, a, b, True)
        return n + b - a

    for m in rx.finditer(layer.text):
        n = copy(at, m.start())
        for char, offset, width in decode(m.group()):
            text.append(char)
            source.put(n, m.start() + offset, m.start() + offset + width, False)
            n += len(char)
        at = m.end()
    copy(at, len(layer.text))
    return Layer("".join(text), source)


def percent_pieces(run: str):
    at = 0
    for char in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
        n = len(char.encode("utf-8", "surrogateescape"))
        yield char, 3 * at, 3 * n
        at += n


def unicode_pieces(run: str):
    high = None
    for m in ONE_ESCAPE.finditer(run):
        given, kind = m.group(m.lastindex), m.lastindex
        code = ord(ENTITIES[given]) if kind == 8 else int(given, {6: 10, 7: 8}.get(kind, 16))
        if high and 0xDC00 <= code < 0xE000:
            yield chr(0x10000 + ((high[0] - 0xD800) << 10) + code - 0xDC00), high[1], m.end() - high[1]
            high = None
            continue
        if high:
            yield "�", high[1], high[2]
        high = (code, m.start(), m.end() - m.start()) if 0xD800 <= code < 0xDC00 else None
        if high is None:
            yield chr(code) if code < 0x110000 and not 0xDC00 <= code < 0xE000 else "�", m.start(), m.end() - m.start()
    if high:
        yield "�", high[1], high[2]


def wide_pieces(run: str):
    """ASCII characters of UTF-16, either byte order."""
    at = 1 if run[0] == "\0" else 0
    for k in range(0, len(run), 2):
        yield run[k + at], k, 2


class Stream:
    """The unfolded pieces of the compressed members that follow each other from ``start`` of ``raw``.
    Afterwards ``end`` is where they end; ``dry``: the input ended before the stream did."""

    def __init__(self, raw: bytes, start: int):
        self.raw, self.start, self.end, self.dry = raw, start, start, False

    def __iter__(self):
        while self.end < len(self.raw) and (m := MAGIC.match(self.raw, self.end)):
            head = m.group()
            d = (zlib.decompressobj(31) if head[:1] == b"\x1f" else zlib.decompressobj() if head[:1] == b"x"
                 else bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor())
            fed = self.end
            try:
                while not d.eof:
                    data = getattr(d, "unconsumed_tail", b"")
                    if not data and getattr(d, "needs_input", True):
                        data = self.raw[fed:fed + STEP]
                        fed += len(data)
                    out = d.decompress(data, PIECE)
                    if out:
                        yield out
                    elif not data and not d.eof:
                        self.dry = True
                        return
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                return  # what came out before the fault has been given
            self.end = fed - len(d.unused_data)


class Deflated(Stream):
    """A stream without any header that is the whole of ``raw``; ``whole`` once its end was met there."""

    whole = False

    def __iter__(self):
        d, fed = zlib.decompressobj(-15), 0
        try:
            while not d.eof:
                data = d.unconsumed_tail
                if not data:
                    data = self.raw[fed:fed + STEP]
                    fed += len(data)
                out = d.decompress(data, PIECE)
                if out:
                    yield out
                elif not data and not d.eof:
                    return
        except zlib.error:
            return
        self.end = fed - len(d.unused_data)
        self.whole = self.end + 4 >= len(self.raw)


def inflates(raw: bytes) -> bool:
    """The bytes begin a deflate stream of something that is worth a look (garbage fails at once)."""
    try:
        out = zlib.decompressobj(-15).decompress(raw[:1 << 12], 1 << 12)
    except zlib.error:
        return False
    return bool(WORTH.search(out))


def streams(raw: bytes):
    at = 0
    while m := MAGIC.search(raw, at):
        yield (s := Stream(raw, m.start()))
        at = max(s.end, m.start() + 1)


def parts(stream: Stream, most: int):
    """(bytes, whether more follow, whether a run may be cut) of a stream, in parts of about ``most`` bytes that end
    where no span, escape or base64 run goes on."""
    held = bytearray()
    for out in stream:
        held += out
        if len(held) > most:
            cut, back = 0, 1 << 12
            while not cut and back < 2 * len(held):
                cut = max((m.end() for m in SAFE.finditer(held, max(0, len(held) - back), len(held) - 1)), default=0)
                back *= 8
            yield bytes(held[:cut] if cut else held), True, not cut
            del held[:cut or max(1, len(held) - OVERLAP)]
    if held:
        yield bytes(held), False, False


def base64_layers(layer: Layer):
    """Every base64 run, over line breaks, decoded from each of the first four characters: groups of four stand alone,
    so one of these is right for a body that begins anywhere in the run."""
    for m in BASE64.finditer(layer.text):
        at, spans, body = [], [], []
        n = 0
        blanked = ESCAPED_BREAK.sub(lambda x: " " * len(x.group()), m.group()) if "\\" in m.group() else m.group()
        for x in BASE64_LINE.finditer(blanked):
            at.append(n)
            spans.append(m.start() + x.start())
            body.append(x.group())
            n += x.end() - x.start()
        if n < MIN_BODY:
            continue
        body = "".join(body).replace("-", "+").replace("_", "/")
        for skip in range(4):
            used = n - skip - ((n - skip) % 4 == 1)
            raw = base64.b64decode(body[skip:skip + used] + "=" * (-used % 4))
            text = raw.decode("utf-8", "surrogateescape")
            if len(raw) >= MIN_BYTES and (WORTH.search(raw) or not ODD.search(text) or inflates(raw)):
                yield Layer(text, Decoded(layer.source, text, at, spans, skip, skip + used), raw, tail=layer.root(m.end() - 1, m.end())[1])


def find_secrets(text: str, most: int = MAX_LAYER_BYTES) -> dict:
    """Base spans, spans added from decoded layers, text layers seen, deepest of these, streams taken in parts."""
    base = scan(text)
    added: set[tuple[str, int, int]] = set()
    seen = set()
    n = {"layers": 0, "depth": 0, "oversized": 0}

    def unfolded(layer: Layer, depth: int):
        """The layers of the streams in ``layer``; a stream beyond ``most`` is explored part by part."""
        bare = isinstance(layer.source, Decoded) and not MAGIC.match(layer.raw) and inflates(layer.raw)
        for stream in chain(streams(layer.raw), [Deflated(layer.raw, 0)] if bare else []):
            whole, many, given = None, False, False
            for raw, more, cut in parts(stream, most):
                given = True
                if not (many or more):
                    whole = raw
                    break
                many = True
                span = layer.bytes_root(stream.start, len(layer.raw))
                if cut:
                    added.add((UNSCANNED, *span))
                explore(Layer(raw.decode("utf-8", "surrogateescape"), Whole(*span), raw, more), depth)
            if isinstance(stream, Deflated) and not stream.whole:
                continue
            n["oversized"] += many
            if layer.partial and stream.dry and given:
                added.add((UNSCANNED, *layer.root(0, len(layer.text))))
            if whole is not None and len(whole) >= MIN_BYTES:
                end = stream.end if stream.end > stream.start else len(layer.raw)
                yield Layer(whole.decode("utf-8", "surrogateescape"), Whole(*layer.bytes_root(stream.start, end)), whole)

    def explore(first: Layer, first_depth: int) -> None:
        work: deque[tuple[Layer, int]] = deque([(first, first_depth)])
        while work:
            layer, depth = work.popleft()
            if depth:
                key = layer.key()
                if key in seen:
                    continue
                seen.add(key)
                spans = {(kind, *layer.root(a, b)) for kind, a, b in scan(layer.text)}
                added.update(spans)
                if spans or isinstance(layer.source, Pieces) or not ODD.search(layer.text):
                    n["layers"] += 1
                    n["depth"] = max(n["depth"], depth)
                if layer.raw is None:
                    layer.raw = layer.text.encode("utf-8", "surrogateescape")
                work.extend((x, depth + 1) for x in unfolded(layer, depth + 1))
            escapes = [(PERCENT, percent_pieces)] if "%" in layer.text else []
            escapes += [(UNICODE, unicode_pieces)] if "\\" in layer.text or "&" in layer.text or "%u" in layer.text else []
            escapes += [(WIDE, wide_pieces)] if "\0" in layer.text else []
            inner = [x for rx, pieces in escapes if (x := in_place(layer, rx, pieces)) is not None and x.text]
            work.extend((x, depth + 1) for x in [*inner, *base64_layers(layer)])

    explore(Layer(text), 0)
    return {"base": base, "added": added - base, **n}


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], (*KINDS, UNSCANNED).index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in in_order(spans))


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                     T.StructField("added", T.BooleanType())])
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def with_secrets(docs: DataFrame, text: str = "text", most: int = MAX_LAYER_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``secrets`` (all spans in order), ``base_joined``, ``redacted``
    (the text with merged spans masked; null where there is none), ``n_layers``,
    ``max_depth`` and ``n_oversized``."""

    def make():
        def work(raws):
            rows = [find_secrets((r or b"").decode("utf-8"), most) for r in raws]
            spans, masked = [], []
            for raw, r in zip(raws, rows):
                every = r["base"] | r["added"]
                spans.append([{"kind": k, "start": a, "end": b, "added": (k, a, b) not in r["base"]} for k, a, b in in_order(every)])
                if not every:
                    masked.append(None)
                    continue
                t, out, at = (raw or b"").decode("utf-8"), [], 0
                for a, b in merged(every):
                    out += [t[at:a], MASK]
                    at = b
                masked.append("".join([*out, t[at:]]))
            return [pa.array(spans, ARROW_SPAN), pa.array([joined(r["base"]) for r in rows], pa.string()), pa.array(masked, pa.string()),
                    *(pa.array([r[k] for r in rows], pa.int64()) for k in ("layers", "depth", "oversized"))]
        return work

    return map_rows(docs, text, [T.StructField("secrets", T.ArrayType(SPAN)), T.StructField("base_joined", T.StringType()),
                                 T.StructField("redacted", T.StringType()), T.StructField("n_layers", T.LongType()),
                                 T.StructField("max_depth", T.LongType()), T.StructField("n_oversized", T.LongType())], make, keep_text)


def n_base(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: (s["kind"] == kind) & ~s["added"])).cast("long")


def joined_spans() -> Column:
    return F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in ``text`` (and ``n_chars``, where there is one, set anew for masked rows)."""
    own_docs, names = apart(docs)
    found = with_secrets(own_docs, names[text])
    out = []
    for c, own in names.items():
        value = F.col(own)
        if c == text:
            value = F.coalesce("redacted", own)
        elif c == n_chars:
            value = F.when(F.col("redacted").isNull(), F.col(own)).otherwise(F.length("redacted").cast(docs.schema[c].dataType))
        out.append(value.alias(c))
    return found.select(*out)
