"""SentencePiece encoding and decoding on the tokenizers library.

``parse_model`` reads the model's protobuf; ``build`` rebuilds it as a tokenizer:
the precompiled normaliser (if any) and white-space rules, the metaspace marker,
the scores (a unigram lattice, or merges ranked by score for a BPE model) and
byte fallback.  No piece has a marker after another character, so a text can be
cut before each run of markers without changing an id, and likewise at other
places that no piece reaches across (``unit_pattern``).  Each task encodes the distinct units of its batches on the
library's own threads, and checks each of them once against the sentencepiece
library (``parity``) and by decoding it (``round_trip``); a row's ids are its
units' ids in order, and its two flags hold when they hold for all its units.

The model file is read once on the driver (its size is checked) and shipped to
the tasks as bytes, so executors need no copy.  A null text gives a null ``ids``
and zero tokens; an empty text gives empty ids; equal texts have equal ids; an empty table gives an empty one.
Other columns stay; one that is named like a new one is replaced.  The given model is a BPE model; a unigram
model's lattice runs in the tests only.
"""

from __future__ import annotations

import itertools
import os
import re
import string
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, per_process

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
THREADS = 2
BATCH_BYTES = 1 << 20
KEPT_BYTES = 88 << 20  # of units and their ids in a worker process
ENTRY_BYTES = 230
# A second normaliser message, merged by protobuf: no character map, no prefix, spaces kept.
NO_NORMALISER = b"\x1a\x06\x12\x00\x18\x00\x20\x00"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(b, i)
        elif wire == 2:
            n, i = _varint(b, i)
            value, i = b[i:i + n], i + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, i = b[i:i + n], i + n
        else:
            raise ValueError(f"wire type {wire} in a SentencePiece model")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def parse_model(blob: bytes) -> Model:
    m = Model()
    for number, value in _fields(blob):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append((f[1].decode("utf-8"), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            m.kind, m.unk_id, m.byte_fallback = f.get(3, UNIGRAM), f.get(40, 0), bool(f.get(35, 0))
        elif number == 3:
            f = dict(_fields(value))
            m.charsmap = f.get(2, b"")
            m.dummy_prefix, m.squeeze_spaces, m.escape_spaces = (bool(f.get(k, 1)) for k in (3, 4, 5))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"SentencePiece model type {m.kind} is neither unigram nor BPE")
    if not m.escape_spaces:
        raise ValueError("a model without the metaspace marker is not supported")
    if any(kind == USER_DEFINED for _, _, kind in m.pieces):
        raise ValueError("user-defined pieces are not supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Merge rules of a BPE model: every split of a piece into two pieces, best piece first.

    Runs of the marker share one score, and the leftmost pair goes first there, so
    a run grows from its left end: longer runs rank before shorter ones.
    """
    score = {p: s for p, s, kind in m.pieces if kind == NORMAL}
    rules = []
    for i, (piece, s, kind) in enumerate(m.pieces):
        if kind != NORMAL:
            continue
        run = not piece.strip(MARK)
        for k in range(1, len(piece)):
            if piece[:k] in score and piece[k:] in score:
                rules.append((run, -len(piece) if run else -s, i, -k, (piece[:k], piece[k:])))
    return [r[-1] for r in sorted(rules)]


def build(m: Model):
    """The tokenizer of ``m``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    if m.kind == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback))
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        tok = Tokenizer(models.BPE(vocab, merges(m), unk_token=m.pieces[m.unk_id][0], fuse_unk=True,
                                   byte_fallback=m.byte_fallback))
    tok.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    tok.encode_special_tokens = True
    return tok


def read_model(path: str = MODEL_PATH, most: int = MAX_MODEL_BYTES) -> bytes:
    """The model's bytes; refused beyond ``most``, since every task gets a copy."""
    if os.path.getsize(path) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    with open(path, "rb") as f:
        return f.read()


def batches(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def unit_pattern(pieces: list[str], byte_fallback: bool) -> str:
    """A pattern that cuts a normalised text only where no piece can reach across.

    Each finer cut is used when the vocabulary has no pair of characters that would
    cross it: before marker runs; around line feeds, punctuation and digits.
    """
    pairs = {(x, y) for p in pieces for x, y in zip(p, p[1:])}
    if any(y == MARK != x for x, y in pairs):
        return "(?s).+"
    # Without byte fallback neighbouring unknown characters fuse: only the coarse cut.
    if not byte_fallback:
        return f"{MARK}*[^{MARK}]+|{MARK}+"
    own = {c for c in string.digits + "\n" if not any(c in pair for pair in pairs)}
    marks = {c for c in set(itertools.chain.from_iterable(pairs)) | set(string.punctuation)
             if c != MARK and c not in own and unicodedata.category(c)[0] not in "LM"}
    joined = {c for x, y in pairs if x != MARK and (x in marks) != (y in marks) for c in (x, y) if c in marks}
    own, marks, joined = (re.escape("".join(sorted(c))) for c in (own, marks - joined, joined))
    if not marks or not own:
        return f"{MARK}*[^{MARK}]+|{MARK}+"
    # Letters before a safe place; punctuation before a safe place; else all up to one.
    letters = f"{MARK}*[^{MARK}{own}{marks}{joined}]+(?=[{MARK}{own}{marks}]|\\Z)"
    signs = f"{MARK}*[{marks}]+(?![{marks}{joined}])"
    return f"{letters}|{signs}|[{own}]|{MARK}*[^{MARK}{own}]+|{MARK}+"


class Codec:
    """Encodes whole texts by their units; one in each task."""

    def __init__(self, blob: bytes, kept_bytes: int = KEPT_BYTES):
        import sentencepiece

        self.model = parse_model(blob)
        self.whole = build(self.model)
        self.unit = build(self.model)
        self.unit.normalizer = None
        # The unit is normalised already: the same model without a normaliser of its own.
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob + NO_NORMALISER)
        normal = [p for p, _, kind in self.model.pieces if kind == NORMAL]
        self.plain = not self.model.charsmap and not self.model.squeeze_spaces
        self.rx = re.compile(unit_pattern(normal, self.model.byte_fallback))
        self.text_of = [None if kind != NORMAL else p.replace(MARK, " ") for p, _, kind in self.model.pieces]
        self.lead_id = next((i for i, (p, _, _) in enumerate(self.model.pieces) if p == MARK), 0)
        self.kept_bytes, self.held = kept_bytes, 0
        self.known: dict[str, bytes] = {}
        self.bad: dict[str, tuple[bool, bool]] = {}

    def units(self, text: str) -> list[str]:
        if self.plain:
            text = ((" " if self.model.dummy_prefix and text else "") + text).replace(" ", MARK)
        else:
            text = self.whole.normalizer.normalize_str(text) if text else text
        return self.rx.findall(text)

    def learn(self, new: list[str]) -> None:
        for group in batches(new):
            rows = [e.ids for e in self.unit.encode_batch_fast(group, add_special_tokens=False)]
            plain = [u.replace(MARK, " ") for u in group]
            for u, ids, text, theirs in zip(group, rows, plain, self.lib.encode(plain)):
                self.known[u] = array("i", ids).tobytes()
                self.held += ENTRY_BYTES + 2 * len(u) + 4 * len(ids)
                pieces = [self.text_of[i] for i in ids]
                back = "".join(pieces) if None not in pieces else self.decode_bytes(ids)
                if back != text or theirs != ids:
                    self.bad[u] = (back == text, theirs == ids)

    def decode_bytes(self, ids: list[int]) -> str:
        """A unit with byte pieces; the decoder drops a text's prefix marker, so one is put before it."""
        return self.whole.decode([self.lead_id, *ids] if self.model.dummy_prefix else ids, skip_special_tokens=False)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, round trip, parity) of each text."""
        cut = [self.units(t) for t in texts]
        wanted = set(itertools.chain.from_iterable(cut))
        if self.held > self.kept_bytes:
            self.known, self.bad, self.held = {}, {}, 0
        self.learn([u for u in wanted if u not in self.known])
        out = []
        for text, units in zip(texts, cut):
            bad = [self.bad[u] for u in units if u in self.bad] if self.bad else []
            out.append((np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int32),
                        MARK not in text and all(x for x, _ in bad), all(x for _, x in bad)))
        return out


def encode(docs: DataFrame, text: str = "text", model_path: str = MODEL_PATH, threads: int = THREADS,
           keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens``, ``round_trip`` (the ids decode
    to the normalised text) and ``parity`` (the ids are those of the sentencepiece library)."""
    blob = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def make():
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        # Kept for the worker's later tasks, with the units it has seen.
        codec = per_process("sentencepiece", hash(blob.value), lambda: Codec(blob.value))

        def work(raws):
            rows = iter(codec.encode([r.decode("utf-8") for r in raws if r is not None]))
            rows = [None if r is None else next(rows) for r in raws]
            lengths = np.array([0 if x is None else len(x[0]) for x in rows], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32),
                            mask=np.array([*(x is None for x in rows), False]))
            flat = np.concatenate([np.empty(0, np.int32), *(x[0] for x in rows if x is not None)])
            flags = [pa.array([None if x is None else x[k] for x in rows], pa.bool_()) for k in (1, 2)]
            return [pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), pa.array(lengths), *flags]
        return work

    return map_rows(docs, text, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
                                 T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())], make, keep_text)


def decode(rows: DataFrame, ids: str = "ids", name: str = "decoded", model_path: str = MODEL_PATH) -> DataFrame:
    """``rows`` with the text of each ``ids`` (null ids: null)."""
    blob = rows.sparkSession.sparkContext.broadcast(read_model(model_path))
    keep = [c for c in rows.columns if c != name]

    def run(parts):
        tok = build(parse_model(blob.value))
        for part in parts:
            lists = part.column(part.schema.get_field_index(ids)).to_pylist()
            known = [x for x in lists if x is not None]
            texts = iter(tok.decode_batch(known, skip_special_tokens=False))
            out = [None if x is None else next(texts) for x in lists]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(out, pa.string())],
                                             names=[*keep, name])

    return rows.select(*keep).mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField(name, T.StringType())]))
