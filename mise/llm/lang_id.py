"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords (hashed byte n-grams of
its lower-cased letters, word edges marked); a linear softmax on the average gives
the language.  Embeddings and softmax are trained together in numpy by stochastic
gradient descent on a bounded sample of different texts, equally many for each
language.  Softmax and average are both linear, so a
trained model folds into one score row per bucket, and a text's scores are the
mean of its subwords' rows.

Temperature is fitted on a held-back part of the sample; ``reject_below`` is the
score under which the held-back errors lie too thick (accuracy below ``TARGET``);
``rejected`` marks predictions below it.

Null texts and texts without a letter are ``und`` with score 0 (and rejected); an
empty training table gives ``und`` everywhere.  Repeated rows have equal results and count once in
training; an empty table gives an empty one.  Other columns stay; one that is named like a new one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, map_rows

BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3)
EPOCHS = 4
RATE = 0.5
TRAIN_ROWS = 3000
MAX_LANGS = 256
SLICE_BYTES = 1 << 19
TARGET = 0.9
UNKNOWN = "und"
_PRIME = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


# ASCII letters in lower case and all bytes beyond ASCII; everything else is a word edge.
_LETTERS = np.zeros(256, np.uint8)
for _c in range(256):
    _LETTERS[_c] = _c if 97 <= _c <= 122 or _c >= 128 else _c + 32 if 65 <= _c <= 90 else 32


def buckets_of(raw: bytes, orders=ORDERS) -> np.ndarray:
    """Bucket of every subword of a slice of bytes: n-grams that hold no inner word edge."""
    b = _LETTERS[np.frombuffer(b" " + raw + b" ", np.uint8)]
    letter = b != 32
    b = b.astype(np.uint32)
    out = []
    key = b
    for n in range(2, max(orders) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        key = (key[:m] << np.uint32(8)) | b[n - 1:]
        if n not in orders:
            continue
        # Word edges may stand first or last only, and some byte must be a letter.
        keep = letter[:m] | letter[1:m + 1] if n == 2 else letter[1:m + 1].copy()
        for k in range(2, n - 1):
            keep &= letter[k:k + m]
        out.append((key[keep] * _PRIME) >> _SHIFT)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def slices_of(raw: bytes, size: int = SLICE_BYTES):
    """The whole text in slices cut at word edges, so that no subword is lost and memory stays bounded."""
    at = 0
    while len(raw) - at > size:
        cut = raw.rfind(b" ", at, at + size)
        cut = at + size if cut <= at else cut
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def has_letter(raw: bytes) -> bool:
    if raw.isascii():
        return bool((_LETTERS[np.frombuffer(raw, np.uint8)] != 32).any())
    return any(c.isalpha() for c in raw.decode("utf-8"))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (buckets, langs): the softmax weights folded into the embeddings
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, raw: bytes) -> np.ndarray | None:
        total = np.zeros(len(self.langs))
        n = 0
        for part in slices_of(raw):
            ids = buckets_of(part)
            if len(ids):
                total += self.scores[ids].sum(axis=0) if len(ids) < len(self.scores) else \
                    np.bincount(ids, minlength=len(self.scores)) @ self.scores
                n += len(ids)
        return total / n if n else None

    def predict(self, raw: bytes | None) -> tuple[str, float, bool]:
        if raw is None or not self.langs or not has_letter(raw):
            return UNKNOWN, 0.0, True
        z = self.logits(raw)
        if z is None:  # letters, but no subword
            z = np.zeros(len(self.langs))
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list[tuple[bytes, str]], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = 7) -> Model:
    """A model from (text, language) rows; every fifth of a language is held back to calibrate it."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)))
    at = {lang: k for k, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    held, fit, seen = [], [], dict.fromkeys(langs, 0)
    for raw, lang in rows:
        counts = np.zeros(BUCKETS, np.int64)
        for part in slices_of(raw):
            counts += np.bincount(buckets_of(part), minlength=BUCKETS)
        ids = np.flatnonzero(counts)
        if len(ids):
            # Every fifth of a language, so that each keeps rows to learn from.
            seen[lang] += 1
            (fit if seen[lang] % 5 else held).append((ids, counts[ids] / counts.sum(), at[lang]))
    emb = rng.normal(0, 0.1, (BUCKETS, dim))
    soft = np.zeros((dim, len(langs)))
    steps, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            ids, share, k = fit[i]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ emb[ids]
            grad = softmax(hidden @ soft)
            grad[k] -= 1
            back = soft @ grad
            soft -= lr * np.outer(hidden, grad)
            # Rare and frequent subwords learn alike: the step is spread over the bag, not shrunk by its size.
            emb[ids] -= lr * np.outer(np.sqrt(share), back)
    model = Model(langs, emb @ soft)
    return calibrate(model, held)


def rejection(score: np.ndarray, right: np.ndarray, target: float) -> float:
    """The score under which accuracy, fitted as a rising function of the score, is below ``target``."""
    blocks: list[list[float]] = []  # (highest score, rows, right ones), pooled until accuracy rises
    for s in np.unique(score):
        at = score == s
        blocks.append([float(s), int(at.sum()), int(right[at].sum())])
        while len(blocks) > 1 and blocks[-1][2] * blocks[-2][1] <= blocks[-2][2] * blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [top[0], blocks[-1][1] + top[1], blocks[-1][2] + top[2]]
    low = [b[0] for b in blocks if b[2] < target * b[1]]
    if not low:
        return 0.0
    above = score[score > low[-1]]
    return float((low[-1] + (above.min() if len(above) else 1.0)) / 2)


def calibrate(model: Model, held: list) -> Model:
    """Temperature by held-back likelihood; rejection where held-back accuracy falls below TARGET."""
    if not held:
        return model
    logits = np.array([share @ model.scores[ids] for ids, share, _ in held])
    truth = np.array([k for _, _, k in held])

    def probs(t: float) -> np.ndarray:
        z = logits / t
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    # Without a single held-back error the likelihood would sharpen for ever: count one error more.
    wrong = 1 / (len(truth) + 2)

    def loss_at(t: float) -> float:
        p = np.maximum(probs(t)[np.arange(len(truth)), truth], 1e-12)
        return float(-((1 - wrong) * np.log(p) + wrong * np.log(np.maximum(1 - p, 1e-12))).mean())

    grid = np.geomspace(0.05, 20, 60)
    loss = [loss_at(t) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = probs(model.temperature)
    score, right = p.max(1), p.argmax(1) == truth
    model.reject_below = rejection(score, right, TARGET)
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, max_langs: int = MAX_LANGS) -> Model:
    """A model trained on ``rows`` different texts, as many of each language as of any other.

    Texts are picked by their hash and repeated ones count once, so no language is missing however
    often a text comes.  Of more than ``max_langs`` languages the most frequent are learnt.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    langs = [r.l for r in known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_langs).collect()]
    if not langs:
        return train([])
    sample = hash_sample(known.where(F.col("l").isin(langs)), ["t"], -(-rows // len(langs)), by="l")
    return train(sorted((r.t.encode(), r.l) for r in sample.toLocalIterator()))


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(raws):
            rows = [shared.value.predict(r) for r in raws]
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())]
        return work

    return map_rows(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                 T.StructField("rejected", T.BooleanType())], make, keep_text)
