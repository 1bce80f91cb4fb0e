"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(cut_j - w.x): one weight vector shared by all ordered
thresholds.  Features are the words of the whole text, case and punctuation folded,
and their beginnings (``PREFIXES`` bytes), which carry the stems of inflected insults;
a feature's value is 1 + log(count), a document's vector is not scaled by its length,
so a long text is not diluted.  The vocabulary (the words that tell most for the toxic label, by
document frequencies counted in Spark), weights and cuts come from a bounded sample
of labelled rows (``TRAIN_ROWS``), by gradient ascent with shrinkage.

The labels say toxic or not.  Grades order the toxic ones: 0 for the others,
then 1..``GRADES - 1`` by the summed log-odds of the document's toxic words, cut at the
quantiles of the training documents; a toxic label without any toxic word is grade 1.  The log-odds that
grade a document are counted on the other half of the sample, so its own label has no part in them.

``severity`` is the expected grade, ``grade`` the most likely one, and ``toxic`` holds
when P(grade >= 1) reaches the threshold that maximises F1 on the training sample.
Null and empty texts have no features: they get the model's prior.  Without labels of
both kinds nothing can be learnt and every row is grade 0.  Equal texts have equal results; an empty
table gives an empty one.  Other columns stay; one that is named like a new one is replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, map_rows, written

GRADES = 4
VOCABULARY = 768
MIN_TOXIC_DOCS = 5
MIN_LOG_ODDS = 1.5
PREFIXES = (6, 8)
TRAIN_ROWS = 12000
STEPS = 400
RATE = 0.5
SHRINK = 1e-3
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 39 if c == 39 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words in ASCII lower case; all but letters, apostrophes and bytes beyond ASCII separate."""
    return (raw or b"").translate(_FOLD).split()


def bag_of(raw: bytes | None) -> Counter:
    """How often each feature occurs; a beginning is marked with a leading '^'."""
    words = Counter(words_of(raw))
    out = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) >= k:
                out[b"^" + w[:k]] += n
    return out


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=lambda: [20.0, 21.0, 22.0])
    threshold: float = 0.5

    def score(self, raw: bytes | None) -> float:
        if not self.weights:
            return 0.0
        known = {w: n for w, n in bag_of(raw).items() if w in self.weights}
        return float(sum(self.weights[w] * (1 + np.log(known[w])) for w in sorted(known)))

    def grades(self, score: float) -> np.ndarray:
        """P(grade) for each grade."""
        below = np.concatenate([[0.0], sigmoid(np.array(self.cuts) - score), [1.0]])
        return np.maximum(np.diff(below), 0)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = GRADES, steps: int = STEPS, rate: float = RATE,
                shrink: float = SHRINK) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by Adam on the mean cumulative-link log-likelihood.

    Cuts are kept in order by construction: the first is free, the others add exponentials.
    """
    n, d = x.shape
    share = np.array([(y <= j).mean() for j in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    theta = np.concatenate([np.zeros(d), start[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, cuts = theta[:d], cuts_of(theta[d:])
        z = x @ w
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, low = sigmoid(edges[y + 1] - z), sigmoid(edges[y] - z)
        p = np.maximum(up - low, 1e-12)
        gu, gl = up * (1 - up) / p, low * (1 - low) / p
        dz = gl - gu  # of the log-likelihood
        dcut = np.zeros(grades + 1)
        np.add.at(dcut, y + 1, gu)
        np.add.at(dcut, y, -gl)
        dcut = dcut[1:-1] / n
        tail = np.cumsum(dcut[::-1])[::-1]
        grad = np.concatenate([x.T @ dz / n - shrink * w, tail[:1], tail[1:] * np.exp(theta[d + 1:])])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad ** 2
        theta = theta + rate * 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta[:d], cuts_of(theta[d:])


def cuts_of(part: np.ndarray) -> np.ndarray:
    return part[0] + np.concatenate([[0.0], np.cumsum(np.exp(part[1:]))])


def best_threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """The midpoint between scores at which F1 is highest."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + toxic.sum())
    ordered = p[order]
    last = np.append(ordered[1:] != ordered[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    after = ordered[k + 1] if k + 1 < len(p) else 0.0
    return float((ordered[k] + after) / 2)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """A model from about ``rows`` rows of ``labels`` (doc_id, toxic); equal texts of one label count once."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic"))
    sample = F.broadcast(hash_sample(one, ["doc_id"], rows))  # 4 * rows rows at most
    labelled = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(sample, "doc_id")

    def make():
        def work(raws):
            found = [sorted(bag_of(r).items()) for r in raws]
            return [pa.array([[{"w": w, "n": n} for w, n in f] for f in found], pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())])))]
        return work

    kind = T.ArrayType(T.StructType([T.StructField("w", T.BinaryType()), T.StructField("n", T.LongType())]))
    bags = map_rows(labelled.select("toxic", "text", F.xxhash64("text").alias("h")), "text", [T.StructField("bag", kind)], make, keep_text=False)
    bags = written(bags.dropDuplicates(["h", "toxic"]).withColumn("row", F.monotonically_increasing_id()), "toxicity-bags")
    kept = bags.select("row", "toxic", (F.col("h") % 2 == 0).alias("even")).collect()
    toxic_rows, even_rows = {r.row: int(r.toxic) for r in kept}, {r.row: r.even for r in kept}
    n_toxic = sum(toxic_rows.values())
    n_other = len(toxic_rows) - n_toxic
    if not n_toxic or not n_other:
        return Model()
    words = bags.select("row", "toxic", (F.col("h") % 2 == 0).alias("even"), F.explode("bag").alias("e")).select("row", "toxic", "even", "e.w", "e.n")
    df = words.groupBy("w").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"),
                                F.count_if(F.col("toxic") & F.col("even")).alias("a_even"), F.count_if(~F.col("toxic") & F.col("even")).alias("b_even"))
    odds = F.log((F.col("a") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(n_other + 1.0))
    picked = df.select("w", "a", "b", "a_even", "b_even", odds.alias("o"), (odds * F.sqrt(F.col("a") + F.col("b"))).alias("told")).where(
        (F.col("a") >= MIN_TOXIC_DOCS) & (F.col("o") >= MIN_LOG_ODDS)).orderBy(F.desc("told"), "w").limit(VOCABULARY).collect()
    if not picked:
        return Model()
    vocab = {bytes(r.w): k for k, r in enumerate(picked)}
    chosen = bags.sparkSession.createDataFrame([(bytearray(w), k) for w, k in vocab.items()], "w binary, k int")
    at = {row: i for i, row in enumerate(sorted(toxic_rows))}
    x = np.zeros((len(at), len(vocab)), np.float32)
    # Columns of numbers, not rows: at most a few words of the vocabulary for each sampled text.
    cells = words.join(F.broadcast(chosen), "w").select("row", "k", "n").toArrow()
    x[[at[row] for row in cells.column("row").to_numpy()], cells.column("k").to_numpy()] = 1 + np.log(cells.column("n").to_numpy())
    toxic = np.array([toxic_rows[row] for row in sorted(toxic_rows)])
    even = np.array([even_rows[row] for row in sorted(toxic_rows)])
    mass = np.where(even, x @ half_odds(picked, toxic, even, False), x @ half_odds(picked, toxic, even, True))
    felt = mass[(toxic == 1) & (mass > 0)]
    steps = np.quantile(felt, [k / (GRADES - 1) for k in range(1, GRADES - 1)]) if len(felt) else np.zeros(GRADES - 2)
    y = np.where(toxic == 1, 1 + np.searchsorted(steps, mass, side="right"), 0)
    w, cuts = fit_ordinal(x, y)
    p = 1 - sigmoid(cuts[0] - x @ w)
    return Model({word: float(w[k]) for word, k in vocab.items()}, [float(c) for c in cuts], best_threshold(p, toxic))


def half_odds(picked: list, toxic: np.ndarray, even: np.ndarray, of_even: bool) -> np.ndarray:
    """Log-odds of each word for the toxic label, counted on one half of the sample."""
    a = np.array([r.a_even if of_even else r.a - r.a_even for r in picked], float)
    b = np.array([r.b_even if of_even else r.b - r.b_even for r in picked], float)
    own = toxic[even == of_even]
    return (np.log((a + 0.5) / (own.sum() + 1)) - np.log((b + 0.5) / (len(own) - own.sum() + 1))).astype(np.float32)


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``severity``, ``grade``, ``p_toxic`` and ``toxic``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(raws):
            p = np.array([m.grades(m.score(r)) for r in raws])
            severe = 1 - p[:, 0]
            return [pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype(np.int32), pa.int32()), pa.array(severe),
                    pa.array(severe >= m.threshold, pa.bool_())]
        return work

    return map_rows(docs, text, [T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()),
                                 T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())], make, keep_text)
