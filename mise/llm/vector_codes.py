"""Product codes of vectors, with nearest codebook entries found by Orchard search.

A vector is quantised to integers, ``floor(SCALE * x)``, and cut into ``PARTS`` consecutive
parts; each part position has a codebook of up to ``ENTRIES`` entries.  The first codebooks are the
parts of the vectors with the smallest ids; ``ROUNDS`` times every part is assigned to its nearest
entry (squared distance, ties to the lower index) and each used entry becomes the floor of
its parts' mean.

Orchard search: a codebook keeps, for each entry, all entries sorted by their distance
from it.  A search holds a current entry and walks down that entry's list; an entry that is
nearer becomes current and the walk goes on in its list from the top.  Visited entries are
marked and not measured again, and the walk stops where the list's distance is beyond twice the current
one: by the triangle inequality nothing after that can be as near.  All distances are
integers, so the stop is exact and equal distances are still seen.  The points of a batch walk
in step, as arrays.

Each round is one pass over a written table of quantised vectors: tasks return sums and counts
by part and entry, Spark adds them up, and the driver gets at most PARTS x ENTRIES rows.  Totals by label
are joined back apart for labels of a thousandth of the rows or more (at most 1,000
of them, broadcast) and for the others.

Vectors that are null or hold null, NaN or infinite components are dropped.  Shorter vectors are
read as filled up with zeros to the longest; a length that is no multiple of PARTS gives the
first parts one component more.  Components beyond what keeps sums of squares in 64 bits (32,768
for 64 components) are held at that bound.  Equal ids are ordered by their vectors; rows with a null
id come last and keep it.  Null labels count as one label.  A ``label_error`` beyond 64 bits is null.
With fewer vectors than entries the codebooks are shorter; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# A label with this share of all rows or more is joined by broadcast: at most 1 / HEAVY of them.
HEAVY = 1e-3
BATCH_POINTS = 1 << 15


@dataclass
class Codebook:
    """Entries of one part, distances between them, and for each its neighbours from near to far."""

    entries: np.ndarray

    def __post_init__(self):
        gaps = self.entries[:, None, :] - self.entries[None, :, :]
        between = np.einsum("abk,abk->ab", gaps, gaps)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted_distances = np.take_along_axis(between, self.order, axis=1)
        # Where walks begin: by the component in which the entries lie farthest apart.
        spread = self.entries.max(axis=0) - self.entries.min(axis=0) if self.entries.size else np.zeros(1)
        self.axis = int(spread.argmax())
        self.by_axis = np.argsort(self.entries[:, self.axis], kind="stable") if self.entries.size else None

    def _starts(self, points: np.ndarray) -> np.ndarray:
        values = self.entries[self.by_axis, self.axis]
        return self.by_axis[np.searchsorted((values[:-1] + values[1:]) // 2, points[:, self.axis])]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of, and squared distance to, the nearest entry of each point."""
        n, k = len(points), len(self.entries)
        if not points.shape[1]:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        current = self._starts(points)
        best = _squared(points, self.entries[current])
        visited = np.zeros((n, k), bool)
        visited[np.arange(n), current] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n)
        while len(walking):
            at = current[walking]
            beyond = self.sorted_distances[at, place[walking]] > 4 * best[walking]
            walking, at = walking[~beyond], at[~beyond]
            candidate = self.order[at, place[walking]]
            fresh = ~visited[walking, candidate]
            seen, tried = walking[fresh], candidate[fresh]
            visited[seen, tried] = True
            distance = _squared(points[seen], self.entries[tried])
            better = (distance < best[seen]) | ((distance == best[seen]) & (tried < current[seen]))
            place[walking] += 1
            moved = seen[better]
            current[moved], best[moved], place[moved] = tried[better], distance[better], 0
            walking = walking[place[walking] < k]
        return current, best


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def part_bounds(dims: int, parts: int = PARTS) -> list[int]:
    """Where the parts begin, and the end: as equal as can be, the longer ones first."""
    return [dims * p // parts if dims % parts == 0 else p * (dims // parts) + min(p, dims % parts) for p in range(parts + 1)]


def largest_component(dims: int) -> int:
    """Bound of a quantised component, so that four times a squared distance is in 64 bits."""
    return math.isqrt((1 << 60) // max(dims, 1)) // 2


def quantised(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label",
              scale: int = SCALE) -> tuple[DataFrame, int]:
    """(``vec_id``, ``label``, ``q``: array of bigint) of the kept rows, written once, and the number of components."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own_label = F.col(label) if label else F.lit(None).cast("int")
    kept = table.select(F.col(vec_id).alias("vec_id"), own_label.alias("label"), x.alias("x")).where(F.col("x").isNotNull() & ~bad)
    # A floor of a double beyond 64 bits is the largest long.
    q = F.transform("x", lambda c: F.floor(c * scale).cast("bigint"))
    rows = written(kept.select("vec_id", "label", q.alias("q")), "codes-quantised")
    return rows, rows.agg(F.max(F.size("q"))).first()[0]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` integers, short ones filled up with zeros, all within the bound."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dims).all():
        out = flat.reshape(len(lengths), dims)
    else:
        out = np.zeros((len(lengths), dims), np.int64)
        out[np.arange(dims) < lengths[:, None]] = flat
    bound = largest_component(dims)
    return np.clip(out, -bound, bound)


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_POINTS):
            part = batch.slice(start, BATCH_POINTS)
            yield part, _matrix(part.column(part.schema.get_field_index("q")), dims)


def first_books(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks of the parts of the vectors with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    bound, at = largest_component(dims), part_bounds(dims, parts)
    whole = np.array([np.clip(r.q + [0] * (dims - len(r.q)), -bound, bound) for r in first], np.int64).reshape(len(first), dims)
    return [whole[:, at[p]:at[p + 1]] for p in range(parts)]


def improved(rows: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """One round: each used entry becomes the floor of the mean of the parts nearest to it."""
    at, width = part_bounds(dims, len(books)), max(b.shape[1] for b in books)
    columns = [f"s{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ["part", "entry", "n", *columns]])

    def run(batches):
        searches = [Codebook(b) for b in books]
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for _, points in _batches(batches, dims):
            for p, search in enumerate(searches):
                own = points[:, at[p]:at[p + 1]]
                index, _ = search.nearest(own)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                for i in range(own.shape[1]):
                    # Exact in doubles: a batch's sums stay below 2 ** 53.
                    sums[p][:, i] += np.bincount(index, own[:, i], len(counts[p])).astype(np.int64)
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p)), pa.array(used), pa.array(n[used]),
                                              *(pa.array(sums[p][used, i]) for i in range(width))], names=[*["part", "entry", "n"], *columns])

    partial = rows.select("q").mapInArrow(run, schema)
    totals = partial.groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *columns]]).collect()
    out = [b.copy() for b in books]
    for r in totals:
        out[r.part][r.entry] = [int(r[c]) // int(r.n) for c in columns[:out[r.part].shape[1]]]
    return out


def fit(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    books = first_books(rows, dims, parts, entries)
    for _ in range(rounds):
        books = improved(rows, books, dims)
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """``rows`` with ``code`` (two hex digits a part) and ``error`` in place of ``q``."""
    at = part_bounds(dims, len(books))
    keep = [c for c in rows.columns if c not in ("q", "code", "error")]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        searches = [Codebook(b) for b in books]
        for batch, points in _batches(batches, dims):
            codes, error = np.zeros((len(points), len(books)), np.uint8), np.zeros(len(points), np.int64)
            for p, search in enumerate(searches):
                index, distance = search.nearest(points[:, at[p]:at[p + 1]])
                codes[:, p] = index
                error += distance
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep),
                                              pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error)],
                                             names=[*keep, "code", "error"])

    return rows.mapInArrow(run, schema)


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``: the coded entries, put together and scaled back."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]).cast("array<double>") for e in b]) for b in books])
    index = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)),
                        lambda p: F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return codes.withColumn("vector", F.flatten(F.zip_with(entries, index, lambda b, i: F.get(b, i))))


def label_errors(codes: DataFrame, heavy: float = HEAVY) -> DataFrame:
    """``codes`` with ``label_error``: errors added up over equal labels.  Read three times: written rows are best."""
    totals = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"),
                                        F.count("*").alias("n__"))
    totals = written(totals, "codes-labels")
    least = heavy * (totals.agg(F.sum("n__")).first()[0] or 0)
    # At most 1 / heavy labels can hold that share each.
    often = F.broadcast(totals.where(F.col("n__") >= least).select(F.col("label").alias("own__"), "label_error"))
    seldom = totals.where(F.col("n__") < least).select(F.col("label").alias("own__"), "label_error")
    same = F.col("label").eqNullSafe(F.col("own__"))
    common = codes.join(often, same)
    others = codes.join(often, same, "left_anti").join(seldom, same)
    return common.unionByName(others).drop("own__")


def compressed(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per kept vector: ``vec_id``, ``label``, ``code``, ``error``, ``label_error``, ``codebooks_sha256``."""
    rows, dims = quantised(table, vec_id, vector, label)
    dims = dims or 0
    books = fit(rows, dims)
    codes = written(encode(rows, books, dims), "codes-encoded")
    return label_errors(codes).withColumn("codebooks_sha256", F.lit(books_digest(books)))
