"""SimHash near-duplicates by pivot distance tables.

Fingerprint: ASCII-lower-cased words, 3-word shingles with repeats, XXH64 (seed
42); a bit is set when over half of the shingle hashes set it.  Fingerprints
link at ``MAX_BITS`` or fewer differing bits; components are closed over links.

Rows with one fingerprint collapse into a class first, so copies never pair up.
Candidate cells: of four 16-bit blocks, two differing bits leave at least two
blocks equal, so every linked pair shares one of six two-block keys.  Within a
cell, pairs are discarded by the pivot table - each fingerprint's Hamming
distances to ``PIVOTS`` reference fingerprints, precomputed once; by the triangle
inequality a coordinate differing by more than ``MAX_BITS`` rules the pair out -
and the survivors are verified bit by bit.  A cell with more than ``CELL_PAIRS``
classes emits no pairs: its members meet at the fingerprints one flipped bit
away (two fingerprints are within two bits exactly when such balls meet), which
is exact and linear in the cell.

Null and empty texts have fingerprint zero and link like any other.  Rows with a
null id get their component's id.  A component of null ids only has a null id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, map_rows, together, written

SHINGLE = 3
MAX_BITS = 2
PIVOTS = 16
PIVOT_SAMPLE = 2000
CELL_PAIRS = 64
BLOCK_BITS = 16


def fingerprint(raw: bytes | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = (raw or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        ones += bit_counts(hashes[k:k + (1 << 15)])
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", width: int = SHINGLE,
                     keep_text: bool = True) -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of each whole text."""

    def make():
        return lambda raws: [pa.array(np.array([fingerprint(r, width) for r in raws], np.uint64).view(np.int64))]

    return map_rows(docs, text, [T.StructField(name, T.LongType())], make, keep_text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def choose_pivots(classes: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> list[int]:
    """``n`` reference fingerprints, each the farthest from those chosen before,
    from a sample of at most ``sample`` classes (the smallest by hash)."""
    rows = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    if not rows:
        return [0] * n
    fps = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    chosen = [0]
    nearest = np.bitwise_count(fps ^ fps[0]).astype(int)
    while len(chosen) < min(n, len(fps)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.bitwise_count(fps ^ fps[chosen[-1]]))
    return [int(x) for x in fps[chosen].view(np.int64)]


def pivot_row(fp: Column, pivots: list[int]) -> Column:
    """The pivot table's row: Hamming distances to the reference fingerprints."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p).cast("long"))).cast("tinyint") for p in pivots])


def cell_keys(fp: Column) -> Column:
    """The six keys of two 16-bit blocks each, the pair's number in the high bits."""
    block = [F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(4)]
    return F.array(*[F.lit(k << 32).cast("long") + F.shiftleft(block[i], BLOCK_BITS) + block[j]
                     for k, (i, j) in enumerate(itertools.combinations(range(4), 2))])


def links(classes: DataFrame, pivots: list[int], max_bits: int = MAX_BITS, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Edges (a, b) between fingerprints; their closure holds all links within ``max_bits``."""
    if max_bits != 2:
        raise ValueError("the block keys and the one-bit balls are exact for two differing bits")
    table = classes.select("fp", F.explode(cell_keys(F.col("fp"))).alias("cell"))
    sizes = table.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # Members of cells that hold two classes or more: few, so written once and used for both ways.
    shared = written(table.join(sizes, "cell"), "simhash-cells")
    small = shared.where(F.col("n") <= cell_pairs).withColumn("pivots", pivot_row(F.col("fp"), pivots))
    a = small.select("cell", F.col("fp").alias("a"), F.col("pivots").alias("pa"))
    b = small.select("cell", F.col("fp").alias("b"), F.col("pivots").alias("pb"))
    near = F.lit(True)
    for i in range(len(pivots)):
        near = near & (F.abs(F.col("pa")[i] - F.col("pb")[i]) <= max_bits)
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = a.join(b, (a["cell"] == b["cell"]) & (F.col("a") < F.col("b")) & near & verified).select("a", "b")
    crowded = shared.where(F.col("n") > cell_pairs).select("fp").distinct()
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    meets = crowded.select("fp", F.explode(ball).alias("at"))
    low = meets.groupBy("at").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = meets.join(low, "at").where("fp != low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the component's smallest node.

    Alternating large-star and small-star steps; each round is a written table.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "simhash-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "simhash-edges")
        # Equal edge sets in two rounds: every edge points at its root.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed), ``root`` (the component's
    smallest fingerprint) and ``component_id``."""
    sigs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sigs = written(with_fingerprint(sigs, "text", keep_text=False), "simhash-sigs")
    classes = written(sigs.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    roots = components(links(classes, choose_pivots(classes)))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return sigs.join(rooted.drop("low").join(lows, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the row with its smallest id.

    Ids that several rows carry, and null ids, are settled by fingerprint and then
    by a hash of the text: such a component keeps one row too.
    """
    found = written(near_duplicates(docs, doc_id, text), "simhash-found")
    shared = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    lead = found.where("doc_id = component_id").join(shared, "doc_id", "left_anti").select(F.col("doc_id").alias(doc_id))
    kept = docs.join(lead, doc_id, "left_semi").select(*docs.columns)
    if shared.isEmpty():
        return kept
    own, names = apart(docs)
    own_id, own_text = names[doc_id], names[text]
    rows = with_fingerprint(own.join(shared, F.col(own_id).eqNullSafe(F.col("doc_id")), "left_semi"), own_text)
    member = found.where("doc_id <=> component_id").select("doc_id", F.col("fp").alias("member"), "root").distinct()
    rows = rows.join(member, F.col(own_id).eqNullSafe(F.col("doc_id")) & (F.col("fp") == F.col("member")))
    picked = rows.groupBy("root").agg(F.min_by(F.struct(*names.values()), F.struct("fp", F.xxhash64(own_text))).alias("row"))
    return kept.unionByName(together(picked.select("row.*"), names))
