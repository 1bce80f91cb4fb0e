"""Benchmark decontamination: a BM25 inverted index of test items with block-max WAND.

Test items are cut into chunks of at most ``CHUNK_WORDS`` words; a chunk's BM25
impacts are divided by its own full score, so a passage scores 1 when it holds
every term of the chunk.  Training texts are cut into overlapping passages of
``2 * HALF`` words, so that each chunk lies whole in some passage wherever it stands, and every
passage is a query.

WAND: a chunk's terms of least weight, up to ``SLACK`` of its score, are
non-essential - on their own they cannot lift it to ``THRESHOLD`` - so only
postings of essential terms are walked, and a chunk needs ``THRESHOLD - SLACK``
from them.  Pivots: each term has its largest impact in any block, and a passage whose terms' largest
impacts add up to less than the least demanding block needs is skipped before a posting is
opened.  Block-max: chunks are stored in blocks with each term's largest
essential impact; sums are taken over the blocks that a passage's postings name, and one whose
bound stays below its need is not looked into.  Surviving (passage, block) pairs are scored in full with all their terms,
and every chunk at or above ``THRESHOLD`` is retrieved.  Both bounds are safe: no
passage above the threshold is lost.

A retrieved item is verified in the text around the passage: its question and its
answer (the parts around the last '?' if there is one, otherwise its first and
second half) must each have ``OVERLAP`` of their word 5-grams there.

Frequencies are counted by Spark over all items.  Items are dealt to slices of about
``INDEX_WORDS`` words by hash, each slice's index is built in a task from its items and the
frequencies of its words, and the driver passes on one built slice at a time; with several slices the
texts are scanned once for each and each result is a written table.  Null and empty texts and items match
nothing; equal items are reported each under its own id, equal texts have equal matches; an empty table of
either kind gives no match.  Other columns stay; ``clean`` returns all columns unchanged.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, map_rows, together, written

K1, B = 1.2, 0.75
CHUNK_WORDS = 48
HALF = 48
THRESHOLD = 0.6
SLACK = 0.3
BLOCK = 8
GRAM = 5
OVERLAP = 0.6
INDEX_WORDS = 2_000_000
ROUNDING = 1e-4
CELLS = 1 << 21
_PUNCTUATION = bytes(c for c in range(128) if not (chr(c).isalnum() or c >= 128))
_SPACED = bytes(32 if c in _PUNCTUATION else c for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words; ASCII punctuation separates."""
    return (raw or b"").lower().translate(_SPACED).split()


def parts_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """(question, answer) words of an item."""
    head, mark, tail = text.rpartition("?")
    q, a = words_of(head.encode()), words_of(tail.encode())
    if mark and q and a:
        return q, a
    words = words_of(text.encode())
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def grams(words: list[bytes], n: int = GRAM) -> set[tuple[bytes, ...]]:
    """Word n-grams; of fewer words, the one sequence."""
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


class Index:
    """Chunks, their impacts and the block-max table of essential terms."""

    def __init__(self, items: list[tuple[int, str]], df: Counter, n_chunks: int, mean_words: float):
        self.items = []
        self.chunk_item: list[int] = []
        chunks = []
        for item_id, text in items:
            question, answer = parts_of(text)
            self.items.append((item_id, grams(question), grams(answer), len(words_of(text.encode()))))
            for c in chunked(words_of(text.encode())):
                self.chunk_item.append(len(self.items) - 1)
                chunks.append(Counter(c))
        self.vocab: dict[bytes, int] = {}
        for c in chunks:
            for w in c:
                self.vocab.setdefault(w, len(self.vocab))
        self.n_blocks = -(-len(chunks) // BLOCK)
        full: list[dict[int, float]] = []
        best: dict[int, dict[int, float]] = {}
        self.need = np.full(self.n_blocks, np.inf)
        for i, c in enumerate(chunks):
            size = sum(c.values())
            impact = {self.vocab[w]: math.log(1 + (n_chunks - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1)
                      / (tf + K1 * (1 - B + B * size / mean_words)) for w, tf in c.items()}
            total = sum(impact.values())
            impact = {t: x / total for t, x in impact.items()}
            full.append(impact)
            left = 0.0
            for t, x in sorted(impact.items(), key=lambda p: (p[1], p[0])):
                if left + x <= SLACK:
                    left += x
                else:
                    row = best.setdefault(t, {})
                    row[i // BLOCK] = max(row.get(i // BLOCK, 0.0), x)
            self.need[i // BLOCK] = min(self.need[i // BLOCK], THRESHOLD - left - ROUNDING)
        self.full = full
        # Postings of the block-max table in one run per term: where it starts, how many, block, impact.
        counts = np.zeros(len(self.vocab) + 1, np.int64)  # the last row stands for words outside the vocabulary
        for t, row in best.items():
            counts[t] = len(row)
        self.count = counts
        self.start = np.cumsum(counts) - counts
        order = sorted(best)
        self.block = np.array([b for t in order for b in sorted(best[t])], np.int64)
        self.impact = np.array([best[t][b] for t in order for b in sorted(best[t])])
        self.largest = np.zeros(len(self.vocab) + 1)
        for t, row in best.items():
            self.largest[t] = max(row.values())
        self.least_need = float(self.need.min()) if self.n_blocks else np.inf

    def passages(self, ids: np.ndarray, half: np.ndarray, n_half: int, most_cells: int = CELLS) -> Iterator[tuple[int, int]]:
        """(passage, block) pairs whose bound reaches the block's need; passage p is halves p and p + 1.

        Postings are opened only for passages whose terms could reach the least need, a run of
        about ``most_cells`` of them at a time, so cost follows the postings that are opened and
        memory neither the length of a text nor the size of the index.
        """
        reach = np.bincount(half, self.largest[ids], minlength=n_half + 1)
        alive = reach[:-1][:n_half] + np.append(reach[1:], 0.0)[:n_half] >= self.least_need
        open_half = np.zeros(n_half + 1, bool)
        open_half[:n_half] |= alive
        open_half[1:] |= alive
        wanted = open_half[half] & (self.count[ids] > 0)
        ids, half = ids[wanted], half[wanted]
        opened = np.cumsum(self.count[ids])
        begin = 0  # the next passage
        while (lo := int(np.searchsorted(half, begin))) < len(half):
            begin = max(begin, int(half[lo]) - 1)
            full = int(np.searchsorted(opened, (opened[lo - 1] if lo else 0) + most_cells))
            end = max(begin, int(half[min(full, len(half) - 1)]) - (1 if full < len(half) else 0))  # the run's last passage
            hi = int(np.searchsorted(half, end + 1, side="right"))
            n = self.count[ids[lo:hi]]
            k = np.repeat(np.cumsum(n) - n, n)
            posting = np.repeat(self.start[ids[lo:hi]], n) + np.arange(len(k)) - k
            own, block, impact = np.repeat(half[lo:hi], n), self.block[posting], self.impact[posting]
            # A half counts for the passage that it begins and for the one before it.
            passage = np.concatenate((own, own - 1))
            keep = (passage >= begin) & (passage <= end) & (passage < n_half)
            cells, where = np.unique((passage * self.n_blocks + np.concatenate((block, block)))[keep], return_inverse=True)
            bound = np.bincount(where, np.concatenate((impact, impact))[keep], minlength=len(cells))
            for c in cells[bound >= self.need[cells % max(1, self.n_blocks)]].tolist():
                yield divmod(c, self.n_blocks)
            begin = end + 1

    def retrieve(self, words: list[bytes], ids: np.ndarray, pairs: list[tuple[int, int]]) -> dict[int, list[tuple[int, float]]]:
        """item -> [(passage, score)] of the chunks at or above the threshold."""
        out: dict[int, list[tuple[int, float]]] = {}
        terms: tuple[int, set[int]] = (-1, set())
        for p, b in pairs:
            if terms[0] != p:
                terms = (p, set(ids[p * HALF:(p + 2) * HALF].tolist()))
            for i in range(b * BLOCK, min(len(self.full), (b + 1) * BLOCK)):
                score = sum(x for t, x in self.full[i].items() if t in terms[1])
                if score >= THRESHOLD - 1e-9:
                    out.setdefault(self.chunk_item[i], []).append((p, score))
        return out

    def verify(self, words: list[bytes], item: int, hits: list[tuple[int, float]]) -> tuple[float, float]:
        """Shares of the question's and the answer's 5-grams found around the hits."""
        _, question, answer, size = self.items[item]
        best = (0.0, 0.0)
        for p in sorted({p for p, _ in hits}):
            near = grams(words[max(0, p * HALF - size):(p + 2) * HALF + size])
            if len(question) == 1 or len(answer) == 1:  # a part shorter than a 5-gram is looked for as it is
                near |= {g for part in (question, answer) for g in part if len(g) < GRAM and contains(words, g)}
            shares = tuple(len(part & near) / len(part) if part else 1.0 for part in (question, answer))
            best = max(best, shares, key=min)
        return best

    def search(self, raw: bytes | None) -> list[dict]:
        return self.search_many([raw])[0]

    def search_many(self, raws: list[bytes | None], most: int = 1 << 17) -> list[list[dict]]:
        """Verified matches of each text; bounds are summed for many passages at once."""
        out: list[list[dict]] = [[] for _ in raws]
        cut = [words_of(r) for r in raws]
        group: list[int] = []
        size = 0
        for i, words in enumerate(cut):
            group.append(i)
            size += len(words)
            if size >= most or i == len(cut) - 1:
                self._search_group(cut, group, out)
                group, size = [], 0
        return out

    def _search_group(self, cut: list[list[bytes]], group: list[int], out: list[list[dict]]) -> None:
        if not self.full:
            return
        other = len(self.vocab)
        all_ids, halves, first, n_half = [], [], [], 0
        for i in group:
            ids = np.fromiter(map(self.vocab.get, cut[i], repeat(other)), np.int64, len(cut[i]))
            all_ids.append(ids)
            halves.append(np.arange(len(ids)) // HALF + n_half)
            first.append(n_half)
            n_half += -(-len(ids) // HALF) + 1  # an empty half parts the texts
        found: dict[int, list[tuple[int, int]]] = {}
        for p, b in self.passages(np.concatenate(all_ids), np.concatenate(halves), n_half):
            k = int(np.searchsorted(first, p, side="right")) - 1
            found.setdefault(k, []).append((p - first[k], b))
        for k, pairs in found.items():
            words, ids = cut[group[k]], all_ids[k]
            for item, hits in sorted(self.retrieve(words, ids, pairs).items()):
                question, answer = self.verify(words, item, hits)
                if min(question, answer) >= OVERLAP:
                    out[group[k]].append({"item_id": self.items[item][0], "score": max(s for _, s in hits), "n_passages": len({p for p, _ in hits}),
                                          "question_overlap": question, "answer_overlap": answer})


def contains(words: list[bytes], part: tuple[bytes, ...]) -> bool:
    n = len(part)
    return any(tuple(words[k:k + n]) == part for k in range(len(words) - n + 1) if words[k] == part[0])


def chunked(words: list[bytes]) -> list[list[bytes]]:
    """Equal chunks of at most CHUNK_WORDS words."""
    n = -(-len(words) // CHUNK_WORDS)
    size = -(-len(words) // n) if n else 1
    return [words[k:k + size] for k in range(0, len(words), size)]


def index_slices(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = INDEX_WORDS) -> Iterator[Index]:
    """Indexes over slices of the items of about ``most`` words each; frequencies are those of all items."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))

    def cut():
        def work(raws):
            chunks = [chunked(words_of(r)) for r in raws]
            return [pa.array([[sorted(set(c)) for c in cs] for cs in chunks], pa.list_(pa.list_(pa.binary()))),
                    pa.array([sum(map(len, cs)) for cs in chunks], pa.int64())]
        return work

    whole = written(map_rows(rows, "t", [T.StructField("chunks", T.ArrayType(T.ArrayType(T.BinaryType()))), T.StructField("size", T.LongType())], cut), "bm25-items")
    total = whole.agg(F.sum(F.size("chunks")).alias("n"), F.sum("size").alias("size")).first()
    if not total.n:
        return
    n_slices = -(-total["size"] // most)
    whole = whole.where(F.size("chunks") > 0).withColumn("slice", F.pmod(F.xxhash64("i", "t"), F.lit(n_slices)).cast("int"))
    words = whole.select("slice", F.explode("chunks").alias("c")).select("slice", F.explode("c").alias("w"))
    counted = words.groupBy("slice", "w").agg(F.count("*").alias("n"))
    df = written(counted.join(counted.groupBy("w").agg(F.sum("n").alias("df")), "w").select("slice", "w", "df"), "bm25-frequencies")
    n, mean = total.n, total["size"] / total.n

    def build(key, own: pa.Table, frequencies: pa.Table) -> pa.Table:
        held = sorted(zip(own.column("i").to_pylist(), own.column("t").to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        index = Index(held, Counter(dict(zip(frequencies.column("w").to_pylist(), frequencies.column("df").to_pylist()))), n, mean)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "built": pa.array([pickle.dumps(index.__dict__)], pa.binary())})

    built = written(whole.select("slice", "i", "t").groupBy("slice").cogroup(df.groupBy("slice")).applyInArrow(build, "slice int, built binary"), "bm25-slices")
    for k in range(n_slices):
        for row in built.where(F.col("slice") == k).collect():
            index = Index.__new__(Index)
            index.__dict__.update(pickle.loads(row.built))
            yield index


MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType()),
                      T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])
ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64()),
                                  ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def with_matches(docs: DataFrame, items: DataFrame, text: str = "text", name: str = "matches") -> DataFrame:
    """``docs`` with ``name``: the verified test items of each whole text."""
    spark = docs.sparkSession
    out = docs.withColumn(name, F.array().cast(T.ArrayType(MATCH)))
    fresh = f"__{name}"
    for k, index in enumerate(index_slices(items)):
        if k:
            out = written(out, "bm25-matches")
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            return lambda raws: [pa.array(shared.value.search_many(raws), ARROW_MATCH)]

        out = map_rows(out, text, [T.StructField(fresh, T.ArrayType(MATCH))], make)
        out = out.withColumn(name, F.concat(name, fresh)).drop(fresh)
    return out


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (doc_id, item_id) that is verified."""
    found = with_matches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a test item."""
    own, names = apart(docs)
    return together(with_matches(own, items, names[text]).where(F.size("matches") == 0), names)
