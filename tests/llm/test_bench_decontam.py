import random

from mise.llm import bench_decontam as B

ITEMS = "item_id long, text string"


def brute(docs, items):
    """Pairs whose question and answer 5-grams both stand in the text."""
    out = set()
    for d, t in docs:
        have = B.grams(B.words_of((t or "").encode()))
        for i, x in items:
            parts = [B.grams(p) for p in B.parts_of(x or "")]
            if any(parts) and all(len(p & have) >= B.OVERLAP * len(p) for p in parts):
                out.add((d, i))
    return out


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in B.matches(docs, items).collect()}
    assert got and got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    kept = {r.doc_id for r in B.clean(docs, items).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in got}


def test_bounds_lose_no_passage_above_the_threshold():
    """Block-max WAND against scoring every passage with every chunk."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rng.choices(words, weights=range(300, 0, -1), k=rng.randint(8, 90)))) for i in range(60)]
    from collections import Counter
    df, n, size = Counter(), 0, 0
    for _, t in items:
        for c in B.chunked(B.words_of(t.encode())):
            df.update(set(c))
            n, size = n + 1, size + len(c)
    index = B.Index(items, df, n, size / n)
    texts = []
    for _ in range(20):
        t = rng.choices(words, weights=range(300, 0, -1), k=400)
        for _ in range(3):
            cut = rng.choice(items)[1].split()
            at = rng.randrange(400)
            t[at:at] = [w if rng.random() > 0.15 else "other" for w in cut]
        texts.append([w.encode() for w in t])
    import numpy as np
    for text in texts:
        ids = np.array([index.vocab.get(w, len(index.vocab)) for w in text])
        n_half = -(-len(ids) // B.HALF) + 1
        pairs = list(index.passages(ids, np.arange(len(ids)) // B.HALF, n_half))
        assert pairs == list(index.passages(ids, np.arange(len(ids)) // B.HALF, n_half, most_cells=5 * index.n_blocks))
        got = {(i, p) for i, hits in index.retrieve(text, ids, pairs).items() for p, _ in hits}
        want = set()
        for p in range(n_half):
            terms = set(ids[p * B.HALF:(p + 2) * B.HALF].tolist())
            for c, impact in enumerate(index.full):
                if sum(x for t, x in impact.items() if t in terms) >= B.THRESHOLD:
                    want.add((index.chunk_item[c], p))
        assert got == want
        assert len(pairs) < n_half * index.n_blocks


def test_questions_and_odd_rows(spark, make_docs, odd_rows):
    item = "Which river flows through the old town? The broad green river Elm flows through it to the sea."
    question = item.split("?")[0]
    filler = " ".join(f"f{k}" for k in range(70))
    docs = make_docs([*odd_rows, (40, f"{filler} {item.upper()} {filler}"), (41, f"{filler} {question} {filler}"), (42, item), (42, item)],
                     clash=("matches", "__matches", "item_id"))
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "?!"), (None, "an item without id but with some words here")], ITEMS)
    got = sorted((r.doc_id, r.item_id) for r in B.matches(docs, items).collect())
    assert got == [(40, 1)] * 2 + [(42, 1)] * 4  # the question alone is no leak; equal rows and items are each reported
    assert B.clean(docs, items).columns == docs.columns
    assert B.clean(docs, items).count() == docs.count() - 3


def test_index_slices_agree(spark, documents, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted((r.doc_id, r.item_id, r.score) for r in B.matches(documents, items).collect())
    parts = list(B.index_slices(items, most=200))
    assert len(parts) > 2
    found = []
    for r in documents.collect():
        for part in parts:
            found += [(r.doc_id, m["item_id"], m["score"]) for m in part.search(r.text.encode())]
    assert sorted(found) == whole


def test_empty_tables(spark, make_docs):
    no_items = spark.createDataFrame([], ITEMS)
    assert B.matches(make_docs([(1, "a b c")]), no_items).count() == 0
    assert B.clean(make_docs([(1, "a b c")]), no_items).count() == 1
    assert B.matches(make_docs([]), spark.createDataFrame([(1, "a b c d e f")], ITEMS)).count() == 0


def test_passages_without_a_pivot_open_no_postings():
    """A text of common words costs nothing beyond the bound test; runs of any size give the same pairs."""
    from collections import Counter

    import numpy as np
    rng = random.Random(9)
    items = [(i, " ".join([f"rare{i}x{k}" for k in range(10)] + rng.choices(["the", "of", "and", "to"], k=30))) for i in range(400)]
    df = Counter(w for _, t in items for w in set(B.words_of(t.encode())))
    index = B.Index(items, df, len(items), 40)
    common = np.array([index.vocab[w] for w in rng.choices([b"the", b"of", b"and", b"to"], k=5000)])
    opened = []
    index.start = type("Spy", (), {"__getitem__": lambda self, k: opened.append(len(k)) or np.zeros(len(k), np.int64)})()
    assert list(index.passages(common, np.arange(5000) // B.HALF, 106)) == [] and sum(opened) == 0


def test_an_exact_copy_is_found_at_every_offset(spark, make_docs):
    words = ["zeta", "yotta", "xeno", "wolfram"] + ["the", "of", "and"] * 13 + ["vortex", "umbra", "tonic", "sable", "runic"]
    item = " ".join(words)
    others = [(k, " ".join(random.Random(k).choices(["the", "of", "and", "a", "in"], k=48))) for k in range(2, 40)]
    items = spark.createDataFrame([(1, item), *others], ITEMS)
    docs = make_docs([(k, " ".join([f"f{j % 17}" for j in range(k)] + words + ["g"] * 100)) for k in range(0, 100, 3)])
    got = {r.doc_id for r in B.matches(docs, items).where("item_id = 1").collect()}
    assert got == set(range(0, 100, 3))


def test_several_slices_give_the_same_through_written_tables(spark, documents, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted((r.doc_id, r.item_id, r.score) for r in B.matches(documents, items).collect())
    slices = B.index_slices
    monkeypatch.setattr(B, "index_slices", lambda rows: slices(rows, most=300))
    assert sorted((r.doc_id, r.item_id, r.score) for r in B.matches(documents, items).collect()) == whole
