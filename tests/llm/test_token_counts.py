import random

import pytest
from pyspark.sql import functions as F

from mise.llm import queries as Q
from mise.llm import token_counts as C

HAND = ["don't we'll I'r I're 'really 's!'s it''s", "héllo wörld 123 ½ İstanbul ΣΑΣ", "ȩ́x ä ̈a 각 कि 각",
        "<|endoftext|>x <|endof a<|endoftext|><|startoftext|>b <<|endoftext|>>", "日本語 ✓ 🙂😂😂😂😂😂 é\x00b\x1cx", "", "  a b \n",
        "<|endoftext|>'s don<|endoftext|>t 1<|endoftext|>2", "Ᲊ Ɤ́", "a" * 40 + " !!!!!!!!'s ''''''' 'll'll'd"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(C.MODEL_PATH)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return C.Counter(C.read_model())


def every_prefix(library, text):
    return [library(text[:k]) for k in range(len(text) + 1)]


def random_texts(n):
    rnd = random.Random(7)
    parts = list("abcdetrhinsoTHE'''  sstrevml!?.-123ȩ́́İÜß日😂") + ["<|endoftext|>", "'re", "'ll", "the", "ing", "ᄀ", "ᅡ", "ِ"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


def test_every_prefix_equals_the_library(library, counter):
    for text in [*HAND, *random_texts(1500)]:
        table, want = counter.table(text), every_prefix(library, text)
        assert list(table.counts()) == want, text
        assert [table.at(k) for k in range(len(text) + 1)] == want


def test_budgets_equal_the_library(library, counter):
    for text in [*HAND, *random_texts(300)]:
        table, counts = counter.table(text), every_prefix(library, text)
        for budget in range(max(counts) + 2):
            assert table.longest_within(budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_pairs_that_follow_are_those_whose_encoding_they_are(counter):
    """The walk over both merge trees against a plain run of the merges."""
    m, rnd = counter.merges, random.Random(1)
    parts = {whole: (a, b) for whole, (_, a, b) in m.made.items()}

    def atoms(t):
        return [t] if t not in parts else atoms(parts[t][0]) + atoms(parts[t][1])

    def merged(ids):
        while True:
            best = min(((m.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in m.rank), default=None)
            if best is None:
                return ids
            i = best[1]
            whole = next(w for w in [m.vocab[names[ids[i]] + names[ids[i + 1]]]])
            ids = [*ids[:i], whole, *ids[i + 2:]]
    names = {i: t for t, i in m.vocab.items()}
    plain, ends = sorted(m.plain.values()), sorted(m.ends.values())
    near = [t for t in plain if len(names[t]) <= 3]
    seen = set()
    for _ in range(4000):
        a, b = rnd.choice(near if rnd.random() < 0.7 else plain), rnd.choice(rnd.choice([near, ends]))
        assert m.follows(a, b) == (merged(atoms(a) + atoms(b)) == [a, b])
        seen.add(m.follows(a, b))
    assert seen == {True, False}


def test_long_pieces(library, counter):
    for text in ["x" * 60000, "!" * 50000, "ab1" * 20000, "'re" * 10000, "日" * 3000, "é" * 3000]:
        assert counter.table(text).total == library(text)


def test_whole_table_equals_the_library(spark, documents, library):
    out = {r.doc_id: r for r in Q.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = documents.collect()
    assert len(out) == len(docs)
    for r in docs:
        n = library(r.text or "")
        assert (out[r.doc_id].n_tokens, out[r.doc_id].n_bytes, out[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 2048)


def test_odd_rows_and_clashing_columns(make_docs, odd_rows, library):
    out = C.with_counts(make_docs(odd_rows, clash=("n_tokens", "cut_chars")), limit=50).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in out), key=str) == sorted(((i, library(t or "")) for i, t in odd_rows), key=str)
    for r in out:
        text = r.text or ""
        assert library(text[:r.cut_chars]) <= 50 and (r.cut_chars == len(text)) == (r.n_tokens <= 50)
    assert C.with_counts(make_docs([])).count() == 0


def test_stored_counts_answer_without_encoding(make_docs, library):
    docs = make_docs(list(enumerate(HAND)) + [(99, None)])
    table = C.with_counts(docs, store=True)
    table = table.withColumn("half", F.floor(F.length("text") / 2)).select(
        "text", "half", C.tokens_of_prefix(F.col("prefix_counts"), F.col("half").cast("int")).alias("at_half"),
        C.longest_prefix(F.col("prefix_counts"), F.lit(5)).alias("fits"))
    for r in table.collect():
        text = r.text or ""
        assert r.at_half == (library(text[:r.half]) if r.text is not None else None)
        assert r.fits == max(k for k in range(len(text) + 1) if library(text[:k]) <= 5)
    cut = {r.doc_id: r.text for r in C.truncated(docs, limit=3).collect()}
    assert all(library(t or "") <= 3 for t in cut.values()) and cut[99] is None


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        C.Counter(open("/opt/tokenizers/byte_bpe_50k.json", "rb").read())
