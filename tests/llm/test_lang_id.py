import zlib

import numpy as np

from mise.llm import lang_id as L
from mise.llm.queries import op9_lang_id


def test_held_out_accuracy_and_split(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_lang_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id][1] for r in held) / len(held)
    assert right >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def brute_subwords(text):
    """2- and 3-byte subwords with word edges as a space, no inner edge."""
    low = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b" " + text + b" ")
    out = []
    for n in L.ORDERS:
        for i in range(len(low) - n + 1):
            g = low[i:i + n]
            if b" " not in g[1:-1] and g.strip(b" "):
                out.append(g)
    return out


def test_buckets_match_brute_force():
    def bucket(g):
        key = int.from_bytes(g, "big")
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - 15)
    for text in (b"", b"a", b"Ab c", "Größe, 12 été!".encode(), b"  x  yz "):
        assert sorted(L.buckets_of(text).tolist()) == sorted(bucket(g) for g in brute_subwords(text))


def test_long_texts_are_read_whole():
    model = L.Model(["a", "b"], np.random.default_rng(0).normal(size=(L.BUCKETS, 2)))
    text = b"some words in a row " * 60000
    whole = model.scores[L.buckets_of(text)].mean(0)
    assert np.allclose(model.logits(text), whole, atol=1e-3)
    assert [len(x) for x in L.slices_of(b"x" * (L.SLICE_BYTES * 2 + 5))] == [L.SLICE_BYTES, L.SLICE_BYTES, 5]


def test_undetermined_and_odd_rows(spark, make_docs, odd_rows):
    model = L.train([(b"the cat and the dog " * 5, "en"), ("der Hund und die Katze ".encode() * 5, "de")] * 10)
    docs = make_docs([*odd_rows, (50, "1234 !?"), (51, "the dog")], clash=("lang_pred", "score", "rejected"))
    rows = L.predict(docs, model).collect()
    assert len(rows) == len(odd_rows) + 2
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and r.rejected))
    assert next(r for r in rows if r.doc_id == 51).lang_pred == "en"


def test_no_training_rows(make_docs):
    model = L.fit(make_docs([(1, None)]).where("false"))
    assert model.langs == [] and L.predict(make_docs([(1, "text")]), model).first().lang_pred == "und"
    assert L.predict(make_docs([]), model).count() == 0


def test_rejection_is_calibrated():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):  # one language is clear, two are alike and their labels noise
        if i % 2:
            rows.append((b"zzz qqq xxx " * 4, "clear"))
        else:
            rows.append((b"abc def ghi " * int(rng.integers(2, 6)), ["left", "right"][int(rng.integers(2))]))
    model = L.train(rows)
    clear, mixed = model.predict(b"qqq zzz xxx"), model.predict(b"abc def ghi")
    assert clear[0] == "clear" and not clear[2] and mixed[2] and mixed[1] < clear[1]


TEXTS = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "der schnelle braune Fuchs springt", "cc": "le renard brun saute par dessus", "dd": "el zorro salta sobre el perro"}


def test_few_texts_repeated_often_are_all_learnt(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(sorted(TEXTS.items()) * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.langs == sorted(TEXTS)
    got = {(r.lang, r.lang_pred) for r in L.predict(docs, model).select("lang", "lang_pred").distinct().collect()}
    assert got == {(lang, lang) for lang in TEXTS}


def test_a_text_with_most_rows_leaves_room_for_others(spark):
    rows = [(0, TEXTS["aa"], "aa")] * 9000 + [(i, f"{TEXTS['aa']} {i}", "aa") for i in range(50)] + [(i, f"{t} {i}", lang) for lang, t in TEXTS.items() if lang != "aa" for i in range(3)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=40)
    assert model.langs == sorted(TEXTS)


def test_most_frequent_languages_where_there_are_too_many(spark):
    rows = [(i, f"text of language {i % 40}", f"l{i % 40:02d}") for i in range(400)] + [(1, "more", "l07")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_langs=3)
    assert model.langs == ["l00", "l01", "l07"]


def test_hash_sample_is_exact_and_the_same_for_any_partitions(spark):
    from pyspark.sql import functions as F

    from mise.llm.common import hash_sample
    rows = [(f"t{i % 700}", "g" if i % 3 else None, i % 7) for i in range(5000)] + [("hot", "g", 1)] * 4000 + [(None, "g", 2)]
    df = spark.createDataFrame(rows, "t string, g string, x int")
    hashes = sorted({(r.h, r.t) for r in df.select("t", F.xxhash64("t").alias("h")).collect()}, key=lambda p: p[0])
    for n in (1, 10, 300, 701, 5000):
        for parts in (1, 9):
            got = [r.t for r in hash_sample(df.repartition(parts), ["t"], n).collect()]
            assert sorted(got, key=str) == sorted((t for _, t in hashes[:n]), key=str)
    grouped = hash_sample(df, ["t"], 5, by="g").collect()
    for g in ("g", None):
        own = {t for t, gg, _ in rows if gg == g}
        assert {r.t for r in grouped if r.g == g} == {t for _, t in [h for h in hashes if h[1] in own][:5]}
    assert hash_sample(df.limit(0), ["t"], 5).count() == 0 and hash_sample(df.limit(0), ["t"], 5, by="g").count() == 0
