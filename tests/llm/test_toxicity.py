import numpy as np

from mise.llm import toxicity as T


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    true = np.array([1.5, -1.0, 0.0])
    noisy = x @ true + rng.logistic(size=3000)
    y = np.searchsorted([-1.0, 0.5, 2.0], noisy)
    w, cuts = T.fit_ordinal(x, y)
    assert np.allclose(w, true, atol=0.15) and np.allclose(cuts, [-1.0, 0.5, 2.0], atol=0.2)
    assert (np.diff(cuts) > 0).all()


def test_expected_severity_grows_with_the_score():
    m = T.Model({b"bad": 2.0}, [1.0, 2.0, 3.0], 0.5)
    steps = [float(m.grades(s) @ np.arange(4)) for s in (-2, 0, 1, 3, 6)]
    assert steps == sorted(steps) and all(abs(m.grades(s).sum() - 1) < 1e-9 for s in (-40, 0, 40))
    assert m.score(b"Bad bad, BAD!") == 2.0 * (1 + np.log(3)) and m.score(b"good") == m.score(None) == 0.0


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.fit(docs, labels.where("doc_id % 2 = 0"))
    told = T.predict(docs.join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id"), model)
    n = {(r.truth, r.toxic): r["count"] for r in told.groupBy("truth", "toxic").count().collect()}
    hits = n[(1, True)]
    assert hits / (hits + n.get((0, True), 0)) >= 0.9 and hits / (hits + n.get((1, False), 0)) >= 0.9


def test_odd_rows_and_missing_labels(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=("severity", "grade", "toxic", "bag"))
    for labels in ([], [(4, 0), (5, 0)], [(4, 1)], [(None, 1), (4, None)]):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        rows = T.predict(docs, model).collect()
        assert len(rows) == len(odd_rows) and all(r.grade == 0 and not r.toxic for r in rows)
    assert T.predict(make_docs([]), T.Model()).count() == 0


def test_long_text_is_not_diluted(spark, make_docs):
    plain = " ".join(f"word{k}" for k in range(50))
    rows = [(i, f"{plain} {'awful' if i % 3 == 0 else 'fine'} tail{i}") for i in range(60)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    rows = {r.doc_id: r.toxic for r in T.predict(make_docs([(1, "plain " * 20000), (2, "plain " * 20000 + "AWFUL!"), (3, None)]), model).collect()}
    assert rows == {1: False, 2: True, 3: False}


def test_predictions_equal_a_plain_statement(spark, make_docs, odd_rows):
    """The model's formula by loops over words and grades."""
    import math
    import re
    weights = {b"bad": 1.5, b"^badmin": 0.7, b"worse": -0.4, b"\xc3\xa9vil": 2.0, b"^despic": 1.1}
    m = T.Model(weights, [0.5, 1.5, 3.0], 0.6)
    rows = [*odd_rows, (30, "Bad bad badminton, despicable!"), (31, "worse ÉVIL évil évil's"), (32, "BAD " * 5000)]
    for r in T.predict(make_docs(rows, clash=("severity", "grade", "toxic")), m).collect():
        counts = {}
        for w in re.split(rb"[^a-z'\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode())):
            for f in [w, *(b"^" + w[:k] for k in T.PREFIXES if len(w) >= k)]:
                if w:
                    counts[f] = counts.get(f, 0) + 1
        z = sum(v * (1 + math.log(counts[f])) for f, v in weights.items() if f in counts)
        below = [0.0, *(1 / (1 + math.exp(z - c)) for c in m.cuts), 1.0]
        p = [max(0.0, b - a) for a, b in zip(below, below[1:])]
        assert abs(r.severity - sum(g * x for g, x in enumerate(p))) < 1e-9 and abs(r.p_toxic - (1 - p[0])) < 1e-9
        assert r.grade == p.index(max(p)) and r.toxic == (1 - p[0] >= 0.6)


def test_half_odds_leave_the_other_half_out():
    from types import SimpleNamespace as N
    picked = [N(a=10, b=3, a_even=4, b_even=1)]
    toxic, even = np.array([1, 1, 0, 0, 1, 0]), np.array([True, False, True, False, False, True])
    assert np.isclose(T.half_odds(picked, toxic, even, True)[0], np.log(4.5 / 2) - np.log(1.5 / 3))
    assert np.isclose(T.half_odds(picked, toxic, even, False)[0], np.log(6.5 / 3) - np.log(2.5 / 2))
