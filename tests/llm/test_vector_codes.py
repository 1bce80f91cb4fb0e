import hashlib
import math
import random

import numpy as np
import pytest

from mise.llm import queries as Q
from mise.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, q string, own__ string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "x", "x") for i, v, y in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6):
    """The same contract by plain loops over Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, v, _ in kept), default=0)
    kept = [(i, v + [0] * (dims - len(v)), y) for i, v, y in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size, more = divmod(dims, parts)
    at = [p * size + min(p, more) for p in range(parts + 1)]
    books = [[v[at[p]:at[p + 1]] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                x = v[at[p]:at[p + 1]]
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    rows, labels = [], {}
    for i, v, y in kept:
        best = [nearest(v[at[p]:at[p + 1]], books[p]) for p in range(parts)]
        rows.append((i, y, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        labels[y] = labels.get(y, 0) + rows[-1][3]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, labels[y], digest) for i, y, code, error in rows), key=str)


def run(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.compressed(df).collect()), key=str)


def test_search_is_exact_with_ties_and_equal_entries():
    rng = np.random.default_rng(5)
    visits = 0
    for trial in range(200):
        k, w = int(rng.integers(1, 17)), int(rng.integers(1, 9))
        book = rng.integers(-6, 6, (k, w)) * int(rng.integers(1, 1000))
        points = rng.integers(-8, 8, (50, w)) * int(rng.integers(1, 1000))
        index, distance = V.Codebook(book).nearest(points)
        all_of = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()
        visits += k


def test_search_measures_fewer_than_all_entries(monkeypatch):
    rng = np.random.default_rng(1)
    book = rng.integers(-4096, 4096, (16, 2))
    points = book[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 2))
    measured = []
    plain = V._squared
    monkeypatch.setattr(V, "_squared", lambda a, b: measured.append(len(a)) or plain(a, b))
    V.Codebook(book).nearest(points)
    assert sum(measured) < 4000 * 8


def test_whole_table_equals_brute_force(spark):
    df = Q.read(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert run(df) == brute(rows)


def test_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 2.25]) for _ in range(11)], rnd.choice([1, 2, None])) for i in range(60)]
    rows += [(60, None, 1), (61, [1.0, None], 1), (62, [float("nan")] * 11, 2), (63, [float("inf")] * 11, 2), (64, [], 1), (65, [0.25], None),
             (None, [0.125] * 11, 2), (3, [1.0] * 11, 2), (3, [1.0] * 11, 2), (-5, [-0.00001] * 11, 1)]
    assert run(table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], None)], [(1, [1.0], 1)], [(1, [0.5] * 8, None), (1, [0.5] * 8, None)]])
def test_small_tables(spark, rows):
    assert run(table(spark, rows)) == brute(rows)


def test_huge_components_are_held_at_the_bound(spark):
    rows = [(i, [3e38 * (-1) ** i] * 8, 1) for i in range(3)]
    out = V.compressed(table(spark, rows)).collect()
    assert len(out) == 3 and all(r.error == 0 for r in out)


def test_heavy_and_light_labels_join_alike(spark):
    codes = spark.range(3000).selectExpr("id as vec_id", "if(id % 3 = 0, null, if(id % 3 = 1, 7, cast(id as int))) as label", "id as error")
    want = {}
    for r in codes.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    for heavy in (1e-9, 1e-3, 1.0):
        out = V.label_errors(codes, heavy).collect()
        assert len(out) == 3000 and all(r.label_error == want[r.label] for r in out)


def test_decode_gives_the_coded_entries(spark):
    rows, dims = V.quantised(Q.read(spark, "/root/testdata/sf0.001", "embeddings"))
    books = V.fit(rows, dims, rounds=1)
    out = V.decode(V.encode(rows, books, dims), books).join(rows.select("vec_id", "q"), "vec_id").collect()
    for r in out:
        assert sum((a - b * 4096) ** 2 for a, b in zip(r.q, r.vector)) == r.error
