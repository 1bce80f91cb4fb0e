import random

import xxhash

from mise.llm import simhash_neardup as S
from pyspark.sql import functions as F


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin(a ^ rows[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]


def test_fingerprints_and_components_match_brute_force(documents, make_docs, odd_rows):
    for docs in (documents, make_docs(odd_rows, clash=("fp", "component_id", "root", "low"))):
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        rows = [(d, brute_fingerprint(t)) for d, t in texts]
        want = sorted((str(d), "%016x" % f, str(c)) for (d, f), c in zip(rows, brute_components(rows)))
        got = S.near_duplicates(docs).select("doc_id", S.hex16(F.col("fp")).alias("h"), "component_id").collect()
        assert sorted((str(r.doc_id), r.h, str(r.component_id)) for r in got) == want


def _classes(spark, fps):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    return spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, low long")


def _closure(spark, classes, **kw):
    roots = {r.node: r.root for r in S.components(S.links(classes, S.choose_pivots(classes), **kw)).collect()}
    return [roots.get(r.fp, r.fp) for r in classes.orderBy("low").collect()]


def test_links_in_small_and_crowded_cells(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):  # families of a few flipped bits, chains among them, and the sign bit
        base = rng.getrandbits(64)
        for _ in range(14):
            fps.add(base)
            for _ in range(rng.randint(1, 4)):
                base ^= 1 << rng.randrange(64)
    fps |= {0, 1, 3, 1 << 63, (1 << 64) - 1, (1 << 64) - 2}
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    want = brute_components(list(enumerate(fps)))
    classes = _classes(spark, fps)
    for limit in (64, 2):  # pairs behind the pivot table, and one-bit balls
        got = _closure(spark, classes, cell_pairs=limit)
        assert {tuple(sorted(i for i, r in enumerate(got) if r == root)) for root in got} == \
            {tuple(sorted(i for i, r in enumerate(want) if r == root)) for root in want}


def test_pivot_bound_is_safe():
    rng = random.Random(5)
    pivots = [rng.getrandbits(64) for _ in range(16)]
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert all(abs(bin(a ^ p).count("1") - bin(b ^ p).count("1")) <= 2 for p in pivots)


def test_one_of_each_keeps_one_row_per_group(make_docs, odd_rows):
    rows = odd_rows + [(6, "another text under the same id altogether"), (None, "only null ids have this text"), (None, "only null ids have this text")]
    docs = make_docs(rows, clash=("__fp", "root"))
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = sorted(str(r.text) for r in kept.collect())
    groups = {}
    for t, c in zip(rows, brute_components([(i, brute_fingerprint(t)) for i, (_, t) in enumerate(rows)])):
        groups.setdefault(c, []).append(t[1])
    assert len(texts) == len(groups)
    for members in groups.values():
        assert sum(texts.count(str(t)) for t in set(members)) == 1


def test_empty_table(make_docs):
    assert S.near_duplicates(make_docs([])).count() == 0
    assert S.one_of_each(make_docs([])).count() == 0
