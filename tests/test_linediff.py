"""Edit scripts against brute force: they turn one file into the other, and none is shorter."""
import random

import pytest

from mise.operators import golden as G
from mise.operators import linediff as D


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def applied(reference, actual, edits):
    """The reference without what is removed, with the added lines at their places in the actual file."""
    gone, added = {p for s, p, _ in edits if s == "-"}, {p: t for s, p, t in edits if s == "+"}
    stay = iter([t for p, t in D.counted_lines(reference) if p not in gone])
    return [added[p] if p in added else next(stay) for p, _ in D.counted_lines(actual)], list(stay)


@pytest.mark.parametrize("letters", [2, 4, 40])
def test_scripts_are_valid_and_shortest(letters):
    rnd = random.Random(letters)
    for _ in range(250):
        ref, act = ("\n".join(rnd.choice(["", " ", "line "][-1:] * 5 + ["", " \t"]) + (str(rnd.randrange(letters)) if rnd.random() < 0.9 else "")
                              + rnd.choice(["", " ", "\t"]) for _ in range(rnd.randint(0, 25))) for _ in range(2))
        edits = D.edit_script(ref, act)
        got, left = applied(ref, act, edits)
        assert got == [t for _, t in D.counted_lines(act)] and not left
        a, b = [t for _, t in D.counted_lines(ref)], [t for _, t in D.counted_lines(act)]
        assert len(edits) == len(a) + len(b) - 2 * longest(a, b)


def test_row_of_lengths_is_the_dynamic_programme():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        assert list(D._lengths(a, b)) == [longest(a, b[:k]) for k in range(len(b) + 1)]


def test_long_files():
    rnd = random.Random(5)
    lines = [f"line {rnd.randrange(3000)}" for _ in range(20_000)]
    other = [t for t in lines if rnd.random() > 0.1]
    for k in range(0, len(other), 50):
        other[k] = f"new {k}"
    edits = D.edit_script("\n".join(lines), "\n".join(other))
    got, left = applied("\n".join(lines), "\n".join(other), edits)
    assert got == other and not left


def test_only_failed_tests_and_hot_references(spark):
    tests = spark.createDataFrame([(i, f"u{i}", "hot.md" if i % 2 else f"r{i}.md") for i in range(40)] + [(99, "u", "none.md")],
                                  "line_no bigint, url string, ref_file string")
    actual = spark.createDataFrame([(i, "a\nb\nc" if i % 4 else "a\n\nx\nc") for i in range(40)] + [(99, "q")], "line_no bigint, body string")
    refs = spark.createDataFrame([("hot.md", "a\nc")] + [(f"r{i}.md", "a  \nb\nc\n") for i in range(0, 40, 2)], "ref_file string, body string")
    verdicts = G.golden_diff(tests, actual, refs)
    got = sorted((r.line_no, r.side, r.position, r.text) for r in D.failed_edits(verdicts, actual, refs).collect())
    want = [(i, "+", 2, "b") for i in range(1, 40, 2)] + [x for i in range(0, 40, 4) for x in ((i, "+", 3, "x"), (i, "-", 2, "b"))]
    assert got == sorted(want)
    assert D.failed_edits(verdicts.limit(0), actual, refs).count() == 0


def test_repeated_bodies_follow_the_verdict(spark):
    tests = spark.createDataFrame([(1, "u", "a.md")], "line_no bigint, url string, ref_file string")
    actual = spark.createDataFrame([(1, 0, "old"), (1, 1, "new\nmore")], "line_no bigint, pos int, body string")
    refs = spark.createDataFrame([("a.md", 0, "x"), ("a.md", 5, "new")], "ref_file string, pos int, body string")
    verdicts = G.golden_diff(tests, actual, refs, "pos")
    got = [(r.side, r.position, r.text) for r in D.failed_edits(verdicts, actual, refs, "pos").collect()]
    assert got == [("+", 2, "more")]
