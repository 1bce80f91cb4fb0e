"""The wrapping fold against Python's ``textwrap``."""
import random
import textwrap
import time

from pyspark.sql import functions as F

from mise.functions import wrapping as W
from mise.operators import render as RD

PARTS = list("ab ") * 6 + ["-", "--", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", " ", " ", "\x1c", "\x85", "é", "🙂", "word", "hyphen-ated",
                           "x" * 40, "y" * 80, "z-" * 30, "-" * 50, "-" * 90, " " * 80, "don't", "a.b,c", "1-2", "__", "½", "a-b-c", "foo--bar",
                           "q" * 200, "ab-" * 60]
HAND = ["", " ", "  a", "a ", " ", "x" * 75, "x" * 76, "x" * 75 + " y", "x" * 74 + " " + "y" * 100, "x " * 37 + "z" * 100, " " * 80, " " * 80 + "a",
        "a" + " " * 80 + "b", "a" * 75 + " " + "b" * 75, "-" * 200, " " * 200 + " a", "\ta\tbc\n\td", "  " * 60]
PREFIXES = ["", "1. ", "12. ", "* ", "123. "]


def by_hand(text, prefix):
    return "".join(line + "\n" for line in textwrap.wrap(text, 75, initial_indent=prefix, subsequent_indent=" " * len(prefix)))


def test_equals_textwrap(spark):
    rnd = random.Random(4)
    texts = HAND + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    texts += [" ".join(rnd.choice(["lorem", "ip-sum", "dolor--sit", "a", "x" * rnd.randint(60, 90)]) for _ in range(rnd.randint(100, 2500))) for _ in range(40)]
    rows = [(i, t, PREFIXES[i % 5]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, x string, p string")
    got = {r.i: r.o for r in df.select("i", F.expr(W.wrapped_sql("x", "p", 75)).alias("o")).collect()}
    for i, t, p in rows:
        assert got[i] == by_hand(t, p), (t, p)


def test_groups_number_items_from_one_and_skip_empty_ones(spark):
    groups = [["one " * 30, "", None, "four"], None, [], ["again"]]
    df = spark.createDataFrame([(groups,), (None,), ([],)], "g array<array<string>>")
    got = [r.b for r in df.select(RD.wrap_groups(F.col("g"), "numbered").alias("b")).collect()]
    assert got == [by_hand("one " * 30, "1. ") + by_hand("four", "4. ") + by_hand("again", "1. "), "", ""]
    got = df.select(RD.wrap_groups(F.col("g"), "bullet", "*", True).alias("b")).first().b
    assert got == by_hand("one " * 30, "* ") + "\n\n\n" + by_hand("four", "* ") + "\n" + by_hand("again", "* ") + "\n"


def test_no_python_worker_and_long_texts(spark):
    text = " ".join(f"word{i % 977}" for i in range(150_000))
    df = spark.createDataFrame([(text,)], "t string").select(RD.wrap_groups(F.array(F.array("t")), "plain").alias("b"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    start = time.time()
    assert df.first().b == by_hand(text, "")
    assert time.time() - start < 60


def test_long_words_are_looked_for_at_word_starts_only():
    """A search from every character of a word costs the square of the word's length."""
    from mise.functions.wrapping import wrapped_sql

    assert "(?:^| )[^ ]{71}" in wrapped_sql("x", "p", 75) and "'[^ ]{71,}'" not in wrapped_sql("x", "p", 75)


def test_usual_texts_with_a_blank_before_them_take_no_fold(spark):
    rnd = random.Random(8)
    words = ["lorem", "é", "ÿ&<(", "x" * 66] + ["y" * n for n in range(68, 77)] + ["a", "bc"] * 10
    rows = [(i, " " * (i % 2) + " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))), PREFIXES[i % 5]) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, x string, p string")
    got = {r.i: r.o for r in df.select("i", F.expr(W.wrapped_sql("x", "p", 75)).alias("o")).collect()}
    assert [got[i] for i, _, _ in rows] == [by_hand(t, p) for _, t, p in rows]
    # What is looked at first: one run over the text, before its tabs, chunks and lines are.
    first = W.wrapped_sql("x", "p", 75).split("THEN")[0]
    assert "x RLIKE" in first and "aggregate" not in first and "^ ?" in first
