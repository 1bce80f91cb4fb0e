import re
from collections import Counter

from mise.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts_match_brute_force(documents, make_docs, odd_rows):
    extra = [(100, "a b c d e " * 4 + "tail"), (101, "one two three four five six\none two three four five seven"), (102, "x\n\nx\n \nx")]
    for docs in (documents, make_docs(odd_rows + extra, clash=("n_words", "kept", "rule"))):
        rows = Q.report(docs, list(Q.RULES)).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)


def test_repeat_words_with_renumbering():
    words = [b"%d" % (i % 7000) for i in range(20000)]  # n^5 is beyond 2^62
    assert Q.repeat_words(words) == 20000
    assert Q.repeat_words([b"%d" % i for i in range(20000)]) == 0


def test_verdict_does_not_depend_on_the_order(documents):
    order = Q.plan_rules(documents)
    assert sorted(order) == sorted(Q.RULES)
    there = {r.doc_id: r.kept for r in Q.cascade(documents, order).collect()}
    back = {r.doc_id: r.kept for r in Q.cascade(documents, order[::-1]).collect()}
    full = {r.doc_id: r.kept for r in Q.report(documents, order).collect()}
    assert there == back == full
    assert {r.doc_id for r in Q.keep(documents).collect()} == {d for d, k in there.items() if k}


def test_rules_are_ordered_by_rejection_per_cost():
    measured = [{"rule": "few_words", "n": 10, "hits": 1, "seconds": 1.0}, {"rule": "repeats", "n": 10, "hits": 9, "seconds": 1.0},
                {"rule": "symbols", "n": 10, "hits": 9, "seconds": 0.1}]
    assert Q.order_rules(measured)[:3] == ["symbols", "repeats", "few_words"]


def test_cascade_stops_at_the_first_rejection(make_docs):
    calls = {"first": lambda t: True, "second": lambda t: 1 / 0}
    rows = Q.cascade(make_docs([(1, "a b")]), ["first", "second"], calls).collect()
    assert rows[0].rejected_by == "first" and not rows[0].kept


def test_empty_table(make_docs):
    none = make_docs([])
    assert Q.report(none, Q.plan_rules(none)).count() == 0 and Q.keep(none).count() == 0


def test_good_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id")
    long_enough = good.where("size(split(text, '[ \\n]+')) >= 10")
    assert Q.keep(long_enough).count() >= 0.97 * long_enough.count()
