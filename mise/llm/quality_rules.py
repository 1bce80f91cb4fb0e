"""Quality rules as a short-circuit cascade.

Each rule rejects a document from features of its whole text.  ``plan_rules``
runs every rule on a bounded hash sample, measures its seconds per document and
the share it rejects, and orders the rules by rejection per cost; ``cascade``
then tries them in that order and stops at the first rejection.  The verdict is
the conjunction of all rules, so it does not depend on the order.

Null and empty texts have no words and are rejected by ``few_words``; repeated
rows get equal verdicts; an empty table gives an empty result; other columns pass
through, those named like an output column are replaced.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, hash_sample, map_rows, together

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SAMPLE_ROWS = 2000

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PER_10_WORDS = 2
MAX_DUP_LINE_PERCENT = 60
WORD_LENGTH_BOUNDS = (2, 25)
MAX_UPPER_PERCENT = 50
MAX_EXCLAIM_PER_10_WORDS = 4
MIN_LETTER_WORD_PERCENT = 50
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
NOT_LETTERS = bytes(sorted(set(range(128)) - set(UPPER + LOWER + SPACES)))


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a ``width``-word window found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, itertools.count()), np.int64, len(words))
    size = len(words)  # a word's number is the place of its first occurrence
    key = ids[:n].copy()
    bound = size
    for k in range(1, width):
        if bound * size >= 1 << 62:  # renumber before the product could overflow
            key = np.unique(key, return_inverse=True)[1]
            bound = int(key.max()) + 1
        key = key * size + ids[k:n + k]
        bound *= size
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


class Text:
    """Features of one text, each computed when first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    def __getattr__(self, name: str):
        value = getattr(Text, f"_{name}")(self)
        self.__dict__[name] = value
        return value

    def _words(self):
        return self.raw.split()

    def _n_words(self):
        return len(self.words)

    def _word_chars(self):
        return len(self.raw.translate(None, SPACES + CONTINUATION))

    def _n_symbols(self):
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    def _lines(self):
        return [x for x in self.raw.split(b"\n") if x.split(None, 1)]

    def _n_dup_lines(self):
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self):
        return repeat_words(self.words)

    def _n_upper(self):
        return len(self.raw) - len(self.raw.translate(None, UPPER))

    def _n_lower(self):
        return len(self.raw) - len(self.raw.translate(None, LOWER))

    def _n_exclaim(self):
        return self.raw.count(b"!")

    def _n_letter_words(self):
        # A word counts when it has an ASCII letter or any character beyond ASCII.
        return len(self.raw.translate(None, NOT_LETTERS).split())


#: name -> rejects; all in integers, so that SQL states the same rules.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < MIN_WORDS,
    "repeats": lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > MAX_SYMBOLS_PER_10_WORDS * t.n_words,
    "dup_lines": lambda t: 100 * t.n_dup_lines > MAX_DUP_LINE_PERCENT * len(t.lines),
    "word_length": lambda t: not WORD_LENGTH_BOUNDS[0] * t.n_words <= t.word_chars <= WORD_LENGTH_BOUNDS[1] * t.n_words,
    "upper_case": lambda t: 100 * t.n_upper > MAX_UPPER_PERCENT * (t.n_upper + t.n_lower),
    "exclaims": lambda t: 10 * t.n_exclaim > MAX_EXCLAIM_PER_10_WORDS * t.n_words,
    "letter_words": lambda t: 100 * t.n_letter_words < MIN_LETTER_WORD_PERCENT * t.n_words,
}
BASE_RULES = ("few_words", "repeats")


def measure_rules(docs: DataFrame, rules: dict = RULES, text: str = "text") -> DataFrame:
    """Per rule: rows seen, rows rejected and seconds, over all rows of ``docs``."""

    def make():
        def work(raws):
            seconds = {r: 0.0 for r in rules}
            hits = {r: 0 for r in rules}
            for raw in raws:
                for name, rejects in rules.items():
                    t = Text(raw)
                    began = time.perf_counter()
                    hits[name] += bool(rejects(t))
                    seconds[name] += time.perf_counter() - began
            empty = [[] for _ in raws[1:]]
            return [pa.array([[{"rule": r, "n": len(raws), "hits": hits[r], "seconds": seconds[r]} for r in rules], *empty],
                             pa.list_(pa.struct([("rule", pa.string()), ("n", pa.int64()), ("hits", pa.int64()),
                                                 ("seconds", pa.float64())])))]
        return work

    kind = T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("n", T.LongType()),
                                     T.StructField("hits", T.LongType()), T.StructField("seconds", T.DoubleType())]))
    out = map_rows(docs.select(text), text, [T.StructField("measured", kind)], make)
    m = out.select(F.explode("measured").alias("m"))
    return m.groupBy("m.rule").agg(F.sum("m.n").alias("n"), F.sum("m.hits").alias("hits"), F.sum("m.seconds").alias("seconds"))


def order_rules(measured: list, rules: dict = RULES) -> list[str]:
    """Rules by rejection per cost, highest first; ties and rules without figures in their given order."""
    worth = {r["rule"]: (r["hits"] / r["n"]) / max(r["seconds"] / r["n"], 1e-9) for r in measured if r["n"]}
    return sorted(rules, key=lambda r: -worth.get(r, 0.0))


def plan_rules(docs: DataFrame, rules: dict = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The cascade's order, from a sample of about ``sample_rows`` rows (picked by a hash of the text)."""
    sample = hash_sample(docs.select(text), [text], sample_rows)
    return order_rules(measure_rules(sample, rules, text).collect(), rules)


def cascade(docs: DataFrame, order: list[str], rules: dict = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by`` (the first rule in ``order`` that rejects, or null)."""

    def make():
        tests = [(name, rules[name]) for name in order]

        def work(raws):
            by = []
            for raw in raws:
                t = Text(raw)
                by.append(next((name for name, rejects in tests if rejects(t)), None))
            return [pa.array([b is None for b in by], pa.bool_()), pa.array(by, pa.string())]
        return work

    return map_rows(docs, text, [T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())], make)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, their columns unchanged."""
    own, names = apart(docs)
    judged = cascade(own, plan_rules(docs, text=text), text=names[text])
    return together(judged.where("kept"), names)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def report(docs: DataFrame, order: list[str], rules: dict = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and the cascade's ``kept``.

    The base counts are wanted for every row; the other rules still run in the
    cascade's order and only until one rejects.
    """

    def make():
        base = [rules[r] for r in BASE_RULES]
        tests = [rules[name] for name in order if name not in BASE_RULES]

        def work(raws):
            counts = [[] for _ in COUNTS]
            failed, kept = [], []
            for raw in raws:
                t = Text(raw)
                for out, name in zip(counts, COUNTS):
                    out.append(getattr(t, name))
                failed.append(any(rejects(t) for rejects in base))
                kept.append(not failed[-1] and not any(rejects(t) for rejects in tests))
            return [*(pa.array(c, pa.int64()) for c in counts), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
        return work

    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    return map_rows(docs, text, [*fields, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())], make)
