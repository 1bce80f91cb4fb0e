"""Personal data by weak supervision, in SQL expressions only.

Base spans (kept whatever the model says): ``email``, ``ip`` (parts at most 255),
``card`` (13 to 19 digits passing Luhn) and ``phone`` ('+', 9 to 15 digits),
leftmost and non-overlapping per kind.  Further candidates are looser patterns:
obfuscated e-mail, local phone numbers, social-security shapes, long account
numbers, given names with a surname.

Every candidate is voted on by labelers - the strict pattern of its kind (dial plans, card
issuers and their lengths, reserved addresses), a gazetteer (mail domains, given names), the words
around it, a label right before it and the shape of its digits - each for, against or abstaining.  Expectation-maximisation estimates each labeler's reliability and
the share of personal data per kind from the counts of vote patterns, which are
exact over all documents and as few as the patterns.  The posteriors then train a
logistic span classifier on span features (kind, digits, neighbours), again
from counts of feature patterns; candidates at or above ``ACCEPT`` are added.

All of it is linear in a text: offsets and overlaps are running sums, minima and maxima in blocks
of ``BLOCK`` spans, and what a labeler sees around a span is at most ``CONTEXT`` characters of the
text between it and its neighbours of the same kind.

A null text counts as empty.  Positions are code points, ends exclusive.  Spans of
one kind do not overlap; a further candidate that overlaps a base span is left out.
Equal texts have equal spans; an empty table gives an empty one.  Only the id and the text are read, so
other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BASE_KINDS = ("email", "ip", "card", "phone")
# (?<!..)|\G: inside a run a match can only start where the last one ended, so long runs cost one pass.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GIVEN_NAMES = ("James", "John", "Robert", "Michael", "William", "David", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara",
               "Hans", "Karl", "Peter", "Anna", "Ursula", "Jean", "Pierre", "Marie", "Jacques", "Juan", "Carlos", "Ana", "Carmen")
EXTRA = {
    "email_at": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{2,63}(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]{2,63})+",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Z0-9])",
    "name": r"(?<![A-Za-z])(?=[A-Z])(?:" + "|".join(GIVEN_NAMES) + r")\x20[A-Z][a-z]{1,30}(?![A-Za-z])",
}
KINDS = (*BASE_KINDS, *EXTRA)
# What a text must have for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+", "email_at": None, "name": None}
CONTEXT = 40
HINTS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|amex|mastercard|payment|pay|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
    "account": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "name": r"(?i)\b(?:mr|mrs|ms|dr|herr|frau|m\.|mme|name|named|contact|señor|señora)\b",
}
LIKE = {"email_at": "email", "phone_local": "phone"}
AGAINST = r"(?i)\b(?:version|v|isbn|issn|doi|figure|fig|table|section|chapter|example|rfc)\b"
MAIL_ENDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co")
LABELERS = ("pattern", "gazetteer", "context", "label", "shape")
BLOCK = 256
# A label that ends right before the span.
LABELS = {
    "email": r"(?i)(?:e-?mail|mail|mailto|correo|courriel)",
    "ip": r"(?i)(?:ip|host|server|client|address|login from|addr)",
    "card": r"(?i)(?:card|card no|card number|visa|mastercard|amex|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono)",
    "ssn": r"(?i)(?:ssn|social security number|social security)",
    "account": r"(?i)(?:iban|account|konto|compte|cuenta)",
    "name": r"(?i)(?:mr|mrs|ms|dr|herr|frau|mme|name|señor|señora)",
}
# Digits of national numbers by country code; the first digit after +1 is 2 to 9.
DIAL_PLANS = r"^(?:1[2-9][0-9]{9}|33[1-9][0-9]{8}|34[6-9][0-9]{8}|44[1-9][0-9]{8,9}|49[1-9][0-9]{5,12}|39[0-9]{8,11}|31[1-9][0-9]{8}|41[1-9][0-9]{8}|43[1-9][0-9]{4,12}|61[2-9][0-9]{8}|81[1-9][0-9]{8,9}|86[1-9][0-9]{9,10}|91[6-9][0-9]{9})$"
# Issuers' first digits with the lengths of their cards.
CARD_PLANS = (r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}"
              r"|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14})$")
RESERVED_IP = r"^(?:0|127|255|22[4-9]|23[0-9])\.|(?:^|\.)0[0-9]"
# One digit repeated, or digits in counting order.
DULL_DIGITS = r"^([0-9])\1+$|^(?:0?123456789|9876543210?)"
EM_STEPS = 50
FIT_STEPS = 300
ACCEPT = 0.5


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (an expression inside a lambda is computed each time)."""
    return F.get(F.transform(F.array(value), body), 0)


def running(items: Column, value, begin: Column, join) -> Column:
    """array<(item, before)>: each item with the joined values of all items before it.

    Two levels, so that no step copies more than a block's or the blocks' results.
    """
    def carried(values: Column, start: Column, of) -> Column:
        """array<(item, before)> of one block."""
        typed = F.struct(start.alias("at"), F.transform(F.slice(values, 1, 0), lambda x: F.struct(x.alias("item"), start.alias("before"))).alias("out"))
        return F.aggregate(values, typed, lambda acc, x: F.struct(
            join(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("item"), acc["at"].alias("before")))).alias("out")),
            lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
        totals = F.transform(blocks, lambda b: F.struct(
            b.alias("block"), F.aggregate(F.slice(b, 2, BLOCK), value(F.get(b, 0)), lambda acc, x: join(acc, value(x))).alias("total")))
        some = let(totals, lambda t: F.flatten(F.transform(carried(t, begin, lambda x: x["total"]), lambda x: carried(x["item"]["block"], x["before"], value))))
        return F.when(F.size(v) > 0, some).otherwise(carried(v, begin, value))

    return let(items, whole)


def _matches(text: Column, pattern: str) -> Column:
    """array<(start, end, match, before, after)> of a pattern, in code points; what stands
    around a match comes from the pieces of the text between matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between")), lambda s: F.transform(
        s["found"], lambda m, i: F.struct(
            m.alias("match"), F.length(F.get(s["between"], i)).alias("gap"),
            F.right(F.get(s["between"], i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(s["between"], i + 1), F.lit(CONTEXT)).alias("after"))))
    placed = running(pieces, lambda x: x["gap"] + F.length(x["match"]), F.lit(0), lambda a, b: a + b)
    return F.transform(placed, lambda x: F.struct(
        (x["before"] + x["item"]["gap"]).alias("start"), (x["before"] + x["item"]["gap"] + F.length(x["item"]["match"])).alias("end"),
        x["item"]["match"].alias("match"), x["item"]["before"].alias("before"), x["item"]["after"].alias("after")))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    d = _digits(match)
    n = F.length(d)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
        F.when(F.substring(d, i, F.lit(1)).cast("int") > 4, F.substring(d, i, F.lit(1)).cast("int") * 2 - 9).otherwise(
            F.substring(d, i, F.lit(1)).cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """The strict rule of a base kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3)
                        & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(match)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>"


def _spans(text: Column, kind: str) -> Column:
    pattern = PATTERNS.get(kind) or EXTRA[kind]
    need = NEEDS.get(kind, "digit")
    there = text.rlike("[0-9]") if need == "digit" else text.contains(need) if need else text.rlike(pattern)
    found = F.transform(F.filter(_matches(text, pattern), lambda m: _valid(kind, m["match"]) if kind in PATTERNS else F.lit(True)),
                        lambda m: F.struct(F.lit(kind).alias("kind"), *[m[c].alias(c) for c in ("start", "end", "match", "before", "after")]))
    return F.when(there, found).otherwise(F.array().cast(SPAN))


def _apart_from(extra: Column, base: Column) -> Column:
    """The spans of ``extra`` that overlap none of ``base``."""
    def marked(spans: Column, own: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("span")))

    ordered = F.array_sort(F.concat(marked(base, True), marked(extra, False)))
    ends = running(ordered, lambda x: F.when(x["own"], x["end"]).otherwise(0), F.lit(0), lambda a, b: F.greatest(a, b))
    far = F.lit((1 << 31) - 1)
    both = running(F.reverse(ends), lambda x: F.when(x["item"]["own"], x["item"]["start"]).otherwise(far), far, lambda a, b: F.least(a, b))
    # Base spans that begin before it end before it; those that begin after it begin beyond its end.
    free = F.filter(both, lambda x: ~x["item"]["item"]["own"] & (x["item"]["before"] <= x["item"]["item"]["start"])
                    & (x["before"] >= x["item"]["item"]["end"]))
    return F.transform(F.reverse(free), lambda x: x["item"]["item"]["span"])


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` spans and voted ``candidates`` (base and further)."""
    t = F.coalesce(F.col(text), F.lit(""))
    cols = {f"__{k}": _spans(t, k) for k in KINDS}
    found = docs.withColumns(cols)
    found = found.withColumn("__base", F.concat(*[F.col(f"__{k}") for k in BASE_KINDS])).withColumn("__more", F.concat(*[F.col(f"__{k}") for k in EXTRA]))
    found = found.withColumn("__extra", F.when(F.size("__more") > 0, _apart_from(F.col("__more"), F.col("__base"))).otherwise(F.col("__more")))
    voted = F.transform(F.concat("__base", "__extra"), _voted)
    base = F.transform("__base", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "match")]))
    return found.withColumn("candidates", voted).withColumn("base", base).drop(*cols, "__base", "__more", "__extra")


def _by_kind(kind: Column, of, default: Column) -> Column:
    out = default
    for k in KINDS:
        out = F.when(kind == k, of(k)).otherwise(out)
    return out


def _voted(s: Column) -> Column:
    """A span with its votes (1 for, 0 against, -1 abstains) and features."""
    kind, match, before, after = s["kind"], s["match"], s["before"], s["after"]
    near = F.concat(before, F.lit(" "), after)
    digits = _digits(match)
    n = F.length(digits)
    fits = lambda ok: F.when(ok, 1).otherwise(0)
    strict = _by_kind(kind, lambda k: fits(digits.rlike(DIAL_PLANS)) if k == "phone" else fits(digits.rlike(CARD_PLANS)) if k == "card" else
                      F.when(match.rlike(RESERVED_IP), 0).otherwise(1) if k == "ip" else fits(match.rlike("^[A-Za-z0-9]")) if k == "email" else
                      fits(digits.rlike("^[2-9][0-9]{2}[2-9]")) if k == "phone_local" else
                      fits(match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")) if k == "ssn" else
                      fits((n >= 10) & match.rlike("^(?:DE|FR|ES|IT|NL|BE|AT|CH|GB|IE|LU|PT|PL|SE|DK|FI|NO)")) if k == "account" else F.lit(-1), F.lit(-1))
    ending = F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1))
    gazetteer = _by_kind(kind, lambda k: fits(ending.isin(*MAIL_ENDS)) if k.startswith("email") else F.lit(1) if k == "name" else F.lit(-1), F.lit(-1))
    hinted = _by_kind(kind, lambda k: near.rlike(HINTS[LIKE.get(k, k)]), F.lit(False))
    context = F.when(before.rlike(AGAINST + r"[^A-Za-z]*$"), 0).when(hinted, 1).otherwise(-1)
    label = F.when(_by_kind(kind, lambda k: before.rlike(LABELS[LIKE.get(k, k)] + r"[\s.:=#(]{1,3}$"), F.lit(False)), 1).otherwise(-1)
    shape = F.when(digits.rlike(DULL_DIGITS), 0).when(match.rlike("[0-9]") & near.rlike(r"[0-9][.,:/-]?\s?$|[=+*/^%#]\s?$"), 0).otherwise(-1)
    votes = {"pattern": strict, "gazetteer": gazetteer, "context": context, "label": label, "shape": shape}
    return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *[v.cast("int").alias(name) for name, v in votes.items()],
                    F.least(n, F.lit(20)).cast("int").alias("digits"), before.rlike(r"(?:^|\s)$").alias("open"), after.rlike(r"^(?:[\s.,;:!?)]|$)").alias("shut"))


@dataclass
class LabelModel:
    """P(personal) per kind, and for each labeler how often it votes for personal and for other spans."""
    prior: dict[str, float] = field(default_factory=dict)
    right: dict[str, tuple[float, float]] = field(default_factory=dict)

    def posterior(self, kind: str, votes: tuple[int, ...]) -> float:
        p = self.prior.get(kind, 0.5)
        a, b = p, 1 - p
        for name, v in zip(LABELERS, votes):
            if v >= 0:
                yes, no = self.right.get(name, (0.7, 0.3))
                a *= yes if v else 1 - yes
                b *= no if v else 1 - no
        return a / (a + b)


def expectation_maximisation(counts: dict[tuple, int], steps: int = EM_STEPS) -> LabelModel:
    """Reliabilities and shares from {(kind, votes): count}; counts are smoothed so that no rate is 0 or 1."""
    model = LabelModel({k: 0.5 for k, _ in counts}, {name: (0.8, 0.2) for name in LABELERS})
    for _ in range(steps):
        share = {k: [1.0, 2.0] for k, _ in counts}
        seen = {name: [[4.0, 5.0], [1.0, 5.0]] for name in LABELERS}  # [[for | personal, all], [for | other, all]]
        for (kind, votes), n in sorted(counts.items()):
            q = model.posterior(kind, votes)
            share[kind][0] += n * q
            share[kind][1] += n
            for name, v in zip(LABELERS, votes):
                if v >= 0:
                    for side, mass in ((0, n * q), (1, n * (1 - q))):
                        seen[name][side][0] += mass * v
                        seen[name][side][1] += mass
        model = LabelModel({k: a / b for k, (a, b) in share.items()}, {name: (s[0][0] / s[0][1], s[1][0] / s[1][1]) for name, s in seen.items()})
    return model


def features(kind: str, votes: tuple[int, ...], digits: int, opened: bool, shut: bool) -> list[str]:
    named = [f"{name}={v}" for name, v in zip(LABELERS, votes) if v >= 0]
    return ["bias", f"kind={kind}", f"{kind}:digits={digits}", f"open={opened}", f"shut={shut}", *named]


def fit_classifier(rows: list[tuple[list[str], float, int]], steps: int = FIT_STEPS, rate: float = 0.5, shrink: float = 1e-3) -> dict[str, float]:
    """Logistic weights from (features, posterior, count) rows, by AdaGrad on the mean log-likelihood."""
    total = sum(n for _, _, n in rows)
    weights: dict[str, float] = {}
    power: dict[str, float] = {}
    for _ in range(steps if total else 0):
        grad: dict[str, float] = {}
        for names, target, n in rows:
            z = sum(weights.get(f, 0.0) for f in names)
            pull = (target - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            for f in names:
                grad[f] = grad.get(f, 0.0) + pull
        for f, g in grad.items():
            g -= shrink * weights.get(f, 0.0)
            power[f] = power.get(f, 1e-12) + g * g
            weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(power[f])
    return weights


def fit(candidates: DataFrame) -> tuple[LabelModel, dict[str, float]]:
    """Label model and classifier from the exact counts of vote and feature patterns over all candidates."""
    each = candidates.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.*")
    rows = each.groupBy("kind", *LABELERS, "digits", "open", "shut").agg(F.count("*").alias("n")).collect()
    votes: dict[tuple, int] = {}
    for r in rows:
        key = (r.kind, tuple(r[name] for name in LABELERS))
        votes[key] = votes.get(key, 0) + r.n
    model = expectation_maximisation(votes)
    train = sorted((features(r.kind, tuple(r[name] for name in LABELERS), r.digits, r.open, r.shut),
                    model.posterior(r.kind, tuple(r[name] for name in LABELERS)), r.n) for r in rows)
    return model, fit_classifier(train)


def probability(c: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability of a candidate, as an expression."""
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for f, w in sorted(weights.items()) for x in (f, float(w))])
    names = F.array(F.lit("bias"), F.concat(F.lit("kind="), c["kind"]), F.concat(c["kind"], F.lit(":digits="), c["digits"].cast("string")),
                    F.when(c["open"], "open=True").otherwise("open=False"), F.when(c["shut"], "shut=True").otherwise("shut=False"),
                    *[F.concat(F.lit(f"{name}="), c[name].cast("string")) for name in LABELERS])
    z = F.aggregate(names, F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``spans`` (kind, start, end, probability, base or added)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = written(with_candidates(own).drop("text"), "pii-candidates")
    _, weights = fit(found)
    strict = F.transform("candidates", lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), probability(c, weights).alias("probability"),
        c["kind"].isin(*BASE_KINDS).alias("base")))
    return found.select("doc_id", "base", F.filter(strict, lambda s: s["base"] | (s["probability"] >= ACCEPT)).alias("spans"))


def n_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(
        _by_kind(s["kind"], lambda k: F.lit(KINDS.index(k)), F.lit(len(KINDS))).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
