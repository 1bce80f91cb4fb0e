"""Text column functions: tag stripping, whitespace, times, file names.

All functions map Column -> Column and stay inside whole-stage codegen
(regexp_replace / replace / translate / when), so they run JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .hof import in_lambda

# --- fixed values -----------------------------------------------------------
# Python's Unicode whitespace set (str.isspace / re \s), as a Java regex class.
# Java's \s is ASCII-only and (?U)\s misses U+001C..U+001F, so it is spelled out.
# Single characters below U+0100 are one table lookup in Java, ranges a call each; the
# characters beyond are asked for inside one range only.
WS_LATIN = r"\x{9}\x{a}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}"
_BEYOND = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_BEYOND = rf"[\x{{1680}}-\x{{3000}}&&[{_BEYOND}]]"
WS_CLASS = f"[{WS_LATIN}{WS_BEYOND}]"

# Tag-stripping steps, applied in this order (fixed values that decide the output): what a
# text must hold for a step to change it (any of these literals, and a match of the
# expression where there is one), and the step's replacements ("lit" literal, "re" regex),
# one after the other.  No replacement of a step makes what another one of it looks for.
NOT_ASCII = None
ENTITY_RX = r"&(?:nbsp|#8217|#39|frac(?:14|12|34|13|23));"
STRIP_TAGS_HEAD = [
    (["\u2019", "\u00a0"], None, [("lit", "\u2019", "'"), ("lit", "\u00a0", " ")]),
    (["<"], None, [("re", "<[^>]*>", "")]),  # drop tags
    (["&"], ENTITY_RX, [("lit", "&nbsp;", " "), ("lit", "&#8217;", "'"), ("lit", "&#39;", "'"),
                        ("lit", "&frac14;", "1/4"), ("lit", "&frac12;", "1/2"), ("lit", "&frac34;", "3/4"),
                        ("lit", "&frac13;", "1/3"), ("lit", "&frac23;", "2/3")]),
    (NOT_ASCII, "[¼½¾⅓⅔\u00c2]", [("lit", "¼", " 1/4"), ("lit", "½", " 1/2"), ("lit", "¾", " 3/4"),
                                  ("lit", "⅓", " 1/3"), ("lit", "⅔", " 2/3"), ("lit", "\u00c2", " ")]),
    (["\t", "\r"], None, [("lit", "\t", " "), ("lit", "\r", "")]),  # TAB -> space, CR dropped
]
STRIP_TAGS_NEWLINE = [(["\n"], None, [("lit", "\n", " ")])]
# The last: every whitespace run is one ASCII space (a run that is one already stays).
STRIP_TAGS_TAIL = [([" // "], None, [("lit", " // ", " / ")]), (["))"], None, [("lit", "))", ")")]),
                   (["(("], None, [("lit", "((", "(")]),
                   ([], None, [("re", f"[{WS_LATIN.replace(chr(92) + 'x{20}', '')}{WS_BEYOND}]{WS_CLASS}*| {WS_CLASS}+", " ")])]
# A text without a match, and without a blank at either end, comes out as it is.
UNTIDY_RX = (f"[<¼½¾\u00c2{WS_LATIN.replace(chr(92) + 'x{20}', '')}" + rf"[\x{{1680}}-\x{{3000}}&&[\u2019⅓⅔{_BEYOND}]]]"
             rf"|([ ()/])\1|{ENTITY_RX}")
# Printable characters below U+0100 that no rule is about, but for doubled brackets and slashes.  Each is spelled
# out (see above).  Words of them between single blanks are looked at in one run, much
# cheaper than the search above.
PLAIN_CHARS = "".join(rf"\x{{{c:x}}}" for c in (*range(0x21, 0x7f), *range(0xa1, 0x100)) if chr(c) not in "<&\u00bc\u00bd\u00be\u00c2")
PLAIN_RX = rf"^[{PLAIN_CHARS}]*(?: [{PLAIN_CHARS}]+)*+\z"
DOUBLED = ["((", "))", "//"]
# ---------------------------------------------------------------------------


def _steps(strip_newline: bool) -> list:
    return STRIP_TAGS_HEAD + (STRIP_TAGS_NEWLINE if strip_newline else []) + STRIP_TAGS_TAIL


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _step(t: Column, literals: list | None, rx: str | None, rules: list) -> Column:
    new = t
    for kind, a, b in rules:
        new = F.replace(new, F.lit(a), F.lit(b)) if kind == "lit" else F.regexp_replace(new, a, b)
    if literals == []:
        return new
    held = F.octet_length(t) > F.char_length(t) if literals is NOT_ASCII else F.contains(t, F.lit(literals[0]))
    for other in (literals or [])[1:]:
        held = held | F.contains(t, F.lit(other))
    return F.when(held if rx is None else held & t.rlike(rx), new).otherwise(t)


def _expanded_strip(t: Column) -> Column:
    ends = F.left(t, F.lit(1)).rlike(WS_CLASS) | F.right(t, F.lit(1)).rlike(WS_CLASS)
    return F.when(ends, F.regexp_replace(t, f"^{WS_CLASS}+|{WS_CLASS}+$", "")).otherwise(t)


def _expanded_strip_tags(col: Column, strip_newline: bool, strip_first: bool = False) -> Column:
    def tidied(t: Column) -> Column:
        out = _expanded_strip(t) if strip_first else t
        for step in _steps(strip_newline):
            out = _let(out, (lambda step: lambda v: _step(v, *step))(step))
        # Every whitespace run is one ASCII space now, so the final strip only has to drop spaces.
        return F.trim(out)
    def plain(t: Column) -> Column:
        out = t.rlike(PLAIN_RX) & ~t.startswith(" ")
        for double in DOUBLED:
            out = out & ~F.contains(t, F.lit(double))
        return out
    return _let(col, lambda t: F.when(plain(t), t).when(t.rlike(UNTIDY_RX) | t.startswith(" ") | t.endswith(" "), tidied(t)).otherwise(t))


# ------------------------------------------------ session SQL functions
# The same rules as SQL text.  A rule chain is ~25 expressions; building it
# through the DataFrame API costs one driver->JVM call per node at every use,
# while a SQL function is one call and the analyzer inlines its body (the
# plan and the generated code are the same as the expanded form).

def sql_str(v: str) -> str:
    """A Spark SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") \
        .replace("\r", "\\r").replace("\t", "\\t") + "'"


def _let_sql(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _step_sql(t: str, literals: list | None, rx: str | None, rules: list) -> str:
    new = t
    for kind, a, b in rules:
        new = f"{'replace' if kind == 'lit' else 'regexp_replace'}({new}, {sql_str(a)}, {sql_str(b)})"
    if literals == []:
        return new
    held = f"octet_length({t}) > length({t})" if literals is NOT_ASCII else " OR ".join(f"contains({t}, {sql_str(x)})" for x in literals)
    return f"CASE WHEN ({held}){'' if rx is None else f' AND {t} RLIKE {sql_str(rx)}'} THEN {new} ELSE {t} END"


def _py_strip_sql(x: str) -> str:
    ws = sql_str(WS_CLASS)
    return _let_sql("sp", x, f"CASE WHEN left(sp, 1) RLIKE {ws} OR right(sp, 1) RLIKE {ws} "
                             f"THEN regexp_replace(sp, {sql_str(f'^{WS_CLASS}+|{WS_CLASS}+$')}, '') ELSE sp END")


def _strip_tags_sql(x: str, strip_newline: bool, strip_first: bool = False) -> str:
    out = _py_strip_sql("st") if strip_first else "st"
    for step in _steps(strip_newline):
        out = _let_sql("sv", out, _step_sql("sv", *step))
    plain = f"st RLIKE {sql_str(PLAIN_RX)} AND NOT startswith(st, ' ')" + "".join(f" AND NOT contains(st, {sql_str(d)})" for d in DOUBLED)
    return _let_sql("st", x, f"CASE WHEN {plain} THEN st WHEN st RLIKE {sql_str(UNTIDY_RX)} OR startswith(st, ' ') OR endswith(st, ' ') THEN trim({out}) ELSE st END")


def _iso_minutes_sql(s: str) -> str:
    # In DOUBLE, where no product or sum can overflow; minutes beyond INT count as 0.
    def num(i: int) -> str:
        return f"coalesce(try_cast(nullif(regexp_extract({s}, {sql_str(ISO_DURATION_RX)}, {i}), '') AS DOUBLE), 0D)"
    total = f"({num(1)} * 86400 + {num(2)} * 3600 + {num(3)} * 60 + {num(4)})"
    return f"coalesce(try_cast(floor({total} / 60) AS INT), 0)"


def _minutes_text_sql(m: str, d: str) -> str:
    h = f"floor({m} / 60)"
    r = f"({m} - {h} * 60)"
    return (f"CASE WHEN {m} > 0 THEN concat("
            f"CASE WHEN {h} > 1 THEN concat(CAST({h} AS STRING), ' hours ') WHEN {h} = 1 THEN '1 hour ' ELSE '' END, "
            f"CASE WHEN {r} > 1 THEN concat(CAST({r} AS STRING), ' minutes') WHEN {r} = 1 THEN '1 minute' ELSE '' END)"
            f" ELSE {d} END")


def _sql_functions() -> dict[str, tuple[str, str, str]]:
    from .jsonkeys import find_key_sql
    from .wrapping import wrapped_groups_sql

    return {
        "mise_find_key": ("raw STRING, ky STRING", "STRING", find_key_sql("raw", "ky")),
        "mise_wrap_groups": ("grs ARRAY<ARRAY<STRING>>, md STRING, bl STRING, af BOOLEAN", "STRING",
                             wrapped_groups_sql("grs", "md", "bl", "af")),
        "mise_py_strip": ("x STRING", "STRING", _py_strip_sql("x")),
        "mise_strip_tags": ("x STRING", "STRING", _strip_tags_sql("x", False)),
        "mise_strip_tags_nl": ("x STRING", "STRING", _strip_tags_sql("x", True)),
        "mise_clean_text": ("x STRING", "STRING", _strip_tags_sql("x", False, True)),
        "mise_clean_text_nl": ("x STRING", "STRING", _strip_tags_sql("x", True, True)),
        "mise_iso_minutes_of": ("s STRING", "INT", _iso_minutes_sql("s")),
        "mise_minutes_text": ("m BIGINT, d STRING", "STRING", _minutes_text_sql("m", "d")),
        # Value-cleaning rule on a VARIANT field; NULL (key absent) is left to the caller's default.
        "mise_clean_value": ("v VARIANT", "STRING",
                             "CASE WHEN v IS NULL THEN NULL WHEN is_variant_null(v) THEN '' "
                             "WHEN schema_of_variant(v) = 'STRING' THEN "
                             + _strip_tags_sql("try_variant_get(v, '$', 'string')", False, True)
                             + " ELSE to_json(v) END"),
    }


_REGISTERED: set[int] = set()


def register_sql_functions(spark: SparkSession | None = None) -> None:
    """Create the package's temporary SQL functions in ``spark`` (once)."""
    spark = spark or SparkSession.getActiveSession()
    key = spark._jsparkSession.hashCode()
    if key in _REGISTERED:
        return
    for name, (params, ret, body) in _sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    _REGISTERED.add(key)


def _call(name: str, *cols: Column) -> Column:
    register_sql_functions()
    return F.call_function(name, *cols)


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    if in_lambda():
        return _let(col, _expanded_strip)
    return _call("mise_py_strip", col)


def strip_tags(col: Column, strip_newline: bool = False) -> Column:
    """Remove markup and normalise entities, fractions and whitespace.

    The rules run in the order of the fixed table above; a final collapse of
    whitespace runs and a strip.  ``&amp;``/``&lt;``/``&quot;`` are kept as is.
    """
    if in_lambda():
        return _expanded_strip_tags(col, strip_newline)
    return _call("mise_strip_tags_nl" if strip_newline else "mise_strip_tags", col)


def clean_text(col: Column, strip_newline: bool = False) -> Column:
    """String branch of the value-cleaning rule: strip, then strip tags."""
    if in_lambda():
        return _expanded_strip_tags(col, strip_newline, strip_first=True)
    return _call("mise_clean_text_nl" if strip_newline else "mise_clean_text", col)


def leaf_text(col: Column) -> Column:
    """DOM leaf text cleanup: newlines deleted (not spaced), then stripped."""
    return py_strip(F.translate(col, "\n", ""))


def minutes_text(minutes: Column, default: str = "TBD") -> Column:
    """Human time text: ``1 hour ``, ``2 hours 5 minutes``, ``1 minute``.

    Exact hours keep a trailing space; ``minutes <= 0`` (or NULL) gives ``default``.
    """
    if not in_lambda():
        return _call("mise_minutes_text", minutes.cast("bigint"), F.lit(default))
    m = minutes.cast("bigint")
    h = F.floor(m / 60).cast("bigint")
    r = m - h * 60
    hours = F.when(h > 1, F.concat(h.cast("string"), F.lit(" hours "))) \
             .when(h == 1, F.lit("1 hour ")).otherwise(F.lit(""))
    mins = F.when(r > 1, F.concat(r.cast("string"), F.lit(" minutes"))) \
            .when(r == 1, F.lit("1 minute")).otherwise(F.lit(""))
    return F.when(m > 0, F.concat(hours, mins)).otherwise(F.lit(default))


# ISO-8601 duration P[nD][T[nH][nM][nS]]; anything else counts as 0 minutes.
ISO_DURATION_RX = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def iso_minutes(col: Column) -> Column:
    """Whole minutes of an ISO-8601 duration text; 0 when empty or not a duration."""
    s = F.coalesce(py_strip(col), F.lit(""))
    if not in_lambda():
        return _call("mise_iso_minutes_of", s)

    def num(i: int) -> Column:
        g = F.regexp_extract(s, ISO_DURATION_RX, i)
        return F.coalesce(F.nullif(g, F.lit("")).try_cast("double"), F.lit(0.0))

    total_s = num(1) * 86400 + num(2) * 3600 + num(3) * 60 + num(4)
    return F.coalesce(F.floor(total_s / 60).try_cast("int"), F.lit(0))


def add_minutes(a: Column, b: Column) -> Column:
    """Sum of minutes; 0 where it is beyond INT."""
    return F.coalesce(F.try_add(a, b), F.lit(0))


# --- fixed values -----------------------------------------------------------
# Unicode "word" characters for file names: letters, numbers and underscore
# (Python's \w on str; Java's \W alone is ASCII-only).
NON_WORD_RX = r"[^\p{L}\p{N}_]+"
# ---------------------------------------------------------------------------


def output_filename(base: Column, ext: str | Column) -> Column:
    """``base + '.' + ext`` with a doubled ``.ext.ext`` collapsed to ``.ext``."""
    e = F.lit(ext) if isinstance(ext, str) else ext
    dot_ext = F.concat(F.lit("."), e)
    return F.replace(F.concat(base, dot_ext), F.concat(dot_ext, dot_ext), dot_ext)


def title_filename(title: Column, ext: str | Column) -> Column:
    """File name of a rendered recipe: title without non-word runs, plus extension."""
    return output_filename(F.regexp_replace(title, NON_WORD_RX, ""), ext)
