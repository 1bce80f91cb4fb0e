"""JSON value rules over raw JSON text columns.

Canonical storage is the raw JSON text (key order kept).  A candidate is
parsed once into a struct of VARIANT fields for type tests and scalar values
(``from_json`` keeps the *last* duplicate key, as Python's ``json`` does).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hof as H
from .text import clean_text, register_sql_functions, sql_str


def vtype(v: Column) -> Column:
    """Type name of a VARIANT value (``STRING``, ``ARRAY<...>``, ``OBJECT<...>``...)."""
    return F.schema_of_variant(v)


def v_is_string(v: Column) -> Column:
    return vtype(v) == F.lit("STRING")


def v_is_array(v: Column) -> Column:
    return vtype(v).startswith("ARRAY")


def v_is_object(v: Column) -> Column:
    return vtype(v).startswith("OBJECT")


def v_string(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def clean_value(v: Column, default: Column | str = "") -> Column:
    """Value-cleaning rule on a VARIANT struct field.

    Key absent (SQL NULL) -> ``default``; JSON null -> ``''``; string ->
    strip + strip tags; any other type -> its JSON text.
    """
    d = F.lit(default) if isinstance(default, str) else default
    if not H.in_lambda():
        register_sql_functions()
        return F.coalesce(F.call_function("mise_clean_value", v), d)
    return (F.when(v.isNull(), d)
            .when(F.is_variant_null(v), F.lit(""))
            .when(v_is_string(v), clean_text(v_string(v)))
            .otherwise(F.to_json(v)))


def json_text(v: Column, raw: Column) -> Column:
    """Uniform JSON text of a value: quoted for strings, raw text otherwise.

    ``raw`` is the same field parsed as STRING (order-preserving re-serialisation
    for arrays and objects, unquoted content for strings).
    """
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("string"))
            .when(v_is_string(v), F.to_json(v))
            .otherwise(raw))


def occurrences(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal in ``text``."""
    n = len(needle)
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / n).cast("int")


# --- fixed values -----------------------------------------------------------
# A masked JSON text as strings, brackets and what stands between them.
TOKEN_RX = r'"[^"]*+"|[{}\[\]]|[^"{}\[\]]++'
COLON_RX = r"^[ \t\r\n]*:"
SCALAR_RX = r"^[ \t\r\n]*:[ \t\r\n]*([^ \t\r\n,]*)"
# ---------------------------------------------------------------------------
_SEARCH, _KEY, _VALUE, _INSIDE, _FOUND, _OVER = range(6)


def find_key_sql(raw: str, key: str) -> str:
    """JSON text of the first value under ``key`` in a JSON object's text, as a fold over its tokens.

    The state holds the open brackets, so it follows the text in pre-order: a key counts in an
    object that stands in objects and lists only, not in a list directly inside a list.
    A found value is not searched; if its object repeats the key the last one counts.
    """
    names = ("stack", "dead", "pos", "phase", "home", "start", "val")

    def state(**new: str) -> str:
        return "named_struct(" + ", ".join(f"'{n}', {new.get(n, 's.' + n)}" for n in names) + ")"

    pos = "s.pos + length(t)"
    is_key = (f"t = concat('\"', {key}, '\"') AND right(s.stack, 1) = '{{' AND s.dead = 0 "
              f"AND (s.phase = {_SEARCH} OR s.phase = {_FOUND} AND length(s.stack) = s.home)")
    scalar = _let("v", f"regexp_extract(t, {sql_str(SCALAR_RX)}, 1)", (
        f"CASE WHEN v <> '' THEN {state(pos=pos, val='v', phase=str(_FOUND))} ELSE {state(pos=pos, phase=str(_VALUE))} END"))
    after_key = (f"CASE WHEN t RLIKE {sql_str(COLON_RX)} THEN {scalar} "
                 f"ELSE {state(pos=pos, phase=f'CASE WHEN s.val IS NULL THEN {_SEARCH} ELSE {_FOUND} END')} END")
    opened = state(pos=pos, stack="concat(s.stack, t)",
                   dead="CASE WHEN s.dead = 0 AND t = '[' AND right(s.stack, 1) = '[' THEN length(s.stack) + 1 ELSE s.dead END",
                   phase=f"CASE WHEN s.phase = {_VALUE} THEN {_INSIDE} ELSE s.phase END",
                   start=f"CASE WHEN s.phase = {_VALUE} THEN s.pos ELSE s.start END")
    shorter = "length(s.stack) - 1"
    ends_value = f"s.phase = {_INSIDE} AND {shorter} = s.home"
    closed = state(pos=pos, stack=f"left(s.stack, {shorter})", dead="CASE WHEN s.dead = length(s.stack) THEN 0 ELSE s.dead END",
                   phase=f"CASE WHEN {ends_value} THEN {_FOUND} WHEN s.phase = {_FOUND} AND {shorter} < s.home THEN {_OVER} ELSE s.phase END",
                   val=f"CASE WHEN {ends_value} THEN substr({raw}, s.start + 1, s.pos - s.start + 1) ELSE s.val END")
    step = (f"CASE WHEN s.phase = {_OVER} THEN s WHEN t IN ('{{', '[') THEN {opened} WHEN t IN ('}}', ']') THEN {closed} "
            f"WHEN s.phase = {_KEY} THEN {after_key} "
            f"WHEN s.phase = {_VALUE} AND left(t, 1) = '\"' THEN {state(pos=pos, val=f'substr({raw}, s.pos + 1, length(t))', phase=str(_FOUND))} "
            f"WHEN {is_key} THEN {state(pos=pos, phase=str(_KEY), home='length(s.stack)')} ELSE {state(pos=pos)} END")
    # Escaped backslashes and quotes are masked, length for length, so that a quote always ends a string.
    masked = f"replace(replace({raw}, '\\\\\\\\', '\\u0001\\u0001'), '\\\\\"', '\\u0001\\u0001')"
    zero = f"named_struct('stack', '', 'dead', 0, 'pos', 0, 'phase', {_SEARCH}, 'home', 0, 'start', 0, 'val', CAST(NULL AS STRING))"
    val = f"aggregate(regexp_extract_all({masked}, {sql_str(TOKEN_RX)}, 0), {zero}, (s, t) -> {step}, s -> s.val)"
    # Objects and lists without the white space between their parts.
    tidy = _let("w", val, "CASE WHEN left(w, 1) IN ('{', '[') THEN from_json(concat('{\"v\":', w, '}'), 'v STRING').v ELSE nullif(w, 'null') END")
    return f"CASE WHEN ltrim({raw}) LIKE '{{%' THEN {tidy} END"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def search_key(raw: Column, key: str) -> Column:
    """JSON text of the first value under ``key`` anywhere in an object's text; NULL for none,
    for a JSON null and for texts that are no JSON object."""
    register_sql_functions()
    return F.call_function("mise_find_key", F.when(is_whole_json(raw), raw), F.lit(key))


def find_key_first(raw: Column, key: str, top_v: Column, top_raw: Column) -> Column:
    """JSON text of the first value under ``key`` anywhere in ``raw`` (pre-order).

    Where the quoted key does not occur, or occurs once and the top level holds it, the parsed
    top-level field is the answer; other texts (several occurrences, or nested only) are searched.
    """
    n = occurrences(raw, json.dumps(key))
    return (F.when(n == 0, F.lit(None).cast("string"))
            .when((n == 1) & top_v.isNotNull(), json_text(top_v, top_raw))
            .otherwise(search_key(raw, key)))


def first_typed_element(list_text: Column, type_value: str = "Recipe") -> Column:
    """Raw text of the first array element whose ``@type`` equals ``type_value``.

    Elements without ``@type`` (or not objects) simply do not match.
    """
    elems = F.from_json(list_text, "array<string>")
    typ = lambda e: F.from_json(e, "struct<`@type`: string>").getField("@type")
    return F.get(H.filter(elems, lambda e: typ(e) == F.lit(type_value)), 0)


def is_whole_json(t: Column) -> Column:
    """The text is exactly one JSON value (surrounding whitespace allowed).

    Spark's JSON readers stop after the first value and ignore what follows;
    inside ``[`` ... ``]`` any trailing text becomes a syntax error instead.
    """
    return F.coalesce(F.size(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")) == 1,
                      F.lit(False))


def json_list_items(t: Column) -> Column:
    """Elements of a JSON list text as strings (objects stay JSON text)."""
    return F.from_json(t, "array<string>")


def json_unquote(t: Column) -> Column:
    """Content of a JSON string text."""
    return F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 0)
