"""DuckDB SQL text for the rules, used by the correctness oracle.

These build *independent* expressions in DuckDB's dialect (RE2 regexes,
``lambda x: ...`` list functions) for the same rules the Spark library
implements, so the driver can compare the two engines value by value.
"""

from __future__ import annotations

# Fixed values, written out here on their own: a wrong entry in the library's
# tables shows as a difference instead of passing on both sides.
BEFORE_TAGS = [("\u2019", "'"), ("\u00a0", " ")]
AFTER_TAGS = [("&nbsp;", " "), ("&#8217;", "'"), ("&#39;", "'"), ("&frac14;", "1/4"), ("&frac12;", "1/2"), ("&frac34;", "3/4"),
              ("&frac13;", "1/3"), ("&frac23;", "2/3"), ("\u00bc", " 1/4"), ("\u00bd", " 1/2"), ("\u00be", " 3/4"),
              ("\u2153", " 1/3"), ("\u2154", " 2/3"), ("\u00c2", " "), ("\t", " "), ("\r", "")]
LAST = [(" // ", " / "), ("))", ")"), ("((", "(")]
PUBLISHER_OF = {
    "www.americastestkitchen.com": "America's Test Kitchen", "www.cookscountry.com": "Cook's Country",
    "www.cooksillustrated.com": "Cook's Illustrated", "www.epicurious.com": "Epicurious", "www.bonappetit.com": "Bon Appetit",
    "www.foodnetwork.com": "Food Network", "cooking.nytimes.com": "New York Times", "www.food.com": "Food.com",
    "www.saveur.com": "Saveur", "www.thecookingguy.com": "Sam the Cooking Guy (Sam Zien)",
    "www.thechunkychef.com": "The Chunky Chef", "www.allrecipes.com": "AllRecipes",
}
ROUTE_OF = {
    "www.americastestkitchen.com": "next_data", "www.cookscountry.com": "next_data", "www.cooksillustrated.com": "next_data",
    "www.epicurious.com": "inline_store", "www.saveur.com": "dom_saveur", "www.thecookingguy.com": "dom_squarespace",
}

WS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def lit(s: str) -> str:
    """A DuckDB string literal; control characters spelled with chr()."""
    parts, buf = [], ""
    for ch in s:
        if ord(ch) < 32:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def replaced(e: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        e = f"replace({e}, {lit(old)}, {lit(new)})"
    return e


def py_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def strip_tags(e: str, strip_newline: bool = False) -> str:
    e = f"regexp_replace({replaced(e, BEFORE_TAGS)}, '<[^>]*>', '', 'g')"
    e = replaced(e, AFTER_TAGS)
    if strip_newline:
        e = f"replace({e}, chr(10), ' ')"
    e = replaced(e, LAST)
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'), ' ')"


def clean_text(e: str, strip_newline: bool = False) -> str:
    return strip_tags(py_strip(e), strip_newline)


def leaf_text(e: str) -> str:
    return py_strip(f"replace({e}, chr(10), '')")


def minutes_text(m: str, default: str = "TBD") -> str:
    h, r = f"(({m}) // 60)", f"(({m}) % 60)"
    return (f"(CASE WHEN ({m}) > 0 THEN "
            f"(CASE WHEN {h} > 1 THEN CAST({h} AS VARCHAR) || ' hours ' WHEN {h} = 1 THEN '1 hour ' ELSE '' END) || "
            f"(CASE WHEN {r} > 1 THEN CAST({r} AS VARCHAR) || ' minutes' WHEN {r} = 1 THEN '1 minute' ELSE '' END) "
            f"ELSE {lit(default)} END)")


def url_domain(e: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({e}, '{WS}+$', ''), '[^/]*//', '', 'g'), "
            f"'/[^\\n]*$', '')")


def pick(key: str, values: list[str]) -> str:
    arr = "[" + ", ".join(lit(v) for v in values) + "]"
    return f"({arr})[(({key}) % {len(values)}) + 1]"


def _case(e: str, table: dict[str, str], other: str) -> str:
    whens = " ".join(f"WHEN {e} = {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"(CASE {whens} ELSE {lit(other)} END)"


def publisher(domain: str) -> str:
    return _case(domain, PUBLISHER_OF, "")


def route(domain: str) -> str:
    return _case(domain, ROUTE_OF, "ldjson")


def author_rule(author: str, pub: str) -> str:
    return (f"(CASE WHEN {pub} <> '' AND {author} <> '' AND {author} <> {pub} AND NOT contains({author}, {pub}) "
            f"THEN {pub} || ' (' || {author} || ')' ELSE {author} END)")


# Where a word may be divided; U+0001 marks the places (RE2 has no look-around, so each rule runs twice).
_LT, _WP, _WD = r"[\p{L}\p{Nl}\p{No}_]", r"""[\p{L}\p{N}_!"''&.,?]""", r"[\p{L}\p{N}_]"
_DIVISIONS = [(f"({_LT}{_LT}-)({_LT}-?{_LT})", "\\1\x01\\2")] * 2 + [(f"({_LT}-{_WP}-)({_LT}-?{_LT})", "\\1\x01\\2")] * 2 + \
             [(f"({_WP})(-{{2,}})({_WD})", "\\1\x01\\2\x01\\3")] * 2


def divided(e: str) -> str:
    """The text with white space as blanks and a mark wherever a hyphenated word may be divided."""
    e = f"regexp_replace({e}, '[\\t\\n\\x0B\\f\\r]', ' ', 'g')"
    for pattern, to in _DIVISIONS:
        e = f"regexp_replace({e}, '{pattern}', {lit(to)}, 'g')"
    return e


def wrapped_ctes(src: str, out: str, width: int = 75) -> str:
    """CTEs that wrap ``src(wid, x, p)``: text x after prefix p; ``out(wid, body)`` has the lines of each.

    Chunks have running ends; the line that begins at a chunk reaches to the last chunk which
    ends within the width.  Lines follow from line to line, a blank chunk between them goes.
    (Words longer than a line, and tabs, do not occur in the given tables.)
    """
    return f"""{out}_c AS (
  SELECT wid, width, i, ch, ch[1] = ' ' AS blank, length(ch) AS n, sum(length(ch)) OVER (PARTITION BY wid ORDER BY i) AS upto
  FROM (SELECT wid, {width} - length(p) AS width, unnest(chs) AS ch, unnest(range(1, len(chs) + 1)) AS i
        FROM (SELECT wid, p, regexp_extract_all({divided('x')}, ' +|[^ \x01]+') AS chs FROM {src}))),
{out}_l AS MATERIALIZED (SELECT *, max(i) OVER (PARTITION BY wid ORDER BY upto RANGE BETWEEN CURRENT ROW AND (width - n) FOLLOWING) AS stop FROM {out}_c),
{out}_n AS MATERIALIZED (SELECT a.wid, a.i, a.stop, CASE WHEN b.blank THEN a.stop + 2 ELSE a.stop + 1 END AS following
           FROM {out}_l AS a LEFT JOIN {out}_l AS b ON b.wid = a.wid AND b.i = a.stop + 1),
{out}_s AS (SELECT wid, i, stop, following FROM {out}_n WHERE i = 1
            UNION ALL SELECT n.wid, n.i, n.stop, n.following FROM {out}_s AS s JOIN {out}_n AS n ON n.wid = s.wid AND n.i = s.following),
{out}_t AS (SELECT c.wid, s.i AS line, string_agg(CASE WHEN c.blank AND c.i = s.stop THEN '' ELSE c.ch END, '' ORDER BY c.i) AS text
            FROM {out}_l AS c ASOF JOIN {out}_s AS s ON c.wid = s.wid AND c.i >= s.i WHERE c.i <= s.stop GROUP BY ALL),
{out} AS (SELECT t.wid, string_agg((CASE WHEN line = 1 THEN p ELSE repeat(' ', length(p)) END) || text || chr(10), '' ORDER BY line) AS body
          FROM {out}_t AS t JOIN {src} AS x ON x.wid = t.wid WHERE text <> '' GROUP BY ALL)"""


def json_text(e: str) -> str:
    """A JSON string in ASCII."""
    unit = ("CASE WHEN regexp_matches(c, '^[ -~]') THEN c WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c)) "
            "ELSE printf('\\u%04x\\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END")
    return f"array_to_string([{unit} for c in regexp_extract_all(to_json({e})::VARCHAR, '[ -~]+|[^ -~]')], '')"


def json_list(items: str, level: int) -> str:
    """A list of JSON texts, indented by four at ``level``."""
    pad, outer = "chr(10) || '" + " " * (4 * (level + 1)) + "'", "chr(10) || '" + " " * (4 * level) + "'"
    return f"(CASE WHEN len({items}) = 0 THEN '[]' ELSE '[' || {pad} || array_to_string({items}, ',' || {pad}) || {outer} || ']' END)"
