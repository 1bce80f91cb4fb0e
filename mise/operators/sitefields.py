"""Fields of site pages, for the Arrow UDF of ``sites``.

The texts of a next-data or inline-store page come from one parse of its JSON and the text
rules as plain string methods, several times cheaper than the same rules as interpreted
expressions.  Only regular pages are read here: strict JSON without repeated keys, strings where texts
are expected.  Any other page comes back as not ``plain``, for the expressions in ``sites``, which
define the result; ``tests/test_site_fields.py`` compares the two.  DOM pages are always read here.
"""

from __future__ import annotations

import json
import re

# --- fixed values -----------------------------------------------------------
# Longest page that is read here; what JSON readers bound (text, name, number, depth) lies above or is asked for.
MAX_BYTES = 4 << 20
MAX_NAME, MAX_NUMBER, MAX_DEPTH = 40_000, 900, 900
NEXT_DATA_TAG_RX = re.compile(rb"""(?is)<script[^>]*\bid=["']?__NEXT_DATA__["']?[^>]*>\Z""")
NEXT_DATA_PATH = ("props", "initialState", "content", "documents")
JSON_STRING_RX = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
SURROGATE_RX = re.compile(r"\\u[dD][89a-fA-F]")
PAIR_RX = re.compile(r"\\u[dD][89abAB]..\\u[dD][c-fC-F]..")
# Characters beyond ASCII, other than white space, that the text rules change.
REWRITTEN_RX = re.compile("[’¼½¾⅓⅔Â]")
TAG_RX = re.compile("<[^>]*>")
ENTITIES = [("&nbsp;", " "), ("&#8217;", "'"), ("&#39;", "'"), ("&frac14;", "1/4"), ("&frac12;", "1/2"), ("&frac34;", "3/4"),
            ("&frac13;", "1/3"), ("&frac23;", "2/3")]
FRACTIONS = [("¼", " 1/4"), ("½", " 1/2"), ("¾", " 3/4"), ("⅓", " 1/3"), ("⅔", " 2/3"), ("Â", " ")]
# ---------------------------------------------------------------------------


class Irregular(ValueError):
    """A page for the expressions."""


# ---------------------------------------------------------------- text rules
def tidy(t: str) -> bool:
    """No rule changes the text (other texts may be tidy too)."""
    return (t.isprintable() and "  " not in t and t[:1] != " " and t[-1:] != " " and "<" not in t and "&" not in t
            and "((" not in t and "))" not in t and " // " not in t and (t.isascii() or not REWRITTEN_RX.search(t)))


def strip_tags(t: str, newline: bool = False) -> str:
    """``functions.text.strip_tags`` of a string."""
    if tidy(t):
        return t
    if not t.isascii():
        t = t.replace("\u2019", "'").replace("\u00a0", " ")
    if "<" in t:
        t = TAG_RX.sub("", t)
    if "&" in t:
        for old, new in ENTITIES:
            t = t.replace(old, new)
    if not t.isascii():
        for old, new in FRACTIONS:
            t = t.replace(old, new)
    t = t.replace("\t", " ").replace("\r", "")
    if newline:
        t = t.replace("\n", " ")
    # All white space runs are one blank at the end, none at the ends.
    return " ".join(t.replace(" // ", " / ").replace("))", ")").replace("((", "(").split())


def clean_text(t: str) -> str:
    """``functions.text.clean_text`` of a string."""
    return t if tidy(t) else strip_tags(t.strip())


def cleaned_twice(t: str, newline: bool = False) -> str:
    return t if tidy(t) else strip_tags(strip_tags(t.strip()), newline)


# ---------------------------------------------------------------------- JSON
def _object(pairs: list) -> dict:
    d = dict(pairs)
    if len(d) != len(pairs):
        raise Irregular("repeated key")
    return d


def _named_object(pairs: list) -> dict:
    if any(len(k) > MAX_NAME for k, _ in pairs):
        raise Irregular("long name")
    return _object(pairs)


def _number(digits: str) -> float:
    if len(digits) > MAX_NUMBER:
        raise Irregular("long number")
    return 0.0


def _constant(name: str):
    raise Irregular(name)


def _deep(text: str) -> bool:
    depth = 0
    for c in re.findall(r"[\[{\]}]", JSON_STRING_RX.sub("", text)):
        depth += 1 if c in "[{" else -1
        if depth > MAX_DEPTH:
            return True
    return False


def parsed(text: str):
    """The value of a strict JSON text; numbers are not kept."""
    if "\\u" in text and SURROGATE_RX.search(text) and ("\\\\" in text or SURROGATE_RX.search(PAIR_RX.sub("", text))):
        raise Irregular("half of a character, for all that is looked at")
    if text.count("[") + text.count("{") > MAX_DEPTH and _deep(text):
        raise Irregular("deep")
    return json.loads(text, object_pairs_hook=_named_object if len(text) > MAX_NAME else _object,
                      parse_float=_number, parse_int=_number, parse_constant=_constant)


def _sub(d: dict, key: str) -> dict:
    v = d.get(key)
    if v is None:
        return {}
    if type(v) is not dict:
        raise Irregular(key)
    return v


def _text(d: dict, key: str) -> str:
    v = d.get(key)
    if v is None:
        return ""
    if type(v) is not str:
        raise Irregular(key)
    return v


def _objects(d: dict, key: str) -> list[dict]:
    v = d.get(key)
    if v is None:
        return []
    if type(v) is not list or any(type(x) is not dict for x in v):
        raise Irregular(key)
    return v


def _scripts(html: bytes, low: bytes):
    """(start, tag's end, body's end) of the page's script elements."""
    at = 0
    while (start := low.find(b"<script", at)) >= 0:
        body = low.find(b">", start + 7) + 1
        end = low.find(b"</script>", body)
        if not body or end < 0:
            return
        yield start, body, end
        at = end + 9


def next_data_fields(html: bytes) -> dict:
    low = html.lower()
    at = low.find(b"__next_data__")
    if at < 0:
        raise Irregular("no document")
    # The first tag that fits; none that ends before the name's first place does.
    start = 0
    while (start := low.find(b"<script", start)) >= 0:
        body = low.find(b">", start + 7) + 1
        if not body:
            raise Irregular("no document")
        if body > at and NEXT_DATA_TAG_RX.match(html, start, body):
            break
        start += 7
    end = low.find(b"</script>", body) if start >= 0 else -1
    if end < 0 or not html[start:body].isascii():
        raise Irregular("no document")
    docs = parsed(html[body:end].decode())
    for key in NEXT_DATA_PATH:
        if type(docs) is not dict or type(docs := docs.get(key)) is not dict:
            raise Irregular(key)
    doc = next(iter(docs.values()), None)
    if type(doc) is not dict:
        raise Irregular("document")
    meta, titles, lists = _sub(_sub(doc, "metaData"), "fields"), [], []
    for group in _objects(doc, "ingredientGroups"):
        g = _sub(group, "fields")
        lines = []
        for it in _objects(g, "recipeIngredientItems"):
            f = _sub(it, "fields")
            item = clean_text(_text(_sub(_sub(f, "ingredient"), "fields"), "title"))
            lines.append(strip_tags(f"{clean_text(_text(f, 'qty'))} {clean_text(_text(f, 'preText'))} {item}{clean_text(_text(f, 'postText'))}", True))
        titles.append(clean_text(_text(g, "title")))
        lists.append(lines)
    return {"plain": True, "title": clean_text(_text(doc, "title")), "description": cleaned_twice(_text(meta, "description"), True),
            "yield": clean_text(_text(doc, "yields")), "note": clean_text(_text(doc, "recipeTimeNote")), "author": clean_text(_text(meta, "source")),
            "titles": titles, "ingredients": lists,
            "directions": [[cleaned_twice(_text(_sub(s, "fields"), "content"), True) for s in _objects(doc, "instructions")]],
            "notes": cleaned_twice(_text(doc, "headnote"), True)}


def _store_author(a) -> str:
    if a is None:
        return ""
    if type(a) is str:
        return clean_text(a)
    if type(a) is list:
        if not a:
            return ""
        a = a[0]
    if type(a) is not dict:
        raise Irregular("author")
    return _text(a, "name")


def store_fields(html: bytes, marker: str, fixes: list) -> dict:
    mark, line = marker.encode(), None
    if mark in html:
        for _, body, end in _scripts(html, html.lower()):
            if html.find(mark, body, end) >= 0:
                line = [x for x in html[body:end].decode().splitlines() if marker in x][-1]
    if line is None:
        raise Irregular("no store line")
    line = line[:line.rfind("}") + 1]
    line = line[max(line.find("{"), 0):]
    for rx, new in fixes:
        line = rx.sub(new, line)
    store = parsed(line)
    content = store.get("content") if type(store) is dict else None
    if type(content) is not dict:
        raise Irregular("content")
    return {"plain": True, "title": clean_text(_text(content, "hed")), "description": cleaned_twice(_text(content, "dek")),
            "yield": clean_text(_text(_sub(content, "servingSizeInfo"), "servingSizeDescription")),
            "prep": clean_text(_text(content, "formattedPrepTime")), "cook": clean_text(_text(content, "formattedCookTime")),
            "author": _store_author(content.get("author")),
            "ingredients": [[cleaned_twice(_text(i, "description")) for i in _objects(g, "ingredients")] for g in _objects(content, "ingredientGroups")],
            "directions": [[cleaned_twice(_text(s, "description")) for s in _objects(g, "steps")] for g in _objects(content, "preparationGroups")]}
