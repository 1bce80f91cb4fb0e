"""Site-specific routes: next-data documents, inline store, and two DOM layouts.

next-data and inline store are defined by expressions (regex + JSON functions, in-row); regular
pages get the same fields from ``sitefields``, and only the others reach the expressions.  The
two DOM layouts need an HTML tree.  All of it is one Arrow-batched UDF that
receives NULL for every page of another route, so the scan is still read once.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import hof as H
from ..functions import jsonkeys as J
from ..functions.text import add_minutes, clean_text, iso_minutes, strip_tags
from . import recipes as R
from .sitefields import next_data_fields, store_fields

# --- fixed values -----------------------------------------------------------
NEXT_DATA_RX = r"""(?is)<script[^>]*\bid=["']?__NEXT_DATA__["']?[^>]*>(.*?)</script>"""
NEXT_DATA_DOCS_PATH = "$.props.initialState.content.documents"
SCRIPT_RX = r"(?is)<script[^>]*>(.*?)</script>"
STORE_MARKER = "root.__INITIAL_STATE__.store"
# Line breaks of Python's str.splitlines().
SPLITLINES_RX = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Two unparseable regex literals in the store line are blanked before parsing.
STORE_FIXES = [
    ('"email":\\{"regExp":.*,"password"', '"email":{"regExp":"","password"'),
    ('"password":\\{"regExp":.*,"messages"', '"password":{"regExp":""},"messages"'),
]
STORE_FIXES_PY = [(re.compile(pat), rep) for pat, rep in STORE_FIXES]
STORE_PUBLISHER = "Epicurious"
DOM_B_TITLE_SUFFIX = ". SAM THE COOKING GUY"
# Fields of the two DOM layouts: the path of an element, outermost step first,
# each step (tag, class, (attribute, value)).
DOM_A_FIELDS = {
    "title": [(None, "entry-title", None)],
    "description": [("div", None, ("property", "description"))],
    "yield": [("div", "yield", None), ("span", None, None)],
    "cook": [("div", "cook-time", None), ("meta", None, None)],
    "ingredients": [("li", "ingredient", None)],
    "directions": [("li", "instruction", None)],
}
DOM_B_FIELDS = {
    "title": [("title", None, None)],
    "content": [("div", "sqs-block-content", None)],
    "paragraph": [("div", "sqs-block-content", None), ("p", None, None)],
    "block": [("div", "sqs-block", None), ("div", "sqs-block-content", None)],
    "list": [("div", "sqs-block-content", None), ("ul", None, None)],
    "rte_list": [("div", "sqs-block-content", None), ("ul", None, ("data-rte-list", "default"))],
    "row_paragraph": [("div", "sqs-layout", None), ("div", "row", None), ("div", "sqs-block", None),
                      ("div", "sqs-block-content", None), ("p", None, None)],
    "item": [("li", None, None)],
}
# Elements without an end tag, and those that another start tag closes.
DOM_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
            "param", "source", "track", "wbr"}
DOM_AUTOCLOSE = {"p": {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "table"}, "li": {"li"}}
# Tags in lower case, attributes in double quotes after one blank each and without references.
PLAIN_TAG_RX = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"&<>]*")*)>')
PLAIN_ATTRIBUTE_RX = re.compile(r' ([a-z][a-z0-9-]*)="([^"&<>]*)"')
PLAIN_END_RX = re.compile(r"</([a-z][a-z0-9]*)>")
# Elements whose content is, or may be in some release of the parser, no markup.
TEXT_ELEMENTS = {"script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}
# DOM-layout pages have every em dash turned into a space before parsing.
EM_DASH = "\u2014"
# What the UDF reads: a page's kind, the longest JSON page, the rows that are Python objects at a time, the fields.
KIND_NEXT_DATA, KIND_STORE, KIND_DOM_A, KIND_DOM_B = "n", "s", "a", "b"
MAX_BYTES = 4 << 20
ROWS_AT_A_TIME = 256
FIELDS = {
    "plain": pa.bool_(), "ok": pa.bool_(), "reason": pa.string(),
    "title": pa.string(), "description": pa.string(), "yield": pa.string(), "note": pa.string(),
    "prep": pa.string(), "cook": pa.string(), "author": pa.string(), "titles": pa.list_(pa.string()),
    "ingredients": pa.list_(pa.list_(pa.string())), "directions": pa.list_(pa.list_(pa.string())), "notes": pa.string(),
}
# ---------------------------------------------------------------------------

_NEXT_DOC_DDL = (
    "struct<title: variant, yields: variant, recipeTimeNote: variant, headnote: variant, "
    "metaData: struct<fields: struct<description: variant, source: variant>>, "
    "ingredientGroups: array<struct<fields: struct<title: variant, recipeIngredientItems: "
    "array<struct<fields: struct<qty: variant, preText: variant, postText: variant, "
    "ingredient: struct<fields: struct<title: variant>>>>>>>>, "
    "instructions: array<struct<fields: struct<content: variant>>>>")

_NEXT_GROUPS_TYPE = (
    "array<struct<fields: struct<title: variant, recipeIngredientItems: array<struct<fields: "
    "struct<qty: variant, preText: variant, postText: variant, "
    "ingredient: struct<fields: struct<title: variant>>>>>>>>")

_STORE_DDL = (
    "struct<hed: variant, dek: variant, servingSizeInfo: struct<servingSizeDescription: variant>, "
    "formattedPrepTime: variant, formattedCookTime: variant, author: variant, "
    "ingredientGroups: array<struct<hed: variant, ingredients: array<struct<description: variant>>>>, "
    "preparationGroups: array<struct<hed: variant, steps: array<struct<description: variant>>>>>")

def _empty() -> Column:
    return F.array().cast("array<string>")


def _read(fields: str | None, name: str, slow: Column) -> Column:
    """A field as ``sitefields`` read it, or else from the expression."""
    if fields is None:
        return slow
    f = F.col(fields)
    return F.when(f["plain"], f[name]).otherwise(slow)


def _is_read(fields: str | None) -> Column:
    return F.lit(False) if fields is None else F.coalesce(F.col(fields)["plain"], F.lit(False))


# ----------------------------------------------------------------- next-data
def next_data_document(html: Column) -> Column:
    """Raw JSON text of the first document under props.initialState.content.documents."""
    body = F.regexp_extract(html, NEXT_DATA_RX, 1)
    docs = F.get_json_object(body, NEXT_DATA_DOCS_PATH)
    return F.get(F.map_values(F.from_json(docs, "map<string,string>")), 0)


def add_next_data_recipe(df: DataFrame, doc: str, url: str = "url", publisher: str = "publisher",
                         out: str = "_rec_nd", fields: str | None = None) -> DataFrame:
    """Add the recipe struct of a next-data document column (one parse, staged), or of its
    page's ``fields`` where those are read."""
    cv = J.clean_value
    df = df.withColumn("_ndd", F.from_json(F.col(doc), _NEXT_DOC_DDL))
    d = F.col("_ndd")
    df = df.withColumns({"_nd_note": _read(fields, "note", cv(d["recipeTimeNote"])),
                         "_nd_author": _read(fields, "author", cv(d["metaData"]["fields"]["source"])),
                         "_nd_groups": F.coalesce(d["ingredientGroups"], F.array().cast(_NEXT_GROUPS_TYPE))})
    groups = F.col("_nd_groups")

    def line(it: Column) -> Column:
        f = it["fields"]
        item = F.when(f["ingredient"].isNull(), F.lit("")).otherwise(cv(f["ingredient"]["fields"]["title"]))
        return strip_tags(F.concat(cv(f["qty"]), F.lit(" "), cv(f["preText"]), F.lit(" "),
                                   item, cv(f["postText"])), strip_newline=True)

    # Staged: the groups' titles depend on the number of lists, which would make the lists anew for each group.
    df = df.withColumns({
        "_nd_titles": _read(fields, "titles", H.transform(groups, lambda g: cv(g["fields"]["title"]))),
        "_nd_lists": _read(fields, "ingredients", H.transform(
            groups, lambda g: F.coalesce(H.transform(g["fields"]["recipeIngredientItems"], line), _empty())))})
    ingredient_groups = R.assemble_groups(F.col("_nd_titles"), F.col("_nd_lists"))
    steps = F.coalesce(H.transform(d["instructions"], lambda s: strip_tags(cv(s["fields"]["content"]), True)),
                       _empty())
    note, author = F.col("_nd_note"), F.col("_nd_author")
    rec = R.recipe_struct(
        url=F.col(url), title=_read(fields, "title", cv(d["title"])),
        description=_read(fields, "description", strip_tags(cv(d["metaData"]["fields"]["description"]), strip_newline=True)),
        **{"yield": _read(fields, "yield", cv(d["yields"]))},
        preptime=F.lit(""), cooktime=F.lit(""),
        totaltime=F.when(note == "", F.lit("TBD")).otherwise(note),
        author=F.when(author == "", F.col(publisher)).otherwise(author),
        ingredient_groups=ingredient_groups,
        direction_groups=R.single_direction_group(
            steps if fields is None else F.when(_is_read(fields), F.get(F.col(fields)["directions"], 0)).otherwise(steps)),
        notes=F.array(_read(fields, "notes", strip_tags(cv(d["headnote"]), strip_newline=True))))
    return (df.withColumn(out, F.when(F.col(doc).isNotNull() | _is_read(fields), rec))
              .drop("_ndd", "_nd_note", "_nd_author", "_nd_groups", "_nd_titles", "_nd_lists"))


# -------------------------------------------------------------- inline store
def inline_store_line(html: Column) -> Column:
    """The last store line of any script; pages without the marker are not split."""
    html = F.when(html.contains(STORE_MARKER), html)
    scripts = F.regexp_extract_all(html, F.lit(SCRIPT_RX), 1)
    lines = F.flatten(H.transform(scripts, lambda s: F.split(s, SPLITLINES_RX)))
    hits = H.filter(lines, lambda l: l.contains(STORE_MARKER))
    return F.try_element_at(hits, F.lit(-1))


def inline_store_text(line: Column) -> Column:
    """The line's JSON text, known breakages mended."""
    # Trim to the outer braces.  Up to the last '}' via the reversed string:
    # an unanchored "[^}]*$" would rescan from every position (quadratic).
    from_end = F.instr(F.reverse(line), "}")
    upto_last = F.when(from_end > 0, F.substring(line, F.lit(1), F.length(line) - from_end + 1)).otherwise(F.lit(""))
    text = F.regexp_replace(upto_last, "^[^{]*", "")
    for pat, rep in STORE_FIXES:
        text = F.regexp_replace(text, "(?d)" + pat, rep)
    return text


def inline_store_content(html: Column) -> Column:
    """Raw JSON text of ``content`` from the last store line of any script."""
    return inline_store_json(inline_store_text(inline_store_line(html)))


def add_inline_store_content(df: DataFrame, html: Column, out: str = "_store") -> DataFrame:
    """Raw JSON text of ``content``; line and text are staged, so each is computed once a page."""
    df = df.withColumn("_st_line", inline_store_line(html))
    df = df.withColumn("_st_text", inline_store_text(F.col("_st_line")))
    return df.withColumn(out, inline_store_json(F.col("_st_text"))).drop("_st_line", "_st_text")


def inline_store_json(text: Column) -> Column:
    return F.when(J.is_whole_json(text), F.get_json_object(text, "$.content"))


def add_inline_store_recipe(df: DataFrame, content: str, url: str = "url",
                            out: str = "_rec_st", fields: str | None = None) -> DataFrame:
    """Add the recipe struct of an inline-store ``content`` column (one parse, staged), or of its
    page's ``fields`` where those are read."""
    cv = J.clean_value
    df = df.withColumn("_std", F.from_json(F.col(content), _STORE_DDL))
    d = F.col("_std")
    a = d["author"]
    df = df.withColumns({
        "_st_prep_m": iso_minutes(_read(fields, "prep", cv(d["formattedPrepTime"]))),
        "_st_cook_m": iso_minutes(_read(fields, "cook", cv(d["formattedCookTime"]))),
        "_st_author": _read(fields, "author", F.when(a.isNull() | F.is_variant_null(a), F.lit(""))
                            .when(J.v_is_string(a), clean_text(J.v_string(a)))
                            .when(J.v_is_array(a), F.coalesce(J.v_string(a, "$[0].name"), F.lit("")))
                            .when(J.v_is_object(a), F.coalesce(J.v_string(a, "$.name"), F.lit("")))
                            .otherwise(F.lit("")))})
    df = df.withColumn("_st_total_m", add_minutes(F.col("_st_prep_m"), F.col("_st_cook_m")))
    df = R.add_derived_times(df, "_st_prep_m", "_st_cook_m", "_st_total_m", fill_total=False, prefix="_st")
    # Group titles always come out empty (the rule reads the new, empty group).
    ingr = F.coalesce(H.transform(d["ingredientGroups"], lambda g: F.struct(
        F.lit("").alias("title"),
        F.coalesce(H.transform(g["ingredients"], lambda i: strip_tags(cv(i["description"]))), _empty())
         .alias("ingredients"))), F.array().cast("array<struct<title:string,ingredients:array<string>>>"))
    dirs = F.coalesce(H.transform(d["preparationGroups"], lambda g: F.struct(
        F.lit("").alias("group"),
        F.coalesce(H.transform(g["steps"], lambda s: strip_tags(cv(s["description"]))), _empty())
         .alias("directions"))), F.array().cast("array<struct<group:string,directions:array<string>>>"))
    if fields is not None:
        f, ingr_type, dirs_type = F.col(fields), "array<struct<title:string,ingredients:array<string>>>", "array<struct<group:string,directions:array<string>>>"
        ingr = F.when(f["plain"], F.transform(f["ingredients"], lambda x: F.struct(F.lit("").alias("title"), x.alias("ingredients"))).cast(ingr_type)).otherwise(ingr)
        dirs = F.when(f["plain"], F.transform(f["directions"], lambda x: F.struct(F.lit("").alias("group"), x.alias("directions"))).cast(dirs_type)).otherwise(dirs)
    rec = R.recipe_struct(
        url=F.col(url), title=_read(fields, "title", cv(d["hed"])), description=_read(fields, "description", strip_tags(cv(d["dek"]))),
        **{"yield": _read(fields, "yield", F.when(d["servingSizeInfo"].isNull(), F.lit(""))
                          .otherwise(cv(d["servingSizeInfo"]["servingSizeDescription"])))},
        **R.staged_time_fields("_st"),
        author=R.author_rule(F.col("_st_author"), F.lit(STORE_PUBLISHER)),
        ingredient_groups=ingr, direction_groups=dirs)
    return (df.withColumn(out, F.when(F.col(content).isNotNull() | _is_read(fields), rec))
              .drop("_std", "_st_prep_m", "_st_cook_m", "_st_author", "_st_total_m",
                    "_st_prep", "_st_total", "_st_cook"))


# ----------------------------------------------------------------------- DOM
def em_dash_to_space(html: Column) -> Column:
    """Em dash -> space, applied to DOM-layout pages ahead of the HTML parse."""
    return F.when(html.contains(EM_DASH), F.replace(html, F.lit(EM_DASH), F.lit(" "))).otherwise(html)


class _Collector(HTMLParser):
    """One pass over a page: the texts of the layout's fields, nothing else kept.

    Only the open elements are held.  An element that satisfies a field's path
    (its last step is the element, the earlier ones are open around it, in order)
    starts to gather text, until it is closed.
    """

    def __init__(self, fields: dict):
        super().__init__(convert_charrefs=True)
        self.by_tag: dict = {}
        for name, path in fields.items():
            self.by_tag.setdefault(path[-1][0], []).append((name, path))
        self.found: dict[str, list] = {name: [] for name in fields}
        self.open: list[tuple] = []      # (tag, attributes) of the open elements
        self.gathering: list[tuple] = []  # (depth, pieces)

    def updatepos(self, i, j):
        """Lines and columns are not asked for."""
        return j

    def parse_starttag(self, i):
        """Tags as they are usually written; any other way is the parser's."""
        m = PLAIN_TAG_RX.match(self.rawdata, i)
        if m is None or m[1] in TEXT_ELEMENTS:
            return super().parse_starttag(i)
        self.handle_starttag(m[1], PLAIN_ATTRIBUTE_RX.findall(m[2]) if m[2] else [])
        return m.end()

    def parse_endtag(self, i):
        m = PLAIN_END_RX.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    @staticmethod
    def _fits(element: tuple, step: tuple) -> bool:
        tag, cls, attr = step
        return (tag in (None, element[0]) and (cls is None or cls in (element[1].get("class") or "").split())
                and (attr is None or element[1].get(attr[0]) == attr[1]))

    def _on_path(self, element: tuple, path: list) -> bool:
        if not self._fits(element, path[-1]):
            return False
        around = iter(reversed(self.open))
        return all(any(self._fits(e, step) for e in around) for step in reversed(path[:-1]))

    def _begin(self, tag: str, attrs: list, stays: bool) -> None:
        element = (tag, {k: (v if v is not None else "") for k, v in attrs})
        for name, path in (*self.by_tag.get(tag, ()), *self.by_tag.get(None, ())):
            if self._on_path(element, path):
                pieces: list[str] = []
                # Which first elements of other fields it stands in: the first list, the first block.
                inside = {other for other, found in self.found.items() if found and found[0]["depth"] is not None}
                self.found[name].append({"pieces": pieces, "attrs": element[1], "depth": len(self.open) if stays else None, "inside": inside})
                if stays:
                    self.gathering.append((len(self.open), pieces))
        if stays:
            self.open.append(element)

    def _close_to(self, depth: int) -> None:
        del self.open[depth:]
        while self.gathering and self.gathering[-1][0] >= depth:
            self.gathering.pop()
        for found in self.found.values():
            if found and found[0]["depth"] is not None and found[0]["depth"] >= depth:
                found[0]["depth"] = None

    def handle_starttag(self, tag, attrs):
        while self.open and tag in DOM_AUTOCLOSE.get(self.open[-1][0], ()):
            self._close_to(len(self.open) - 1)
        self._begin(tag, attrs, tag not in DOM_VOID)

    def handle_startendtag(self, tag, attrs):
        self._begin(tag, attrs, False)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self._close_to(depth)
                return

    def handle_data(self, data):
        for _, pieces in self.gathering:
            pieces.append(data)

    def texts(self, name: str) -> list[str]:
        return ["".join(x["pieces"]) for x in self.found[name]]


def _leaf(s: str) -> str:
    return s.replace("\n", "").strip()


def _plain_items(page: _Collector, inside: str) -> list[str]:
    """Class-less list items within the first element of ``inside``."""
    return [_leaf("".join(x["pieces"])) for x in page.found["item"] if "class" not in x["attrs"] and inside in x["inside"]]


def _dom_a(page: _Collector) -> dict:
    """Layout A; a page without a field, or without the time's value, is a reject."""
    one = {name: page.found[name][0] if page.found[name] else None for name in ("title", "description", "yield", "cook")}
    if None in one.values() or "content" not in one["cook"]["attrs"]:
        return {"ok": False, "reason": "dom_field_missing"}
    return {"ok": True, **{name: "".join(one[name]["pieces"]) for name in ("title", "description", "yield")},
            "cook": one["cook"]["attrs"]["content"],
            "ingredients": [_leaf(t) for t in page.texts("ingredients")], "directions": [_leaf(t) for t in page.texts("directions")]}


def _dom_b(page: _Collector) -> dict:
    """Layout B: paragraphs of the content blocks and class-less items of the first list in one."""
    missing = {"ok": False, "reason": "dom_field_missing"}
    title, paras = page.texts("title"), page.texts("paragraph")
    if not title or len(paras) < 2 or not page.found["block"] or not page.found["list"]:
        return missing
    items = _plain_items(page, "list")
    dirs = items
    if not dirs:
        # The fallback list must stand in the first content block.
        if not page.found["rte_list"] or "content" not in page.found["rte_list"][0]["inside"]:
            return missing
        dirs = _plain_items(page, "rte_list")
    ingr = [_leaf(t) for t in page.texts("row_paragraph")] or items
    return {"ok": True, "title": re.sub(DOM_B_TITLE_SUFFIX, "", title[0]), "yield": paras[0], "description": paras[1], "cook": None,
            "ingredients": ingr, "directions": dirs}


def dom_page(html: str, layout: str) -> dict:
    """Fields of a page of DOM layout ``a`` or ``b`` by the layout's CSS rules."""
    page = _Collector(DOM_A_FIELDS if layout == "a" else DOM_B_FIELDS)
    try:
        page.feed(html)
        page.close()
        return _dom_a(page) if layout == "a" else _dom_b(page)
    except (AssertionError, ValueError):  # what the parser raises on broken declarations and references
        return {"ok": False, "reason": "dom_parse_error"}


def page_fields(html: bytes | None, kind: str | None) -> dict:
    """``FIELDS`` of a page; none where the expressions are to read it."""
    if html is None or kind is None:
        return {}
    if kind in (KIND_DOM_A, KIND_DOM_B):
        read = dom_page(html.decode(errors="replace"), kind)
        return read | {c: [read[c]] for c in ("ingredients", "directions") if c in read}
    if len(html) > MAX_BYTES:
        return {}
    try:
        return next_data_fields(html) if kind == KIND_NEXT_DATA else store_fields(html, STORE_MARKER, STORE_FIXES_PY)
    except (ValueError, RecursionError):  # not regular, no strict JSON, no UTF-8
        return {}


@F.arrow_udf(from_arrow_schema(pa.schema(list(FIELDS.items()))))
def site_fields(html: pa.Array, kind: pa.Array) -> pa.Array:
    """Fields of a page's bytes by its ``kind``; all NULL without one."""
    parts = []
    for at in range(0, len(html), ROWS_AT_A_TIME):
        rows = [page_fields(h, k) for h, k in zip(html.slice(at, ROWS_AT_A_TIME).to_pylist(), kind.slice(at, ROWS_AT_A_TIME).to_pylist())]
        parts.append(pa.StructArray.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in FIELDS.items()], names=list(FIELDS)))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(FIELDS.items())))


def add_dom_recipe(df: DataFrame, fields: str, layout: str, url: str = "url",
                   publisher: str = "publisher", out: str = "_rec_dom") -> DataFrame:
    """Add the recipe struct from the DOM fields struct column."""
    f = F.col(fields)
    df = df.withColumn("_dm_cook", iso_minutes(f["cook"]))
    # These pages have a cooking time only: no preparation, and the total is the cooking time.
    df = df.withColumns({"_dm_prep": F.lit(0), "_dm_total": F.col("_dm_cook")})
    is_a = F.col(layout) == "a"
    times = R.staged_time_fields("_dm")
    none = F.lit(None).cast("string")
    rec = R.recipe_struct(
        url=F.col(url), title=f["title"], description=f["description"], **{"yield": f["yield"]},
        preptime=F.when(is_a, times["preptime"]).otherwise(none),
        cooktime=F.when(is_a, times["cooktime"]).otherwise(none),
        totaltime=F.when(is_a, times["totaltime"]).otherwise(none),
        author=F.col(publisher),
        ingredient_groups=R.single_ingredient_group(F.coalesce(F.get(f["ingredients"], 0), _empty())),
        direction_groups=R.single_direction_group(F.coalesce(F.get(f["directions"], 0), _empty())))
    return (df.withColumn(out, F.when(f["ok"], rec))
              .drop("_dm_cook", "_dm_prep", "_dm_total"))


__all__ = ["em_dash_to_space", "next_data_document", "add_next_data_recipe", "inline_store_content",
           "add_inline_store_recipe", "dom_page", "site_fields", "add_dom_recipe", "leaf_text", "minutes_text"]
