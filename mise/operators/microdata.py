"""Second extractor: schema.org recipes written as microdata (``itemscope`` / ``itemprop``).

One pass of the stdlib HTML parser over a page, in an Arrow-batched UDF that gets NULL
for pages it is not asked about.  It shares nothing with the JSON routes, so each can
stand in for the other (``plans.extract``, ``fallback``).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import iso_minutes, minutes_text
from . import recipes as R
from .sites import DOM_AUTOCLOSE, DOM_VOID

# --- fixed values -----------------------------------------------------------
RECIPE_ITEM_RX = re.compile(r"https?://schema\.org/Recipe/?")
# Where an element's value stands, by tag; any other element's value is its text.
VALUE_ATTRIBUTE = {"meta": "content", "time": "datetime", "data": "value", "meter": "value", "a": "href", "link": "href",
                   "img": "src", "audio": "src", "video": "src", "source": "src", "embed": "src", "iframe": "src", "object": "data"}
# Property names, the older ones too.
PROPERTIES = {"name": "title", "recipeYield": "yield", "yield": "yield", "totalTime": "total",
              "recipeIngredient": "ingredients", "ingredients": "ingredients", "recipeInstructions": "directions"}
# Elements that end a line of text.
LINE_ENDS = {"br", "p", "li", "div", "tr", "h1", "h2", "h3", "h4"}
# ---------------------------------------------------------------------------

REASON_NO_MICRODATA = "no_microdata"
REASON_INCOMPLETE = "microdata_incomplete"
MARKER = "itemscope"
FIELDS = ["reason", "title", "yield", "total", "ingredients", "directions"]


class _RecipeItem(HTMLParser):
    """Property values of the page's first recipe item; nested items keep theirs to themselves."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.values: dict[str, list] = {}
        self.open: list[str] = []
        self.scopes: list[int] = []       # depths of the open items, the recipe's first
        self.gathering: list[tuple] = []  # (depth, pieces)
        self.found = self.over = False

    def _begin(self, tag: str, attrs: list, stays: bool) -> None:
        at = dict(reversed(attrs))
        if self.found and not self.over:
            if tag in LINE_ENDS:
                self._text("\n")
            # A property belongs to the innermost item that is open around its element.
            names = (at.get("itemprop") or "").split() if len(self.scopes) == 1 else []
            for name in {PROPERTIES[n] for n in names if n in PROPERTIES}:
                given = at.get(VALUE_ATTRIBUTE.get(tag, ""))
                pieces = [given] if given is not None else []
                self.values.setdefault(name, []).append(pieces)
                if given is None and stays:
                    self.gathering.append((len(self.open), pieces))
        if not self.over and "itemscope" in at and stays:
            if self.found:
                self.scopes.append(len(self.open))
            elif any(RECIPE_ITEM_RX.fullmatch(t) for t in (at.get("itemtype") or "").split()):
                self.found, self.scopes = True, [len(self.open)]
        if stays:
            self.open.append(tag)

    def _close_to(self, depth: int) -> None:
        del self.open[depth:]
        while self.gathering and self.gathering[-1][0] >= depth:
            self.gathering.pop()
        while self.scopes and self.scopes[-1] >= depth:
            self.scopes.pop()
        self.over = self.found and not self.scopes

    def _text(self, data: str) -> None:
        for _, pieces in self.gathering:
            pieces.append(data)

    def handle_starttag(self, tag, attrs):
        while self.open and tag in DOM_AUTOCLOSE.get(self.open[-1], ()):
            if self.open[-1] in LINE_ENDS:
                self._text("\n")
            self._close_to(len(self.open) - 1)
        self._begin(tag, attrs, tag not in DOM_VOID)

    def handle_startendtag(self, tag, attrs):
        self._begin(tag, attrs, False)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] == tag:
                if tag in LINE_ENDS:
                    self._text("\n")
                self._close_to(depth)
                return

    def handle_data(self, data):
        self._text(data)

    def lines(self, name: str) -> list[str]:
        """Lines of all values of a property, white space collapsed, empty ones dropped."""
        whole = "\n".join("".join(pieces) for pieces in self.values.get(name, ()))
        return [line for line in (" ".join(raw.split()) for raw in whole.split("\n")) if line]

    def items(self, name: str) -> list[str]:
        """One text for each value of a property, empty ones dropped."""
        return [t for t in (" ".join("".join(pieces).split()) for pieces in self.values.get(name, ())) if t]


def read_item(html: str) -> tuple:
    """(reason, title, yield, total time, ingredients, directions); a reason says why there is no recipe."""
    page = _RecipeItem()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):  # what the parser raises on broken declarations and references
        return (REASON_NO_MICRODATA, None, None, None, None, None)
    if not page.found:
        return (REASON_NO_MICRODATA, None, None, None, None, None)
    title, ingredients, directions = page.items("title"), page.items("ingredients"), page.lines("directions")
    if not (title and ingredients and directions):
        return (REASON_INCOMPLETE, None, None, None, None, None)
    one = {name: (page.items(name) or [None])[0] for name in ("yield", "total")}
    return (None, title[0], one["yield"], one["total"], ingredients, directions)


FIELDS_SCHEMA = T.StructType([T.StructField(f, T.ArrayType(T.StringType()) if f in ("ingredients", "directions") else T.StringType())
                              for f in FIELDS])


@F.pandas_udf(FIELDS_SCHEMA)
def microdata_fields(html: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 6 if h is None else read_item(h) for h in html]
    return pd.DataFrame(rows, columns=FIELDS, dtype=object)


def add_microdata_recipe(df: DataFrame, html: Column, out: str = "_rec_md", url: str = "url") -> DataFrame:
    """Add the recipe struct of the page's microdata (NULL without one).  Pages that
    never mention an item are settled without Python."""
    df = df.withColumn("_md", microdata_fields(F.when(html.contains(MARKER), html)))
    f = F.col("_md")
    rec = R.recipe_struct(
        url=F.col(url), title=f["title"], description=F.lit(""), **{"yield": F.coalesce(f["yield"], F.lit(""))},
        preptime=F.lit(""), cooktime=F.lit(""), totaltime=minutes_text(iso_minutes(f["total"])),
        ingredient_groups=R.single_ingredient_group(f["ingredients"]),
        direction_groups=R.single_direction_group(f["directions"]))
    return df.withColumn(out, F.when(f["title"].isNotNull(), rec)).drop("_md")
