"""Recipe record: schema, field rules shared by all extractors, flat views.

A recipe is one row with nested arrays (``ingredient_groups`` /
``direction_groups``).  Every extractor builds it in-row from one page, so no
recipe is ever gathered across rows: the size of a recipe is bounded by the
size of the page it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hof as H
from ..functions.text import add_minutes, minutes_text

RECIPE_DDL = (
    "url string, title string, description string, yield string, "
    "preptime string, cooktime string, totaltime string, author string, "
    "ingredient_groups array<struct<title: string, ingredients: array<string>>>, "
    "direction_groups array<struct<group: string, directions: array<string>>>, "
    "notes array<string>"
)
RECIPE_FIELDS = ["url", "title", "description", "yield", "preptime", "cooktime",
                 "totaltime", "author", "ingredient_groups", "direction_groups", "notes"]


def recipe_struct(**cols: Column) -> Column:
    """Build the recipe struct; fields not given are NULL (unset keys)."""
    types = {
        "ingredient_groups": "array<struct<title: string, ingredients: array<string>>>",
        "direction_groups": "array<struct<group: string, directions: array<string>>>",
        "notes": "array<string>",
    }
    parts = []
    for name in RECIPE_FIELDS:
        c = cols.get(name)
        if c is None:
            c = F.lit(None).cast(types.get(name, "string"))
        parts.append(c.alias(name))
    return F.struct(*parts)


def single_ingredient_group(items: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("title"), items.alias("ingredients")))


def single_direction_group(items: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("group"), items.alias("directions")))


def times_derive(prep: Column, cook: Column, total: Column, fill_total: bool = True):
    """Derived (prep, total) minutes.

    prep := total - cook when prep = 0 and total > 0 and cook > 0; then (JSON-LD
    rule) total := prep + cook when total = 0 and either is > 0.
    """
    prep2 = F.when((prep == 0) & (total > 0) & (cook > 0), total - cook).otherwise(prep)
    total2 = total
    if fill_total:
        total2 = F.when((total == 0) & ((prep2 > 0) | (cook > 0)), add_minutes(prep2, cook)).otherwise(total)
    return prep2, total2


def time_fields(prep: Column, cook: Column, total: Column) -> dict[str, Column]:
    return {
        "preptime": minutes_text(prep, ""),
        "cooktime": minutes_text(cook, ""),
        "totaltime": minutes_text(total),
    }


def add_derived_times(df: DataFrame, prep: str, cook: str, total: str, fill_total: bool,
                      prefix: str) -> DataFrame:
    """Stage derived minutes ``{prefix}_prep`` / ``{prefix}_total`` (and keep cook)."""
    p2, t2 = times_derive(F.col(prep), F.col(cook), F.col(total), fill_total)
    df = df.withColumn(f"{prefix}_prep", p2)
    if fill_total:
        t2 = F.when((F.col(total) == 0) & ((F.col(f"{prefix}_prep") > 0) | (F.col(cook) > 0)),
                    add_minutes(F.col(f"{prefix}_prep"), F.col(cook))).otherwise(F.col(total))
    df = df.withColumn(f"{prefix}_total", t2)
    return df.withColumn(f"{prefix}_cook", F.col(cook))


def staged_time_fields(prefix: str) -> dict[str, Column]:
    return time_fields(F.col(f"{prefix}_prep"), F.col(f"{prefix}_cook"), F.col(f"{prefix}_total"))


def author_rule(author: Column, publisher: Column) -> Column:
    """``Publisher (Author)`` when both are set and the author does not already
    name the publisher; an empty author stays empty."""
    return (F.when((publisher != "") & (author != "") & (author != publisher)
                   & ~author.contains(publisher),
                   F.concat(publisher, F.lit(" ("), author, F.lit(")")))
            .otherwise(author))


def flat_recipe(recipes: DataFrame, key: str = "page_id", sep: str = " | ", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scalar view of a recipe struct column ``recipe`` (for checks and export), with the columns of ``keep``."""
    r = F.col("recipe")
    ingr = F.flatten(H.transform(r["ingredient_groups"], lambda g: g["ingredients"]))
    dirs = F.flatten(H.transform(r["direction_groups"], lambda g: g["directions"]))
    return recipes.select(
        key,
        *[F.coalesce(r[c], F.lit("")).alias(c) for c in
          ["url", "title", "description", "yield", "preptime", "cooktime", "totaltime", "author"]],
        F.coalesce(F.size(r["ingredient_groups"]), F.lit(0)).alias("n_ingredient_groups"),
        F.coalesce(F.size(ingr), F.lit(0)).alias("n_ingredients"),
        F.coalesce(F.array_join(ingr, sep), F.lit("")).alias("ingredients"),
        F.coalesce(F.size(dirs), F.lit(0)).alias("n_directions"),
        F.coalesce(F.array_join(dirs, sep), F.lit("")).alias("directions"),
        F.coalesce(F.array_join(r["notes"], sep), F.lit("")).alias("notes"),
        *keep,
    )


def flatten_items(recipes: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per listed item: ``(key, section, group_pos, group_title, item_no, item)``.

    Numbering restarts in each group (``enumerate(..., 1)``); empty items keep
    their number.  One generator pass over the nested arrays: no shuffle.
    """
    r = F.col("recipe")
    sect = "struct<section: string, group_pos: int, group_title: string, items: array<string>>"
    ingr = H.transform(F.coalesce(r["ingredient_groups"], F.array().cast(
        "array<struct<title:string,ingredients:array<string>>>")), lambda g, i: F.struct(
        F.lit("ingredients").alias("section"), i.alias("group_pos"),
        F.coalesce(g["title"], F.lit("")).alias("group_title"), g["ingredients"].alias("items")))
    dirs = H.transform(F.coalesce(r["direction_groups"], F.array().cast(
        "array<struct<group:string,directions:array<string>>>")), lambda g, i: F.struct(
        F.lit("directions").alias("section"), i.alias("group_pos"),
        F.coalesce(g["group"], F.lit("")).alias("group_title"), g["directions"].alias("items")))
    groups = F.concat(ingr.cast(f"array<{sect}>"), dirs.cast(f"array<{sect}>"))
    return (recipes.select(key, F.explode(groups).alias("g"))
            .select(key, "g.section", "g.group_pos", "g.group_title",
                    F.posexplode(F.col("g.items")).alias("i", "item"))
            .select(key, "section", "group_pos", "group_title", (F.col("i") + 1).alias("item_no"), "item"))


def assemble_groups(titles: Column, items: Column) -> Column:
    """Nested group array from parallel arrays of group titles and item lists.

    The group title is kept only when there is more than one group.
    """
    n = F.size(items)
    none = F.array().cast("array<string>")
    return F.zip_with(titles, items, lambda t, i: F.struct(
        F.when(n > 1, F.coalesce(t, F.lit(""))).otherwise(F.lit("")).alias("title"), F.coalesce(i, none).alias("ingredients")))


# Items that are gathered and sorted at a time; a longer group comes together from such chunks.
NEST_CHUNK = 1000


def nest_items(flat: DataFrame, key: str = "page_id", chunk: int = NEST_CHUNK) -> DataFrame:
    """Flat rows ``(key, section, group_pos, group_title, item_no, item)`` back to
    ``(key, ingredient_groups, direction_groups)``: the inverse of ``flatten_items``.

    Rows may come in any order.  Items are ordered by ``item_no`` (rows with one number by their text,
    null first), groups by ``group_pos``; numbers need not be dense.  An ingredient group's title is
    kept only when the recipe has more than one ingredient group.  A group without items has
    no rows and does not come back.

    Each level is ordered by the sort keys it carries: chunks of ``chunk`` numbers of a group,
    groups, a recipe.  Rows are dealt by ``key`` once, which serves all three, so an item's
    text crosses the disk once and not once for each level; a recipe is one row in the end, so what
    meets in a task is what stands in its rows.
    """
    dealt = flat.select(key, "section", "group_pos", "item_no", "item", F.nullif("group_title", F.lit("")).alias("_name")).repartition(key)
    rows = dealt.select(key, "section", "group_pos", F.floor((F.col("item_no") - 1) / chunk).alias("_part"), F.struct("item_no", "item").alias("_it"),
                        F.when(F.col("_name").isNotNull(), F.struct("item_no", F.col("_name").alias("group_title"))).alias("_title"))
    pieces = rows.groupBy(key, "section", "group_pos", "_part").agg(
        F.transform(F.array_sort(F.collect_list("_it")), lambda x: x["item"]).alias("_items"), F.min("_title").alias("_title"))
    groups = pieces.groupBy(key, "section", "group_pos").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_items"))), lambda x: x["_items"])).alias("items"),
        F.coalesce(F.min("_title")["group_title"], F.lit("")).alias("title"))
    nested = groups.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "group_pos", "title", "items"))).alias("_g"))

    def of(section: str, title: str, items: str, titled: Column) -> Column:
        own = F.filter("_g", lambda g: g["section"] == section)
        return F.transform(own, lambda g: F.struct(F.when(titled, g["title"]).otherwise(F.lit("")).alias(title), g["items"].alias(items)))

    several = F.size(F.filter("_g", lambda g: g["section"] == "ingredients")) > 1
    return nested.select(key, of("ingredients", "title", "ingredients", several).alias("ingredient_groups"),
                         of("directions", "group", "directions", F.lit(True)).alias("direction_groups"))
