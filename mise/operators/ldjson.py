"""JSON-LD route: scripts -> one recipe candidate per page -> recipe struct.

Everything happens inside the page row (array functions and an in-row
``aggregate`` fold), so the route is map-only: no shuffle, no skew exposure,
and a page's scripts are never gathered across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hof as H
from ..functions import jsonkeys as J
from ..functions.text import clean_text, iso_minutes, strip_tags
from . import recipes as R

# --- fixed values -----------------------------------------------------------
# <script ... type="application/ld+json" ...> body </script>, any quoting; the
# attribute stands after white space and has exactly this value; the body is
# group 1.  A "</script>" inside the JSON ends it, as in HTML.
LDJSON_RX = (r"""(?is)<script(?=\s)[^>]*\stype\s*=\s*(?-i:"application/ld\+json"|'application/ld\+json'"""
             r"""|application/ld\+json(?=[\s>]))[^>]*>(.*?)</script>""")
# Cheap test ahead of extraction.
LDJSON_MARKER = "application/ld+json"
# Text before the first '{' or '[' of a script body is cut.
LEAD_RX = r"^[^\{\[]*"
# Type name a candidate must carry.
RECIPE_TYPE = "Recipe"
# ---------------------------------------------------------------------------

KIND_LIST, KIND_GRAPH, KIND_OBJECT, KIND_BAD = "list", "graph", "object", "malformed"

_HEAD_DDL = "struct<`@type`: string, `@graph`: string>"

# Why a chosen candidate is no recipe after all.
REASON_NULL_INGREDIENTS = "null_ingredients"
REASON_NO_INSTRUCTIONS = "no_instructions"

# Fields read from a chosen candidate: typed once as VARIANT ...
LD_VARIANT_DDL = (
    "struct<headline: variant, name: variant, description: variant, recipeYield: variant, "
    "totalTime: variant, cookTime: variant, prepTime: variant, author: variant, "
    "recipeIngredient: variant, recipeInstructions: variant, itemListElement: variant>")
# ... and once as order-preserving raw text for the list-valued ones.
DEEP_KEYS = ("recipeIngredient", "recipeInstructions", "itemListElement")
LD_RAW_DDL = "struct<recipeIngredient: string, recipeInstructions: string, itemListElement: string>"


def has_ldjson(html: Column) -> Column:
    """Pre-filter: the page mentions the JSON-LD media type at all."""
    return F.coalesce(html.contains(LDJSON_MARKER), F.lit(False))


def _has_key(text: Column, key: str) -> Column:
    """The object has the key at top level, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def script_infos(bodies: Column) -> Column:
    """Per script body: struct<pos, kind, raw, cand>, built by chained
    ``transform`` stages so each parse runs once per script."""
    s1 = H.transform(bodies, lambda b, i: F.struct(
        i.alias("pos"), F.regexp_replace(b, LEAD_RX, "").alias("raw")))
    s2 = H.transform(s1, lambda s: F.struct(
        s["pos"].alias("pos"), s["raw"].alias("raw"),
        F.from_json(s["raw"], _HEAD_DDL).alias("head"),
        s["raw"].startswith("[").alias("is_list"),
        (J.json_list_items(s["raw"]).isNotNull() & J.is_whole_json(s["raw"])).alias("list_ok"),
        (F.json_object_keys(s["raw"]).isNotNull() & J.is_whole_json(s["raw"])).alias("obj_ok")))
    s3 = H.transform(s2, lambda s: F.struct(
        s["pos"].alias("pos"), s["raw"].alias("raw"), s["head"].alias("head"),
        (F.when(s["is_list"] & s["list_ok"], F.lit(KIND_LIST))
          .when(s["is_list"], F.lit(KIND_BAD))
          .when(s["obj_ok"] & F.coalesce(s["head"].getField("@graph").startswith("["), F.lit(False)), F.lit(KIND_GRAPH))
          .when(s["obj_ok"], F.lit(KIND_OBJECT))
          .otherwise(F.lit(KIND_BAD))).alias("kind")))
    s4 = H.transform(s3, lambda s: F.struct(
        s["pos"].alias("pos"), s["kind"].alias("kind"), s["raw"].alias("raw"), s["head"].alias("head"),
        F.when(s["kind"] == KIND_LIST, J.first_typed_element(s["raw"], RECIPE_TYPE))
         .when(s["kind"] == KIND_GRAPH, J.first_typed_element(s["head"].getField("@graph"), RECIPE_TYPE))
         .alias("first")))
    return H.transform(s4, lambda s: F.struct(
        s["pos"].alias("pos"), s["kind"].alias("kind"), s["raw"].alias("raw"),
        F.when(s["kind"].isin(KIND_LIST, KIND_GRAPH)
               & _has_key(s["first"], "recipeIngredient"), s["first"])
         .when((s["kind"] == KIND_OBJECT) & (s["head"].getField("@type") == RECIPE_TYPE)
               & _has_key(s["raw"], "recipeIngredient"), s["raw"])
         .alias("cand")))


def scripts_of(html: Column) -> Column:
    """``scripts``: array<struct<pos, kind, raw, cand>> in document order (empty
    when the page fails the pre-filter)."""
    bodies = F.regexp_extract_all(html, F.lit(LDJSON_RX), 1)
    return F.when(has_ldjson(html), script_infos(bodies)) \
        .otherwise(F.array().cast("array<struct<pos:int,kind:string,raw:string,cand:string>>"))


def with_scripts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    return pages.withColumn("scripts", scripts_of(F.col(html_col)))


def extract_ldjson(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """Table-valued: one row per JSON-LD script ``(key, pos, kind, raw, is_candidate)``.

    For a plain ``explode`` Spark adds filters on the array (not null, not empty) below it, each of
    which would parse the scripts again; the row of an empty one is dropped after the outer form.
    """
    return (with_scripts(pages.filter(has_ldjson(F.col(html_col))), html_col)
            .select(key, F.explode_outer("scripts").alias("s"))
            .where(F.col("s").isNotNull())
            .select(key, "s.pos", "s.kind", "s.raw", F.col("s.cand").isNotNull().alias("is_candidate")))


def pick_candidate(scripts: Column) -> Column:
    """Fold over the scripts in order: a list / @graph script replaces the state
    (NULL when it holds no valid recipe); an object script only fills an empty
    state; malformed scripts are skipped.  Returns struct<pos, raw>."""
    zero = F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("raw"))

    def step(acc: Column, s: Column) -> Column:
        here = F.struct(F.when(s["cand"].isNotNull(), s["pos"]).alias("pos"), s["cand"].alias("raw"))
        return (F.when(s["kind"].isin(KIND_LIST, KIND_GRAPH), here)
                 .when((s["kind"] == KIND_OBJECT) & acc["raw"].isNull(), here)
                 .otherwise(acc))

    return H.aggregate(scripts, zero, step)


def _instruction_steps(t: Column) -> Column:
    """Direction texts from the JSON text of the chosen instructions value."""
    items = J.json_list_items(t)
    step = lambda e: strip_tags(F.coalesce(
        F.when(e.startswith("{"), F.get_json_object(e, "$.text")), e))
    as_list = H.transform(items, step)
    empty = F.array().cast("array<string>")
    return (F.when(t.isNull(), empty)
            .when(t.startswith("["), F.coalesce(as_list, empty))
            .when(t.startswith('"'),
                  F.when(J.json_unquote(t) == "", empty).otherwise(F.array(strip_tags(J.json_unquote(t)))))
            .otherwise(F.array(strip_tags(t))))


def _ingredient_items(t: Column) -> Column:
    items = J.json_list_items(t)
    empty = F.array().cast("array<string>")
    return (F.when(t.isNull(), empty)
            .when(t.startswith("["), F.coalesce(H.transform(items, lambda e: strip_tags(e)), empty))
            .when(t.startswith('"'), F.array(strip_tags(J.json_unquote(t))))
            .otherwise(F.array(strip_tags(t))))


def add_ldjson_recipe(df: DataFrame, cand: str, url: str = "url", publisher: str = "publisher",
                      out: str = "_rec_ld") -> DataFrame:
    """Add the recipe struct built from the candidate JSON text column ``cand``.

    Heavy sub-expressions (the two candidate parses, cleaned time texts, minutes,
    author) are staged as columns so each is evaluated once per row.
    """
    c = F.col(cand)
    cv = J.clean_value
    df = df.withColumns({"_ldv": F.from_json(c, LD_VARIANT_DDL), "_ldr": F.from_json(c, LD_RAW_DDL)})
    v, raw = F.col("_ldv"), F.col("_ldr")
    a = v["author"]
    df = df.withColumns({
        "_ld_total_s": cv(v["totalTime"]), "_ld_cook_s": cv(v["cookTime"]), "_ld_prep_s": cv(v["prepTime"]),
        "_ld_author": (F.when(a.isNull() | F.is_variant_null(a), F.lit(""))
                       .when(J.v_is_string(a), clean_text(J.v_string(a)))
                       .when(J.v_is_array(a), F.coalesce(J.v_string(a, "$[0].name"), F.lit("")))
                       .when(J.v_is_object(a), F.coalesce(J.v_string(a, "$.name"), F.lit("")))
                       .otherwise(F.lit(""))),
    })
    found = {k: J.find_key_first(c, k, v[k], raw[k]) for k in DEEP_KEYS}
    df = df.withColumns({"_ld_ingr_t": found["recipeIngredient"],
                         "_ld_steps_t": F.coalesce(found["itemListElement"], found["recipeInstructions"])})
    df = df.withColumn("_ld_reason", F.when(c.isNotNull() & F.col("_ld_ingr_t").isNull(), F.lit(REASON_NULL_INGREDIENTS))
                       .when(c.isNotNull() & F.col("_ld_steps_t").isNull(), F.lit(REASON_NO_INSTRUCTIONS)))
    df = df.withColumns({"_ld_total_m": iso_minutes(F.col("_ld_total_s")),
                         "_ld_cook_m": iso_minutes(F.col("_ld_cook_s")),
                         "_ld_prep_m": iso_minutes(F.col("_ld_prep_s"))})
    df = R.add_derived_times(df, "_ld_prep_m", "_ld_cook_m", "_ld_total_m", fill_total=True, prefix="_ld")
    ry = v["recipeYield"]
    yields = F.try_variant_get(ry, "$", "array<string>")
    # Numbers compare as numbers, texts as texts.
    largest = F.array_max(H.transform(yields, lambda y: F.struct(y.try_cast("double").alias("n"), y.alias("text"))))["text"]
    numeric = F.schema_of_variant(ry).rlike(r"^ARRAY<(?:BIGINT|DOUBLE|DECIMAL)")
    yield_ = F.when(J.v_is_array(ry), F.coalesce(F.when(numeric, largest).otherwise(F.array_max(yields)), F.lit(""))) \
              .otherwise(cv(ry))
    rec = R.recipe_struct(
        url=F.col(url),
        title=F.when(v["headline"].isNotNull(), cv(v["headline"])).otherwise(cv(v["name"])),
        description=cv(v["description"]), **{"yield": yield_},
        **R.staged_time_fields("_ld"),
        author=R.author_rule(F.col("_ld_author"), F.col(publisher)),
        ingredient_groups=R.single_ingredient_group(_ingredient_items(F.col("_ld_ingr_t"))),
        direction_groups=R.single_direction_group(_instruction_steps(F.col("_ld_steps_t"))))
    df = df.withColumn(out, F.when(c.isNotNull(), rec))
    return df.drop("_ldv", "_ldr", "_ld_total_s", "_ld_cook_s", "_ld_prep_s", "_ld_author", "_ld_ingr_t",
                   "_ld_steps_t", "_ld_total_m", "_ld_cook_m", "_ld_prep_m", "_ld_prep", "_ld_total", "_ld_cook")
