"""Registered queries: one per operator, each reading the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
over the same tables).  Results are flat scalar columns; every computed
column carries the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hof as H
from ..functions import jsonkeys as J
from ..functions import text as T
from ..functions import urls as U
from ..operators import ldjson as L
from ..operators import recipes as R
from ..operators import sites as S
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources.tables import read_table, scan_pages
from . import extract as X
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


FLAT_COLS = ["page_id", "url", "title", "description", "yield", "preptime", "cooktime", "totaltime",
             "author", "n_ingredient_groups", "n_ingredients", "ingredients", "n_directions",
             "directions", "notes"]


def _flat(recipes: DataFrame) -> DataFrame:
    return R.flat_recipe(recipes)


# ------------------------------------------------------------------ sources
register("scan_pages", """
SELECT page_id, url, CAST(length(html) AS INTEGER) AS html_chars FROM pages
""")(lambda spark, d: scan_pages(spark, d).select("page_id", "url", F.length("html").alias("html_chars")))


# ---------------------------------------------------------- urls & routing
@register("url_domain", f"SELECT page_id, {O.url_domain('url')} AS domain FROM pages")
def q_url_domain(spark, d):
    return read_table(spark, d, "pages").select("page_id", U.url_domain(F.col("url")).alias("domain"))


_REMAP_URL = (f"'https://' || {O.pick('page_id', FX.REMAP_DOMAINS)} || "
              f"regexp_replace(url, '^([a-z]+://)[^/?#]*', '')")
_REMAP_CTE = f"WITH f1 AS (SELECT page_id, {_REMAP_URL} AS url FROM pages), " \
             f"f1d AS (SELECT page_id, url, {O.url_domain('url')} AS domain FROM f1) "


@register("publisher_lookup", _REMAP_CTE + f"SELECT page_id, domain, {O.publisher('domain')} AS publisher FROM f1d")
def q_publisher_lookup(spark, d):
    return U.publisher_lookup(FX.remapped_pages(spark, d).select("page_id", "url")) \
        .select("page_id", "domain", "publisher")


@register("route_pages", _REMAP_CTE + f"SELECT page_id, domain, {O.route('domain')} AS route FROM f1d")
def q_route_pages(spark, d):
    return U.route_pages(FX.remapped_pages(spark, d).select("page_id", "url")).select("page_id", "domain", "route")


# ------------------------------------------------------------- text rules
_INJECT = " &frac12; ½ ¼ ’ &nbsp; ((x)) a // b &#39;s &#8217; Â \t\r\n&frac23;⅓ "


@register("strip_tags", f"""
SELECT page_id, {O.strip_tags("html || " + O.lit(_INJECT))} AS text,
       {O.strip_tags("html || " + O.lit(_INJECT), True)} AS text_nl
FROM pages""")
def q_strip_tags(spark, d):
    h = F.concat(F.col("html"), F.lit(_INJECT))
    return read_table(spark, d, "pages").select("page_id", T.strip_tags(h).alias("text"),
                                                 T.strip_tags(h, True).alias("text_nl"))


@register("minutes_text", f"""
SELECT event_id, CAST(event_id % 400 - 5 AS INTEGER) AS minutes,
       {O.minutes_text('(event_id % 400 - 5)')} AS total_text,
       {O.minutes_text('(event_id % 400 - 5)', '')} AS part_text
FROM events""")
def q_minutes_text(spark, d):
    m = (F.col("event_id") % 400 - 5).cast("int")
    return read_table(spark, d, "events").select("event_id", m.alias("minutes"),
                                                  T.minutes_text(m).alias("total_text"),
                                                  T.minutes_text(m, "").alias("part_text"))


_ISO_TEXT = ("CASE event_id % 4 WHEN 0 THEN 'PT' || CAST(event_id % 5 AS VARCHAR) || 'H' || CAST(event_id % 60 AS VARCHAR) || 'M' "
             "WHEN 1 THEN 'P' || CAST(event_id % 3 AS VARCHAR) || 'DT' || CAST(event_id % 90 AS VARCHAR) || 'S' "
             "WHEN 2 THEN 'PT' || CAST(event_id % 7 AS VARCHAR) || 'M' || CAST(event_id % 130 AS VARCHAR) || 'S' "
             "ELSE 'about ' || CAST(event_id % 9 AS VARCHAR) || ' min' END")


@register("iso_minutes", f"""
SELECT event_id, {_ISO_TEXT} AS duration,
       CAST(CASE event_id % 4 WHEN 0 THEN (event_id % 5) * 60 + event_id % 60
            WHEN 1 THEN (event_id % 3) * 1440 + (event_id % 90) // 60
            WHEN 2 THEN event_id % 7 + (event_id % 130) // 60 ELSE 0 END AS INTEGER) AS minutes
FROM events""")
def q_iso_minutes(spark, d):
    e = F.col("event_id")
    txt = F.expr(_ISO_TEXT.replace("VARCHAR", "STRING"))
    return read_table(spark, d, "events").select("event_id", txt.alias("duration"),
                                                  T.iso_minutes(txt).alias("minutes"))


_HUGE = ("CASE event_id % 3 WHEN 0 THEN 'PT' || CAST(event_id + 200000000 AS VARCHAR) || '000000S' "
         "WHEN 1 THEN 'P' || CAST(event_id + 1 AS VARCHAR) || '999999999999999D' ELSE 'PT' || CAST(2147480000 + event_id AS VARCHAR) || 'M' END")


@register("iso_minutes_huge", f"""
SELECT event_id, {_HUGE} AS duration,
       CAST(CASE WHEN event_id % 3 = 2 AND 2147480000 + event_id <= 2147483647 THEN 2147480000 + event_id ELSE 0 END AS INTEGER) AS minutes
FROM events""")
def q_iso_minutes_huge(spark, d):
    """Durations beyond INT minutes count as 0 and do not end the job."""
    txt = F.expr(_HUGE.replace("VARCHAR", "STRING").replace("2147480000", "2147480000L"))
    return read_table(spark, d, "events").select("event_id", txt.alias("duration"), T.iso_minutes(txt).alias("minutes"))


@register("output_filename", f"""
SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || ')', '[^\\p{{L}}\\p{{N}}_]+', '', 'g') || '.md' AS md_file,
       p_type || '.rst' AS rst_file
FROM part""")
def q_output_filename(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey",
                    T.title_filename(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")), "md").alias("md_file"),
                    T.output_filename(F.concat(F.col("p_type"), F.lit(".rst")), "rst").alias("rst_file"))


# ---------------------------------------------------- JSON-LD (F2 from part)
_F2_BASE = f"""
f2 AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS ptype, p_size AS s,
              {O.pick('p_partkey', FX.LDJSON_DOMAINS)} AS domain FROM part),
f2a AS (SELECT k AS page_id,
  'https://' || domain || '/recipe/' || CAST(k AS VARCHAR) || '/' || replace(name, ' ', '-') AS url,
  {O.publisher('domain')} AS pub, k % 9 AS layout,
  CASE WHEN k % 9 = 7 THEN 'no_ldjson' WHEN k % 9 IN (6, 8) THEN 'no_recipe_candidate'
       WHEN k % 13 = 6 THEN 'null_ingredients' WHEN k % 6 = 5 THEN 'no_instructions'
       WHEN k % 11 = 4 THEN 'empty_title' END AS reason,
  CASE WHEN k % 11 = 3 THEN upper(name) WHEN k % 11 = 4 THEN '' ELSE {O.clean_text("'  ' || name || '  '")} END AS title,
  {O.strip_tags("'<p>' || ptype || ' &amp; ' || brand || ' &frac12; cup</p>'")} AS description,
  CASE k % 3 WHEN 0 THEN CAST(s AS VARCHAR) || ' servings'
       WHEN 1 THEN CASE WHEN k % 12 = 1 THEN CAST(s + 4 AS VARCHAR)
                        ELSE greatest(CAST(s AS VARCHAR), CAST(s AS VARCHAR) || ' servings') END ELSE CAST(s AS VARCHAR) END AS yield,
  CASE k % 5 WHEN 0 THEN s WHEN 2 THEN 60 * (s % 3) + s ELSE 0 END AS total0,
  CASE k % 5 WHEN 0 THEN s % 7 WHEN 1 THEN 60 + s WHEN 3 THEN s ELSE 0 END AS cook,
  CASE k % 5 WHEN 1 THEN s ELSE 0 END AS prep0,
  CASE k % 4 WHEN 0 THEN 'Chef ' || brand WHEN 3 THEN '' ELSE brand END AS author0,
  brand || ' | ' || ptype || ' 1/2 | (' || CAST(s AS VARCHAR) || ' g) of ' || name AS ingredients,
  CASE k % 6 WHEN 0 THEN 'Mix the ' || name || '. | Bake ' || CAST(s AS VARCHAR) || ' minutes.'
       WHEN 1 THEN 'Combine all and serve.' WHEN 2 THEN 'Prepare ' || name || ' | Rest'
       WHEN 3 THEN 'Chop the ' || name || '. | Serve.' WHEN 4 THEN '{{"@type":"HowToStep","name":"no text"}}'
       ELSE '' END AS directions,
  CAST(CASE k % 6 WHEN 1 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 0 ELSE 2 END AS INTEGER) AS n_directions
FROM f2),
f2b AS (SELECT *, CASE WHEN prep0 = 0 AND total0 > 0 AND cook > 0 THEN total0 - cook ELSE prep0 END AS prep FROM f2a),
f2c AS (SELECT *, CASE WHEN total0 = 0 AND (prep > 0 OR cook > 0) THEN prep + cook ELSE total0 END AS total FROM f2b),
f2x AS (SELECT page_id, url, pub AS publisher, reason, layout, title, description, yield,
  {O.minutes_text('prep', '')} AS preptime, {O.minutes_text('cook', '')} AS cooktime,
  {O.minutes_text('total')} AS totaltime, {O.author_rule('author0', 'pub')} AS author,
  CAST(1 AS INTEGER) AS n_ingredient_groups, CAST(3 AS INTEGER) AS n_ingredients, ingredients,
  n_directions, directions, '' AS notes FROM f2c)
"""


def _f2_extracted(spark, d) -> DataFrame:
    return X.extracted(spark, "ldjson", FX.ldjson_pages, d)


def _f2_flat(spark, d) -> DataFrame:
    return _flat(X.recipes_of(_f2_extracted(spark, d)))


register("recipes_ldjson", f"WITH {_F2_BASE} SELECT {', '.join(FLAT_COLS)} FROM f2x WHERE reason IS NULL")(_f2_flat)

for _name, _cols in [("title_rule", ["title"]), ("times_derive", ["preptime", "cooktime", "totaltime"]),
                     ("author_rule", ["author"]), ("yield_max", ["yield"]),
                     ("ingredients_ldjson", ["n_ingredients", "ingredients"]),
                     ("directions_ldjson", ["n_directions", "directions"])]:
    register(_name, f"WITH {_F2_BASE} SELECT page_id, {', '.join(_cols)} FROM f2x WHERE reason IS NULL")(
        (lambda cols: lambda spark, d: _f2_flat(spark, d).select("page_id", *cols))(_cols))


@register("publisher_effective", f"WITH {_F2_BASE} SELECT page_id, url, publisher, author FROM f2x WHERE reason IS NULL")
def q_publisher_effective(spark, d):
    return _f2_extracted(spark, d).where("reason IS NULL").select(
        "page_id", "url", "publisher", F.coalesce(F.col("recipe.author"), F.lit("")).alias("author"))


@register("reject_pages", f"WITH {_F2_BASE} SELECT page_id, url, 'ldjson' AS route, reason FROM f2x WHERE reason IS NOT NULL")
def q_reject_pages(spark, d):
    return X.rejects_of(_f2_extracted(spark, d))


@register("title_required", f"WITH {_F2_BASE} SELECT page_id, (reason IS NULL) AS has_recipe FROM f2x "
                            f"WHERE reason IS NULL OR reason = 'empty_title'")
def q_title_required(spark, d):
    ex = _f2_extracted(spark, d)
    return ex.filter(F.col("reason").isNull() | (F.col("reason") == X.REASON_EMPTY_TITLE)) \
        .select("page_id", F.col("reason").isNull().alias("has_recipe"))


@register("ldjson_prefilter", "SELECT p_partkey AS page_id, (p_partkey % 9 <> 7) AS has_ldjson FROM part")
def q_ldjson_prefilter(spark, d):
    return FX.ldjson_pages(spark, d).select("page_id", L.has_ldjson(F.col("html")).alias("has_ldjson"))


# scripts per layout: (pos, kind, is_candidate) per fixture layout
_LAYOUT_SCRIPTS = {
    0: [("object", "v")], 1: [("object", "false"), ("object", "v")], 2: [("list", "v")],
    3: [("graph", "v")], 4: [("malformed", "false"), ("object", "v")], 5: [("list", "false"), ("object", "v")],
    6: [("object", "v"), ("list", "false")], 8: [("object", "false")],
}


def _scripts_sql() -> str:
    rows = []
    for layout, scripts in _LAYOUT_SCRIPTS.items():
        for pos, (kind, cand) in enumerate(scripts):
            rows.append(f"({layout}, {pos}, '{kind}', {'true' if cand == 'v' else 'false'})")
    return "layouts(layout, pos, kind, is_candidate) AS (VALUES " + ", ".join(rows) + ")"


@register("extract_ldjson", f"""
WITH {_scripts_sql()}
SELECT p_partkey AS page_id, CAST(l.pos AS INTEGER) AS pos, l.kind, l.is_candidate
FROM part JOIN layouts l ON l.layout = p_partkey % 9""")
def q_extract_ldjson(spark, d):
    return L.extract_ldjson(FX.ldjson_pages(spark, d)).select("page_id", "pos", "kind", "is_candidate")


@register("classify_script", f"""
WITH {_scripts_sql()}
SELECT l.kind, count(*) AS n_scripts, count(*) FILTER (WHERE l.is_candidate) AS n_candidates
FROM part JOIN layouts l ON l.layout = p_partkey % 9 GROUP BY l.kind""")
def q_classify_script(spark, d):
    s = L.extract_ldjson(FX.ldjson_pages(spark, d))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n_scripts"),
                                 F.count_if(F.col("is_candidate")).alias("n_candidates"))


@register("valid_recipe", f"""
WITH {_scripts_sql()}
SELECT p_partkey AS page_id, count(*) FILTER (WHERE l.is_candidate) AS n_valid
FROM part JOIN layouts l ON l.layout = p_partkey % 9 GROUP BY p_partkey""")
def q_valid_recipe(spark, d):
    pages = FX.ldjson_pages(spark, d).filter(L.has_ldjson(F.col("html")))
    s = pages.select("page_id", L.scripts_of(F.col("html")).alias("s"))
    return s.select("page_id", F.size(H.filter("s", lambda x: x["cand"].isNotNull())).cast("bigint").alias("n_valid"))


@register("pick_candidate", """
SELECT p_partkey AS page_id,
       CAST(CASE p_partkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0
            WHEN 4 THEN 1 WHEN 5 THEN 1 END AS INTEGER) AS cand_pos
FROM part WHERE p_partkey % 9 <> 7""")
def q_pick_candidate(spark, d):
    pages = FX.ldjson_pages(spark, d).filter(L.has_ldjson(F.col("html")))
    return pages.select("page_id", L.pick_candidate(L.scripts_of(F.col("html")))["pos"].alias("cand_pos"))


@register("first_typed_element", """
SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS pos, '  ' || p_name || '  ' AS first_name
FROM part WHERE p_partkey % 9 IN (2, 3)""")
def q_first_typed_element(spark, d):
    s = L.extract_ldjson(FX.ldjson_pages(spark, d)).filter(F.col("kind").isin(L.KIND_LIST, L.KIND_GRAPH))
    src = F.when(F.col("kind") == L.KIND_LIST, F.col("raw")) \
        .otherwise(F.from_json("raw", "struct<`@graph`: string>").getField("@graph"))
    first = J.first_typed_element(src, L.RECIPE_TYPE)
    return s.select("page_id", "pos", F.get_json_object(first, "$.name").alias("first_name")) \
        .filter(F.col("first_name").isNotNull())


# ------------------------------------------------- fall-through of extractors
_CHAIN_SQL = f"""WITH c AS (
  SELECT p_partkey AS page_id, p_partkey % 5 AS have, p_partkey % 3 = 0 AS store, p_name AS name, p_brand AS brand, p_type AS ptype,
         {O.minutes_text('p_size')} AS minutes FROM part),
m AS (SELECT * FROM c, (VALUES ('default'), ('forced')) AS t(mode)),
w AS (SELECT *, CASE WHEN mode = 'forced' AND have IN (1, 2, 4) THEN 'microdata'
                     WHEN mode = 'default' AND NOT store AND have = 1 THEN 'microdata'
                     WHEN have IN (0, 2) THEN CASE WHEN store THEN 'inline_store' ELSE 'ldjson' END END AS extractor FROM m)
SELECT page_id, mode, extractor,
       CASE WHEN extractor IS NOT NULL THEN NULL WHEN store THEN 'no_inline_store' WHEN have = 4 THEN 'no_instructions' ELSE 'no_ldjson' END AS reason,
       CASE WHEN extractor = 'microdata' THEN 'Micro ' || name WHEN extractor IS NOT NULL THEN name END AS title,
       CASE WHEN extractor IS NOT NULL THEN minutes END AS totaltime,
       CASE WHEN extractor = 'microdata' THEN ptype || ' | ' || brand || ' & salt' WHEN extractor IS NOT NULL THEN brand END AS ingredients,
       CASE WHEN extractor = 'microdata' THEN 'Chop ' || name || ' | Bake | Serve <hot>' WHEN extractor IS NOT NULL THEN 'Mix ' || name END AS directions
FROM w"""


@register("fallback_chain", _CHAIN_SQL)
def q_fallback_chain(spark, d):
    """Both orders over pages with either, both or neither kind of markup: who made each recipe, and what came out."""
    def run(mode):
        pages = FX.chain_pages(spark, d)
        return X.extract(pages, fallback=mode).withColumn("mode", F.lit(mode))
    both = run(X.FALLBACK_DEFAULT).unionByName(run(X.FALLBACK_FORCED))
    r = F.col("recipe")
    return both.select(
        "page_id", "mode", "extractor", "reason", r["title"].alias("title"), r["totaltime"].alias("totaltime"),
        F.array_join(F.flatten(H.transform(r["ingredient_groups"], lambda g: g["ingredients"])), " | ").alias("ingredients"),
        F.array_join(F.flatten(H.transform(r["direction_groups"], lambda g: g["directions"])), " | ").alias("directions"))


# ----------------------------------------------------------- key search (F4)
_F4_JSON = ("CASE event_id % 4 WHEN 0 THEN '{\"a\":{\"b\":' || props || '},\"k\":\"top\"}' "
            "WHEN 1 THEN '{\"l\":[1,' || props || '],\"k\":-1}' "
            "WHEN 2 THEN '{\"k\":\"first\",\"a\":' || props || '}' "
            "ELSE '{\"x\":[[' || props || ']],\"y\":{\"z\":' || props || '}}' END")


@register("find_key_first", f"""
SELECT event_id, CASE event_id % 4 WHEN 2 THEN '"first"' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS k_value
FROM events""")
def q_find_key_first(spark, d):
    ev = read_table(spark, d, "events")
    doc = F.expr(_F4_JSON)
    v = F.from_json(doc, "struct<k: variant>")["k"]
    raw = F.from_json(doc, "struct<k: string>")["k"]
    return ev.select("event_id", J.find_key_first(doc, "k", v, raw).alias("k_value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which recipes are in this crawl, who published them, how long do they take?"""
    flat = _f2_flat(spark, sf_dir)
    return flat.select("page_id", "title", "totaltime", "n_ingredients", "author")


# ------------------------------------------------ site routes (F7 from documents)
def _sites_extracted(spark, d) -> DataFrame:
    return X.extracted(spark, "sites", FX.site_pages, d)


def _sites_flat(spark, d) -> DataFrame:
    return R.flat_recipe(X.recipes_of(_sites_extracted(spark, d)), keep=("route",))


def _ws(words_expr: str, fn) -> str:
    return f"list_transform({words_expr}, lambda w: {fn('w')})"


_ND_INGR = ("list_transform(lines, lambda w, i: " +
            O.strip_tags("CAST(i AS VARCHAR) || ' ' || (CASE WHEN (i - 1) % 2 = 0 THEN 'cup' ELSE '' END) || ' ' || "
                         + O.clean_text("w") + " || (CASE WHEN (i - 1) % 3 = 0 THEN ', chopped' ELSE '' END)", True) + ")")
_F7_BASE = f"""
f7 AS (SELECT doc_id AS d, text AS t, string_split(text, chr(10)) AS lines FROM documents),
f7b AS (SELECT *, lines[1] AS title0 FROM f7),
nd AS (SELECT d, d * 4 AS page_id, 'next_data' AS route,
  'https://' || {O.pick('d', FX.NEXT_DATA_DOMAINS)} || '/recipes/' || CAST(d AS VARCHAR) AS url,
  {O.clean_text('title0')} AS title, {O.strip_tags(O.clean_text('t'), True)} AS description,
  CAST(d % 8 + 1 AS VARCHAR) || ' servings' AS yield, '' AS preptime, '' AS cooktime,
  CASE WHEN d % 3 = 0 THEN 'TBD' ELSE CAST(d % 90 + 5 AS VARCHAR) || ' minutes' END AS totaltime,
  CASE WHEN d % 2 = 0 THEN {O.publisher(O.pick('d', FX.NEXT_DATA_DOMAINS))} ELSE 'Test Kitchen ' || CAST(d % 5 AS VARCHAR) END AS author,
  CASE WHEN d % 3 = 0 THEN 2 ELSE 1 END AS n_ingredient_groups,
  CASE WHEN d % 3 = 0 THEN list_append({_ND_INGR}, '1 pinch salt') ELSE {_ND_INGR} END AS ingr,
  {_ws('lines', lambda l: O.strip_tags(O.clean_text(l), True))} AS dirs,
  {O.strip_tags(O.clean_text("'<p>*** ' || t || '</p>'"), True)} AS notes
  FROM f7b),
st AS (SELECT d, d * 4 + 1 AS page_id, 'inline_store' AS route, 'https://www.epicurious.com/recipes/' || CAST(d AS VARCHAR) AS url,
  {O.clean_text('title0')} AS title, {O.strip_tags(O.clean_text("'<p>' || t || '</p>'"))} AS description,
  'Serves ' || CAST(d % 6 + 1 AS VARCHAR) AS yield,
  {O.minutes_text('(d % 50)', '')} AS preptime, {O.minutes_text('((d % 4) * 60 + d % 60)', '')} AS cooktime,
  {O.minutes_text('(d % 50 + (d % 4) * 60 + d % 60)')} AS totaltime,
  CASE WHEN d % 3 = 2 THEN 'Epicurious Staff' ELSE 'Epicurious (Cook ' || CAST(d % 7 AS VARCHAR) || ')' END AS author,
  CASE WHEN d % 2 = 0 THEN 2 ELSE 1 END AS n_ingredient_groups,
  CASE WHEN d % 2 = 0 THEN list_append({_ws('lines', lambda w: O.strip_tags(O.clean_text(w)))}, 'salt &amp; pepper')
       ELSE {_ws('lines', lambda w: O.strip_tags(O.clean_text(w)))} END AS ingr,
  {_ws('lines', lambda l: O.strip_tags(O.clean_text(l)))} AS dirs, '' AS notes
  FROM f7b),
da AS (SELECT d, d * 4 + 2 AS page_id, 'dom_saveur' AS route, 'https://www.saveur.com/recipes/' || CAST(d AS VARCHAR) AS url,
  title0 AS title, t AS description, 'Makes ' || CAST(d % 6 + 1 AS VARCHAR) AS yield, '' AS preptime,
  {O.minutes_text('(d % 120)', '')} AS cooktime, {O.minutes_text('(d % 120)')} AS totaltime,
  'Saveur' AS author, 1 AS n_ingredient_groups,
  {_ws('lines', O.leaf_text)} AS ingr, {_ws('lines', O.leaf_text)} AS dirs, '' AS notes
  FROM f7b),
db AS (SELECT d, d * 4 + 3 AS page_id, 'dom_squarespace' AS route, 'https://www.thecookingguy.com/recipes/' || CAST(d AS VARCHAR) AS url,
  title0 || ' ' AS title, t AS description, 'Serves ' || CAST(d % 6 + 1 AS VARCHAR) AS yield,
  '' AS preptime, '' AS cooktime, '' AS totaltime, 'Sam the Cooking Guy (Sam Zien)' AS author, 1 AS n_ingredient_groups,
  CASE WHEN d % 2 = 1 THEN {_ws('lines', O.leaf_text)} ELSE ['Serves ' || CAST(d % 6 + 1 AS VARCHAR), {O.leaf_text('t')}] END AS ingr,
  {_ws('lines', O.leaf_text)} AS dirs, '' AS notes
  FROM f7b),
f7x AS (
  SELECT d, page_id, route, url, title, description, yield, preptime, cooktime, totaltime, author,
         CAST(n_ingredient_groups AS INTEGER) AS n_ingredient_groups,
         CAST(len(ingr) AS INTEGER) AS n_ingredients, array_to_string(ingr, ' | ') AS ingredients,
         CAST(len(dirs) AS INTEGER) AS n_directions, array_to_string(dirs, ' | ') AS directions, notes, ingr, dirs,
         CASE WHEN n_ingredient_groups = 1 THEN [{{'title': '', 'items': ingr}}]
              WHEN route = 'next_data' THEN [{{'title': 'For the base', 'items': ingr[1:len(ingr) - 1]}}, {{'title': 'To finish', 'items': ingr[len(ingr):]}}]
              ELSE [{{'title': '', 'items': ingr[1:len(ingr) - 1]}}, {{'title': '', 'items': ingr[len(ingr):]}}] END AS igroups
  FROM (SELECT * FROM nd UNION ALL SELECT * FROM st UNION ALL SELECT * FROM da UNION ALL SELECT * FROM db))
"""

_FLAT_ROUTE = ", ".join(FLAT_COLS + ["route"])
register("recipes_sites", f"WITH {_F7_BASE} SELECT {_FLAT_ROUTE} FROM f7x")(_sites_flat)


def _route_subset(routes: list[str], cols: list[str] | None = None):
    def q(spark, d):
        df = _sites_flat(spark, d).filter(F.col("route").isin(routes))
        return df.select(*(cols or FLAT_COLS))
    return q


_in = lambda rs: ", ".join(f"'{r}'" for r in rs)
for _name, _routes, _cols in [
        ("extract_next_data", [U.ROUTE_NEXT_DATA], None),
        ("extract_inline_store", [U.ROUTE_INLINE_STORE], None),
        ("extract_dom_fields", [U.ROUTE_DOM_A, U.ROUTE_DOM_B], None),
        ("notes_rule", [U.ROUTE_NEXT_DATA], ["page_id", "notes"]),
        ("ingredients_nested", [U.ROUTE_NEXT_DATA, U.ROUTE_INLINE_STORE], ["page_id", "n_ingredient_groups", "ingredients"]),
        ("directions_nested", [U.ROUTE_NEXT_DATA, U.ROUTE_INLINE_STORE], ["page_id", "n_directions", "directions"])]:
    register(_name, f"WITH {_F7_BASE} SELECT {', '.join(_cols or FLAT_COLS)} FROM f7x WHERE route IN ({_in(_routes)})")(
        _route_subset(_routes, _cols))


@register("compose_ingredient", f"""WITH {_F7_BASE},
x AS (SELECT page_id, ingr, unnest(generate_series(1, len(ingr))) AS i FROM f7x WHERE route = 'next_data')
SELECT page_id, CAST(i AS INTEGER) AS ingredient_no, ingr[i] AS ingredient FROM x""")
def q_compose_ingredient(spark, d):
    """Next-data ingredient lines: quantity, unit text, item and modifier composed, tags stripped."""
    rec = X.recipes_of(_sites_extracted(spark, d)).filter(F.col("route") == U.ROUTE_NEXT_DATA)
    items = F.flatten(H.transform(F.col("recipe.ingredient_groups"), lambda g: g["ingredients"]))
    return (rec.select("page_id", F.posexplode(items).alias("pos", "ingredient"))
            .select("page_id", (F.col("pos") + 1).cast("int").alias("ingredient_no"), "ingredient"))


@register("em_dash_to_space", """
SELECT page_id, CAST(length(html) - length(replace(html, chr(8212), '')) AS INTEGER) AS n_em_dash,
       CAST(length(translate(html, chr(8212), ' ')) AS INTEGER) AS html_chars,
       strpos(translate(html, chr(8212), ' '), chr(8212)) = 0 AS dash_free FROM (SELECT page_id, html || '— a—b' AS html FROM pages)""")
def q_em_dash_to_space(spark, d):
    html = F.concat("html", F.lit("— a—b"))
    out = S.em_dash_to_space(html)
    n = F.length(html) - F.length(F.replace(html, F.lit(S.EM_DASH), F.lit("")))
    return read_table(spark, d, "pages").select(
        "page_id", n.cast("int").alias("n_em_dash"), F.length(out).cast("int").alias("html_chars"),
        (F.locate(S.EM_DASH, out) == 0).alias("dash_free"))


@register("assemble_groups", f"""WITH {_F7_BASE}
SELECT page_id, CAST(i - 1 AS INTEGER) AS group_pos, igroups[i].title AS group_title, CAST(len(igroups[i].items) AS INTEGER) AS n_items
FROM (SELECT page_id, igroups, unnest(range(1, len(igroups) + 1)) AS i FROM f7x)""")
def q_assemble_groups(spark, d):
    """Groups put together from flat rows, one for each item."""
    flat = R.flatten_items(X.recipes_of(_sites_extracted(spark, d)))
    return R.nest_items(flat).select("page_id", F.posexplode("ingredient_groups").alias("group_pos", "g")) \
        .select("page_id", "group_pos", F.col("g.title").alias("group_title"), F.size("g.ingredients").alias("n_items"))


@register("nest_items", f"""WITH {_F7_BASE}
SELECT page_id, array_to_string([g.title || ': ' || array_to_string(g.items, ' | ') for g in igroups], chr(10)) AS ingredients, directions FROM f7x""")
def q_nest_items(spark, d):
    """Flat item rows, dealt anew without any order, back to whole nested lists."""
    flat = R.flatten_items(X.recipes_of(_sites_extracted(spark, d))).repartition("item")
    groups = F.transform("ingredient_groups", lambda g: F.concat(g["title"], F.lit(": "), F.array_join(g["ingredients"], " | ")))
    return R.nest_items(flat).select("page_id", F.array_join(groups, "\n").alias("ingredients"),
                                     F.array_join(F.flatten(F.transform("direction_groups", lambda g: g["directions"])), " | ").alias("directions"))


@register("flatten_items", f"""WITH {_F7_BASE}
SELECT page_id, 'ingredients' AS section, CAST(CASE WHEN i > len(ingr) - 1 AND n_ingredient_groups = 2 THEN 1 ELSE 0 END AS INTEGER) AS group_pos,
       CAST(CASE WHEN i > len(ingr) - 1 AND n_ingredient_groups = 2 THEN 1 ELSE i END AS INTEGER) AS item_no, ingr[i] AS item
FROM f7x, generate_series(1, len(ingr)) AS t(i)
UNION ALL
SELECT page_id, 'directions', CAST(0 AS INTEGER), CAST(i AS INTEGER), dirs[i] FROM f7x, generate_series(1, len(dirs)) AS t(i)""")
def q_flatten_items(spark, d):
    rec = X.recipes_of(_sites_extracted(spark, d))
    return R.flatten_items(rec).select("page_id", "section", "group_pos", "item_no", "item")


@register("split_instructions", """
SELECT doc_id, CAST(i AS INTEGER) AS step_no, string_split(text, chr(10))[i] AS step
FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS t(i)""")
def q_split_instructions(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "step")) \
        .select("doc_id", (F.col("i") + 1).alias("step_no"), "step")


# ------------------------------------------------------------- rendering
from ..operators import render as RD  # noqa: E402
from ..sources import document_files as DF  # noqa: E402
from ..sources import recipe_json as RJ  # noqa: E402


def _f2_recipes(spark, d) -> DataFrame:
    return X.recipes_of(_f2_extracted(spark, d))


def _sites_recipes(spark, d) -> DataFrame:
    return X.recipes_of(_sites_extracted(spark, d))


_F2_DOC = f"WITH {_F2_BASE}, ok AS (SELECT * FROM f2x WHERE reason IS NULL) "


@register("doc_header", _F2_DOC + """
SELECT page_id, '## ' || title || chr(10) || chr(10) AS md_header,
       title || chr(10) || repeat('=', CAST(length(title) AS BIGINT)) || chr(10) || chr(10) AS rst_header FROM ok""")
def q_doc_header(spark, d):
    t = RD._s(F.col("recipe.title"))
    return _f2_recipes(spark, d).select("page_id", RD.header(t, "md", 1).alias("md_header"),
                                         RD.header(t, "rst", 1).alias("rst_header"))


_INFO_SQL = ("rtrim('| ' || (CASE WHEN p <> '' THEN 'Prep: ' || p || ' | ' ELSE '' END) || "
             "(CASE WHEN t <> '' THEN 'Total: ' || t || ' | ' ELSE '' END) || "
             "(CASE WHEN y <> '' THEN 'Yield: ' || y || ' | ' ELSE '' END))")


@register("doc_info_line", _F2_DOC + f""",
i AS (SELECT page_id, {_INFO_SQL} AS info FROM (SELECT page_id, {O.clean_text('preptime')} AS p,
      {O.clean_text('totaltime')} AS t, {O.clean_text('yield')} AS y FROM ok))
SELECT page_id, CASE WHEN info = '|' THEN '' ELSE regexp_replace(info, '[^|]', '-', 'g') || chr(10) || info || chr(10)
       || regexp_replace(info, '[^|]', '-', 'g') || chr(10) || chr(10) END AS md_info,
       CASE WHEN info = '|' THEN '' ELSE replace(regexp_replace(info, '[^|]', '-', 'g'), '|', '+') || chr(10) || info
       || chr(10) || replace(regexp_replace(info, '[^|]', '-', 'g'), '|', '+') || chr(10) || chr(10) END AS rst_info
FROM i""")
def q_doc_info_line(spark, d):
    r = F.col("recipe")
    # Clean each field once: the info line references every field several
    # times, and inlining the cleaning chain there overflows generated code.
    staged = _f2_recipes(spark, d).select("page_id", RD._s(r["preptime"]).alias("p"),
                                          RD._s(r["totaltime"]).alias("t"), RD._s(r["yield"]).alias("y"))
    p, t, y = F.col("p"), F.col("t"), F.col("y")
    return staged.select("page_id", RD.info_line(p, t, y, "md").alias("md_info"),
                         RD.info_line(p, t, y, "rst").alias("rst_info"))


@register("doc_source_line", _F2_DOC + f"""
SELECT page_id, 'Source: [' || (CASE WHEN author = '' THEN {O.url_domain('url')} ELSE author END) || '](' || url || ')' || chr(10) || chr(10) AS md_source,
       'Source: `' || (CASE WHEN author = '' THEN {O.url_domain('url')} ELSE author END) || ' <' || url || '>`__' || chr(10) || chr(10) AS rst_source
FROM ok""")
def q_doc_source_line(spark, d):
    r = F.col("recipe")
    u, a = RD._s(r["url"]), RD._s(r["author"])
    return _f2_recipes(spark, d).select("page_id", RD.source_line(u, a, "md").alias("md_source"),
                                         RD.source_line(u, a, "rst").alias("rst_source"))


@register("format_fanout", _F2_DOC + """
SELECT f.format, count(*) AS n_docs FROM ok, (VALUES ('json'), ('md'), ('rst')) AS f(format) GROUP BY f.format""")
def q_format_fanout(spark, d):
    docs = RD.render_docs(_f2_recipes(spark, d), ["json", "md", "rst"])
    return docs.groupBy("format").agg(F.count(F.lit(1)).alias("n_docs"))


@register("filename_collision", _F2_DOC + """
SELECT regexp_replace(title, '[^\\p{L}\\p{N}_]+', '', 'g') || '.md' AS filename, max(page_id) AS page_id,
       count(*) AS n_candidates FROM ok GROUP BY 1""")
def q_filename_collision(spark, d):
    docs = RD.render_docs(_f2_recipes(spark, d), ["md"])
    return RD.filename_collision(docs).select("filename", "page_id", "n_candidates")


def _sink_query(fmt: str):
    def q(spark, d):
        docs = RD.render_docs(_f2_recipes(spark, d), [fmt])
        path = RD.sink_documents(docs, scratch_path(spark, f"documents-{fmt}"))
        back = spark.read.parquet(path).filter(F.col("format") == fmt)
        return back.select("page_id", "filename", "body")
    return q


# Recipes of both corpora as documents need them; ``notes`` is NULL where there are none.
_F2_SOURCE = """SELECT 1 AS corpus, page_id, title, description, yield, preptime, totaltime, cooktime, url, author,
  [{'title': '', 'items': string_split(ingredients, ' | ')}] AS igroups, string_split(directions, ' | ') AS dirs, CAST(NULL AS VARCHAR) AS notes, false AS timeless FROM f2x WHERE reason IS NULL"""
_F7_SOURCE = """SELECT 2 AS corpus, page_id, title, description, yield, preptime, totaltime, cooktime, url, author, igroups, dirs,
  CASE WHEN route = 'next_data' THEN notes END AS notes, route = 'dom_squarespace' AS timeless FROM f7x"""


def _document_sql(fmt: str, both: bool = False) -> str:
    """Whole documents: of the JSON-LD recipes, or of ``both`` corpora."""
    source = f"{_F2_SOURCE} UNION ALL {_F7_SOURCE}" if both else _F2_SOURCE
    base = f"WITH RECURSIVE {_F2_BASE}, {_F7_BASE}" if both else f"WITH RECURSIVE {_F2_BASE}"
    name = f"regexp_replace(title, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') || '.{fmt}' AS filename"
    if fmt == "json":
        scalars = [("url", None), ("title", None), ("description", None), ("yield", None), ("preptime", "NOT timeless"),
                   ("cooktime", "NOT timeless"), ("totaltime", "NOT timeless"), ("author", None)]
        fields = [f"CASE WHEN {when or 'true'} THEN '\"{c}\": ' || {O.json_text(c)} END" for c, when in scalars]

        def group(title: str, items: str, texts: str) -> str:
            inner = O.json_list(f"[{O.json_text('y')} for y in {texts}]", 3)
            pad = "chr(10) || '" + " " * 12 + "'"
            return f"'{{' || {pad} || '\"{title}\": ' || {O.json_text('g.title')} || ',' || {pad} || '\"{items}\": ' || {inner} || chr(10) || '        }}'"
        fields.append("'\"ingredient_groups\": ' || " + O.json_list(f"[{group('title', 'ingredients', 'g.items')} for g in igroups]", 1))
        fields.append("'\"direction_groups\": ' || " + O.json_list(f"[{group('group', 'directions', 'g.items')} for g in [{{'title': '', 'items': dirs}}]]", 1))
        fields.append(f"CASE WHEN notes IS NOT NULL THEN '\"notes\": ' || {O.json_list('[' + O.json_text('notes') + ']', 1)} END")
        return f"""{base}, src AS ({source}),
named AS (SELECT *, {O.clean_text('title')} AS shown FROM src)
SELECT page_id, 'json' AS format, {name.replace('title', 'shown')},
       '{{' || chr(10) || '    ' || concat_ws(',' || chr(10) || '    ', {', '.join(fields)}) || chr(10) || '}}' AS body FROM named"""

    def head(text: str, level: int) -> str:
        if fmt == "md":
            return f"'{'#' * (level + 1)} ' || {text} || chr(10) || chr(10)"
        return f"{text} || chr(10) || repeat('{'=-^'[level - 1]}', CAST(length({text}) AS BIGINT)) || chr(10) || chr(10)"
    who = f"(CASE WHEN author = '' THEN {O.url_domain('url')} ELSE author END)"
    link = f"'Source: [' || {who} || '](' || url || ')'" if fmt == "md" else f"'Source: `' || {who} || ' <' || url || '>`__'"
    line = "regexp_replace(info, '[^|]', '-', 'g')" if fmt == "md" else "replace(regexp_replace(info, '[^|]', '-', 'g'), '|', '+')"
    info = f"(CASE WHEN info = '|' THEN '' ELSE {line} || chr(10) || info || chr(10) || {line} || chr(10) || chr(10) END)"
    bullet = "*" if fmt == "md" else "-"
    items = (f"array_to_string([(CASE WHEN g.title = '' THEN '' ELSE (CASE WHEN gi > 1 THEN chr(10) ELSE '' END) || {head('g.title', 3)} END) || "
             f"array_to_string(['{bullet} ' || y || chr(10) for y in g.items], '') for g, gi in igroups], '')")
    cleaned = ", ".join(f"{O.clean_text(c)} AS {n}" for c, n in
                        [("title", "title"), ("description", "description"), ("preptime", "p"), ("totaltime", "t"), ("yield", "y"), ("url", "url"), ("author", "author")])
    return f"""{base}, src AS MATERIALIZED ({source}),
doc AS MATERIALIZED (SELECT corpus, page_id, igroups, dirs, notes, row_number() OVER (ORDER BY corpus, page_id) * 1000000 AS did, {cleaned} FROM src),
part AS MATERIALIZED (SELECT did + 1 AS wid, description AS x, '' AS p FROM doc UNION ALL SELECT did + 2, replace(notes, '***', ''), '' FROM doc WHERE notes IS NOT NULL
         UNION ALL SELECT did + 10 + i, dirs[i], CAST(i AS VARCHAR) || '. ' FROM (SELECT did, dirs, unnest(range(1, len(dirs) + 1)) AS i FROM doc)),
{O.wrapped_ctes('part', 'wrapped')},
steps AS (SELECT wid // 1000000 * 1000000 AS did, string_agg(body, '' ORDER BY wid) AS body FROM wrapped WHERE wid % 1000000 > 10 GROUP BY 1),
lined AS (SELECT doc.*, {_INFO_SQL} AS info, coalesce(a.body, '') AS about, coalesce(s.body, '') AS steps, coalesce(n.body, '') AS said FROM doc
          LEFT JOIN wrapped AS a ON a.wid = did + 1 LEFT JOIN wrapped AS n ON n.wid = did + 2 LEFT JOIN steps AS s ON s.did = doc.did)
SELECT page_id, '{fmt}' AS format, {name},
       {head('title', 1)} || {info} || {link} || chr(10) || chr(10) || about || chr(10) ||
       {head("'Ingredients'", 2)} || {items} || chr(10) || {head("'Directions'", 2)} || steps ||
       (CASE WHEN notes IS NULL THEN '' ELSE chr(10) || {head("'Notes'", 2)} || said || chr(10) END) AS body FROM lined"""


for _fmt in ["md", "rst", "json"]:
    register(f"render_{_fmt}", _document_sql(_fmt, both=True))((lambda fmt: lambda spark, d: RD.render_docs(
        _sites_recipes(spark, d).unionByName(_f2_recipes(spark, d)), [fmt]))(_fmt))


for _fmt in ["md", "rst"]:
    register(f"sink_{_fmt}", f"SELECT page_id, filename, body FROM ({_document_sql(_fmt)})")(_sink_query(_fmt))


@register("doc_wrap", f"""WITH RECURSIVE
d AS MATERIALIZED (SELECT row_number() OVER () * 1000000 AS did, doc_id, string_split(text, chr(10)) AS lines FROM documents),
part AS MATERIALIZED (SELECT did + i AS wid, lines[i] AS x, CAST(i AS VARCHAR) || '. ' AS p FROM (SELECT did, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
{O.wrapped_ctes('part', 'wrapped')},
blocks AS (SELECT wid // 1000000 * 1000000 AS did, string_agg(body, '' ORDER BY wid) AS block FROM wrapped GROUP BY 1)
SELECT doc_id, coalesce(block, '') AS block FROM d LEFT JOIN blocks USING (did)""")
def q_doc_wrap(spark, d):
    """Directions of every document line wrapped at 75 with numbered prefixes."""
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", RD.wrap_groups(F.array(F.split("text", "\n")), "numbered").alias("block"))


@register("document_files", f"""SELECT filename, arg_max(body, page_id) AS body FROM ({_document_sql('md')}) GROUP BY filename""")
def q_document_files(spark, d):
    """Markdown documents written as one file each, the last one of each name, and read back."""
    path = DF.write_document_files(RD.render_docs(_f2_recipes(spark, d), ["md"]), scratch_path(spark, "document-files"))
    return DF.scan_document_files(spark, path)


_RECIPE_JSON_SQL = "'{' || " + " || ',' || ".join(
    [f"'\"{c}\":' || to_json({c})" for c in ("url", "title", "description", "yield", "preptime", "cooktime", "totaltime", "author")]
    + ["'\"ingredient_groups\":[{\"title\":\"\",\"ingredients\":' || to_json(string_split(ingredients, ' | ')) || '}]'",
       "'\"direction_groups\":[{\"group\":\"\",\"directions\":' || to_json(string_split(directions, ' | ')) || '}]'"]) + " || '}'"


@register("sink_json", _F2_DOC + f"""
SELECT page_id, '{{"page_id":' || CAST(page_id AS VARCHAR) || ',"recipe":' || {_RECIPE_JSON_SQL} || '}}' AS line FROM ok""")
def q_sink_json(spark, d):
    """Whole records, as written."""
    back = spark.read.text(RJ.sink_json(_f2_recipes(spark, d), spark))
    return back.select(F.get_json_object("value", "$.page_id").cast("bigint").alias("page_id"), F.col("value").alias("line"))


@register("render_json_ldjson", f"SELECT page_id, filename, body FROM ({_document_sql('json')})")
def q_render_json_ldjson(spark, d):
    return RD.render_docs(_f2_recipes(spark, d), ["json"]).select("page_id", "filename", "body")


@register("scan_recipe_json", f"WITH {_F2_BASE} SELECT {', '.join(FLAT_COLS)} FROM f2x WHERE reason IS NULL")
def q_scan_recipe_json(spark, d):
    path = RJ.sink_recipe_files(_f2_recipes(spark, d), spark)
    return _flat(RJ.scan_recipe_json(spark, path))


# ----------------------------------------------------------------------- QA
from ..operators import golden as G  # noqa: E402
from ..operators import linediff as LD  # noqa: E402
from ..sources import manifest as M  # noqa: E402

_MANIFEST_SQL = """
m0 AS (SELECT page_id * 2 AS line_no, CASE WHEN page_id % 10 = 0 THEN '# section ' || CAST(page_id AS VARCHAR)
                                          WHEN page_id % 7 = 0 THEN ' ' || chr(9) || ' ' END AS value FROM pages
       UNION ALL
       SELECT page_id * 2 + CASE WHEN page_id % 10 = 0 OR page_id % 7 = 0 THEN 1 ELSE 0 END,
              CASE WHEN page_id % 6 = 2 THEN '  ' ELSE '' END || url || '|page_' || CAST(page_id AS VARCHAR) || '.' ||
              (['rst', 'md', 'json'])[page_id % 3 + 1] || CASE WHEN page_id % 4 = 1 THEN '  # checked' ELSE '' END
       FROM pages),
m1 AS (SELECT line_no, regexp_replace(regexp_replace(value, '#.*$', ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t
       FROM m0 WHERE value IS NOT NULL),
m2 AS (SELECT line_no, CASE WHEN contains(t, '|') THEN split_part(t, '|', 1) ELSE t END AS url,
              CASE WHEN contains(t, '|') THEN split_part(t, '|', 2) ELSE t END AS ref_file FROM m1 WHERE t <> '')
"""


def _manifest(spark, d) -> DataFrame:
    return M.parse_manifest(M.manifest_lines_from_pages(read_table(spark, d, "pages")))


def _in_unequal_files(df: DataFrame, order: list, spread: str, n_files: int = 7) -> DataFrame:
    """``df`` in file order by ``order``: ranges of a column that grows with the order, so files differ in size."""
    return df.repartitionByRange(n_files, F.col(spread), *order).sortWithinPartitions(*order)


@register("scan_manifest", f"""WITH {_MANIFEST_SQL},
dense AS (SELECT line_no, row_number() OVER (ORDER BY line_no) AS dense_no FROM m0 WHERE value IS NOT NULL)
SELECT dense_no AS line_no, url, ref_file, CASE regexp_extract(ref_file, '[^.]*$') WHEN 'rst' THEN 'rst' WHEN 'md' THEN 'md'
       WHEN 'json' THEN 'json' END AS format FROM m2 JOIN dense USING (line_no)""")
def q_scan_manifest(spark, d):
    """A folder of manifest files of unequal size, its lines numbered through."""
    path = scratch_path(spark, "manifest")
    lines = M.manifest_lines_from_pages(read_table(spark, d, "pages")).withColumn("spread", F.floor(F.log2(F.col("line_no") + 1)))
    _in_unequal_files(lines, ["line_no"], "spread").select("value").write.text(path)
    return M.scan_manifest(spark, path).select("line_no", "url", "ref_file", "format")


@register("input_pos", _F2_DOC + """,
p AS (SELECT *, row_number() OVER (ORDER BY title DESC, page_id) - 1 AS input_pos FROM ok)
SELECT input_pos, page_id, title FROM p""")
def q_input_pos(spark, d):
    """Stored recipe records of a folder, in the order in which they stand in its files."""
    return _stored_recipes(spark, d).select("input_pos", "page_id", F.col("recipe.title").alias("title"))


def _stored_recipes(spark, d) -> DataFrame:
    """The JSON-LD recipes stored by falling title, so that input order is not key order."""
    path = scratch_path(spark, "recipe-files")
    rec = _f2_recipes(spark, d).withColumn("title", F.col("recipe.title"))
    order = [F.col("title").desc(), F.col("page_id")]
    rec.repartitionByRange(7, *order).sortWithinPartitions(*order).select("page_id", "recipe.*").write.json(path)
    return RJ.scan_recipe_json(spark, path, pos="input_pos")


@register("filename_collision_input_order", _F2_DOC + """,
p AS (SELECT *, row_number() OVER (ORDER BY title DESC, page_id) - 1 AS input_pos FROM ok)
SELECT 'dish_' || substr(author, 1, 3) || '.md' AS filename, max(input_pos) AS input_pos, arg_max(page_id, input_pos) AS page_id, count(*) AS n_candidates
FROM p GROUP BY 1""")
def q_filename_collision_input_order(spark, d):
    """Which stored record's document is left under each name: the last one in input order."""
    rec = _stored_recipes(spark, d)
    docs = RD.render_docs(rec.withColumn("key", F.struct("input_pos", "page_id")), ["md"], key="key")
    named = docs.join(rec.select(F.struct("input_pos", "page_id").alias("key"), F.col("recipe.author").alias("author")), "key")
    named = named.select(F.col("key.input_pos").alias("input_pos"), F.col("key.page_id").alias("page_id"), "format", "body",
                         F.concat(F.lit("dish_"), F.substring("author", 1, 3), F.lit(".md")).alias("filename"))
    won = RD.filename_collision(named, "input_pos").select("filename", "input_pos", "n_candidates")
    return won.join(named.select("input_pos", "page_id"), "input_pos").select("filename", "input_pos", "page_id", "n_candidates")


@register("manifest_write", f"WITH {_MANIFEST_SQL} SELECT url, ref_file FROM m2")
def q_manifest_write(spark, d):
    path = M.write_manifest(_manifest(spark, d), scratch_path(spark, "manifest"))
    return M.scan_manifest(spark, path).select("url", "ref_file")


@register("manifest_append", f"""WITH {_MANIFEST_SQL}, n AS (SELECT min(line_no) AS first, max(line_no) AS last FROM m2)
SELECT line_no, url, ref_file FROM m2 UNION ALL SELECT line_no - first + last + 1, url, 'again_' || ref_file FROM m2, n""")
def q_manifest_append(spark, d):
    """Ad-hoc tests of the same addresses after the loaded ones, numbered on."""
    m = _manifest(spark, d)
    again = m.withColumn("ref_file", F.concat(F.lit("again_"), "ref_file"))
    return M.manifest_append(m, again).select("line_no", "url", "ref_file")


def _run_documents(spark, d) -> DataFrame:
    """Every address captured twice (``captured`` 0 and 1) in all formats; the older document holds something else.

    The address comes along with the recipe: rendering is one narrow pass, which is planned once and moves no body."""
    recipes = _f2_extracted(spark, d).where("reason IS NULL").select(F.struct("page_id", "url").alias("page"), "recipe")
    docs = RD.render_docs(recipes, ["json", "md", "rst"], key="page")
    twice = F.array(F.concat(F.lit("as it was "), "body"), F.col("body"))
    return docs.select("page.page_id", "page.url", "format", F.posexplode(twice).alias("captured", "body"))


def _run_inputs(spark, d):
    """Tests over the JSON-LD pages, their rendered documents and references: the
    document itself with other blanks, changed for ``page_id % 5 = 0``, absent for ``page_id % 7 = 3``.

    Documents are rendered and written once."""
    pages = FX.ldjson_pages(spark, d).select("page_id", "url")
    tests = M.parse_manifest(M.manifest_lines_from_pages(pages))
    path = scratch_path(spark, "run-documents")
    _run_documents(spark, d).write.parquet(path)
    docs = spark.read.parquet(path)
    ext = F.element_at(F.array(F.lit("rst"), F.lit("md"), F.lit("json")), (F.col("page_id") % 3 + 1).cast("int"))
    named = pages.withColumn("format", ext).withColumn("ref_file", F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit("."), ext))
    body = F.coalesce(F.replace(F.col("body"), F.lit("\n"), F.lit(" \n\n")), F.lit("what was there before"))
    now = docs.where("captured = 1").select("page_id", "format", "body")
    reference = (named.where("page_id % 7 <> 3").join(now, ["page_id", "format"], "left")
                 .select("ref_file", F.when(F.col("page_id") % 5 == 0, F.concat(body, F.lit("\nchanged"))).otherwise(body).alias("body")))
    return tests, docs.select("url", "format", "captured", "body"), reference


_RUN_SQL = f"""WITH {_F2_BASE},
run AS (SELECT page_id, page_id * 2 + CASE WHEN page_id % 10 = 0 OR page_id % 7 = 0 THEN 1 ELSE 0 END AS line_no, url, reason,
               'page_' || CAST(page_id AS VARCHAR) || '.' || (['rst', 'md', 'json'])[page_id % 3 + 1] AS ref_file FROM f2x)
"""


@register("golden_run", _RUN_SQL + """
SELECT line_no, url, ref_file, CASE WHEN page_id % 7 = 3 THEN 'MISSING' WHEN reason IS NOT NULL THEN 'ERROR'
       WHEN page_id % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, reason IS NULL AS has_output FROM run""")
def q_golden_run(spark, d):
    return G.golden_run(*_run_inputs(spark, d), order_col="captured")


@register("golden_new_references", _RUN_SQL + "SELECT ref_file FROM run WHERE reason IS NULL AND page_id % 7 = 3")
def q_golden_new_references(spark, d):
    tests, docs, reference = _run_inputs(spark, d)
    verdicts = G.golden_run(tests, docs, reference, "captured")
    return G.golden_missing(verdicts, G.produced(tests, docs, "captured")).where("length(body) > 0").select("ref_file")


@register("golden_reset", _RUN_SQL + "SELECT ref_file FROM run WHERE reason IS NULL")
def q_golden_reset(spark, d):
    tests, docs, _ = _run_inputs(spark, d)
    return G.golden_reset(tests, docs, "captured").where("body not like 'as it was%'").select("ref_file")


def _golden_inputs(spark, d):
    """documents as reference files; the 'actual' output of each test is the
    document altered by ``doc_id % 5`` (0: extra line, 1: trailing blanks and
    blank lines only); references of ``doc_id % 7 = 3`` are absent."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    did = F.col("doc_id")
    ref_file = F.concat(F.lit("doc_"), did.cast("string"), F.lit(".rst"))
    tests = docs.select(did.alias("line_no"), F.concat(F.lit("https://docs.example/"), did.cast("string")).alias("url"),
                        ref_file.alias("ref_file"))
    act = (F.when(did % 5 == 0, F.concat("text", F.lit("\nALTERED LINE")))
           .when(did % 5 == 1, F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("  \n\n")), F.lit("\t ")))
           .otherwise(F.col("text")))
    actual = docs.select(did.alias("line_no"), act.alias("body"))
    reference = docs.filter(did % 7 != 3).select(ref_file.alias("ref_file"), F.col("text").alias("body"))
    return tests, actual, reference


_GOLDEN_SQL = """
g0 AS (SELECT doc_id, 'https://docs.example/' || CAST(doc_id AS VARCHAR) AS url, 'doc_' || CAST(doc_id AS VARCHAR) || '.rst' AS ref_file,
              CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'ALTERED LINE'
                   WHEN doc_id % 5 = 1 THEN replace(text, chr(10), '  ' || chr(10) || chr(10)) || chr(9) || ' '
                   ELSE text END AS act, CASE WHEN doc_id % 7 <> 3 THEN text END AS ref FROM documents),
g1 AS (SELECT doc_id, url, ref_file, act, ref,
              list_filter(list_transform(string_split(act, chr(10)), lambda l: rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda l: l <> '') AS a,
              list_filter(list_transform(string_split(ref, chr(10)), lambda l: rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda l: l <> '') AS r
       FROM g0),
g2 AS (SELECT doc_id AS line_no, url, ref_file, act,
              CASE WHEN coalesce(length(ref), 0) = 0 THEN 'MISSING' WHEN act IS NULL THEN 'ERROR'
                   WHEN a = r THEN 'PASS' ELSE 'FAIL' END AS status FROM g1)
"""


def _verdicts(spark, d):
    return G.golden_diff(*_golden_inputs(spark, d))


register("golden_diff", f"WITH {_GOLDEN_SQL} SELECT line_no, url, ref_file, status FROM g2")(
    lambda spark, d: _verdicts(spark, d).select("line_no", "url", "ref_file", "status"))


def _golden_sides(spark, d):
    """As ``_golden_inputs``, but every document's reference exists: where the test names an absent
    file, the document's own file is named by no test.  Each ``doc_id % 3 = 0`` file was written
    twice, its older body first."""
    tests, actual, _ = _golden_inputs(spark, d)
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    did = F.col("doc_id")
    name = F.concat(F.lit("doc_"), did.cast("string"), F.lit(".rst"))
    tests = tests.withColumn("ref_file", F.when(F.col("line_no") % 7 == 3, F.concat(F.lit("new_"), "ref_file")).otherwise(F.col("ref_file")))
    written = F.when(did % 3 == 0, F.array(F.concat(F.lit("before "), "text"), F.col("text"))).otherwise(F.array("text"))
    reference = docs.select(name.alias("ref_file"), F.posexplode(written).alias("written_pos", "body"))
    return tests, actual, reference


@register("golden_join", f"""WITH {_GOLDEN_SQL},
t AS (SELECT line_no, url, CASE WHEN line_no % 7 = 3 THEN 'new_' || ref_file ELSE ref_file END AS ref_file, act FROM g2),
r AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.rst' AS ref_file, text AS body FROM documents),
j AS (SELECT coalesce(t.ref_file, r.ref_file) AS ref_file, line_no, url, act, r.body, t.ref_file IS NOT NULL AS is_test, r.ref_file IS NOT NULL AS is_ref
      FROM t FULL JOIN r ON t.ref_file = r.ref_file)
SELECT ref_file, line_no, url, CASE WHEN is_test AND is_ref THEN 'both' WHEN is_test THEN 'test' ELSE 'reference' END AS side,
       act IS NOT NULL AS has_output, coalesce(length(body) > 0, false) AS has_reference,
       is_test AND is_ref AND line_no % 5 <> 0 AS same FROM j""")
def q_golden_join(spark, d):
    return G.golden_join(*_golden_sides(spark, d), order_col="written_pos")


register("golden_missing", f"WITH {_GOLDEN_SQL} SELECT ref_file, act AS body FROM g2 WHERE status = 'MISSING'")(
    lambda spark, d: G.golden_missing(_verdicts(spark, d), _golden_inputs(spark, d)[1]))
register("status_counts", f"WITH {_GOLDEN_SQL} SELECT status, count(*) AS n_tests FROM g2 GROUP BY status")(
    lambda spark, d: G.status_counts(_verdicts(spark, d)))


def _edited_inputs(spark, d):
    """Documents as reference files and as output, each with a line of its own: the output's is put
    after line ``doc_id % 7``, the reference's after line ``doc_id % 4`` (or at the end); those
    of ``doc_id % 3 = 0`` differ in blanks only."""
    docs = read_table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    did = F.col("doc_id")

    def with_line(word: str, after) -> object:
        at = F.least(after, F.size("lines"))
        own = F.array(F.concat(F.lit(word + " "), did.cast("string"), F.lit(" \t")))
        return F.array_join(F.concat(F.slice("lines", 1, at), own, F.slice("lines", at + 1, F.size("lines"))), "\n")
    ref_file = F.concat(F.lit("doc_"), did.cast("string"), F.lit(".rst"))
    tests = docs.select(did.alias("line_no"), F.concat(F.lit("https://docs.example/"), did.cast("string")).alias("url"), ref_file.alias("ref_file"))
    same = did % 3 == 0
    actual = docs.select(did.alias("line_no"), F.when(same, F.array_join("lines", " \n\n")).otherwise(with_line("NEW", did % 7)).alias("body"))
    reference = docs.select(ref_file.alias("ref_file"), F.when(same, F.array_join("lines", "\n")).otherwise(with_line("OLD", did % 4)).alias("body"))
    return tests, actual, reference


@register("golden_edits", """WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 3 <> 0),
e AS (SELECT doc_id, '-' AS side, least(doc_id % 4, n) + 1 AS position, 'OLD ' || CAST(doc_id AS VARCHAR) AS text FROM d
      UNION ALL SELECT doc_id, '+', least(doc_id % 7, n) + 1, 'NEW ' || CAST(doc_id AS VARCHAR) FROM d)
SELECT doc_id AS line_no, 'https://docs.example/' || CAST(doc_id AS VARCHAR) AS url, 'doc_' || CAST(doc_id AS VARCHAR) || '.rst' AS ref_file,
       side, position, text FROM e""")
def q_golden_edits(spark, d):
    """Lines that turn a failed test's reference file into what it produced."""
    tests, actual, reference = _edited_inputs(spark, d)
    return LD.failed_edits(G.golden_diff(tests, actual, reference), actual, reference)


def _coverage_sql() -> str:
    return f"""WITH {_F2_BASE}, {_F7_BASE}
SELECT route, sum(n_pages) AS n_pages, sum(n_recipes) AS n_recipes, sum(n_rejected) AS n_rejected FROM (
  SELECT 'ldjson' AS route, count(*) AS n_pages, 0 AS n_recipes, count(*) AS n_rejected FROM pages
  UNION ALL SELECT 'ldjson', count(*), count(*) FILTER (WHERE reason IS NULL), count(*) FILTER (WHERE reason IS NOT NULL) FROM f2x
  UNION ALL SELECT route, count(*), count(*), 0 FROM f7x GROUP BY route) GROUP BY route"""


@register("route_coverage", _coverage_sql())
def q_route_coverage(spark, d):
    real = X.extracted(spark, "pages", lambda s, dd: scan_pages(s, dd), d)
    allx = real.unionByName(_f2_extracted(spark, d)).unionByName(_sites_extracted(spark, d))
    return G.route_coverage(allx)


@register("reject_pages_crawl", "SELECT page_id, url, 'ldjson' AS route, 'no_ldjson' AS reason FROM pages")
def q_reject_pages_crawl(spark, d):
    return X.rejects_of(X.extracted(spark, "pages", lambda s, dd: scan_pages(s, dd), d))
