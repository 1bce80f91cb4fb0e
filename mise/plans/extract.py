"""Pages -> recipes + rejects, in a single narrow pass over the scan.

Every route is a CASE branch of one projection; the UDF of the site routes sees NULL for
pages of other routes.  No shuffle: the plan is scan -> project (-> filter),
so it scales with the number of input splits and is immune to domain skew.
(The one exception: an input with fewer splits than cores is first spread
by page key, see ``spread_for_cores``.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import clean_text
from ..operators import ldjson as L
from ..operators import microdata as MD
from ..operators import sites as S
from ..session import BATCH_BYTES, BATCH_BYTES_KEY
from ..sources.tables import TABLE_CODEC

REASON_NO_LDJSON = "no_ldjson"
REASON_NO_CANDIDATE = "no_recipe_candidate"
REASON_NO_NEXT_DATA = "no_next_data"
REASON_NO_STORE = "no_inline_store"
REASON_EMPTY_TITLE = "empty_title"

# Whether, and in which order, the second extractor (microdata) is asked.
FALLBACK_NONE, FALLBACK_DEFAULT, FALLBACK_FORCED = "none", "default", "forced"
EXTRACTOR_OF_ROUTE = {U.ROUTE_LDJSON: "ldjson", U.ROUTE_NEXT_DATA: "next_data", U.ROUTE_INLINE_STORE: "inline_store",
                      U.ROUTE_DOM_A: "dom", U.ROUTE_DOM_B: "dom"}
EXTRACTOR_SECOND = "microdata"


def extract(pages: DataFrame, key: str = "page_id", fallback: str = FALLBACK_NONE) -> DataFrame:
    """``(page_id, url, domain, publisher, route, recipe, reason)``; exactly one of
    ``recipe`` / ``reason`` is set per page.

    ``fallback`` adds the second extractor and the column ``extractor``, the one that made the
    recipe: ``default`` asks it for JSON-LD pages without a recipe candidate (a candidate
    that turns out broken stays a reject); ``forced`` asks it first on JSON-LD and inline-store
    pages and falls through to the route's own extractor where it fails.
    """
    routed = U.route_pages(pages)
    route, html = F.col("route"), F.col("html")
    layout = F.when(route == U.ROUTE_DOM_A, F.lit(S.KIND_DOM_A)).when(route == U.ROUTE_DOM_B, F.lit(S.KIND_DOM_B))
    kind = F.coalesce(layout, F.when(route == U.ROUTE_NEXT_DATA, F.lit(S.KIND_NEXT_DATA)).when(route == U.ROUTE_INLINE_STORE, F.lit(S.KIND_STORE)))
    # The UDF gets NULL html for pages of any other route.
    given = F.when(layout.isNotNull(), S.em_dash_to_space(html)).when(kind.isNotNull(), html)
    routed = routed.withColumn("_site", S.site_fields(given.cast("binary"), kind))
    unread = ~F.coalesce(F.col("_site.plain"), F.lit(False))
    routed = S.add_inline_store_content(routed, F.when((route == U.ROUTE_INLINE_STORE) & unread, html), "_store")
    df = routed.select(
        key, "url", "domain", "publisher", "route",
        *([] if fallback == FALLBACK_NONE else ["html"]),
        L.scripts_of(F.when(route == U.ROUTE_LDJSON, html)).alias("_scripts"),
        S.next_data_document(F.when((route == U.ROUTE_NEXT_DATA) & unread, html)).alias("_nd"),
        "_store", "_site",
        layout.alias("_layout"))
    df = df.withColumn("_cand", L.pick_candidate(F.col("_scripts")))
    df = L.add_ldjson_recipe(df, "_cand.raw")
    # Whose pages are read is asked for once more, as the struct is of three kinds of pages.
    df = df.withColumns({"_nd_site": F.when(route == U.ROUTE_NEXT_DATA, F.col("_site")), "_st_site": F.when(route == U.ROUTE_INLINE_STORE, F.col("_site"))})
    df = S.add_next_data_recipe(df, "_nd", fields="_nd_site")
    df = S.add_inline_store_recipe(df, "_store", fields="_st_site")
    df = S.add_dom_recipe(df, "_site", "_layout")
    df = df.withColumn("recipe", F.coalesce("_rec_ld", "_rec_nd", "_rec_st", "_rec_dom"))
    if fallback != FALLBACK_NONE:
        df = _with_second_extractor(df, fallback)
    df = df.withColumn("_title_ok", F.coalesce(clean_text(F.col("recipe.title")), F.lit("")) != "")
    is_ld = route == U.ROUTE_LDJSON
    reason = (F.when(is_ld & (F.coalesce(F.size("_scripts"), F.lit(0)) == 0), F.lit(REASON_NO_LDJSON))
              .when(is_ld & F.col("_cand.raw").isNull(), F.lit(REASON_NO_CANDIDATE))
              .when(is_ld & F.col("_ld_reason").isNotNull(), F.col("_ld_reason"))
              .when((route == U.ROUTE_NEXT_DATA) & F.col("_nd").isNull() & unread, F.lit(REASON_NO_NEXT_DATA))
              .when((route == U.ROUTE_INLINE_STORE) & F.col("_store").isNull() & unread, F.lit(REASON_NO_STORE))
              .when(F.col("_layout").isNotNull() & ~F.coalesce(F.col("_site.ok"), F.lit(False)),
                    F.coalesce(F.col("_site.reason"), F.lit("dom_parse_error")))
              .when(~F.col("_title_ok"), F.lit(REASON_EMPTY_TITLE)))
    if fallback != FALLBACK_NONE:
        reason = F.when(~F.col("_second"), reason).when(~F.col("_title_ok"), F.lit(REASON_EMPTY_TITLE))
    df = df.withColumn("reason", reason)
    out = df.select(key, "url", "domain", "publisher", "route",
                    F.when(F.col("reason").isNull(), F.col("recipe")).alias("recipe"), "reason",
                    *([] if fallback == FALLBACK_NONE else [F.when(F.col("reason").isNull(), F.col("extractor")).alias("extractor")]))
    return out


def _with_second_extractor(df: DataFrame, fallback: str) -> DataFrame:
    """Fall through from one extractor to the other; ``_second`` says that the second one made the recipe."""
    on_ld = F.col("route") == U.ROUTE_LDJSON
    if fallback == FALLBACK_FORCED:
        asked = on_ld | (F.col("route") == U.ROUTE_INLINE_STORE)
    elif fallback == FALLBACK_DEFAULT:
        asked = on_ld & F.col("_cand.raw").isNull()
    else:
        raise ValueError(f"unknown fallback {fallback!r}")
    df = MD.add_microdata_recipe(df, F.when(asked, F.col("html")), "_rec_md")
    own = F.element_at(F.create_map(*[F.lit(x) for kv in EXTRACTOR_OF_ROUTE.items() for x in kv]), F.col("route"))
    return (df.withColumn("_second", F.col("_rec_md").isNotNull())
            .withColumn("extractor", F.when(F.col("_second"), F.lit(EXTRACTOR_SECOND)).otherwise(own))
            .withColumn("recipe", F.coalesce("_rec_md", "recipe")).drop("html"))


def spread_for_cores(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Extraction is CPU-bound per page and map-only, so its parallelism is the
    number of input splits.  Pages that arrive in fewer splits than there are
    cores are hash-distributed by page key first; with enough splits, the normal
    case for a large crawl, the plan stays shuffle-free.  Only the number of planned
    splits is looked at, and no output column depends on it."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return pages
    return pages.repartition(cores, key)


def run_extraction(pages: DataFrame, out_path: str, key: str = "page_id") -> DataFrame:
    """Write the extraction result once and return its scan.

    One pass over the pages produces both outputs (recipes and rejects); the
    written table cuts the lineage, so a lost executor never re-runs the
    extraction of finished partitions, and downstream filters on ``reason``
    work on a plain scan instead of being pushed into (and substituted through)
    the extraction expressions.
    """
    spark = pages.sparkSession
    before = spark.conf.get(BATCH_BYTES_KEY, None)
    spark.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))
    try:
        extract(spread_for_cores(pages, key), key).write.mode("overwrite").option("compression", TABLE_CODEC).parquet(out_path)
    finally:
        spark.conf.unset(BATCH_BYTES_KEY) if before is None else spark.conf.set(BATCH_BYTES_KEY, before)
    return spark.read.parquet(out_path)


_SESSION_CACHE: dict[tuple, str] = {}
# Tables that a named corpus comes from.
CORPUS_TABLES = {"ldjson": ["part"], "sites": ["documents"], "pages": ["pages"]}


def extracted(spark, name: str, pages_fn, sf_dir: str, key: str = "page_id") -> DataFrame:
    """Extraction table of a named corpus, written once per session and state of its tables' files."""
    from ..session import scratch_path
    from ..sources.fixtures import listing_digest

    files = listing_digest(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in CORPUS_TABLES[name]])
    ck = (spark.sparkContext.applicationId, name, sf_dir, files)
    if ck not in _SESSION_CACHE:
        path = scratch_path(spark, f"extracted-{name}")
        run_extraction(pages_fn(spark, sf_dir), path, key)
        _SESSION_CACHE[ck] = path
    return spark.read.parquet(_SESSION_CACHE[ck])


def recipes_of(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    return extracted.filter(F.col("reason").isNull()).select(key, "route", "recipe")


def rejects_of(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    return extracted.filter(F.col("reason").isNotNull()).select(key, "url", "route", "reason")
