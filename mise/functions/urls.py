"""URL → domain, publisher and extraction route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WS_CLASS

# --- fixed values -----------------------------------------------------------
# Known recipe publishers by exact domain (anything else: empty publisher).
PUBLISHERS = [
    ("www.americastestkitchen.com", "America's Test Kitchen"),
    ("www.cookscountry.com", "Cook's Country"),
    ("www.cooksillustrated.com", "Cook's Illustrated"),
    ("www.epicurious.com", "Epicurious"),
    ("www.bonappetit.com", "Bon Appetit"),
    ("www.foodnetwork.com", "Food Network"),
    ("cooking.nytimes.com", "New York Times"),
    ("www.food.com", "Food.com"),
    ("www.saveur.com", "Saveur"),
    ("www.thecookingguy.com", "Sam the Cooking Guy (Sam Zien)"),
    ("www.thechunkychef.com", "The Chunky Chef"),
    ("www.allrecipes.com", "AllRecipes"),
]

# Extraction route by exact domain; every other domain takes the JSON-LD route.
NEXT_DATA_DOMAINS = ["www.americastestkitchen.com", "www.cookscountry.com",
                     "www.cooksillustrated.com"]
INLINE_STORE_DOMAINS = ["www.epicurious.com"]
DOM_A_DOMAINS = ["www.saveur.com"]
DOM_B_DOMAINS = ["www.thecookingguy.com"]

ROUTE_NEXT_DATA = "next_data"
ROUTE_INLINE_STORE = "inline_store"
ROUTE_DOM_A = "dom_saveur"
ROUTE_DOM_B = "dom_squarespace"
ROUTE_LDJSON = "ldjson"
# ---------------------------------------------------------------------------


def url_domain(url: Column) -> Column:
    """Domain part of a URL, the way the reference cuts it.

    Right-strip, delete every ``<anything but />//`` run, then cut at the first
    ``/``.  Port, user-info, query (when no path) and case are kept.  This is
    deliberately *not* ``parse_url(..., 'HOST')``.
    """
    rs = F.regexp_replace(url, f"{WS_CLASS}+$", "")
    no_scheme = F.regexp_replace(rs, "[^/]*//", "")
    return F.regexp_replace(no_scheme, "(?d)/.*$", "")


def publishers_df(spark: SparkSession) -> DataFrame:
    """The 12-row publisher dimension (constant size: always broadcast-safe)."""
    return spark.createDataFrame(PUBLISHERS, "domain string, publisher string")


def publisher_expr(domain: Column) -> Column:
    """Publisher as a folded CASE over the fixed table (no join at all)."""
    out = F.lit("")
    for dom, pub in reversed(PUBLISHERS):
        out = F.when(domain == F.lit(dom), F.lit(pub)).otherwise(out)
    return out


def publisher_lookup(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``domain`` and ``publisher`` via a broadcast left join to the dimension.

    The dimension has 12 rows by construction, so broadcasting it is bounded.
    """
    spark = pages.sparkSession
    with_domain = pages.withColumn("domain", url_domain(F.col(url_col)))
    dim = F.broadcast(publishers_df(spark))
    return (with_domain.join(dim, "domain", "left")
            .withColumn("publisher", F.coalesce(F.col("publisher"), F.lit(""))))


def route_expr(domain: Column) -> Column:
    """Extraction route chosen by exact domain."""
    return (F.when(domain.isin(NEXT_DATA_DOMAINS), F.lit(ROUTE_NEXT_DATA))
            .when(domain.isin(INLINE_STORE_DOMAINS), F.lit(ROUTE_INLINE_STORE))
            .when(domain.isin(DOM_A_DOMAINS), F.lit(ROUTE_DOM_A))
            .when(domain.isin(DOM_B_DOMAINS), F.lit(ROUTE_DOM_B))
            .otherwise(F.lit(ROUTE_LDJSON)))


def route_pages(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``domain``, ``publisher`` and ``route`` columns (narrow, no shuffle)."""
    d = url_domain(F.col(url_col))
    return (pages.withColumn("domain", d)
            .withColumn("publisher", publisher_expr(F.col("domain")))
            .withColumn("route", route_expr(F.col("domain"))))
