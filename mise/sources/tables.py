"""Table sources: the driver's parquet tables and captured-page folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# Codec of tables that the jobs write for themselves.  Pages and recipes repeat a text in several
# fields and rows; snappy looks back 64 KB only, this one over a whole page of a column.
TABLE_CODEC = "zstd"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages ``(page_id, url, html)``: the corpus the engine reads."""
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def scan_page_files(spark: SparkSession, path: str, glob: str = "*.html", url_index: DataFrame | None = None) -> DataFrame:
    """Crawl folder of one HTML file per page -> ``(page_id, url, html)``.

    ``binaryFile`` yields one row per file (the whole text, never split); the
    page id is a stable hash of the path, so re-runs and retries agree.
    ``url_index`` (file relative to the folder, url) gives the captured addresses;
    a file without one has its path as address.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    pages = files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"),
                         F.decode(F.col("content"), "UTF-8").alias("html"))
    if url_index is None:
        return pages
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    named = pages.withColumn("file", F.expr(f"substring(url, {len(root) + 2})"))
    index = url_index.groupBy("file").agg(F.min("url").alias("own_url"))
    return named.join(index, "file", "left").select("page_id", F.coalesce("own_url", "url").alias("url"), "html")
