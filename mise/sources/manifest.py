"""Test manifest: ``URL|reference-file`` lines with ``#`` comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordinals import with_input_pos

# --- fixed values -----------------------------------------------------------
# POSIX [[:space:]] (what the manifest trimming strips).
POSIX_SPACE = r"[ \t\n\x0B\f\r]"
# Reference-file extension -> output format.
EXT_FORMAT = {"rst": "rst", "md": "md", "json": "json"}
# ---------------------------------------------------------------------------


def parse_manifest(lines: DataFrame, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """``(line_no, url, ref_file, format)`` from raw manifest lines.

    ``#`` starts a comment anywhere (a ``#fragment`` in a URL is cut too), both
    ends are trimmed, blank lines dropped; fields split on ``|``.  A line with
    no ``|`` is its own URL and its own reference file (``cut`` semantics).
    """
    t = F.regexp_replace(F.regexp_replace(F.col(value), "#.*$", ""), f"^{POSIX_SPACE}+|{POSIX_SPACE}+$", "")
    has_bar = t.contains("|")
    url = F.when(has_bar, F.split_part(t, F.lit("|"), F.lit(1))).otherwise(t)
    ref = F.when(has_bar, F.split_part(t, F.lit("|"), F.lit(2))).otherwise(t)
    ext = F.try_element_at(F.split(ref, r"\."), F.lit(-1))
    fmt = F.element_at(F.create_map(*[x for kv in EXT_FORMAT.items() for x in map(F.lit, kv)]), ext)
    return (lines.select(line_no, t.alias("_t"), url.alias("url"), ref.alias("ref_file"), fmt.alias("format"))
            .filter(F.col("_t") != "").drop("_t"))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Read a manifest text file (or folder of them) and parse it.

    ``line_no`` counts all lines from 1 in file order, comments and blank lines included.
    """
    return parse_manifest(with_input_pos(spark.read.text(path), "line_no", first=1))


def manifest_append(loaded: DataFrame, extra: DataFrame) -> DataFrame:
    """Ad-hoc tests appended after the loaded ones; no de-duplication.

    Their lines are numbered on from the last loaded line (one aggregate over
    ``line_no``), whatever the numbers of either side are.
    """
    last = loaded.agg(F.max("line_no")).first()[0]
    first = extra.agg(F.min("line_no")).first()[0]
    if last is None or first is None:
        return loaded.unionByName(extra)
    return loaded.unionByName(extra.withColumn("line_no", F.col("line_no") - F.lit(first) + F.lit(last + 1)))


def write_manifest(tests: DataFrame, path: str) -> str:
    """Tests back to manifest lines, in line order."""
    line = F.concat_ws("|", "url", "ref_file")
    tests.orderBy("line_no").select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def manifest_lines_from_pages(pages: DataFrame) -> DataFrame:
    """A manifest derived from a page table: one test per page, with comment-only
    lines, blank lines and trailing comments mixed in."""
    pid = F.col("page_id")
    ext = F.element_at(F.array(F.lit("rst"), F.lit("md"), F.lit("json")), (pid % 3 + 1).cast("int"))
    test = F.concat(F.when(pid % 6 == 2, F.lit("  ")).otherwise(F.lit("")), F.col("url"), F.lit("|page_"),
                    pid.cast("string"), F.lit("."), ext,
                    F.when(pid % 4 == 1, F.lit("  # checked")).otherwise(F.lit("")))
    extra: Column = (F.when(pid % 10 == 0, F.concat(F.lit("# section "), pid.cast("string")))
                     .when(pid % 7 == 0, F.lit(" \t ")))
    arr = F.when(extra.isNull(), F.array(test)).otherwise(F.array(extra, test))
    return pages.select(pid, F.posexplode(arr).alias("k", "value")) \
        .select((pid * 2 + F.col("k")).alias("line_no"), "value")
