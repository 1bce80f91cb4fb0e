"""Golden-corpus comparison: PASS / FAIL / MISSING / ERROR per manifest test.

Documents are compared whole, inside the row: split into lines, trailing
whitespace trimmed, blank lines dropped, then array equality.  This is the
verdict of ``diff --ignore-trailing-space --ignore-blank-lines`` (equality
only, no edit script).  No window or per-line shuffle is needed, so a
reference file shared by many tests (a hot key) is one small digest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hof as H

# --- fixed values -----------------------------------------------------------
TRAILING_SPACE = r"[ \t\n\x0B\f\r]+$"
PASS, FAIL, MISSING, ERROR = "PASS", "FAIL", "MISSING", "ERROR"
# ---------------------------------------------------------------------------


def normalized_lines(body: Column) -> Column:
    lines = H.transform(F.split(body, "\n"), lambda l: F.regexp_replace(l, TRAILING_SPACE, ""))
    return H.filter(lines, lambda l: l != "")


def _digest(body: Column) -> Column:
    return F.sha2(F.array_join(normalized_lines(body), "\n"), 256)


def latest(rows: DataFrame, keys: list[str], order_col: str | None, **values: Column) -> DataFrame:
    """One row for each key: the values of its last row by ``order_col``; of rows at one
    position (or without any) the one with the greatest values.  Values are digests and
    flags, never bodies, so a key with a third of all rows leaves one small row per task."""
    made = rows.select(*keys, (F.col(order_col) if order_col else F.lit(0)).alias("_order"), *[c.alias(n) for n, c in values.items()])
    last = made.groupBy(*keys).agg(F.max(F.struct(F.col("_order").isNotNull().alias("has"), "_order", *values)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{n}").alias(n) for n in ("_order", *values)])


def _bodies_of(rows: DataFrame, picked: DataFrame, keys: list[str], order_col: str | None, digest: str) -> DataFrame:
    """The body of the row that ``latest`` picked for each key."""
    held = rows.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col(order_col) if order_col else F.lit(0)).alias("_o"),
                       "body", _digest(F.col("body")).alias("_d"))
    same = F.col("_o").eqNullSafe(F.col("_order")) & F.col("_d").eqNullSafe(F.col(digest))
    for k in keys:
        same = same & F.col(f"_k_{k}").eqNullSafe(F.col(k))
    # Rows equal in key, position and lines differ in blanks at most: the greatest of them stays.
    return held.join(picked, same).groupBy(*picked.columns).agg(F.max("body").alias("body"))


def golden_diff(tests: DataFrame, actual: DataFrame, reference: DataFrame, order_col: str | None = None) -> DataFrame:
    """``(line_no, url, ref_file, status, has_output)``, one row for each test.

    ``tests``: parsed manifest; ``actual``: ``(line_no, body)`` produced for each
    test (NULL body = the run failed); ``reference``: ``(ref_file, body)``.  Where one of them
    repeats a key the last row by ``order_col`` counts (see ``latest``).
    Bodies are reduced to digests of their normalised lines before the joins, so
    no body is shuffled; the join strategy is left to Spark's measured sizes.
    """
    act = latest(actual, ["line_no"], order_col if order_col in actual.columns else None, act_digest=_digest(F.col("body")))
    return _verdicts(tests.join(act.drop("_order"), "line_no", "left"), reference, order_col)


def _references(reference: DataFrame, order_col: str | None) -> DataFrame:
    return latest(reference, ["ref_file"], order_col if order_col in reference.columns else None,
                  ref_digest=_digest(F.col("body")), has_ref=F.length("body") > 0).drop("_order")


def _verdicts(tested: DataFrame, reference: DataFrame, order_col: str | None = None) -> DataFrame:
    joined = tested.join(_references(reference, order_col), "ref_file", "left")
    status = (F.when(~F.coalesce("has_ref", F.lit(False)), F.lit(MISSING))
              .when(F.col("act_digest").isNull(), F.lit(ERROR))
              .when(F.col("act_digest") == F.col("ref_digest"), F.lit(PASS))
              .otherwise(F.lit(FAIL)))
    return joined.select("line_no", "url", "ref_file", status.alias("status"), F.col("act_digest").isNotNull().alias("has_output"))


def golden_join(tests: DataFrame, actual: DataFrame, reference: DataFrame, order_col: str | None = None) -> DataFrame:
    """Tests and reference files side by side, what stands alone on either side included.

    ``(ref_file, line_no, url, side, has_output, has_reference, same)``: ``side`` is
    ``both``, ``test`` (its reference file does not exist) or ``reference`` (no test names
    the file).  A file that several tests name meets each of them; repeated references
    count once, the last by ``order_col``.
    """
    act = latest(actual, ["line_no"], order_col if order_col in actual.columns else None, act_digest=_digest(F.col("body"))).drop("_order")
    tested = tests.select("line_no", "url", "ref_file").join(act, "line_no", "left").withColumn("is_test", F.lit(True))
    refs = _references(reference, order_col).withColumn("is_ref", F.lit(True))
    joined = tested.join(refs, "ref_file", "full_outer")
    side = F.when(F.col("is_test") & F.col("is_ref"), "both").when(F.col("is_test"), "test").otherwise("reference")
    return joined.select("ref_file", "line_no", "url", side.alias("side"), F.col("act_digest").isNotNull().alias("has_output"),
                         F.coalesce("has_ref", F.lit(False)).alias("has_reference"),
                         F.coalesce(F.col("act_digest") == F.col("ref_digest"), F.lit(False)).alias("same"))


def produced(tests: DataFrame, documents: DataFrame, order_col: str | None = None) -> DataFrame:
    """``(line_no, body)``: the last document of each test's address and format (NULL: none was produced)."""
    keys = ["url", "format"]
    last = latest(documents, keys, order_col, _made=_digest(F.col("body")))
    made = _bodies_of(documents, last, keys, order_col, "_made").select(*keys, "body")
    return tests.join(made, keys, "left").select("line_no", "body")


def golden_run(tests: DataFrame, documents: DataFrame, reference: DataFrame, order_col: str | None = None) -> DataFrame:
    """Manifest, rendered documents ``(url, format, body)`` and references to one verdict for each test.

    Digests are taken per document before it meets its tests, so one document that
    many tests name is digested once and no body is shuffled.  Of several captures of an
    address the last by ``order_col`` counts.
    """
    made = latest(documents, ["url", "format"], order_col, act_digest=_digest(F.col("body"))).drop("_order")
    return _verdicts(tests.join(made, ["url", "format"], "left"), reference, order_col)


def golden_reset(tests: DataFrame, documents: DataFrame, order_col: str | None = None) -> DataFrame:
    """All references anew, one row for each file.  Tests run in line order and each
    writes its file, so the last test that has a document leaves it."""
    keys = ["url", "format"]
    made = latest(documents, keys, order_col, _made=_digest(F.col("body")))
    last = (tests.join(made, keys).groupBy("ref_file")
            .agg(F.max_by(F.struct("url", "format", "_order", "_made"), "line_no").alias("t"))
            .select("ref_file", "t.*"))
    # A document that is the last of several files is fetched once.
    needed = last.select(*keys, "_order", "_made").distinct()
    bodies = _bodies_of(documents, needed, keys, order_col, "_made").select(*keys, "body")
    return last.join(bodies, keys).select("ref_file", "body")


def golden_missing(verdicts: DataFrame, actual: DataFrame) -> DataFrame:
    """New reference files: for each one that is missing, the output of its first
    test (by line) that produced any.  Only these bodies are fetched."""
    first = (verdicts.filter((F.col("status") == MISSING) & F.col("has_output"))
             .groupBy("ref_file").agg(F.min("line_no").alias("line_no")))
    return actual.join(first, "line_no").select("ref_file", "body")


def status_counts(verdicts: DataFrame) -> DataFrame:
    """PASS / FAIL / MISSING / ERROR counts (partial + final hash aggregate)."""
    return verdicts.groupBy("status").agg(F.count(F.lit(1)).alias("n_tests"))


def route_coverage(extracted: DataFrame) -> DataFrame:
    """Per route: pages, recipes produced, pages rejected."""
    return extracted.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.col("recipe").isNotNull()).alias("n_recipes"),
        F.count_if(F.col("reason").isNotNull()).alias("n_rejected"))
