"""Recipe JSON: sink (one record per line) and scan back with the recipe schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recipes import RECIPE_DDL
from ..session import scratch_path
from .ordinals import with_input_pos


def sink_json(recipes: DataFrame, spark: SparkSession, path: str | None = None, key: str = "page_id") -> str:
    """Write ``(key, recipe)`` as JSON lines; unset fields are omitted, as in the
    reference's dictionaries.  Returns the path (a fresh one under the shared
    checkpoint folder when none is given)."""
    path = path or scratch_path(spark, "recipes-json")
    recipes.select(key, "recipe").write.mode("overwrite").json(path)
    return path


def sink_recipe_files(recipes: DataFrame, spark: SparkSession, path: str | None = None,
                      key: str = "page_id") -> str:
    """Write bare recipe records (the stored-recipe input format), one per line."""
    path = path or scratch_path(spark, "recipe-files")
    recipes.select(key, "recipe.*").write.mode("overwrite").json(path)
    return path


def scan_recipe_json(spark: SparkSession, path: str, key: str = "page_id", multi_line: bool = False,
                     pos: str | None = None) -> DataFrame:
    """Stored recipe records -> ``(key, recipe)``, schema given (no inference pass).

    ``multi_line=True`` reads pretty-printed single-record files.  ``pos`` names a
    column for the record's dense position in input order.  A record without a key has
    its position as key.
    """
    df = spark.read.schema(f"{key} bigint, {RECIPE_DDL}").option("multiLine", multi_line).json(path)
    own = pos or "_input_pos"
    recipe = F.struct(*[c for c in df.columns if c != key])
    placed = with_input_pos(df, own)
    return placed.select(F.coalesce(F.col(key), F.col(own)).alias(key), *([own] if pos else []), recipe.alias("recipe"))
