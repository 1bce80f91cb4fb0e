"""Helpers shared by the corpus operators: Arrow maps, samples, scratch tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mise.session import scratch_path

# ASCII white space of the word rule ([^\x20\x09-\x0D]+ is bytes.split()).
WORD_RX = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: cuts lineage
    and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, text: str, fields: list[T.StructField],
             make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]], keep_text: bool = True) -> DataFrame:
    """Append ``fields`` to every row of ``df``, computed from its ``text`` column.

    ``make()`` runs once in each task and returns a function from the UTF-8
    bytes of a slice of texts to one Arrow array per field.  Slices are bounded by
    bytes (one whole text at least), so temporaries do not follow the batch size.
    Columns named like a new field are replaced; ``keep_text=False`` drops the text.
    """
    if text not in df.columns:
        raise ValueError(f"no column {text!r}")
    df = df.withColumn(text, F.col(text).cast("string"))
    names = [f.name for f in fields]
    keep = [c for c in df.columns if c not in set(names) and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                new = work(part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist())
                old = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*keep, *names])

    return df.mapInArrow(run, schema)


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with every column under a name that no operator uses, and the names."""
    names = {c: f"in{i}__" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(own) for c, own in names.items()]), names


def together(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that ``apart`` renamed, under their own names again."""
    return df.select(*[F.col(own).alias(c) for c, own in names.items()])


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most_bytes`` of text, one row at least."""
    sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        total += n or 0
        if total >= most_bytes:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def per_process(name: str, key: object, make: Callable[[], object]) -> object:
    """A value kept for the life of a Python worker, one for each ``name``.

    Functions of this package reach the workers by value, so module globals do not
    last from task to task; a module of the worker's own does.
    """
    box = sys.modules.setdefault("_mise_llm_kept", types.ModuleType("_mise_llm_kept")).__dict__
    if name not in box or box[name][0] != key:
        box[name] = (key, make())
    return box[name][1]


def hash_sample(df: DataFrame, cols: list[str], n: int, by: str | None = None) -> DataFrame:
    """The rows with the ``n`` smallest different hashes of ``cols``, in each group of ``by`` if given; written.

    Equal ``cols`` count once, however many rows hold them, so the size is exactly ``n`` or the number of
    different ones, and the same rows come out whatever the partitions.  Only rows below a
    bound on the hash are looked at closer; it is raised until every group has its share.
    """
    spark, group = df.sparkSession, by or "__all"
    rows = df.withColumn("__all", F.lit(0)).withColumn("__h", F.xxhash64(*cols))
    # A group is known by its rows; the caller bounds how many groups there are.
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    want = {r[group]: r["__n"] for r in sizes.collect()}
    share = {g: min(1.0, 4 * n / size) for g, size in want.items()}
    while True:
        bounds = spark.createDataFrame([(g, -(1 << 63) + min((1 << 64) - 1, int(s * (1 << 64)))) for g, s in share.items()],
                                       T.StructType([T.StructField("__g", rows.schema[group].dataType), T.StructField("__most", T.LongType())]))
        low = rows.join(F.broadcast(bounds), F.col(group).eqNullSafe(F.col("__g"))).where("__h <= __most")
        one = low.groupBy(group, "__h").agg(F.max(F.struct(*df.columns)).alias("__row"))
        if by:
            one = one.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy("__h"))).where(F.col("__k") <= n)
        else:
            one = one.orderBy("__h").limit(n)
        found = written(one.select("__row.*"), "sample")
        have = {r[0]: r[1] for r in (found.groupBy(by).count().collect() if by else [(0, found.count())])}
        short = [g for g, s in share.items() if s < 1 and have.get(g, 0) < n]
        if not short:
            return found
        share.update({g: min(1.0, 16 * share[g]) for g in short})


def crc_mod3(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3 (null id: null)."""
    return F.crc32(doc_id.cast("string")) % 3
