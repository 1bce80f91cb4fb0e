"""Documents as files under their names: a data source writer with staged tasks and one commit.

Every file name has one document, the last one written (``render.filename_collision``).  Names
are dealt to ``shards`` folders by hash and a shard is written by one task, so the driver's
commit renames folders, not files.  A task writes into a staging folder of its own
attempt; a failed or repeated attempt is never looked at, and an aborted job takes its staging
folder away, so either all files appear under the target or none.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.render import filename_collision

FORMAT = "mise_documents"
SCHEMA = "shard string, filename string, body string"
STAGING = "_staging"
SHARDS = 16
ABORT_TRIES = 50


def _file_system(path: str):
    """The file system and the path on it: a local or mounted path, or any address that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """One task's staging folder and the shards in it."""

    folder: str
    shards: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        # Tasks make folders in this one only while it stands: one that is being ended makes none after an abort.
        files, root = _file_system(self.path)
        files.create_dir(self._stage(root), recursive=True)

    def _stage(self, root: str) -> str:
        return f"{root}/{STAGING}-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        files, root = _file_system(self.path)
        folder, shards = f"{self._stage(root)}/{uuid.uuid4().hex}", set()
        files.create_dir(folder, recursive=False)
        try:
            for batch in iterator:
                for shard, name, body in zip(*(batch.column(c) for c in ("shard", "filename", "body"))):
                    own = name.as_py()
                    if not own or "/" in own or "\0" in own or own in (".", ".."):
                        raise ValueError(f"not a file name: {own!r}")
                    at = f"{folder}/{shard.as_py()}"
                    if shard.as_py() not in shards:
                        files.create_dir(at, recursive=False)
                        shards.add(shard.as_py())
                    with files.open_output_stream(f"{at}/{own}") as out:
                        out.write(body.as_py().encode())
        except BaseException:
            with contextlib.suppress(OSError):  # an abort may have been here
                files.delete_dir(folder)
            raise
        return Written(folder, sorted(shards))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = _file_system(self.path)
        old = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True))
               if f.type == fs.FileType.Directory and STAGING not in f.base_name]
        if old and not self.overwrite:
            self._clear(files, root)
            raise ValueError(f"{root} holds documents")
        files.create_dir(root, recursive=True)
        # What was there is set aside until the new folders stand.
        aside = f"{self._stage(root)}/before"
        if old:
            files.create_dir(aside, recursive=True)
        for path in old:
            files.move(path, f"{aside}/{path.rsplit('/', 1)[-1]}")
        for message in messages:
            for shard in message.shards if message else ():
                files.move(f"{message.folder}/{shard}", f"{root}/{shard}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _file_system(self.path)
        for _ in range(ABORT_TRIES):  # a file that is just being written keeps its folder
            with contextlib.suppress(OSError):
                return self._clear(files, root)
            time.sleep(0.1)
        self._clear(files, root)

    def _clear(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(self._stage(root)).type != fs.FileType.NotFound:
            files.delete_dir(self._stage(root))


class DocumentFiles(DataSource):
    """``df.write.format("mise_documents").mode(...).save(path)`` for (shard, filename, body)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def write_document_files(docs: DataFrame, path: str, order_col: str = "page_id", shards: int = SHARDS, overwrite: bool = True) -> str:
    """Files ``<path>/<shard>/<filename>`` of ``(filename, order_col, format, body)``.

    Blank documents are not written and leave earlier ones in place.
    """
    docs.sparkSession.dataSource.register(DocumentFiles)
    filled = docs.where(F.col("body").isNotNull() & (F.trim(F.regexp_replace("body", r"\s+", " ")) != ""))
    shard = F.lpad(F.pmod(F.xxhash64("filename"), F.lit(shards)).cast("string"), len(str(shards - 1)), "0")
    won = filename_collision(filled, order_col).select(shard.alias("shard"), "filename", "body")
    (won.repartition(shards, "shard").sortWithinPartitions("shard").write.format(FORMAT)
     .mode("overwrite" if overwrite else "append").save(path))
    return path


def scan_document_files(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, body)`` of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("filename"), F.decode(F.col("content"), "UTF-8").alias("body"))
