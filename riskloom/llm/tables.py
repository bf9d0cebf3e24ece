"""Stored frames with row ids, checked lookups and the shared session settings of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.joins import fits_broadcast, lookup_join
from riskloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A narrow lookup of this many rows (some tens of bytes each) may be broadcast.
LOOKUP_ROWS = 500_000
#: Rows of an Arrow batch: texts can be long, and a batch is held whole by a Python worker.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Let a Python worker hold few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def numbered(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """The columns of ``docs`` under names that clash with nothing, and the needed ones under their own."""
    names = [f"_d{i}" for i in range(len(docs.columns))]
    renamed = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]
    return docs.select(*renamed, *[F.col(c) for c in needed]), names


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Undo :func:`numbered`: only the columns of ``docs``, under their names."""
    return df.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(docs.columns)])


def stored(df: DataFrame, name: str, uid: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, with a row id if one is named.

    The id is the number of the written file and the row's place in it: unique,
    and the same on every later read, as the files no longer change.
    """
    table = materialize(df, name)
    if uid is None:
        return table
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
    return table.select("*", (F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias(uid))


#: Where a row of a file scan lies: a hash of its file's path, and its place there.
PLACE = ["_file", "_at"]


def placed(docs: DataFrame, in_files: bool, *needed: str) -> tuple[DataFrame, list[str]]:
    """:func:`numbered`, and the :data:`PLACE` of every row, by which narrow results find it again.

    ``in_files``: ``docs`` is read from files that do not change, so its rows are found there and no
    text is stored again. Any other frame is stored first, as is one with a column ``_metadata``.
    """
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    given, names = numbered(docs, *needed)
    if not in_files or "_metadata" in docs.columns:
        return stored(given, "rows").select("*", *place), names
    renamed = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]
    return docs.select(*renamed, *[F.col(c) for c in needed], *place), names


def without(given: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``given`` that are not at the places of the stored table ``dropped``."""
    small = fits_broadcast(dropped, LOOKUP_ROWS)
    return given.join(F.broadcast(dropped) if small else dropped, PLACE, "left_anti")


def narrow_lookup(fact: DataFrame, lookup: DataFrame, key: str, how: str, spread: str | None = None) -> DataFrame:
    """Join a stored narrow table by one key: broadcast below a counted size, else by a shuffle.

    ``spread`` names a column that differs among the rows of a key that may be hot; these are then salted.
    """
    if spread is None and not fits_broadcast(lookup, LOOKUP_ROWS):
        return fact.join(lookup, key, how)
    return lookup_join(fact, lookup, [key], [spread or key], how, max_rows=LOOKUP_ROWS)
