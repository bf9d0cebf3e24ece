"""Readers and writers for query text, Parquet, CSV, file trees and catalog tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Run a query or a statement; ``{name}`` in the text refers to a passed frame."""
    return spark.sql(query, **frames) if frames else spark.sql(query)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    fmt: str = "parquet",
    recursive: bool = False,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read Parquet or CSV files; with ``recursive`` every file of the format below the path."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}: use 'parquet' or 'csv'")
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{fmt}")
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path if isinstance(path, str) else list(path))
    return df.select(*columns) if columns else df


def read_with_path_keys(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    fmt: str = "parquet",
    file_glob: str | None = None,
) -> DataFrame:
    """Read a result tree and add one column for each of the last directories.

    ``names`` label the directories just above the file, outermost first; a null
    name skips its directory. A directory ``key=value`` gives its value.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "true")
    df = reader.format(fmt).load(path).withColumn(
        "_dirs", F.split(F.col("_metadata.file_path"), "/")
    )
    depth = len(names)
    for position, name in enumerate(names):
        if name is not None:
            directory = F.url_decode(F.element_at("_dirs", position - depth - 1))
            df = df.withColumn(name, F.regexp_replace(directory, "^[^=]*=", ""))
    return df.drop("_dirs")


def export(
    df: DataFrame,
    path: str,
    overwrite: bool = False,
    max_rows_per_file: int | None = None,
    fmt: str = "parquet",
) -> None:
    """Write Parquet or CSV in files of a bounded row count; fails on an existing target
    unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """Create, replace or append to a catalog table; ``errorifexists`` is the overwrite guard."""
    writer = df.write.mode(mode)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def create_table_as(
    spark: SparkSession, name: str, query: str, path: str | None = None, **frames: DataFrame
) -> DataFrame:
    """Write a query's result to a table, replacing it, and return the table."""
    write_table(sql(spark, query, **frames), name, path=path)
    return spark.table(name)


def csv_to_parquet(
    spark: SparkSession,
    source: str,
    target: str,
    row_id_field: str = "prediction_id",
    schema: StructType | str | None = None,
    overwrite: bool = False,
) -> None:
    """Convert every CSV file below ``source`` to Parquet, sorting each part by the row id.

    A tree of ``key=value`` folders keeps its keys as partitions. Where any file lies
    in a folder of another kind, at whatever depth, all files are read by a recursive
    listing and the folder below ``source`` (empty for the top, as in the file's URI)
    becomes the partition column ``folder``. A tree without a file is an error.
    """
    root = source.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select(_folder_below(root, F.col("path")).alias("folder"))
    )
    some = files.first()
    if some is None:
        raise ValueError(f"no CSV file below {source}")
    plain = F.exists(F.split("folder", "/"), lambda part: (part != "") & ~part.contains("="))
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    if files.where(plain).isEmpty():
        df = reader.csv(root)
        keys = {part.split("=", 1)[0] for part in some["folder"].split("/") if part}
        folders = [c for c in df.columns if c in keys]
    else:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
        path = F.col("_metadata.file_path")
        df = reader.csv(root).withColumn("folder", _folder_below(quote(root, safe="/:"), path))
        folders = ["folder"]
    writer = df.sortWithinPartitions(*folders, row_id_field).write.mode(
        "overwrite" if overwrite else "errorifexists"
    )
    if folders:
        writer = writer.partitionBy(*folders)
    writer.parquet(target)


def _folder_below(root: str, path: Column) -> Column:
    """The folder of a file relative to ``root``, without slashes at its ends."""
    place = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/", root)
    below = F.substring(path, F.locate(place + "/", path) + F.lit(len(place) + 1), F.length(path))
    return F.regexp_replace(below, "/?[^/]*$", "")
