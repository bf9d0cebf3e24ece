"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where a later aggregate then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every job here relies on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Hold one SQL setting for the actions of a block; inserts into tables take no option for it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def build_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is used only in local mode, where driver and
    executors are one process; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = os.path.join(tempfile.gettempdir(), "riskloom-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below a folder of this application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/riskloom/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and return the written table.

    The plan behind it runs once, and a lost executor re-reads files instead of
    replaying it. Unlike a checkpointed RDD the table keeps column pruning and
    tells the planner its real size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, name: str = "buckets") -> Iterator[DataFrame]:
    """Store a frame bucketed by ``key`` for the time of the block.

    Aggregates and joins on the key then read it without a shuffle. There are as
    many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    table = f"riskloom_{name}_{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One writing task per bucket, so a bucket is one file.
    (
        df.repartition(count, key)
        .write.bucketBy(count, key)
        .option("path", scratch_path(spark, name))
        .saveAsTable(table)
    )
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def stored_by(df: DataFrame, key: str, count: int, name: str = "placed") -> DataFrame:
    """Store a frame in ``count`` buckets by ``key`` and return it, for a lazy plan that reads it later.

    As :func:`bucketed`, but the catalog entry is dropped at once: files and frame stay.
    """
    spark = df.sparkSession
    table = f"riskloom_{name}_{uuid.uuid4().hex}"
    (
        df.repartition(count, key)
        .write.bucketBy(count, key)
        .option("path", scratch_path(spark, name))
        .saveAsTable(table)
    )
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored
