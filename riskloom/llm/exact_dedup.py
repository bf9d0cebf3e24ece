"""Exact deduplication by a persistent index of text digests.

The index is a table bucketed and sorted by the SHA-256 of the normalised text,
with one row per different text. New data is reduced to one row per digest
(map-side, so a text that a third of all rows share moves once per task),
anti-joined to the index by a sort-merge join and appended. Only DataFrame
functions are used.

Defined cases: null text counts as empty; a null ``doc_id`` comes after all
others; of rows equal in text and ``doc_id`` one stays; an empty table gives an
empty result; further columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.tables import PLACE, narrow_lookup, placed, restored, stored, without
from riskloom.session import scratch_path

SPACES = r"[\x20\x09-\x0D]+"
#: Texts with at least this share of all rows are looked up by broadcast; there are at most 1,000 of them.
HOT_SHARE = 1000


def text_digest(text: Column) -> Column:
    """SHA-256 of the text after each run of white space became one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


class DigestIndex:
    """A table ``digest, keep_id, keep_row, batch, group_size``, bucketed and sorted by digest.

    ``keep_row`` is the row id of the kept row within the batch that brought it,
    ``group_size`` the number of rows of that batch with the text.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None):
        self.spark = spark
        self.name = name or f"riskloom_digests_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            location = path or scratch_path(spark, "digests")
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING,"
                f" group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest)"
                f" INTO {self.buckets} BUCKETS LOCATION '{location}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame, batch: str) -> None:
        """Append the texts of ``digests`` (doc_id, digest, row) that the index doesn't hold yet."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        groups = digests.groupBy("digest").agg(first.alias("keep"), F.count(F.lit(1)).alias("group_size"))
        # Stored, as the optimizer would else join all rows to the index before it groups them.
        groups = stored(groups, "groups")
        fresh = groups.hint("merge").join(self.rows(), "digest", "left_anti")
        (
            fresh.select(
                "digest",
                F.col("keep.doc_id").alias("keep_id"),
                F.col("keep.row").alias("keep_row"),
                F.lit(batch).alias("batch"),
                "group_size",
            )
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The index row of every digest. Texts of very many rows are looked up by broadcast, so the
        sort-merge join with the bucketed table sees no hot key."""
        index = self.rows()
        total = index.agg(F.sum("group_size")).first()[0] or 0
        hot = index.where(F.col("group_size") >= max(2, total // HOT_SHARE))
        entry = ["keep_id", "keep_row", "batch", "group_size"]
        tried = digests.join(F.broadcast(hot), "digest", "left")
        found = tried.where(F.col("batch").isNotNull())
        cold = tried.where(F.col("batch").isNull()).drop(*entry)
        return found.unionByName(cold.hint("merge").join(index, "digest"))


def _indexed(docs: DataFrame, columns: list[str], index: DigestIndex | None) -> tuple[DataFrame, DataFrame]:
    """The stored rows with their digests, and the index entry of each row."""
    table = stored(docs.select(*columns, "doc_id", text_digest(F.col("text")).alias("digest")), "digests", uid="row")
    index = index or DigestIndex(docs.sparkSession)
    batch = uuid.uuid4().hex
    digests = table.select("doc_id", "digest", "row")
    index.add(digests, batch)
    kept = (F.col("batch") == batch) & (F.col("keep_row") == F.col("row"))
    return table, index.lookup(digests).withColumn("kept", kept)


def dedup_report(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex)."""
    _, looked = _indexed(docs, [], index)
    return looked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, in_files: bool = False) -> DataFrame:
    """The documents that stay, with all their columns. Texts are not shuffled unless the list of
    dropped rows is too long to broadcast. ``in_files``: see :func:`riskloom.llm.tables.placed`."""
    given, _ = placed(docs, in_files, "doc_id", "text")
    table, looked = _indexed(given, PLACE, index)
    rows = stored(looked.where(~F.col("kept")).select("row"), "dropped")
    dropped = stored(narrow_lookup(table.select("row", *PLACE), rows, "row", "left_semi").select(*PLACE), "places")
    return restored(without(given, dropped), docs)
