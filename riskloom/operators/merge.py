"""Union of feature tables, vocabulary, row map and sparse rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.joins import fits_broadcast, lookup_join
from riskloom.functions.ordered import dense_index
from riskloom.session import materialize
from riskloom.sources.omop import union_all

ROW_ID = "prediction_id"


def merge_union(
    frames: Sequence[DataFrame], binary: bool = False, row_id_field: str = ROW_ID
) -> DataFrame:
    """Union of feature tables with counts or 0/1 values, sorted by row id."""
    value = F.col("concept_count")
    if binary:
        value = (value > 0).cast("bigint")
    columns = [row_id_field, "person_id", "feature_id", value.alias("concept_count")]
    return union_all([f.select(*columns) for f in frames]).orderBy(row_id_field)


def build_vocab(features: DataFrame) -> DataFrame:
    """Distinct features with dense ids: ``feature_id, col_id`` (0..V-1)."""
    return dense_index(features.select("feature_id").distinct(), "feature_id", "col_id")


def row_map(features: DataFrame, row_id_field: str = ROW_ID) -> DataFrame:
    """Distinct row ids with dense ids: ``row_id, features_row_id`` (0..N-1)."""
    return dense_index(features.select(row_id_field).distinct(), row_id_field, "features_row_id")


def merge_features(
    frames: Sequence[DataFrame],
    binary: bool = False,
    vocab: DataFrame | None = None,
    row_id_field: str = ROW_ID,
    ranged: bool = False,
) -> DataFrame:
    """Feature tables as one indexed frame: row id, person, ``feature_id, col_id, concept_count``.

    With a given vocabulary, features outside it are dropped. A (row, feature) found in
    several tables is added up, or is 1 if ``binary``. Features get their number before
    they move: the vocabulary is stored and broadcast where its size is proven. If it also
    has a column per feature, numbers alone move and are summed, and get their text after. One
    shuffle by row id, or by ranges of it if ``ranged``, serves the sum here, the rows
    of :func:`to_sparse` and the files of :func:`write_merged`. A row id holds each
    feature once per table, so none is hot. Without a vocabulary the tables are read
    twice: pass stored ones.
    """
    keys = [row_id_field, "person_id", "feature_id"]
    long = union_all([f.select(*keys, "concept_count") for f in frames])
    if vocab is None:
        vocab = materialize(build_vocab(long), "vocabulary")
    names = vocab.select("feature_id", "col_id").where(F.col("feature_id").isNotNull())
    rows, features, cols = names.agg(
        F.count(F.lit(1)), F.count_distinct("feature_id"), F.count_distinct("col_id")
    ).first()
    small = fits_broadcast(vocab)
    coded = lookup_join(long, vocab, ["feature_id"], spread=[row_id_field], small=small)
    by_number = small and rows == features == cols
    if by_number:
        keys.remove("feature_id")
        coded = coded.select(*keys, "col_id", "concept_count")
    placed = coded.repartitionByRange(row_id_field) if ranged else coded.repartition(row_id_field)
    summed = placed.groupBy(*keys, "col_id").agg(F.sum("concept_count").alias("concept_count"))
    if binary:
        summed = summed.withColumn("concept_count", (F.col("concept_count") >= 1).cast("bigint"))
    if by_number:
        summed = summed.join(F.broadcast(names), "col_id")
        summed = summed.select(*keys, "feature_id", "col_id", "concept_count")
    return summed


def to_sparse(merged: DataFrame, row_id_field: str = ROW_ID) -> DataFrame:
    """One row per row id with its sorted (col_id, value) pairs.

    A row holds each column at most once, so its length is bounded by the
    vocabulary.
    """
    pairs = F.array_sort(F.collect_list(F.struct("col_id", F.col("concept_count").alias("value"))))
    return (
        merged.groupBy(row_id_field)
        .agg(pairs.alias("_pairs"))
        .select(
            row_id_field,
            F.col("_pairs.col_id").alias("indices"),
            F.col("_pairs.value").alias("values"),
        )
    )


def write_merged(
    merged: DataFrame, path: str, row_id_field: str = ROW_ID, overwrite: bool = False, placed: bool = False
) -> None:
    """Merged features as Parquet, range-partitioned and sorted by row id.

    ``placed`` says that ``merged`` lies in ranges already, as :func:`merge_features` with ``ranged`` leaves it.
    """
    ranges = merged if placed else merged.repartitionByRange(row_id_field)
    (
        ranges.sortWithinPartitions(row_id_field)
        .write.mode("overwrite" if overwrite else "errorifexists")
        .parquet(path)
    )


def cohort_row_map(
    cohort: DataFrame, rows: DataFrame, columns: Sequence[str], row_id_field: str = ROW_ID
) -> DataFrame:
    """Cohort rows that have features, with their dense id and the named label and group columns."""
    return cohort.select(row_id_field, *columns).join(rows, row_id_field)
