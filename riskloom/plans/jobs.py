"""The three jobs of a study: cohort, features, audit. Tables in, tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import calibration as cal
from riskloom.operators import episodes as ep
from riskloom.operators import features as ft
from riskloom.operators import icu, labels, merge
from riskloom.operators import metrics as mt
from riskloom.operators import scores, splits
from riskloom.session import materialize, setting
from riskloom.sources import tables as io


def create_cohort(
    omop: Mapping[str, DataFrame],
    has_birth_datetime: bool = True,
    limit: int | None = None,
    test_frac: float = 0.1,
    nfold: int = 10,
    seed: int = 657,
) -> DataFrame:
    """Visits to episodes, labels, one adult stay per person and patient folds."""
    episodes = ep.episode_rollup(omop, limit=limit)
    labeled = labels.label_all(episodes, omop, has_birth_datetime)
    # The split reads the sample twice, for the patients and for the rows.
    sampled = materialize(labels.sample_one_per_person(labeled), "cohort")
    return splits.patient_split(sampled, "person_id", test_frac, nfold, seed)


def create_icu_cohort(
    omop: Mapping[str, DataFrame], test_frac: float = 0.1, nfold: int = 10, seed: int = 657, **criteria
) -> DataFrame:
    """First intensive-care stays with demographics, row ids and patient folds."""
    stays = icu.icu_sampled(icu.icu_cohort(omop, **criteria))
    labeled = materialize(icu.icu_cohort_labeled(stays, omop), "cohort")
    return splits.patient_split(labeled, "person_id", test_frac, nfold, seed)


def write_features(
    omop: Mapping[str, DataFrame],
    cohort: DataFrame,
    path: str,
    analysis_ids: Sequence[str] | None = None,
    exclude_analysis_ids: Sequence[str] | None = None,
    overwrite: bool = False,
    csv_path: str | None = None,
    **settings,
) -> DataFrame:
    """Extract features into a Parquet data set partitioned by analysis and time bin.

    Later readers prune to the analyses and bins they ask for. With ``csv_path``
    the same layout is also written as CSV. Returns the stored table.
    """
    long = ft.featurize(omop, cohort, analysis_ids, exclude_analysis_ids, **settings)
    mode = "overwrite" if overwrite else "errorifexists"
    long.write.mode(mode).partitionBy("analysis_id", "time_bin").parquet(path)
    spark = long.sparkSession
    stored = spark.read.schema(long.schema).parquet(path)
    if csv_path:
        stored.write.mode(mode).option("header", "true").partitionBy("analysis_id", "time_bin").csv(csv_path)
    return stored


def featurize_to_destination(
    omop: Mapping[str, DataFrame],
    cohort: DataFrame,
    table: str,
    analysis_ids: Sequence[str] | None = None,
    exclude_analysis_ids: Sequence[str] | None = None,
    path: str | None = None,
    csv_path: str | None = None,
    merge_path: str | None = None,
    binary: bool = True,
    **settings,
) -> DataFrame:
    """Extract features into a catalog table partitioned by analysis and time bin, and return the table.

    Partitions of the chosen analyses are replaced, those that they no longer have are
    dropped, and other analyses in the table stay as they are: an extraction can be
    repeated or extended analysis by analysis. ``path`` places a new table; Spark leaves
    the files of its dropped partitions there, so read it as the table. ``csv_path``
    gets the whole table as CSV, ``merge_path`` the vocabulary, row map and merged
    features of all its analyses.
    """
    spark: SparkSession = cohort.sparkSession
    chosen = ft.select_analyses(analysis_ids, exclude_analysis_ids, settings.get("analyses"))
    long = materialize(ft.featurize(omop, cohort, analysis_ids, exclude_analysis_ids, **settings), "features")
    keys = ["analysis_id", "time_bin"]
    long = long.select(*[c for c in long.columns if c not in keys], *keys)
    if not spark.catalog.tableExists(table):
        writer = long.limit(0).write.partitionBy(*keys).format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(table)
    # A task writes whole partitions, so there are few files; a large one is written by many tasks.
    placed = long.hint("rebalance", *keys)
    with setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        placed.write.insertInto(table, overwrite=True)
    written = {tuple(r) for r in long.select(*keys).distinct().collect()}
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
        analysis_id, time_bin = (part.partition("=")[2] for part in row[0].split("/"))
        if analysis_id in {a.analysis_id for a in chosen} and (analysis_id, time_bin) not in written:
            spark.sql(f"ALTER TABLE {table} DROP PARTITION (analysis_id = '{analysis_id}', time_bin = '{time_bin}')")
    spark.catalog.refreshTable(table)
    stored = spark.table(table)
    if csv_path:
        stored.write.mode("overwrite").option("header", "true").partitionBy(*keys).csv(csv_path)
    if merge_path:
        merge_stored(stored, merge_path, binary, None, settings.get("row_id_field", merge.ROW_ID), overwrite=True)
    return stored


def merge_stored(
    features: DataFrame,
    path: str,
    binary: bool = True,
    vocab: DataFrame | None = None,
    row_id_field: str = merge.ROW_ID,
    overwrite: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write vocabulary, row map and merged features below ``path`` and return the three tables."""
    spark: SparkSession = features.sparkSession
    if vocab is None:
        io.export(merge.build_vocab(features), f"{path}/vocab", overwrite)
        vocab = io.read_table(spark, f"{path}/vocab")
    merged = merge.merge_features([features], binary, vocab, row_id_field, ranged=True)
    merge.write_merged(merged, f"{path}/features", row_id_field, overwrite, placed=True)
    stored = io.read_table(spark, f"{path}/features")
    io.export(merge.row_map(stored, row_id_field), f"{path}/row_map", overwrite)
    return vocab, io.read_table(spark, f"{path}/row_map"), stored


def audit(
    predictions: DataFrame,
    attributes: Sequence[str],
    keys: Sequence[str] = mt.DEFAULT_KEYS,
    thresholds: Sequence[float] | None = None,
) -> dict[str, DataFrame]:
    """Standard, one-versus-all and calibration tables of predictions.

    Tasks, phases, configurations and folds are just more ``keys``: one job
    audits all of them.
    """
    long = scores.melt_attributes(predictions, attributes)
    curves = cal.calibration_curves(long, keys)
    return {
        "standard": mt.standard_report(long, keys, thresholds=thresholds),
        "one_versus_all": mt.ova_report(long, keys),
        "calibration": cal.calibration_summary(curves, keys),
    }
