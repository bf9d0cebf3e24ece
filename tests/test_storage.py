"""Readers, writers, guards, jobs."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskloom.plans import jobs
from riskloom.session import bucketed, materialize, scratch_path, shared_dir
from riskloom.sources import tables as io
from riskloom.sources.omop import READS, VIEWS, load_omop, sample_omop, sample_omop_joined


def test_overwrite_guard(spark, tmp_path):
    path = str(tmp_path / "x")
    io.export(spark.range(3), path)
    with pytest.raises(AnalysisException):
        io.export(spark.range(5), path)
    io.export(spark.range(5), path, overwrite=True)
    assert io.read_table(spark, path).count() == 5


def test_rows_per_file_and_unknown_format(spark, tmp_path):
    path = tmp_path / "x"
    io.export(spark.range(10).coalesce(1), str(path), max_rows_per_file=4)
    assert len(list(path.glob("*.parquet"))) == 3
    with pytest.raises(ValueError):
        io.read_table(spark, str(path), fmt="xml")


def test_statement_and_table_modes(spark):
    io.sql(spark, "CREATE DATABASE IF NOT EXISTS riskloom_test")
    name = "riskloom_test.t"
    io.write_table(spark.range(2), name)
    io.write_table(spark.range(3), name, mode="append")
    assert spark.table(name).count() == 5
    io.write_table(spark.range(1), name)
    assert spark.table(name).count() == 1
    with pytest.raises(AnalysisException):
        io.write_table(spark.range(1), name, mode="errorifexists")
    assert io.create_table_as(spark, name, "SELECT id + 1 AS id FROM {d}", d=spark.range(4)).count() == 4
    io.sql(spark, f"DROP TABLE {name}")


def test_path_keys_and_columns(spark, rows, tmp_path):
    for task, fold in (("a", "1"), ("b c", "2")):
        io.export(spark.range(1).withColumn("v", F.lit(7)), str(tmp_path / "perf" / task / f"fold={fold}"))
    got = io.read_with_path_keys(spark, str(tmp_path / "perf"), ["task", "fold"])
    assert rows(got, "task", "fold") == [("a", "1"), ("b c", "2")]
    assert io.read_with_path_keys(spark, str(tmp_path / "perf"), [None, "fold"]).columns == ["id", "v", "fold"]
    picked = io.read_table(spark, str(tmp_path / "perf"), ["v"], recursive=True)
    assert picked.columns == ["v"] and picked.count() == 2


def test_csv_to_parquet_mirrors_folders(spark, rows, tmp_path):
    data = spark.range(6).select(F.col("id").alias("prediction_id"), (F.col("id") % 2).alias("kind"))
    data.write.partitionBy("kind").option("header", "true").csv(str(tmp_path / "csv"))
    io.csv_to_parquet(spark, str(tmp_path / "csv"), str(tmp_path / "pq"))
    assert rows(spark.read.parquet(str(tmp_path / "pq"))) == rows(data)
    assert {p.name for p in (tmp_path / "pq").glob("kind=*")} == {"kind=0", "kind=1"}


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_materialize_reads_files(spark):
    stored = materialize(spark.range(5).withColumn("x", F.rand(1)))
    assert stored.count() == 5 and len(stored.inputFiles()) > 0
    assert stored.collect() == stored.collect()


def test_bucketed_needs_no_shuffle(spark):
    with bucketed(spark.range(100).withColumn("k", F.col("id") % 10), "k") as table:
        grouped = table.groupBy("k").count()
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
        assert grouped.count() == 10


def test_jobs_end_to_end(spark, tmp_path):
    from tests_support import tiny_warehouse

    folder = str(tmp_path / "omop")
    tiny_warehouse(spark, folder)
    omop = load_omop(spark, folder)
    cohort = materialize(jobs.create_cohort(omop, nfold=3))
    assert cohort.count() == 40
    stored = jobs.write_features(
        omop, cohort, str(tmp_path / "f"), ["condition_occurrence", "gender"], csv_path=str(tmp_path / "c")
    )
    assert io.read_table(spark, str(tmp_path / "c"), fmt="csv").count() == stored.count() > 0
    vocab, row_map, merged = jobs.merge_stored(stored, str(tmp_path / "m"))
    assert merged.select("col_id").distinct().count() == vocab.count()
    assert row_map.count() == merged.select("prediction_id").distinct().count()
    predictions = cohort.select(
        (F.col("person_id") / 41.0).alias("pred_probs"),
        F.col("LOS_7").alias("labels"),
        F.lit("LOS_7").alias("task"),
        F.lit("test").alias("phase"),
        "gender_concept_name",
    )
    tables = jobs.audit(predictions, ["gender_concept_name"])
    assert {r[0] for r in tables["standard"].select("metric").distinct().collect()} == {"auc", "auprc", "brier", "loss_bce"}
    assert tables["one_versus_all"].count() == 20
    assert tables["calibration"].count() == 2


@pytest.mark.parametrize("key_folder", [False, True])
def test_csv_to_parquet_keeps_files_of_any_folder(spark, tmp_path, key_folder):
    names = ["a/b/x.csv", "c/y.csv", "z.csv"] + ["k=1/w.csv"] * key_folder
    for i, name in enumerate(names):
        file = tmp_path / "csv" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"prediction_id,v\n{i},{i * 10}\n")
    io.csv_to_parquet(spark, str(tmp_path / "csv"), str(tmp_path / "pq"))
    found = spark.read.parquet(str(tmp_path / "pq")).collect()
    assert {(r.prediction_id, r.v) for r in found} == {(i, i * 10) for i in range(len(names))}
    assert {r.prediction_id: r.folder or "" for r in found} == {i: n.rpartition("/")[0] for i, n in enumerate(names)}


def test_csv_to_parquet_needs_a_file(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    with pytest.raises(ValueError):
        io.csv_to_parquet(spark, str(tmp_path / "csv"), str(tmp_path / "pq"))


def test_destination_keeps_other_analyses_and_drops_old_bins(spark, rows, tmp_path):
    from tests_support import tiny_warehouse

    folder = str(tmp_path / "omop")
    tiny_warehouse(spark, folder)
    omop = load_omop(spark, folder)
    cohort = materialize(jobs.create_cohort(omop, nfold=3))
    name, place = "riskloom_destination", {"path": str(tmp_path / "table")}
    first = jobs.featurize_to_destination(omop, cohort, name, ["condition_occurrence", "gender"], time_bins=[-50, 0], **place)
    whole = rows(first, "feature_id", "concept_count")
    assert {r[0] for r in rows(first.select("time_bin").distinct())} == {"bin_-50_-1", "bin_-36500_-1", "static"}
    again = jobs.featurize_to_destination(
        omop, cohort, name, ["condition_occurrence"], time_bins=None,
        csv_path=str(tmp_path / "csv"), merge_path=str(tmp_path / "merged"),
    )
    assert {r[0] for r in rows(again.select("time_bin").distinct())} == {"bin_-36500_-1", "static"}
    assert rows(again, "feature_id", "concept_count") == [r for r in whole if "bin_-50_-1" not in r[0]]
    assert io.read_table(spark, str(tmp_path / "csv"), fmt="csv").count() == again.count()
    merged = io.read_table(spark, str(tmp_path / "merged" / "features"))
    assert merged.count() == again.select("prediction_id", "feature_id").distinct().count()
    assert jobs.featurize_to_destination(omop, cohort, name, []).count() == again.count()
    spark.sql(f"DROP TABLE {name}")


def test_views_over_the_stored_join_hold_the_same_rows(spark, tmp_path):
    lines = [(1, 5, 7, 1, 10.0, "A", "F"), (1, 6, 11, 2, 50.0, "N", "O"), (1, 6, 11, 2, 50.0, "N", "O"), (2, 29, 8, 1, None, "R", None), (9, 1, 1, 1, 1.0, "A", "O"), (None, 1, 1, 1, 1.0, "A", "F")]
    lineitem = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_returnflag string, l_linestatus string")
    lineitem.withColumn("l_shipdate", F.expr("timestamp_ntz'1996-02-03 00:00:00'")).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = spark.createDataFrame([(1, 100), (2, None), (2, 7), (3, 8)], "o_orderkey bigint, o_custkey bigint")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    joined, plain = sample_omop_joined(spark, str(tmp_path)), sample_omop(spark, str(tmp_path))
    for name in sorted(set(VIEWS) - set(READS)):
        assert joined[name].schema == plain[name].schema
        assert sorted(map(str, joined[name].collect())) == sorted(map(str, plain[name].collect())) != []
        plan = joined[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Join" in plain[name]._jdf.queryExecution().optimizedPlan().toString()
