"""Roll-up over folds and reporting tables."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics
from riskloom.operators import report as rp


@pytest.fixture
def folds(spark):
    data = [("t", "0.yaml", str(f), "val", "loss", v) for f, v in enumerate([1.0, 3.0])]
    data += [("t", "1.yaml", str(f), "val", "loss", v) for f, v in enumerate([2.0, 2.0])]
    data += [("t", "2.yaml", "0", "val", "loss", 9.0), ("t", "0.yaml", "0", "test", "loss", 7.0)]
    return spark.createDataFrame(
        data, "task string, config_filename string, fold_id string, phase string, metric string, performance double"
    )


def test_best_model_keeps_ties(rows, folds):
    assert rows(rp.best_model(folds).select("config_filename").distinct()) == [("0.yaml",), ("1.yaml",)]


def test_incomplete_folds(rows, folds):
    assert rows(rp.fold_completeness(folds, k=2)) == [("t", "2.yaml", 1)]


def test_fold_stats_and_intervals(folds):
    got = {
        (r.config_filename, r.phase): r
        for r in rp.fold_intervals(rp.fold_stats(folds, suffix="_base"), ["performance_base"]).collect()
    }
    r = got[("0.yaml", "val")]
    assert r.performance_base_mean == 2.0
    assert r.performance_base_std == pytest.approx(math.sqrt(2))
    assert r.performance_base_sem == pytest.approx(1.0)
    assert r.performance_base_CI == pytest.approx(1.96)
    assert (r.performance_base_interval_lower, r.performance_base_interval_upper) == pytest.approx((1.0, 3.0))
    assert got[("2.yaml", "val")].performance_base_std is None


def test_training_log(spark, rows):
    batches = spark.createDataFrame(
        [("train", 1, 2.0, 10), ("train", 1, 5.0, 20)], "phase string, epoch int, loss double, batch_size int"
    )
    assert rows(rp.training_log(batches)) == [("loss", "train", 1, 4.0)]


def test_cohort_table(spark, rows):
    cohort = spark.createDataFrame(
        [("F", "old", 1, 0), ("F", "new", 0, 0), ("M", None, 1, 1)], "sex string, age string, a int, b int"
    )
    got = rp.cohort_table(cohort, ["sex", "age"], ["a", "b"])
    assert rows(got, "attribute", "group", "size", "a", "b") == [
        ("age", "new", 1, 0.0, 0.0),
        ("age", "old", 1, 1.0, 0.0),
        ("sex", "F", 2, 0.5, 0.0),
        ("sex", "M", 1, 1.0, 1.0),
    ]


def test_melt_and_concat(spark, rows):
    wide = spark.createDataFrame([("a", 1.0, 2.0)], "group string, brier double, calib double")
    long = rp.melt_metrics(wide, ["group"])
    assert rows(long) == [("a", "calib", 2.0)]
    both = rp.concat_metrics(long, long.withColumn("performance_overall", F.lit(3.0)))
    assert rows(both, "performance_overall") == [(3.0,), (None,)]


def test_compare(spark, rows):
    key = "task string, phase string, group string, metric string"
    baseline = spark.createDataFrame(
        [("t", "test", "a", "auc", "9.yaml", 0.5), ("t", "test", "b", "auc", "9.yaml", 0.6)],
        f"{key}, config_filename string, performance_baseline_mean double",
    )
    fair = spark.createDataFrame(
        [("t", "test", "a", "auc", "0.yaml", 0.7), ("t", "test", "c", "auc", "0.yaml", 0.8), ("t", "val", "a", "auc", "0.yaml", 0.8)],
        f"{key}, config_filename string, performance_mean double",
    )
    configs = rp.label_fair_mode(
        spark.createDataFrame(
            [("t", "0.yaml", "mmd", "conditional", None, 0.1)],
            "task string, config_filename string, regularization_metric string, mmd_mode string, "
            "mean_prediction_mode string, lam double",
        )
    ).select("task", "config_filename", "fair_mode", "lam")
    got = rp.compare_baseline_fair(baseline, fair, configs)
    assert rows(got, "group", "side", "fair_mode") == [
        ("a", "both", "mmd_conditional"),
        ("c", "right_only", "mmd_conditional"),
    ]
    assert rows(rp.one_sided(got), "group") == [("c",)]


def test_plot_names_and_hyperparameters(spark, rows):
    df = spark.createDataFrame([("FEMALE", "auc"), ("[75-91)", "auc"), ("x", "emd")], "group string, metric string")
    assert rows(rp.plot_dataset(df, metrics=["auc"]), "group") == [("Female",), ("[75-90)",)]
    configs = spark.createDataFrame([("t", 0.1, 8), ("u", 0.2, 9)], "task string, lr double, batch_size int")
    assert rows(rp.hyperparameter_table(configs, ["t", "u"])) == [
        ("Batch Size", "8", "9"),
        ("Learning Rate", "0.1", "0.2"),
    ]


def test_comparison_refuses_settings_with_two_rows_of_a_configuration(spark):
    scores = spark.createDataFrame([("a", "test", 1.0)], "config string, phase string, brier double")
    settings = spark.createDataFrame([("a", 1), ("a", 2)], "config string, rate int")
    with pytest.raises(ValueError, match="more than one row"):
        rp.compare_baseline_fair(scores, scores, settings)


def test_one_versus_all_report_without_keys_equals_one_key(spark, rows):
    data = [("k", g, i % 2, (i * 7 % 10) / 10) for i, g in enumerate("aabbabababbaab")]
    df = spark.createDataFrame(data, "task string, group string, labels int, pred_probs double")
    keyed = metrics.ova_report(df, ["task"]).drop("task")
    got = metrics.ova_report(df, [])
    assert got.columns == keyed.columns and rows(got) == rows(keyed) and got.count() > 0
