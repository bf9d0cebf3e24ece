"""Folds, phases, codes and grids."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.operators import splits as sp


def test_fold_sizes(spark, rows):
    df = spark.createDataFrame([(p, k) for p in range(53) for k in range(2)], "person_id bigint, k int")
    got = sp.patient_split(df, test_frac=0.1, nfold=5)
    assert got.count() == 106
    per_person = rows(got.select("person_id", "fold_id").distinct())
    assert len(per_person) == 53
    assert Counter(f for _, f in per_person) == {"test": 5, "1": 10, "2": 10, "3": 10, "4": 9, "5": 9}
    assert rows(sp.patient_split(df.repartition(9), test_frac=0.1, nfold=5)) == rows(got)
    assert rows(sp.patient_split(df, test_frac=0.1, nfold=5, seed=1)) != rows(got)


@pytest.mark.parametrize("fraction", [0.0, 1.0, -1.0])
def test_bad_fraction(spark, fraction):
    with pytest.raises(ValueError):
        sp.patient_split(spark.range(3).withColumnRenamed("id", "person_id"), test_frac=fraction)


def test_fewer_patients_than_folds(spark, rows):
    df = spark.range(3).withColumnRenamed("id", "person_id")
    assert sorted(r[0] for r in rows(sp.patient_split(df, nfold=10), "fold_id")) == ["1", "2", "3"]


def test_phases(spark, rows):
    df = spark.createDataFrame([("test", 0.0), ("1", 2.0), ("2", None)], "fold_id string, y double")
    assert rows(sp.assign_phase(df, 1, label_col="y"), "fold_id", "phase", "labels") == [
        ("1", "val", 1),
        ("2", "train", 0),
        ("test", "test", 0),
    ]
    assert "val" not in {r[0] for r in rows(sp.assign_phase(df), "phase")}


def test_group_codes(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "g string")
    assert rows(sp.group_codes(df, "g")) == [("a", 0), ("b", 1), ("b", 1), (None, -1)]


def test_grids(spark):
    tasks = spark.createDataFrame([("x",), ("y",)], "task string")
    drawn = sp.config_grid_baseline(tasks).toPandas()
    assert len(drawn) == 100
    settings = [c for c in drawn.columns if c != "task"]
    one, two = (drawn[drawn.task == t][settings].reset_index(drop=True) for t in "xy")
    assert one.equals(two)
    assert len(one.drop(columns="id").drop_duplicates()) == 50
    assert sp.config_grid_baseline(tasks, grid_size=1000).count() == 2 * 216
    fair = sp.config_grid_fair(tasks).toPandas()
    assert len(fair) == 2 * 60
    assert fair.lambda_group_regularization.nunique() == 10
    assert ((fair.regularization_metric == "mmd") == fair.mmd_mode.notna()).all()


def test_group_codes_number_any_count_of_values(spark):
    """More values than slices hold, ties, a null and values whose text order is not their number's."""
    cohort = spark.range(3000).select((F.col("id") % 1500).alias("n")).select(
        F.when(F.col("n") == 7, F.lit(None)).otherwise(F.col("n").cast("string")).alias("v")
    )
    coded = sp.group_codes(cohort, "v")
    assert "collect_set" not in coded._jdf.queryExecution().optimizedPlan().toString()
    values = sorted({str(i) for i in range(1500)} - {"7"})
    found = coded.distinct().collect()
    assert {(r.v, r.group_code) for r in found} == {(None, -1), *((v, i) for i, v in enumerate(values))}
    assert coded.count() == 3000
    assert {r.group_code for r in sp.group_codes(cohort.limit(0), "v").collect()} == set()
