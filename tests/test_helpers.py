"""Joins and global order."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskloom.functions.dates import hour_diff, number_text, year_diff
from riskloom.functions.joins import lookup_join, salted_join
from riskloom.functions.ordered import Level, dense_index, running, with_slices


def test_dense_index_is_dense_and_repeatable(spark, rows):
    ids = spark.createDataFrame([(f"f{i}",) for i in range(500)], "k string")
    first = dense_index(ids, "k", "i", count_name="n")
    again = dense_index(ids.repartition(7), "k", "i", count_name="n")
    got = rows(first)
    assert got == rows(again)
    assert sorted(r[1] for r in got) == list(range(500))
    assert {r[2] for r in got} == {500}


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.createDataFrame([], "k string"), "k", "i").count() == 0


def test_running_equals_pandas_with_one_hot_key(spark):
    rng = random.Random(5)
    data = []
    for key in ["hot"] * 600 + ["a"] * 40 + ["b"] * 5:
        data.append((key, rng.choice("xyz"), round(rng.random(), rng.choice([1, 3])), rng.randint(0, 9)))
    pdf = pd.DataFrame(data, columns=["k", "g", "p", "v"]).groupby(["k", "g", "p"], as_index=False).v.sum()
    df = with_slices(spark.createDataFrame(pdf), ["k", "g"], "p", slices=16).withColumn("at", F.col("p"))
    got = running(
        df, "p", Level(["k"], {"all": "v"}), Level(["k", "g"], {"own": "v"}, {"after": "at"})
    ).toPandas()
    assert len(got) == len(pdf)
    for r in got.itertuples():
        same = pdf[pdf.k == r.k]
        own = same[same.g == r.g]
        assert r.cum_all == same[same.p <= r.p].v.sum()
        assert r.at_all == same[same.p == r.p].v.sum()
        assert r.tot_all == same.v.sum()
        assert r.cum_own == own[own.p <= r.p].v.sum()
        later = own[own.p > r.p].p
        assert (np.isnan(r.after) and later.empty) or r.after == later.min()


def test_slices_keep_a_hot_key_apart(spark):
    data = spark.range(2000).select(F.lit("hot").alias("k"), (F.col("id") / 2000.0).alias("p"), F.lit(1).alias("v"))
    sizes = with_slices(data, ["k"], "p", slices=32).groupBy("_slice").count().toPandas()["count"]
    assert len(sizes) == 32
    assert sizes.max() < 2000 / 4


def test_block_search_counts_the_bounds_below(spark):
    data = spark.range(3000).select(F.lit("k").alias("k"), (F.col("id") % 1000).cast("double").alias("p"))
    got = with_slices(data, ["k"], "p", slices=300).toPandas().groupby("p")._slice.agg(["min", "max"])
    assert (got["min"] == got["max"]).all()
    assert got["min"].is_monotonic_increasing
    # Every bound is itself a value, so the slice number rises right after it.
    assert got["min"].iloc[0] == 0 and got["min"].iloc[-1] >= 290


def test_salted_and_broadcast_lookups_equal_a_plain_join(spark, rows):
    fact = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    lookup = spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi"):
        plain = rows(fact.join(lookup, "k", how))
        assert rows(salted_join(fact, lookup, ["k"], ["id"], how)) == plain
        assert rows(lookup_join(fact, lookup, ["k"], ["id"], how)) == plain
        assert rows(lookup_join(fact, lookup, ["k"], ["id"], how, max_rows=2)) == plain


def test_boundary_differences_and_numbers(spark, rows):
    df = spark.sql(
        "SELECT DATE'2000-12-31' a, DATE'2001-01-01' b, TIMESTAMP_NTZ'2001-01-01 00:59:00' s, "
        "TIMESTAMP_NTZ'2001-01-01 01:01:00' e"
    )
    got = df.select(year_diff(F.col("b"), F.col("a")), hour_diff(F.col("e"), F.col("s"))).first()
    assert tuple(got) == (1, 1)
    text = spark.createDataFrame([(5.0,), (2.5,), (-3.0,)], "v double").select(number_text(F.col("v")))
    assert rows(text) == [("-3",), ("2.5",), ("5",)]


def test_dense_index_leaves_null_keys_out(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "k string")
    found = dense_index(df, "k", "i", count_name="n").collect()
    assert sorted(r.i for r in found) == [0, 1, 2] and {r.n for r in found} == {3}
    assert {r.k for r in found} == {"a", "b", "c"}
