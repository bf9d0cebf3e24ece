"""Scores, prediction tables and the penalised fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import merge as mg
from riskloom.operators import metrics as mt
from riskloom.operators import penalties as pn
from riskloom.operators import scores as sc


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    long, rows = [], []
    for i in range(300):
        group = "a" if i % 3 else "b"
        x = rng.random(3) < [0.5, 0.3, 0.8 if group == "a" else 0.1]
        y = int(rng.random() < 1 / (1 + np.exp(-(x[0] * 2.0 - x[1] + x[2] - 1.0))))
        rows.append((i, y, group))
        long += [(i, int(j), 1.0) for j in np.flatnonzero(x)]
    return (
        spark.createDataFrame(long, "row_id bigint, col_id bigint, value double").cache(),
        spark.createDataFrame(rows, "row_id bigint, labels int, group string").cache(),
        long,
        rows,
    )


def design(long, rows):
    x = np.zeros((len(rows), 4))
    x[:, 3] = 1
    for i, j, v in long:
        x[i, j] = v
    return x, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def objective(w, x, y, group, lam, mode, ridge):
    """Value and gradient by numpy."""
    n, z = len(y), x @ w
    lp = -np.logaddexp(0, -z)
    p = np.exp(lp)
    free = np.array([1.0, 1.0, 1.0, 0.0])
    value = (np.logaddexp(0, z) - y * z).mean() + ridge / 2 * (free * w * w).sum()
    slope = (p - y) / n
    strata = {"unconditional": [np.ones(n, bool)], "conditional": [y == 0, y == 1], "conditional_pos": [y == 1], "conditional_neg": [y == 0]}
    for s in strata[mode]:
        gaps = {g: lp[s & (group == g)].mean() - lp[s].mean() for g in np.unique(group[s])}
        value += lam * sum(v * v for v in gaps.values())
        for g, gap in gaps.items():
            own = s & (group == g)
            slope = slope + lam * 2 * gap * (own / own.sum() - s / s.sum()) * (1 - p)
    return value, x.T @ slope + ridge * free * w


def descend(x, y, group, lam, mode, ridge):
    """Short steps downhill, then Newton steps with a Jacobian of differences, until the gradient is nothing."""

    def slope(w):
        return objective(w, x, y, group, lam, mode, ridge)[1]

    w = np.zeros(4)
    for _ in range(3000):
        w = w - 0.1 * slope(w)
    for _ in range(8):
        jacobian = np.array([(slope(w + 1e-5 * e) - slope(w - 1e-5 * e)) / 2e-5 for e in np.eye(4)])
        w = w - np.linalg.solve(jacobian, slope(w))
    assert np.abs(slope(w)).max() < 1e-11
    return w


@pytest.mark.parametrize(
    "lam, mode, ridge",
    [(0.5, "conditional", 0.0), (2.0, "unconditional", 0.1)],
)
def test_fit_equals_numpy_at_convergence(data, lam, mode, ridge):
    long, rows, raw_long, raw_rows = data
    got = {r.col_id: r.weight for r in sc.fit_score_fair(long, rows, lam, mode, ridge, tol=1e-7).collect()}
    want = descend(*design(raw_long, raw_rows), lam, mode, ridge)
    assert [got[j] for j in (0, 1, 2, -1)] == pytest.approx(list(want), abs=2e-6)


def test_a_fit_takes_few_jobs_and_equals_that_by_tables(spark, data, monkeypatch):
    long, rows, *_ = data

    def fitted(name):
        spark.sparkContext.setJobGroup(name, name)
        found = sc.fit_score_fair(long, rows, 0.5, "conditional", 0.1, tol=1e-5).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        return [r.weight for r in sorted(found)], jobs

    few, jobs = fitted("rows")
    monkeypatch.setattr(sc, "LOCAL_WEIGHTS", 0)
    many, more = fitted("tables")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few == pytest.approx(many, abs=1e-3)
    assert jobs < more / 2


def test_a_weak_ridge_and_like_features_take_few_steps(spark, monkeypatch):
    """Features that nearly repeat each other, as bins of a history do: jobs do not grow with the condition."""
    rng = np.random.default_rng(8)
    x = (rng.random((400, 1)) < 0.5) ^ (rng.random((400, 25)) < 0.02)
    y = rng.random(400) < 1 / (1 + np.exp(1.0 - 2.0 * x[:, 0]))
    long = [(i, int(j), 1.0) for i in range(400) for j in np.flatnonzero(x[i])]
    rows = [(i, int(y[i]), "ab"[i % 3 == 0]) for i in range(400)]
    calls = []
    monkeypatch.setattr(sc._Rows, "_total", lambda *args, f=sc._Rows._total: calls.append(1) or f(*args))
    tables = (
        spark.createDataFrame(long, "row_id bigint, col_id bigint, value double"),
        spark.createDataFrame(rows, "row_id bigint, labels int, group string"),
    )
    few = {r.col_id: r.weight for r in sc.fit_score_fair(*tables, 1.0, "conditional", 1e-4).collect()}
    assert len(calls) <= 45
    # Without the matrix it ends at the same weights, by more steps.
    jobs = len(calls)
    monkeypatch.setattr(sc, "DENSE_WEIGHTS", 0)
    many = {r.col_id: r.weight for r in sc.fit_score_fair(*tables, 1.0, "conditional", 1e-4).collect()}
    assert len(calls) - jobs > 2 * jobs
    assert [few[j] for j in sorted(few)] == pytest.approx([many[j] for j in sorted(many)], abs=1e-3)


def test_without_penalty_the_fit_is_the_plain_one(data):
    long, rows, *_ = data
    sparse = mg.to_sparse(
        long.select(F.col("row_id").alias("prediction_id"), "col_id", F.col("value").alias("concept_count"))
    )
    frame = sc.with_vectors(sparse, 3).join(rows.withColumnRenamed("row_id", "prediction_id"), "prediction_id")
    model = sc.fit_logistic(frame, c=0.5)
    kept = rows.join(frame.select(F.col("prediction_id").alias("row_id")), "row_id", "left_semi")
    got = sc.fit_score_fair(long, kept, ridge=1.0 / (0.5 * kept.count()), tol=1e-8).collect()
    weights = {r.col_id: r.weight for r in got}
    assert [weights[j] for j in (0, 1, 2, -1)] == pytest.approx([*model.coefficients, model.intercept], abs=1e-6)


def test_vectors_need_no_python(data):
    long, rows, *_ = data
    sparse = mg.to_sparse(
        long.select(F.col("row_id").alias("prediction_id"), "col_id", F.col("value").alias("concept_count"))
    )
    vectors = sc.with_vectors(sparse, 3)
    assert "Python" not in vectors._jdf.queryExecution().executedPlan().toString()
    row = vectors.orderBy("prediction_id").first()
    assert row.features.size == 3 and list(row.features.indices) == row.indices and list(row.features.values) == row["values"]


def test_penalty_narrows_the_gap(data):
    long, rows, raw_long, raw_rows = data

    def gap(lam):
        w = sc.fit_score_fair(long, rows, lam, ridge=0.1, tol=1e-3)
        scored = sc.apply_weights(long, w, rows)
        return pn.penalty_mean(scored, "unconditional").first()[0]

    assert gap(2.0) < gap(0.0)


def test_bad_mode(data):
    with pytest.raises(ValueError):
        sc.fit_score_fair(data[0], data[1], 1.0, "sideways")


def test_logistic_ranks_better_than_chance(data):
    long, rows, *_ = data
    sparse = mg.to_sparse(
        long.select(F.col("row_id").alias("prediction_id"), "col_id", F.col("value").alias("concept_count"))
    )
    frame = sc.with_vectors(sparse, 3).join(rows.withColumnRenamed("row_id", "prediction_id"), "prediction_id")
    model = sc.fit_logistic(frame, c=1.0)
    # The optimum of C * summed loss + |w|^2 / 2 with a free intercept, by Newton steps.
    present = {r.prediction_id for r in frame.select("prediction_id").collect()}
    x, y, _ = design(data[2], data[3])
    keep = np.array([i in present for i in range(len(y))])
    x, y, w = x[keep], y[keep], np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + ridge
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge @ w)
    assert list(model.coefficients) + [model.intercept] == pytest.approx(list(w), abs=1e-4)
    scored = sc.score_logistic(model, frame, ["prediction_id", "labels"])
    got = mt.evaluate(scored.withColumn("phase", F.lit("train")), ["phase"], ["auc"]).first()
    assert 0.6 < got.performance <= 1.0


def test_softmax(spark):
    df = spark.createDataFrame([(0.0, 2.0), (1000.0, -1000.0)], "output_0 double, output_1 double")
    got = sc.softmax_score(df).collect()
    assert got[0].pred_probs == pytest.approx(1 / (1 + np.exp(-2.0)))
    assert got[0].log_prob == pytest.approx(np.log(1 / (1 + np.exp(-2.0))))
    assert got[1].pred_probs == 0.0 and got[1].log_prob == -2000.0


def test_prediction_table_and_melt(spark, rows):
    scored = spark.createDataFrame([(1, 0.5, 1)], "row_id bigint, pred_probs double, labels int")
    cohort = spark.createDataFrame([(1, "x", "y")], "row_id bigint, sex string, age string")
    table = sc.prediction_table({"val": scored, "test": scored}, cohort, "T")
    assert rows(table, "phase", "task", "sex") == [("test", "T", "x"), ("val", "T", "x")]
    melted = sc.melt_attributes(table, ["sex", "age"])
    assert rows(melted.where("phase = 'val'"), "attribute", "group") == [("age", "y"), ("sex", "x")]
