"""Calibration curves per group and their error summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.joins import fits_broadcast, lookup_join
from riskloom.operators.metrics import present_keys
from riskloom.session import materialize

TOLERANCE = 1e-10
# A Newton system whose determinant is below this share of the product of its diagonal is singular,
# and scores whose weight is below this share of their number are separated: neither fit has an end.
SINGULAR = 1e-12
SEPARATED = 1e-9


def _score_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per keys and positive score."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return (
        df.where(F.col("pred_probs") > 0)
        .groupBy(*keys, F.log(F.col("pred_probs").cast("double")).alias("x"))
        .agg(
            F.sum(F.col("labels").cast("bigint")).alias("np"), F.count(F.lit(1)).alias("n")
        )
    )


def fit_curves(df: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Unpenalised logistic fits of label on log score, one per keys: ``keys..., a, b, converged``.

    All open fits advance together: a pass reads the stored score counts next to
    the stored coefficients and forms six sums per keys before any shuffle. A
    trial that lowers the likelihood is halved towards the coefficients before it;
    otherwise the 2x2 system is solved in closed form for the next trial. A fit is
    closed when its step falls below the tolerance, or without convergence when
    its scores are separated or all equal. Keys without a positive label get no
    fit. Only the number of open fits reaches the driver.
    """
    keys = list(keys)
    counts = materialize(_score_counts(df, keys), "score_counts")
    # The labels of zero scores count when keys are checked for positives.
    positives = df.groupBy(*keys).agg(F.sum("labels").alias("_pos")).where(F.col("_pos") > 0)
    none = F.lit(None).cast("double")
    state = ["a", "b", "last_a", "last_b", "last_ll"]
    start = {"a": F.lit(0.0), "b": F.lit(0.0), "last_a": none, "last_b": none, "last_ll": none}
    open_ = materialize(positives.select(*keys, *[start[c].alias(c) for c in state]), "fits")
    small = fits_broadcast(open_)
    closed = None
    x, mu = F.col("x"), F.col("mu")
    z = F.col("a") + F.col("b") * x
    w = F.col("n") * mu * (1.0 - mu)
    r = F.col("np") - F.col("n") * mu
    # log(1 + exp(z)) without overflow.
    softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    det = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
    stuck = (F.col("w0") <= SEPARATED * F.col("rows")) | (det <= SINGULAR * F.col("w0") * F.col("w2"))
    step_a = (F.col("w2") * F.col("r0") - F.col("w1") * F.col("r1")) / F.nullif(det, F.lit(0.0))
    step_b = (F.col("w0") * F.col("r1") - F.col("w1") * F.col("r0")) / F.nullif(det, F.lit(0.0))
    worse = F.coalesce(F.col("ll") < F.col("last_ll") - 1e-12 * F.abs("last_ll"), F.lit(False))
    tiny = F.greatest(F.abs("da"), F.abs("db")) <= tolerance * (1 + F.greatest(F.abs("a"), F.abs("b")))
    while not open_.isEmpty():
        passed = (
            lookup_join(counts, open_, keys, spread=["x"], small=small)
            .withColumn("mu", 1.0 / (1.0 + F.exp(-z)))
            .groupBy(*keys, *state)
            .agg(
                F.sum(r).alias("r0"),
                F.sum(r * x).alias("r1"),
                F.sum(w).alias("w0"),
                F.sum(w * x).alias("w1"),
                F.sum(w * x * x).alias("w2"),
                F.sum(F.col("np") * z - F.col("n") * softplus).alias("ll"),
                F.sum("n").alias("rows"),
            )
            .withColumns({"worse": worse, "stuck": stuck})
            .withColumns(
                {
                    "da": F.when(F.col("worse"), (F.col("last_a") - F.col("a")) / 2).otherwise(step_a),
                    "db": F.when(F.col("worse"), (F.col("last_b") - F.col("b")) / 2).otherwise(step_b),
                }
            )
        )
        passed = materialize(
            passed.withColumn("converged", F.when(~F.col("worse") & F.col("stuck"), False).when(tiny, True)), "pass"
        )
        done = passed.where("converged IS NOT NULL").select(*keys, "a", "b", "converged")
        closed = done if closed is None else closed.unionByName(done)
        onward = passed.where("converged IS NULL")
        open_ = onward.select(
            *keys,
            (F.col("a") + F.col("da")).alias("a"),
            (F.col("b") + F.col("db")).alias("b"),
            F.when(F.col("worse"), F.col("last_a")).otherwise(F.col("a")).alias("last_a"),
            F.when(F.col("worse"), F.col("last_b")).otherwise(F.col("b")).alias("last_b"),
            F.when(F.col("worse"), F.col("last_ll")).otherwise(F.col("ll")).alias("last_ll"),
        )
    if closed is None:
        return open_.select(*keys, "a", "b", F.lit(True).alias("converged"))
    return closed


def calibration_curves(
    df: DataFrame, keys: Sequence[str] | None = None, tolerance: float = TOLERANCE
) -> DataFrame:
    """Rows with a positive score and the probability of the label by the group's fit and by
    everyone's fit, both evaluated on the same row.

    Group fits and fits of everyone are steps of the same loop: everyone is one
    more member next to the groups.
    """
    keys = present_keys(df, keys)
    rows = df.select(*keys, "group", "pred_probs", "labels")
    everyone = F.struct(F.lit(True).alias("_everyone"), F.lit("").alias("_name"))
    member = F.struct(F.lit(False).alias("_everyone"), F.col("group").cast("string").alias("_name"))
    members = rows.select(
        *keys,
        "pred_probs",
        "labels",
        F.inline(F.when(F.col("group").isNull(), F.array(everyone)).otherwise(F.array(everyone, member))),
    )
    fits = fit_curves(members, [*keys, "_everyone", "_name"], tolerance)
    shared = fits.where("_everyone").select(
        *keys, F.lit(1).alias("_all"), F.col("a").alias("all_a"), F.col("b").alias("all_b")
    )
    own = fits.where("NOT _everyone").select(
        *keys, F.col("_name").alias("group"), F.lit(1).alias("_all"), "a", "b"
    )
    table = materialize(own.join(shared, [*keys, "_all"]), "fits")
    log_p = F.log("pred_probs")

    def curve(a: str, b: str):
        return 1.0 / (1.0 + F.exp(-(F.col(a) + F.col(b) * log_p)))

    scored = rows.where((F.col("pred_probs") > 0) & F.col("group").isNotNull())
    return lookup_join(scored, table, [*keys, "group"], spread=["pred_probs", "labels"]).select(
        *keys,
        "group",
        "pred_probs",
        "labels",
        curve("a", "b").alias("density_conditional_y1"),
        curve("all_a", "all_b").alias("density_conditional_y1_overall"),
    )


def calibration_summary(curves: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean errors per group: score against label, curve against score, curve against everyone's."""
    keys = [*present_keys(curves, keys), "group"]
    p, y = F.col("pred_probs"), F.col("labels")
    own, everyone = F.col("density_conditional_y1"), F.col("density_conditional_y1_overall")
    gaps = {
        "brier": y - p,
        "calib_error": own - p,
        "calib_group_error": own - everyone,
    }
    columns = []
    for name, gap in gaps.items():
        columns += [F.avg(gap * gap).alias(name), F.avg(gap).alias(f"{name}_signed")]
    return curves.groupBy(*keys).agg(*columns)


def filter_group_spec(df: DataFrame, group_vars: Sequence[str], group_values: Sequence) -> DataFrame:
    """Rows that match every (column, value) pair."""
    for column, value in zip(group_vars, group_values):
        df = df.where(F.col(column) == value)
    return df
