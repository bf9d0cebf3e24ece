"""Group-fairness penalties of predictions: mean gap, generic metric gap, MMD."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scores import LOG_FLOOR, PENALTY_MODES

AGAINST = ("overall", "group")


def log_probability(df: DataFrame) -> Column:
    """The exact ``log_prob`` of a model where the frame has one, else the logarithm of the score, clipped."""
    if "log_prob" in df.columns:
        return F.col("log_prob").cast("double")
    return F.log(F.greatest(F.lit(LOG_FLOOR), F.col("pred_probs").cast("double")))


def _rows(df: DataFrame, keys: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """Counts per keys, mode, stratum, group and log-probability; strata are label values.

    Several modes share one scan: a row is emitted once per mode it takes part in.
    """
    unknown = [m for m in modes if m not in PENALTY_MODES]
    if unknown:
        raise ValueError(f"mode must be one of {PENALTY_MODES}")
    label = F.col("labels").cast("int")
    stratum = {
        "unconditional": F.lit(-1),
        "conditional": label,
        "conditional_pos": F.when(label == 1, label),
        "conditional_neg": F.when(label == 0, label),
    }
    parts = F.array(*[F.struct(F.lit(m).alias("mode"), stratum[m].alias("_s")) for m in modes])
    log_prob = log_probability(df)
    return (
        df.where(F.col("group").isNotNull())
        .select(*keys, "group", log_prob.alias("x"), F.inline(parts))
        .where(F.col("_s").isNotNull())
        .groupBy(*keys, "mode", "_s", "group", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mean_penalties(df: DataFrame, modes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sum over groups of (mean log-probability of the group - mean of all) squared:
    ``keys..., mode, penalty``.

    Conditional modes do this within each label and add up.
    """
    keys = [*keys, "mode"]
    groups = _rows(df, keys[:-1], modes).groupBy(*keys, "_s", "group").agg(
        F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("s")
    )
    # With g groups of means m and overall mean M: sum (m - M)^2 = sum m^2 - 2 M sum m + g M^2.
    m = F.col("s") / F.col("n")
    overall = F.sum("s") / F.sum("n")
    term = F.sum(m * m) - 2.0 * overall * F.sum(m) + F.count(F.lit(1)) * overall * overall
    return groups.groupBy(*keys, "_s").agg(term.alias("t")).groupBy(*keys).agg(F.sum("t").alias("penalty"))


def penalty_mean(df: DataFrame, mode: str = "conditional", keys: Sequence[str] = ()) -> DataFrame:
    """:func:`mean_penalties` of one mode: ``keys..., penalty``."""
    return mean_penalties(df, [mode], keys).drop("mode")


def penalty_group_pairs(
    values: DataFrame,
    metric: str,
    positives: str,
    against: str = "group",
    overall: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Squared gaps of a metric between groups, given one row per group.

    ``against='group'`` adds (m_g - m_h)^2 over all pairs of groups, by the
    identity k * sum m^2 - (sum m)^2; ``'overall'`` adds (m_g - m)^2 with the
    value of everyone in column ``overall``. Groups without positives are
    skipped; with a single group or no positive at all the penalty is 0.
    """
    if against not in AGAINST:
        raise ValueError(f"against must be one of {AGAINST}")
    keys = list(keys)
    m = F.when(F.col(positives) > 0, F.col(metric))
    if against == "group":
        term = F.count(m) * F.sum(m * m) - F.sum(m) * F.sum(m)
    else:
        term = F.sum((m - F.col(overall)) * (m - F.col(overall)))
    return values.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 1, F.coalesce(term, F.lit(0.0))).otherwise(0.0).alias("penalty")
    )


def kernel_nodes(span: float, tail: float = 6.5) -> list[tuple[float, float]]:
    """Frequencies and weights with exp(-d^2) = sum w * cos(f d) for |d| <= span.

    Trapezoidal rule for the Fourier integral of the Gaussian: the spacing keeps
    the first periodic copy ``tail`` beyond the span and the range ends where the
    integrand is below double precision, so both errors are below 1e-15.
    """
    spacing = 2.0 * math.pi / (span + tail)
    count = math.ceil(12.5 / spacing)
    scale = spacing / math.sqrt(math.pi)
    return [
        (k * spacing, scale * (0.5 if k == 0 else 1.0) * math.exp(-((k * spacing) ** 2) / 4.0))
        for k in range(count + 1)
    ]


def _norm(re: Column, im: Column) -> Column:
    return re * re + im * im


def mmd_penalties(
    df: DataFrame, modes: Sequence[str], against: Sequence[str] = AGAINST, keys: Sequence[str] = ()
) -> DataFrame:
    """Squared maximum mean discrepancy of log-probabilities under exp(-d^2):
    ``keys..., mode, against, penalty``.

    The mean over group terms (each group against all, or each pair of groups)
    is taken per label stratum and strata are added up. The kernel is written as
    sum of cosines, so the mean kernel value between two groups is the product of
    their mean cosines and sines: one pass over the scores replaces the table of
    all pairs, to double precision, for all modes together. The spacing of the
    cosines follows the measured span of the log-probabilities, which has no bound
    of its own where the exact ``log_prob`` is given.
    """
    unknown = [a for a in against if a not in AGAINST]
    if unknown:
        raise ValueError(f"against must be one of {AGAINST}")
    keys = [*keys, "mode"]
    x = log_probability(df)
    low, high = df.where(F.col("group").isNotNull()).agg(F.min(x), F.max(x)).first()
    # A few spans only, so that plans are shared: the next power of two.
    span = 2.0 ** math.ceil(math.log2(max(1.0, (high or 0.0) - (low or 0.0))))
    nodes = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(w).alias("w")) for f, w in kernel_nodes(span)])
    waves = (
        _rows(df, keys[:-1], modes)
        .select(*keys, "_s", "group", "x", "n", F.inline(nodes))
        .groupBy(*keys, "_s", "group", "f", "w")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.cos(F.col("f") * F.col("x"))).alias("c"),
            F.sum(F.col("n") * F.sin(F.col("f") * F.col("x"))).alias("s"),
        )
    )
    c, s = F.col("c") / F.col("n"), F.col("s") / F.col("n")
    k = F.count(F.lit(1))
    own = F.sum(_norm(c, s))
    all_c, all_s = F.sum("c") / F.sum("n"), F.sum("s") / F.sum("n")
    spreads = {
        "overall": own - 2.0 * (all_c * F.sum(c) + all_s * F.sum(s)) + k * _norm(all_c, all_s),
        "group": k * own - _norm(F.sum(c), F.sum(s)),
    }
    terms = {"overall": F.col("k"), "group": F.col("k") * (F.col("k") - 1) / 2.0}
    per_node = waves.groupBy(*keys, "_s", "f", "w").agg(
        k.alias("k"), *[spreads[a].alias(f"_{a}") for a in against]
    )
    per_stratum = per_node.groupBy(*keys, "_s", "k").agg(
        *[F.sum(F.col("w") * F.col(f"_{a}")).alias(f"_{a}") for a in against]
    )
    # A stratum with a single group adds nothing.
    means = [
        F.sum(F.when(F.col("k") > 1, F.col(f"_{a}") / terms[a]).otherwise(0.0)).alias(a) for a in against
    ]
    return per_stratum.groupBy(*keys).agg(*means).unpivot(keys, list(against), "against", "penalty")


def penalty_mmd(
    df: DataFrame, mode: str = "conditional", against: str = "overall", keys: Sequence[str] = ()
) -> DataFrame:
    """:func:`mmd_penalties` of one mode and comparison: ``keys..., penalty``."""
    return mmd_penalties(df, [mode], [against], keys).drop("mode", "against")
