"""Performance and one-versus-all fairness metrics of predictions.

Predictions are first collapsed to counts of positives and negatives per
(keys, group, score). All metrics are sums over these counts; rank metrics add
running counts along the score, which :func:`riskloom.functions.ordered.running`
computes without putting a group into one task. No pairs of rows are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordered import Level, running, slices_for, with_slices
from riskloom.session import materialize
from riskloom.sources.omop import union_all

DEFAULT_KEYS = ("task", "attribute", "phase", "sensitive_attribute", "config_filename")
STANDARD_METRICS = ("auc", "auprc", "brier", "loss_bce")
THRESHOLDS = (0.01, 0.05, 0.1, 0.2)
OVA_METRICS = (
    "emd_ova",
    "emd_ova_1",
    "emd_ova_0",
    "mean_prediction",
    "mean_prediction_1",
    "mean_prediction_0",
    "xauc_ova_1",
    "xauc_ova_0",
    "xauc_1",
    "xauc_0",
)
# Flags of an undefined AUC, an undefined log loss and an empty EMD side,
# and the distance kept from 0 and 1 inside a logarithm.
AUC_FLAG = -1.0
LOSS_FLAG = 1e18
EMD_FLAG = -1.0
LOG_EPS = 1e-15


def present_keys(df: DataFrame, keys: Sequence[str] | None) -> list[str]:
    """The key columns that exist in the frame."""
    return [k for k in (DEFAULT_KEYS if keys is None else keys) if k in df.columns]


def _not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in a key belong to no group."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def collapse(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of positives ``np`` and negatives ``nn`` per keys and score ``p``."""
    positive = (F.col("labels") > 0).cast("bigint")
    return (
        _not_null(df, keys)
        .groupBy(*keys, F.col("pred_probs").cast("double").alias("p"))
        .agg(F.sum(positive).alias("np"), F.sum(1 - positive).alias("nn"))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(LOG_EPS), F.least(F.lit(1.0 - LOG_EPS), p))


def _rank_metrics(sliced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUC and average precision per keys from running counts.

    Several rows may share a score, as the groups do when all are taken together.
    """
    curve = running(sliced, "p", Level(keys, {"np": "np", "nn": "nn"}))
    # Counts at or above the score.
    true_pos = F.col("tot_np") - F.col("cum_np") + F.col("at_np")
    false_pos = F.col("tot_nn") - F.col("cum_nn") + F.col("at_nn")
    total = F.max("tot_np").cast("double")
    wins = F.sum(F.col("np") * (F.col("cum_nn") - F.lit(0.5) * F.col("at_nn")))
    return curve.groupBy(*keys).agg(
        F.coalesce(_ratio(wins, total * F.max("tot_nn")), F.lit(AUC_FLAG)).alias("auc"),
        _ratio(F.sum(F.col("np") * _ratio(true_pos, true_pos + false_pos)), total).alias("auprc"),
    )


def _additive(counts: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    p, pos, neg = F.col("p"), F.col("np"), F.col("nn")
    n = F.sum(pos + neg)
    log_loss = -F.sum(pos * F.log(_clipped(p)) + neg * F.log(1 - _clipped(p))) / n
    mixed = (F.sum(pos) > 0) & (F.sum(neg) > 0)
    zero = F.lit(0.0)
    columns = [
        (F.sum(pos * F.pow(1 - p, F.lit(2)) + neg * F.pow(p, F.lit(2))) / n).alias("brier"),
        F.when(mixed, log_loss).otherwise(F.lit(LOSS_FLAG)).alias("loss_bce"),
    ]
    for t in thresholds:
        above = p >= t
        hits = F.sum(F.when(above, pos).otherwise(0))
        alarms = F.sum(F.when(above, neg).otherwise(0))
        columns += [
            F.coalesce(_ratio(hits, F.sum(pos)), zero).alias(f"recall_{t}"),
            F.coalesce(_ratio(hits, hits + alarms), zero).alias(f"precision_{t}"),
            F.coalesce(_ratio(F.sum(neg) - alarms, F.sum(neg)), zero).alias(f"specificity_{t}"),
        ]
    return counts.groupBy(*keys).agg(*columns)


def melt(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], value: str) -> DataFrame:
    # Names such as recall_0.05 hold a dot and must be quoted.
    return df.unpivot(list(keys), [F.col(f"`{m}`") for m in metrics], "metric", value)


def metric_names(metrics: Sequence[str] | None, thresholds: Sequence[float] | None) -> list[str]:
    chosen = list(STANDARD_METRICS if metrics is None else metrics)
    if not set(chosen) <= set(STANDARD_METRICS):
        raise ValueError(f"metrics must be some of {STANDARD_METRICS}, not {chosen}")
    for kind in ("recall", "precision", "specificity"):
        chosen += [f"{kind}_{t}" for t in (thresholds or ())]
    return chosen


def evaluate(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str] | None = None,
    thresholds: Sequence[float] | None = None,
    value: str = "performance",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Long metric table per keys: ``keys..., metric, <value>``; undefined values keep their flags.

    ``counts`` passes sliced score counts that several calls share.
    """
    keys = list(keys)
    names = metric_names(metrics, thresholds)
    if not names:
        raise ValueError("no metric and no threshold is given")
    ranked = [m for m in names if m in ("auc", "auprc")]
    summed = [m for m in names if m not in ranked]
    if counts is None:
        counts = collapse(df, keys)
        counts = with_slices(counts, keys, "p") if ranked else counts
    parts = []
    if ranked:
        parts.append(melt(_rank_metrics(counts, keys), keys, ranked, value))
    if summed:
        parts.append(melt(_additive(counts, keys, thresholds or ()), keys, summed, value))
    return union_all(parts)


def defined(df: DataFrame, value: str = "performance") -> DataFrame:
    """Rows whose metric is neither missing nor flagged."""
    metric, v = F.col("metric"), F.col(value)
    return df.where(
        v.isNotNull()
        & ~((metric == "auc") & (v < 0))
        & ~((metric == "loss_bce") & (v == LOSS_FLAG))
    )


def standard_report(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    metrics: Sequence[str] | None = None,
    thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Metrics by group next to the same metrics of all groups together.

    Undefined group values are left out; overall values keep their flags and
    include rows without a group. Both sides start from one collapse of the
    predictions.
    """
    keys = present_keys(df, keys)
    if "group" not in df.columns:
        raise ValueError("a group column is needed")
    counts = with_slices(group_counts(df, keys), [*keys, "group"], "p")
    by_group = defined(evaluate(df, [*keys, "group"], metrics, thresholds, counts=_grouped(counts)))
    overall = evaluate(df, keys, metrics, thresholds, "performance_overall", counts=counts)
    return by_group.join(overall, [*keys, "metric"])


# --- one versus all -----------------------------------------------------------------------


def group_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per (keys, group, score). Rows without a group stay: they are part of everyone."""
    positive = (F.col("labels") > 0).cast("bigint")
    return (
        _not_null(df, keys)
        .groupBy(*keys, "group", F.col("pred_probs").cast("double").alias("p"))
        .agg(F.sum(positive).alias("np"), F.sum(1 - positive).alias("nn"))
    )


def _grouped(df: DataFrame) -> DataFrame:
    return df.where(F.col("group").isNotNull())


def cross_auc(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Four AUCs between a group and everyone (``xauc_ova_*``) or everyone else (``xauc_*``).

    ``_1`` ranks the group's positives against negatives, ``_0`` the group's
    negatives against positives. Everyone else is the total minus the group's
    own running count, so no group is joined with another.
    """
    c = F.col
    curve = _grouped(
        running(
            counts,
            "p",
            Level(keys, {"all_np": "np", "all_nn": "nn"}),
            Level([*keys, "group"], {"np": "np", "nn": "nn"}),
        )
    )

    def share(wins: Column, own: str, other_total: Column) -> Column:
        pairs = F.max(f"tot_{own}").cast("double") * other_total
        return F.coalesce(_ratio(wins, pairs), F.lit(AUC_FLAG))

    below = c("cum_all_nn") - F.lit(0.5) * c("at_all_nn")
    own_below = c("cum_nn") - F.lit(0.5) * c("nn")
    above = c("tot_all_np") - c("cum_all_np") + F.lit(0.5) * c("at_all_np")
    own_above = c("tot_np") - c("cum_np") + F.lit(0.5) * c("np")
    return curve.groupBy(*keys, "group").agg(
        share(F.sum(c("np") * below), "np", F.max("tot_all_nn")).alias("xauc_ova_1"),
        share(F.sum(c("nn") * above), "nn", F.max("tot_all_np")).alias("xauc_ova_0"),
        share(F.sum(c("np") * (below - own_below)), "np", F.max(c("tot_all_nn") - c("tot_nn"))).alias(
            "xauc_1"
        ),
        share(F.sum(c("nn") * (above - own_above)), "nn", F.max(c("tot_all_np") - c("tot_np"))).alias(
            "xauc_0"
        ),
    )


def mean_gaps(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean score of a group minus the mean score of everyone: all rows, positives, negatives."""
    sides = {
        "mean_prediction": F.col("np") + F.col("nn"),
        "mean_prediction_1": F.col("np"),
        "mean_prediction_0": F.col("nn"),
    }

    def means(by: Sequence[str], prefix: str) -> DataFrame:
        return counts.groupBy(*by).agg(
            *[_ratio(F.sum(F.col("p") * w), F.sum(w)).alias(prefix + m) for m, w in sides.items()]
        )

    own = _grouped(means([*keys, "group"], "own_"))
    gaps = [(F.col(f"own_{m}") - F.col(f"all_{m}")).alias(m) for m in sides]
    return own.join(means(keys, "all_"), list(keys)).select(*keys, "group", *gaps)


def wasserstein(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wasserstein-1 distance of each group's scores to everyone's: ``keys..., group, emd``.

    ``counts`` holds sliced counts ``n`` per (keys, group, p); rows without a
    group count towards everyone. Let F and G be the distribution functions of
    everyone and of a group. Between two neighbouring scores a and b of the
    group, G is a constant g while F grows, so the area between them follows from
    H(x) = I(x) - g * x with I the integral of F: it is +-(H(b) - H(a)), or
    H(a) + H(b) - 2 H(x) when F passes g at a score x in between. I is
    ``(x * W(x) - S(x)) / total`` with W and S the running weight and weighted
    score, so a group score needs running sums and one look-ahead for x, and no
    grid of groups by scores is built.
    """
    c = F.col
    keys = list(keys)
    group_keys = [*keys, "group"]
    weighted = counts.withColumn("weighted", c("n") * c("p"))
    curve = running(
        weighted.withColumn("at", c("p")),
        "p",
        Level(keys, {"w": "n", "s": "weighted"}),
        Level(group_keys, {"g": "n"}, {"after": "at"}),
    ).select(
        *group_keys, "p", "n", "cum_w", "at_w", "tot_w", "cum_s", "tot_s", "cum_g", "tot_g", "after"
    )
    curve = materialize(curve)

    # Weight of everyone at which F equals the group's share. Both sides of every later
    # comparison are this same expression, so rounding cannot make them disagree.
    def level(share: Column) -> Column:
        return share * c("tot_w") / c("tot_g")

    # Slices of equal weight: one holds at most that share of the rows.
    slices = slices_for(curve)
    asks = _grouped(curve).select("*", level(c("cum_g")).alias("v"), F.lit(0).alias("kind"))
    marks = curve.select(
        *keys,
        "tot_w",
        c("cum_w").cast("double").alias("v"),
        F.lit(1).alias("kind"),
        F.struct(c("p").alias("p"), c("cum_w").alias("w"), c("cum_s").alias("s")).alias("mark"),
    )
    line = asks.unionByName(marks, allowMissingColumns=True).withColumn(
        "_slice", F.floor(c("v") * slices / c("tot_w")).cast("int")
    )
    # Of equal values the marks come first along the order, so the next mark is strictly larger.
    steps = running(line, "v", Level(keys, nexts={"cross": "mark"}, ties=["kind"])).where(c("kind") == 0)

    total, size = c("tot_w").cast("double"), c("tot_g").cast("double")
    share, share_before = c("cum_g") / size, (c("cum_g") - c("n")) / size
    area = (c("p") * c("cum_w") - c("cum_s")) / total
    last = c("after").isNull()
    leaving = F.when(c("cum_w") > c("v"), -1.0).otherwise(1.0) * (area - share * c("p"))
    above_before = (c("cum_w") - c("at_w")) > level(c("cum_g") - c("n"))
    arriving = F.when(above_before, 1.0).otherwise(-1.0) * (area - share_before * c("p"))
    passing = F.when(
        (c("cum_w") <= c("v")) & (c("cross.p") < c("after")),
        -2.0 * ((c("cross.p") * c("cross.w") - c("cross.s")) / total - share * c("cross.p")),
    ).otherwise(0.0)
    # Right of the group's last score G is 1.
    tail = ((c("tot_s") - c("cum_s")) - c("p") * (c("tot_w") - c("cum_w"))) / total
    return steps.groupBy(*group_keys).agg(
        F.sum(arriving + F.when(last, tail).otherwise(leaving + passing)).alias("emd")
    )


def emd_ova(counts: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long EMD table; a group without rows on a side gets the flag -1.

    The label sides are one more key, so all of them share the same passes.
    """
    keys = list(keys)
    sides = {"emd_ova": F.col("np") + F.col("nn"), "emd_ova_1": F.col("np"), "emd_ova_0": F.col("nn")}
    chosen = [m for m in sides if m in metrics]
    variants = F.array(*[F.struct(F.lit(m).alias("metric"), sides[m].alias("n")) for m in chosen])
    long = counts.select(*keys, "group", "p", "_slice", F.inline(variants)).where(F.col("n") > 0)
    distance = wasserstein(long, [*keys, "metric"])
    groups = _grouped(counts.select(*keys, "group").distinct()).withColumn(
        "metric", F.explode(F.array(*[F.lit(m) for m in chosen]))
    )
    on = [*keys, "group", "metric"]
    return groups.join(distance, on, "left").select(
        *on, F.coalesce("emd", F.lit(EMD_FLAG)).alias("performance")
    )


def ova_report(
    df: DataFrame, keys: Sequence[str] | None = None, metrics: Sequence[str] | None = None
) -> DataFrame:
    """One-versus-all metrics of every group as ``keys..., group, metric, performance``."""
    keys = present_keys(df, keys)
    if not keys:
        return ova_report(df.withColumn("_all", F.lit(1)), ["_all"], metrics).drop("_all")
    names = list(OVA_METRICS if metrics is None else metrics)
    if not names or not set(names) <= set(OVA_METRICS):
        raise ValueError(f"metrics must be some of {OVA_METRICS}, not {names}")
    counts = with_slices(group_counts(df, keys), [*keys, "group"], "p")
    on = [*keys, "group"]
    parts = []
    if any(m.startswith("emd") for m in names):
        parts.append(emd_ova(counts, keys, names))
    for prefix, build in (("mean", mean_gaps), ("xauc", cross_auc)):
        chosen = [m for m in names if m.startswith(prefix)]
        if chosen:
            parts.append(melt(build(counts, keys), on, chosen, "performance"))
    long = union_all([p.select(*on, "metric", "performance") for p in parts])
    flagged = F.col("metric").startswith("xauc") & (F.col("performance") < 0)
    return long.where(F.col("performance").isNotNull() & ~flagged)
