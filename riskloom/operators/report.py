"""Roll-up of results over folds and configurations, and reporting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.omop import union_all

VALUES = ("performance", "performance_overall")
# Short group names used in figures.
GROUP_NAMES = {
    "FEMALE": "Female",
    "MALE": "Male",
    "[75-91)": "[75-90)",
    "Black or African American": "Black",
    "Hispanic or Latino": "Hispanic",
}
# Display names of searched settings.
SETTING_NAMES = {
    "lr": "Learning Rate",
    "batch_size": "Batch Size",
    "drop_prob": "Dropout Probability",
    "num_hidden": "Number of Hidden Layers",
    "hidden_dim": "Hidden Dimension",
}


def training_log(
    batches: DataFrame,
    losses: Sequence[str] = ("loss",),
    size: str = "batch_size",
    keys: Sequence[str] = ("phase", "epoch"),
) -> DataFrame:
    """Mean losses per phase and epoch weighted by batch size: ``metric, phase, epoch, performance``."""
    means = batches.groupBy(*keys).agg(
        *[(F.sum(F.col(x) * F.col(size)) / F.sum(size)).alias(x) for x in losses]
    )
    return means.unpivot(list(keys), list(losses), "metric", "performance").select(
        "metric", *keys, "performance"
    )


def cohort_table(cohort: DataFrame, attributes: Sequence[str], tasks: Sequence[str]) -> DataFrame:
    """Size and prevalence of each task per (attribute, group).

    All prevalences come from one aggregate over the melted attributes; tasks are
    columns already and are not melted and pivoted back.
    """
    long = cohort.select(*attributes, *tasks).unpivot(list(tasks), list(attributes), "attribute", "group")
    return (
        long.where(F.col("group").isNotNull())
        .groupBy("attribute", "group")
        .agg(F.count(F.lit(1)).alias("size"), *[F.avg(F.col(t).cast("double")).alias(t) for t in tasks])
    )


def fold_completeness(
    results: DataFrame, k: int = 10, keys: Sequence[str] = ("task", "config_filename"), fold: str = "fold_id"
) -> DataFrame:
    """Configurations that do not have results for exactly ``k`` folds."""
    return (
        results.groupBy(*keys)
        .agg(F.countDistinct(fold).alias("num_folds"))
        .where(F.col("num_folds") != k)
    )


def best_model(results: DataFrame, metric: str = "loss", phase: str = "val") -> DataFrame:
    """Results of the configuration with the lowest mean validation metric of each task; ties stay."""
    means = (
        results.where((F.col("metric") == metric) & (F.col("phase") == phase))
        .groupBy("config_filename", "task")
        .agg(F.avg("performance").alias("mean_performance"))
    )
    # A window over the few configurations of a task compares each mean with itself, not with
    # a second evaluation whose last bit may differ.
    lowest = F.min("mean_performance").over(Window.partitionBy("task"))
    chosen = means.withColumn("lowest", lowest).where(F.col("mean_performance") == F.col("lowest"))
    return results.join(chosen.select("task", "config_filename"), ["task", "config_filename"])


def melt_metrics(wide: DataFrame, id_vars: Sequence[str], drop: Sequence[str] = ("brier",)) -> DataFrame:
    """Wide metric table to ``id..., metric, performance`` without the named metrics."""
    values = [c for c in wide.columns if c not in id_vars]
    long = wide.unpivot(list(id_vars), values, "metric", "performance")
    return long.where(~F.col("metric").isin(*drop)) if drop else long


def concat_metrics(*tables: DataFrame) -> DataFrame:
    """Stack metric tables; columns a table lacks are null."""
    return union_all(list(tables), allow_missing=True)


def fold_stats(
    results: DataFrame,
    exclude: Sequence[str] = ("fold_id",),
    suffix: str = "",
    values: Sequence[str] = VALUES,
) -> DataFrame:
    """Mean, sample standard deviation and standard error over folds, per remaining column.

    Missing values and rows with a missing key are left out; ``suffix`` renames the value columns, as in
    ``performance_baseline_mean``.
    """
    values = [v for v in values if v in results.columns]
    keys = [c for c in results.columns if c not in {*values, *exclude}]
    columns = []
    for k in keys:
        results = results.where(F.col(k).isNotNull())
    for v in values:
        name = f"{v}{suffix}"
        std = F.stddev_samp(v)
        columns += [
            F.avg(v).alias(f"{name}_mean"),
            std.alias(f"{name}_std"),
            (std / F.sqrt(F.count(v))).alias(f"{name}_sem"),
        ]
    return results.groupBy(*keys).agg(*columns)


def fold_intervals(stats: DataFrame, names: Sequence[str] = VALUES, z: float = 1.96) -> DataFrame:
    """Half width of the 95% interval and mean plus or minus one standard error."""
    for name in names:
        if f"{name}_sem" not in stats.columns:
            continue
        mean, sem = F.col(f"{name}_mean"), F.col(f"{name}_sem")
        stats = (
            stats.withColumn(f"{name}_CI", sem * z)
            .withColumn(f"{name}_interval_lower", mean - sem)
            .withColumn(f"{name}_interval_upper", mean + sem)
        )
    return stats


def label_fair_mode(configs: DataFrame) -> DataFrame:
    """Add ``fair_mode``: the penalty followed by its own mode."""
    metric = F.col("regularization_metric")
    return configs.withColumn(
        "fair_mode",
        F.when(metric.startswith("mmd"), F.concat_ws("_", metric, F.col("mmd_mode")))
        .when(metric.startswith("mean_prediction"), F.concat_ws("_", metric, F.col("mean_prediction_mode")))
        .otherwise(metric),
    )


def compare_baseline_fair(
    baseline: DataFrame, fair: DataFrame, configs: DataFrame, phase: str | None = "test"
) -> DataFrame:
    """Baseline and penalised results side by side on all shared columns.

    A full outer join with ``side`` ('both', 'left_only', 'right_only'), then the
    settings of each configuration, of which each may have one row only (checked on
    the small settings table). Use :func:`one_sided` to check coverage.
    """
    left = baseline.drop("config_filename")
    shared = [c for c in left.columns if c in fair.columns]
    joined = (
        left.withColumn("_l", F.lit(True))
        .join(fair.withColumn("_r", F.lit(True)), shared, "full")
        .withColumn(
            "side",
            F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both"),
        )
        .drop("_l", "_r")
    )
    on = [c for c in configs.columns if c in joined.columns]
    if not configs.groupBy(*on).count().where("count > 1").isEmpty():
        raise ValueError(f"a configuration has more than one row of settings; the key is {on}")
    result = joined.join(configs, on)
    return result.where(F.col("phase") == phase) if phase else result


def one_sided(compared: DataFrame) -> DataFrame:
    """Penalised results that have no baseline: an empty frame when the comparison is complete."""
    return compared.where(F.col("side") == "right_only")


def plot_dataset(
    df: DataFrame,
    task: str | None = None,
    attribute: str | None = None,
    fair_modes: Sequence[str] | None = None,
    metrics: Sequence[str] | None = None,
    names: Mapping[str, str] = GROUP_NAMES,
) -> DataFrame:
    """Rows of one figure with short group names."""
    if task is not None:
        df = df.where(F.col("task") == task)
    if attribute is not None:
        df = df.where(F.col("attribute") == attribute)
        if "sensitive_attribute" in df.columns:
            df = df.where(F.col("sensitive_attribute") == attribute)
    if fair_modes is not None:
        df = df.where(F.col("fair_mode").isin(*fair_modes))
    if metrics is not None:
        df = df.where(F.col("metric").isin(*metrics))
    return df.replace(dict(names), subset=["group"])


def hyperparameter_table(
    configs: DataFrame, tasks: Sequence[str], names: Mapping[str, str] = SETTING_NAMES
) -> DataFrame:
    """One row per named setting with a column per task, from one configuration row per task."""
    settings = [n for n in names if n in configs.columns]
    text = configs.select("task", *[F.col(s).cast("string").alias(s) for s in settings])
    label = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return (
        text.unpivot(["task"], settings, "setting", "value")
        .groupBy(label[F.col("setting")].alias("Hyperparameter"))
        .pivot("task", list(tasks))
        .agg(F.min("value"))
        .orderBy("Hyperparameter")
    )
