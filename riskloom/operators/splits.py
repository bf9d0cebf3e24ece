"""Patient folds, phases, group codes and configuration grids."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.joins import lookup_join
from riskloom.functions.keys import digest
from riskloom.functions.ordered import Level, dense_index, running, with_slices
from riskloom.session import materialize


def patient_split(
    df: DataFrame,
    patient_col: str = "person_id",
    test_frac: float = 0.1,
    nfold: int = 10,
    seed: int = 657,
) -> DataFrame:
    """Add ``fold_id``: a share of the patients is 'test', the rest is dealt into folds '1'..'k'.

    The order is the digest of seed and patient, so fold sizes are exact and
    membership is the same on every run.
    """
    if not 0.0 < test_frac < 1.0:
        raise ValueError("test_frac must lie strictly between 0 and 1")
    patients = dense_index(
        df.select(patient_col).distinct(), patient_col, "_i", seed=str(seed), count_name="_n"
    )
    test_size = F.floor(F.lit(test_frac) * F.col("_n"))
    fold = F.when(F.col("_i") < test_size, "test").otherwise(
        (F.pmod(F.col("_i") - test_size, F.lit(nfold)) + 1).cast("string")
    )
    return df.join(patients.select(patient_col, fold.alias("fold_id")), patient_col)


def assign_phase(
    cohort: DataFrame,
    fold_id: str | int | None = None,
    fold_id_test: str = "test",
    label_col: str | None = None,
    train_key: str = "train",
    eval_key: str = "val",
    test_key: str = "test",
) -> DataFrame:
    """Add ``phase`` from the fold, and ``labels`` (1 if the outcome is positive).

    Without a ``fold_id`` no row is in the validation phase.
    """
    fold = F.col("fold_id")
    phase = (
        F.when(fold == fold_id_test, test_key)
        .when(fold == ("" if fold_id is None else str(fold_id)), eval_key)
        .otherwise(train_key)
    )
    result = cohort.withColumn("phase", phase)
    if label_col:
        result = result.withColumn("labels", F.coalesce(F.col(label_col) > 0, F.lit(False)).cast("int"))
    return result


def group_codes(cohort: DataFrame, column: str, name: str = "group_code") -> DataFrame:
    """Code each value by its place among the sorted distinct values; null is -1.

    The dictionary is a stored table with a row per value, numbered within slices of the
    order plus what earlier slices hold, so no task and not the driver sees all values.
    It is broadcast where its size is proven, else the cohort is salted by its rows.
    """
    values = cohort.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    sliced = with_slices(values.withColumn("_each", F.lit(1)), [], "_value")
    ranked = running(sliced, "_value", Level([], {"n": "_each"}))
    codes = materialize(ranked.select(F.col("_value").alias(column), (F.col("cum_n") - 1).cast("int").alias(name)), "codes")
    coded = lookup_join(cohort, codes, [column], spread=cohort.columns, how="left")
    return coded.select(*cohort.columns, F.coalesce(name, F.lit(-1)).alias(name))


# The searched settings of the plain models.
BASELINE_GRID = {
    "lr": [1e-3, 1e-4, 1e-5],
    "batch_size": [128, 256, 512],
    "drop_prob": [0.0, 0.25, 0.5, 0.75],
    "num_epochs": [150],
    "num_hidden": [1, 2, 3],
    "hidden_dim": [128, 256],
    "gamma": [1.0],
    "early_stopping": [True],
    "early_stopping_patience": [10],
}
# Penalties and their modes in the search over penalised models.
FAIR_METHODS = {
    "mean_prediction": ["conditional", "unconditional", "conditional_pos"],
    "mmd": ["conditional", "unconditional", "conditional_pos"],
}


def expand_grid(df: DataFrame, grid: Mapping[str, Sequence], index: str = "id") -> DataFrame:
    """Every row of ``df`` with every combination of the listed values and its number.

    The last listed setting varies fastest.
    """
    df = df.withColumn(index, F.lit(0))
    for name, values in grid.items():
        df = df.select(
            "*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_pos", name)
        ).withColumn(index, F.col(index) * len(values) + F.col("_pos")).drop("_pos")
    return df


def config_grid_baseline(
    tasks: DataFrame,
    grid: Mapping[str, Sequence] = BASELINE_GRID,
    grid_size: int = 50,
    seed: int = 234,
) -> DataFrame:
    """The same ``grid_size`` combinations, drawn by digest, for each row of ``tasks``.

    The draw depends on the combination's number only, so all tasks share it;
    ``id`` numbers the drawn ones. The grid is a parameter of a few hundred
    combinations and travels as one array value.
    """
    names = list(grid)
    combinations = expand_grid(tasks.sparkSession.range(1).select(F.lit(0).alias("_one")), grid)
    drawn = (
        combinations.withColumn("_d", digest("id", seed=str(seed)))
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", *names))), 1, grid_size).alias("c"))
        .scalar()
    )
    return (
        tasks.withColumn("_c", drawn)
        .select("*", F.posexplode("_c").alias("id", "_config"))
        .select(*tasks.columns, "id", *[F.col(f"_config.{n}").alias(n) for n in names])
    )


def log_space(low: float, high: float, count: int) -> list[float]:
    step = (high - low) / (count - 1)
    return [math.pow(10.0, low + step * i) for i in range(count)]


def fair_methods() -> list[tuple[str, str]]:
    """Each penalty with each of its modes."""
    return [(metric, mode) for metric, modes in FAIR_METHODS.items() for mode in modes]


def config_grid_fair(base_configs: DataFrame, lambdas: Sequence[float] | None = None) -> DataFrame:
    """Each selected base configuration with every penalty weight, penalty and mode.

    ``id`` numbers the combinations of one base configuration. Every task starts
    from its own base settings.
    """
    weights = list(lambdas) if lambdas is not None else log_space(-3.0, 1.0, 10)
    numbers = list(range(len(fair_methods())))
    grid = expand_grid(
        base_configs.drop("id"), {"lambda_group_regularization": weights, "_method": numbers}
    )
    metric = F.element_at(F.array(*[F.lit(m) for m, _ in fair_methods()]), F.col("_method") + 1)
    mode = F.element_at(F.array(*[F.lit(m) for _, m in fair_methods()]), F.col("_method") + 1)
    return grid.withColumns(
        {
            "regularization_metric": metric,
            "mean_prediction_mode": F.when(metric == "mean_prediction", mode),
            "mmd_mode": F.when(metric == "mmd", mode),
        }
    ).drop("_method")
