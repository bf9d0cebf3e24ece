"""Quality rules: robust multivariate outliers among text statistics.

Each text becomes a vector of five transformed statistics. For every language
and source the minimum-covariance-determinant estimate (the mean and covariance
of the three quarters of the rows whose covariance has the smallest determinant)
is found by concentration steps, followed by the usual reweighting, and rows
beyond a Mahalanobis distance are rejected. Only DataFrame functions are used.

One step is one aggregate: rows are counted and summed by group and distance bin,
so the nearest three quarters are a prefix of the bins and no group, however hot,
is ever gathered or sorted. Statistics are fixed-point integers, hence sums are
exact and a rerun gives the same verdicts. Steps go on until no group's
determinant falls any more, from two starts (medians with interquartile ranges,
and all rows); the start with the smaller determinant counts.

Defined cases: null text has no words; rows that fail the base rule take no part
in the estimates and are not kept; a null language or source is a value of its
own; a group of few or equal rows is judged by the floors alone; an empty table
gives an empty result; further columns pass through.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.joins import fits_broadcast, salted_join
from riskloom.llm.tables import PLACE, WORD, placed, restored, stored, without

WINDOW = 5
SCALE = 4096
BINS_PER_UNIT = 32
PARAMETER_ROWS = 100_000


@dataclass(frozen=True)
class Rules:
    """``floors`` is the least standard deviation granted to each statistic: word length, symbol
    rate, repeated lines, repeated words (all in log units) and log word count."""

    min_words: int = 10
    max_repeat_percent: int = 20
    subset: float = 0.75
    reweight: float = 0.975
    reject: float = 0.99999
    floors: tuple[float, ...] = (0.3, 0.3, 0.4, 0.3, 1.25)


STATISTICS = ("_x1", "_x2", "_x3", "_x4", "_x5")
DIM = len(STATISTICS)
PAIRS = tuple(itertools.combinations_with_replacement(range(DIM), 2))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_cdf(x: float, freedom: int) -> float:
    """Chi-squared distribution by the series of the incomplete gamma function."""
    a, half = freedom / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi2_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, freedom) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, freedom) < p else (low, middle)
    return high


def consistency(share: float) -> float:
    """What makes the covariance of the inner ``share`` of normal rows that of all of them."""
    return share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)


def base_statistics(docs: DataFrame, rules: Rules) -> DataFrame:
    """Add the five base counts, the line count and ``base_failed``.

    Helper arrays are columns used more than once, so the optimizer keeps each
    of them as one step instead of pasting it into the lambdas that read it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    gap = WINDOW - 1
    df = docs.withColumns(
        {
            "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            "_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)),
            "n_symbols": F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("bigint"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.concat_ws("", "_words")).cast("bigint"),
            "_n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_codes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    df = df.withColumn(
        "_runs",
        F.transform(
            F.slice("_codes", 1, F.greatest(F.size("_codes") - gap, F.lit(0))),
            lambda code, i: F.xxhash64(code, *[F.get("_codes", i + k) for k in range(1, WINDOW)]),
        ),
    ).drop("_codes")
    repeated = F.size(F.array_distinct("_runs")) < F.size("_runs")
    df = df.withColumn(
        "_sorted",
        F.when(repeated, F.sort_array(F.transform("_runs", lambda run, i: F.struct(run.alias("run"), i.alias("at"))))),
    ).drop("_runs")
    twice = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(x["run"] == F.get("_sorted", i + 1)["run"], F.lit(False))
        | F.coalesce(x["run"] == F.get("_sorted", i - 1)["run"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumn(
        "n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0).cast("bigint")).otherwise(covered)
    ).drop("_sorted")
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return df.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    words = F.col("n_words")
    values = (
        F.log(F.col("word_chars") / words),
        F.log(1 + 10 * F.col("n_symbols") / words),
        F.log(1 + 10 * F.col("n_dup_lines") / F.col("_n_lines")),
        F.log(1 + 10 * F.col("n_repeat_words") / words),
        F.log(words.cast("double")),
    )
    judged = ~F.col("base_failed")
    return {
        name: F.when(judged, F.round(value * SCALE).cast("bigint"))
        for name, value in zip(STATISTICS, values)
    }


def _sums() -> list[Column]:
    """Count, sums and sums of products, all integers."""
    return [
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(STATISTICS)],
        *[F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"_p{i}{j}") for i, j in PAIRS],
    ]


ENTRIES = tuple((i, j) for i in range(DIM) for j in range(i + 1))
ESTIMATE = ("_m", "_l", "_logdet")


def _first(i: int) -> int:
    """Place of row ``i`` in a lower triangle stored row by row, counted from one."""
    return i * (i + 1) // 2 + 1


def _cholesky(df: DataFrame, *keys: str) -> DataFrame:
    """``keys``, the centre ``_m``, the lower factor ``_l`` of the covariances ``_v`` (both triangles
    by rows) and its log determinant.

    The factor grows by one entry a step inside one expression: it is worked out once a group, and as
    a chain of columns it made plans and generated code that weigh on the driver.
    """
    entries = F.array(
        *[
            F.struct(
                F.get("_v", F.lit(_first(i) - 1 + j)).alias("v"),
                F.lit(_first(i)).alias("own"),
                F.lit(_first(j)).alias("other"),
                F.lit(j).alias("done"),
            )
            for i, j in ENTRIES
        ]
    )

    def grown(factor: Column, e: Column) -> Column:
        products = F.zip_with(
            F.slice(factor, e["own"], e["done"]), F.slice(factor, e["other"], e["done"]), lambda x, y: x * y
        )
        rest = e["v"] - F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
        # The diagonal entry of the row: not there yet where it is the one to find.
        pivot = F.try_element_at(factor, e["other"] + e["done"])
        entry = F.when(e["own"] == e["other"], F.sqrt(rest)).otherwise(rest / pivot)
        return F.concat(factor, F.array(entry))

    factor = F.aggregate(entries, F.array().cast("array<double>"), grown)
    diagonal = [F.log(F.get("_l", F.lit(_first(i) - 1 + i))) for i in range(DIM)]
    return df.select(*keys, "_m", factor.alias("_l")).select(
        *keys, "_m", "_l", (2 * sum(diagonal, F.lit(0.0))).alias("_logdet")
    )


def _estimate(sums: DataFrame, rules: Rules, factor: float, *keys: str) -> DataFrame:
    """Centre and Cholesky factor of ``factor`` times the covariance plus the squared floors."""
    n = F.col("_n").cast("double")
    means = F.array(*[F.col(f"_s{i}") / n / SCALE for i in range(DIM)])
    covariances = F.array(
        *[
            (F.col(f"_p{j}{i}") / n - F.col(f"_s{j}") / n * F.col(f"_s{i}") / n) * (factor / SCALE**2)
            + (rules.floors[i] ** 2 if i == j else 0.0)
            for i, j in ENTRIES
        ]
    )
    return _cholesky(sums.select(*keys, means.alias("_m"), covariances.alias("_v")), *keys)


def _with_distance(rows: DataFrame, parameters: DataFrame, small: bool) -> DataFrame:
    """Join each row to the estimates of its group and add ``_d2``, the squared Mahalanobis distance."""
    if small:
        df = rows.join(F.broadcast(parameters), "_group")
    else:
        df = salted_join(rows, parameters, ["_group"], list(STATISTICS))
    for i in range(DIM):
        at = _first(i) - 1
        rest = sum((F.get("_l", F.lit(at + k)) * F.col(f"_z{k}") for k in range(i)), F.lit(0.0))
        centred = F.col(STATISTICS[i]) / SCALE - F.get("_m", F.lit(i))
        df = df.withColumn(f"_z{i}", (centred - rest) / F.get("_l", F.lit(at + i)))
    squared = sum((F.col(f"_z{i}") ** 2 for i in range(DIM)), F.lit(0.0))
    return df.withColumn("_d2", squared).drop(*[f"_z{i}" for i in range(DIM)], *ESTIMATE)


def _starts(rows: DataFrame, rules: Rules) -> DataFrame:
    """Two first estimates of each group."""
    quarters = [
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q{i}")
        for i, x in enumerate(STATISTICS)
    ]
    spread = rows.groupBy("_group").agg(*quarters)
    middle = stored(spread, "quartiles").select(
        "_group",
        F.lit(0).alias("_start"),
        F.array(*[F.get(f"_q{i}", F.lit(1)) / SCALE for i in range(DIM)]).alias("_m"),
        F.array(
            *[
                F.pow((F.get(f"_q{i}", F.lit(2)) - F.get(f"_q{i}", F.lit(0))) / (1.349 * SCALE), F.lit(2.0))
                + rules.floors[i] ** 2
                if i == j
                else F.lit(0.0)
                for i, j in ENTRIES
            ]
        ).alias("_v"),
    )
    whole = stored(rows.groupBy("_group").agg(*_sums()), "sums").withColumn("_start", F.lit(1))
    return _cholesky(middle, "_group", "_start").unionByName(_estimate(whole, rules, 1.0, "_group", "_start"))


def _concentrate(rows: DataFrame, parameters: DataFrame, rules: Rules, small: bool) -> DataFrame:
    """One step: estimates from the bins of smallest distance that hold the subset's share of the rows."""
    binned = _with_distance(rows, parameters, small).withColumn(
        "_bin", F.floor(F.log2(1 + F.col("_d2")) * BINS_PER_UNIT)
    )
    bins = stored(binned.groupBy("_group", "_start", "_bin").agg(*_sums()), "bins")
    # A bin number is a logarithm, so a group has at most some thousands of bins.
    before = Window.partitionBy("_group", "_start").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_group", "_start")
    placed = bins.withColumns({"_seen": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(every)})
    inner = placed.where(F.col("_seen") < F.ceil(F.col("_all") * rules.subset))
    columns = ["_n", *[f"_s{i}" for i in range(DIM)], *[f"_p{i}{j}" for i, j in PAIRS]]
    sums = stored(inner.groupBy("_group", "_start").agg(*[F.sum(c).alias(c) for c in columns]), "sums")
    return _estimate(sums, rules, consistency(rules.subset), "_group", "_start")


def fit(rows: DataFrame, rules: Rules) -> tuple[DataFrame, bool]:
    """The reweighted estimate of every group from stored rows of statistics, and whether these
    estimates are few enough to broadcast.

    A group whose determinant no longer falls is taken out, so a step costs what is left to do.
    """
    rows = rows.where(F.col(STATISTICS[0]).isNotNull()).select("_group", *STATISTICS)
    parameters = stored(_starts(rows, rules), "step")
    small = fits_broadcast(parameters, PARAMETER_ROWS)
    # The first step leaves the starts behind whatever their determinant is: it is of another kind.
    visited = parameters = stored(_concentrate(rows, parameters, rules, small), "step")
    while not parameters.isEmpty():
        before = parameters.select("_group", "_start", F.col("_logdet").alias("_before"))
        after = _concentrate(rows, parameters, rules, small).join(before, ["_group", "_start"])
        parameters = stored(after.where("_logdet < _before - 1e-9").drop("_before"), "step")
        visited = visited.unionByName(parameters)
    chosen = visited.groupBy("_group").agg(
        F.min_by(F.struct(*ESTIMATE), F.struct("_logdet", "_start")).alias("_e")
    )
    raw = stored(chosen.select("_group", "_e.*"), "raw")
    weighed = _with_distance(rows, raw, small).where(F.col("_d2") <= chi2_quantile(rules.reweight, DIM))
    sums = stored(weighed.groupBy("_group").agg(*_sums()), "sums")
    final = _estimate(sums, rules, consistency(rules.reweight), "_group")
    # No row within the bound: keep the raw estimate.
    rest = raw.join(sums.select("_group"), "_group", "left_anti")
    return stored(final.unionByName(rest), "estimates"), small


def judge(docs: DataFrame, carry: list[str], rules: Rules = Rules()) -> DataFrame:
    """``carry`` columns, the base columns, ``base_failed``, ``distance`` (null if it failed) and ``kept``."""
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    group = F.to_json(F.struct(F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s")))
    given = docs.select(*carried, group.alias("_group"), "text")
    counted = base_statistics(given, rules).withColumns(_vector())
    table = stored(
        counted.select(*[f"_c{i}" for i in range(len(carry))], "_group", *BASE, "base_failed", *STATISTICS),
        "statistics",
    )
    estimates, small = fit(table, rules)
    judged = _with_distance(table.where(~F.col("base_failed")), estimates, small)
    rest = table.where("base_failed").withColumn("_d2", F.lit(None).cast("double"))
    kept = F.coalesce(F.col("_d2") <= chi2_quantile(rules.reject, DIM), F.lit(False))
    return judged.unionByName(rest).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        *BASE,
        "base_failed",
        F.sqrt("_d2").alias("distance"),
        kept.alias("kept"),
    )


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return judge(docs, ["doc_id"], rules)


def keep_quality(docs: DataFrame, rules: Rules = Rules(), in_files: bool = False) -> DataFrame:
    """The documents that pass, with all their columns. ``in_files``: see :func:`riskloom.llm.tables.placed`."""
    given, _ = placed(docs, in_files, "lang", "source", "text")
    rejected = stored(judge(given, PLACE, rules).where(~F.col("kept")).select(*PLACE), "rejected")
    return restored(without(given, rejected), docs)
