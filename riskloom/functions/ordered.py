"""Global order without a global window: dense ids and running totals.

A window over a whole group runs in one task. Both helpers cut the group into
slices by a rule that depends on the row alone, work inside each slice, and add
what the earlier slices contribute. Every slice rule is deterministic, so a
replayed task puts its rows where the first attempt put them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.joins import fits_broadcast
from riskloom.functions.keys import digest
from riskloom.session import materialize

HEX_DIGITS = 4
MAX_SLICES = 16**HEX_DIGITS
MIN_SLICES, MAX_RUN_SLICES = 128, 4096
ROWS_PER_SLICE = 1_000_000


def dense_index(
    df: DataFrame, key: str, name: str, seed: str = "", count_name: str | None = None
) -> DataFrame:
    """Number the distinct non-repeated ``key`` values 0..n-1 in the order of their digest.

    The keys are stored once, as they are read for the sizes and for the rows.
    Slices are the first four hex digits of the digest, hence uniform; the table
    of slice offsets has at most 65,536 rows, which bounds both its one-partition
    window and its broadcast. ``count_name`` adds n as a column. A null key is no key:
    its row is left out before anything is counted, so ids are 0..n-1 without a gap.
    """
    hashed = materialize(df.where(F.col(key).isNotNull()), "keys").withColumn("_d", digest(key, seed=seed)).withColumn(
        "_slice", F.substring("_d", 1, HEX_DIGITS)
    )
    sizes = hashed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    inside = Window.partitionBy("_slice").orderBy("_d", key)
    numbered = (
        hashed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, (F.col("_offset") + F.col("_rn") - 1).cast("bigint"))
    )
    if count_name:
        numbered = numbered.withColumn(count_name, F.col("_total"))
    return numbered.drop("_d", "_slice", "_rn", "_offset", "_total")


def slices_for(stored: DataFrame) -> int:
    """How many slices a stored table needs to hold about a million rows in each."""
    return max(MIN_SLICES, min(MAX_RUN_SLICES, stored.count() // ROWS_PER_SLICE))


def with_slices(df: DataFrame, keys: Sequence[str], order: str, slices: int | None = None) -> DataFrame:
    """Materialise ``df`` and add ``_slice``: how many of ``slices - 1`` sampled order values
    lie below the row's.

    The sample is the rows with the smallest hash, i.e. uniform, bounded and the
    same on every evaluation. Equal order values always share a slice.
    """
    df = materialize(df)
    slices = slices_for(df) if slices is None else slices
    block = math.isqrt(slices)
    identity = [*keys, order]
    sample = (
        df.select(*identity)
        .where(F.col(order).isNotNull())
        .orderBy(F.xxhash64(*identity), *identity)
        .limit(slices - 1)
    )
    # One row holding at most `slices - 1` sorted values, and the last value of each full block.
    bounds = sample.agg(F.array_sort(F.collect_list(order)).alias("_bounds")).select(
        F.lit(1).alias("_one"),
        "_bounds",
        F.filter("_bounds", lambda b, i: i % block == block - 1).alias("_ends"),
    )

    def below(values):
        return F.size(F.filter(values, lambda b: b < F.col(order)))

    sliced = (
        df.withColumn("_one", F.lit(1))
        .join(F.broadcast(bounds), "_one")
        .withColumn("_blocks", below("_ends"))
        .withColumn(
            "_slice",
            F.col("_blocks") * block
            + below(F.slice("_bounds", F.col("_blocks") * block + 1, F.lit(block))),
        )
        .drop("_bounds", "_ends", "_blocks", "_one")
    )
    # The search costs more per row than reading the row back, and every level reads it twice.
    return materialize(sliced, "sliced")


@dataclass(frozen=True)
class Level:
    """What to add along the order within ``keys``.

    ``sums`` maps an output prefix to a column: ``cum_<prefix>`` is its sum over
    the rows of the same keys up to and including equal order values,
    ``at_<prefix>`` the sum over equal order values, ``tot_<prefix>`` the sum
    over all rows of the keys. ``nexts`` maps an output name to a column that
    does not decrease along the order: its smallest non-null value on the rows
    after this one, or null.
    """

    keys: Sequence[str]
    sums: Mapping[str, str] = field(default_factory=dict)
    nexts: Mapping[str, str] = field(default_factory=dict)
    ties: Sequence[str] = ()


def running(sliced: DataFrame, order: str, *levels: Level) -> DataFrame:
    """Running totals and look-ahead along ``order`` for one or more key levels.

    ``sliced`` has a ``_slice`` column that does not decrease along the order,
    from :func:`with_slices` or a rule of the caller. Rows are shuffled once by
    the first level's keys and slice; a level that adds keys to the first is
    sorted within the same partitions. What earlier and later slices contribute
    is a table of one row per keys and slice, broadcast when its size is proven.
    """
    result = sliced
    offsets = []
    for level in levels:
        keys = list(level.keys)
        parts = sliced.groupBy(*keys, "_slice").agg(
            *[F.sum(c).alias(f"_s_{p}") for p, c in level.sums.items()],
            *[F.min(c).alias(f"_m_{n}") for n, c in level.nexts.items()],
        )
        # One row per slice: no key has more rows here than there are slices.
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
            Window.unboundedPreceding, -1
        )
        later = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(
            Window.unboundedPreceding, -1
        )
        whole = Window.partitionBy(*keys)
        offsets.append(
            parts.select(
                *keys,
                "_slice",
                *[F.coalesce(F.sum(f"_s_{p}").over(earlier), F.lit(0)).alias(f"_o_{p}") for p in level.sums],
                *[F.sum(f"_s_{p}").over(whole).alias(f"tot_{p}") for p in level.sums],
                *[F.min(f"_m_{n}").over(later).alias(f"_l_{n}") for n in level.nexts],
            )
        )
        slice_keys = [*keys, "_slice"]
        ascending = Window.partitionBy(*slice_keys).orderBy(order)
        up_to = ascending.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        peers = ascending.rangeBetween(Window.currentRow, Window.currentRow)
        after = (
            Window.partitionBy(*slice_keys)
            .orderBy(F.desc(order), *level.ties)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        result = result.select(
            "*",
            *[F.sum(c).over(up_to).alias(f"_c_{p}") for p, c in level.sums.items()],
            *[F.sum(c).over(peers).alias(f"at_{p}") for p, c in level.sums.items()],
            *[F.min(c).over(after).alias(f"_a_{n}") for n, c in level.nexts.items()],
        )
    for level, table in zip(levels, offsets):
        table = materialize(table)
        if fits_broadcast(table):
            table = F.broadcast(table)
        result = result.join(table, [*level.keys, "_slice"])
        result = result.withColumns(
            {
                **{f"cum_{p}": F.col(f"_c_{p}") + F.col(f"_o_{p}") for p in level.sums},
                **{n: F.coalesce(F.col(f"_a_{n}"), F.col(f"_l_{n}")) for n in level.nexts},
            }
        )
    helpers = ["_slice"]
    for level in levels:
        helpers += [f"_{kind}_{p}" for p in level.sums for kind in "co"]
        helpers += [f"_{kind}_{n}" for n in level.nexts for kind in "al"]
    return result.drop(*helpers)
