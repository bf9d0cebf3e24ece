"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are word counts. The documents of a source stand on a line in hashed order,
each as long as its size. A source's target is a stretch of this line from 0,
which may run around it up to three times; the document at its end is cut, so the
words taken are the target to the word. The line is divided into blocks of equal
length, and the target is a quota of whole blocks. A tree splits the quotas of all
sources among the output shards: at each node the left half of the shards gets a
multivariate-hypergeometric share of the blocks, as if they were dealt without
replacement. A shard's blocks of a source are then neighbours on the line, so
shards are disjoint, and rows are ordered by a hash within the shard.

There are as many shards as the root of the words, and a fixed number of blocks to a
shard. Sources are numbered by the files of their sorted table and dealt in groups: the
driver deals the totals of groups of some thousand sources, each group is then a task
that deals its own sources under these totals, which gives the same distribution.

The place on the line is a running total within slices of the hash plus what the
slices before hold, so a source with a third of all rows is no single group.

Defined cases: null text has size 0 and is never taken; a null source comes last;
equal rows are interchangeable; a very long text stands on many blocks and goes to the
shard of one of them, drawn by hash; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.joins import BROADCAST_BYTES, fits_broadcast, salted_join
from riskloom.llm.tables import LOOKUP_ROWS, PLACE, WORD, placed, restored, stored

SLICE_ROWS = 50_000
#: Rows of one task of an output shard.
SHARD_ROWS = 5_000
#: Sources that one task deals.
GROUP_SOURCES = 4096
#: Beyond it numpy has no hypergeometric draw.
LARGEST_DRAW = 10**9


@dataclass(frozen=True)
class Mix:
    """``shard_words``: the square of the number of shards times this is the number of words."""

    weights: tuple[int, ...] = (1, 2, 3)
    most_copies: int = 3
    shard_words: int = 50_000
    shard_blocks: int = 128
    seed: int = 17

    def shards(self, words: int) -> int:
        return max(1, math.ceil(math.sqrt(words / self.shard_words)))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` blocks are good ones, at any size.

    Beyond numpy's range the distribution is summed over twelve standard deviations around its mean."""
    if good + bad < LARGEST_DRAW:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    mean = drawn * good / (good + bad)
    spread = 12 * math.sqrt(mean * bad / (good + bad)) + 12
    low, high = max(0, drawn - bad, int(mean - spread)), min(good, drawn, int(mean + spread) + 1)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    total = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def deal(rng: np.random.Generator, quotas: np.ndarray, drawn: int) -> np.ndarray:
    """A multivariate-hypergeometric share of ``drawn`` blocks, source by source where they are very many."""
    rest = int(quotas.sum())
    if rest < LARGEST_DRAW:
        return rng.multivariate_hypergeometric(quotas, drawn, method="marginals")
    share = np.zeros_like(quotas)
    for s, quota in enumerate(quotas.tolist()):
        share[s] = hypergeometric(rng, quota, rest - quota, drawn)
        rest, drawn = rest - quota, drawn - int(share[s])
    return share


def split_quotas(quotas: np.ndarray, totals: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal ``quotas[s]`` blocks of each source to shards that hold ``totals[k]`` blocks.

    Returns the shares that are not empty as (shard, source, blocks), shards ascending. A node sees
    only the sources it has blocks of; its generator depends on the seed and on its shards.
    """
    before = np.concatenate([[0], np.cumsum(totals, dtype=np.int64)])
    found = []
    open_ = [(0, len(totals), np.flatnonzero(quotas), quotas[quotas > 0].astype(np.int64))]
    while open_:
        first, last, sources, held = open_.pop()
        if last - first == 1:
            found.append((np.full(len(sources), first), sources, held))
            continue
        middle = (first + last) // 2
        left = deal(np.random.default_rng([seed, first, last]), held, int(before[middle] - before[first]))
        for a, b, share in ((middle, last, held - left), (first, middle, left)):
            open_.append((a, b, sources[share > 0], share[share > 0]))
    return tuple(np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``_source, _rank, source_size, target`` from one row per source.

    The level at which words per unit of weight are shared rises from step to step
    as full sources leave, until no source is above its limit.
    """
    ordered = stored(sizes.orderBy("_source"), "sources", "_uid")
    # The id is the number of the file, ascending with the order, and the row's place in it.
    ordered = ordered.withColumn("_part", F.shiftright("_uid", 40))
    held = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file.
    starts = held.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.col("_uid").bitwiseAND((1 << 40) - 1)
    place = (rank % len(mix.weights)).cast("int")
    weighed = stored(
        ordered.join(F.broadcast(starts), "_part").select(
            "_source", "source_size", rank.alias("_rank"), F.get(F.array(*map(F.lit, mix.weights)), place).alias("_weight")
        ),
        "weights",
    )
    limit = F.lit(mix.most_copies) * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level != before:
        full = limit <= F.col("_weight") * level
        held, weight = weighed.agg(
            F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_weight")))
        ).first()
        level, before = ((total - held) / weight if weight else level), level
    return weighed.select(
        "_source", "_rank", "source_size", F.least(F.col("_weight") * F.lit(level), limit.cast("double")).alias("target")
    )


def draw(docs: DataFrame, carry: list[str], mix: Mix = Mix()) -> DataFrame:
    """``carry`` columns, size, source_size, target and ``draws``: an array of the copies taken.

    A draw is (copy, words, shard): the first ``words`` words of the document, in
    full but for the one at the end of the stretch.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    text = F.coalesce(F.col("text"), F.lit(""))
    source = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    table = stored(
        docs.select(
            *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)],
            source.alias("_source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(mix.seed), "doc_id", text).alias("_order"),
            F.xxhash64(text).alias("_tie"),
        ),
        "sized",
    )
    bits = max(3, (table.count() // SLICE_ROWS).bit_length())
    table = table.withColumn("_slice", F.shiftrightunsigned("_order", 64 - bits))
    parts = stored(table.groupBy("_source", "_slice").agg(F.sum("size").alias("_part")), "slices")
    earlier = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_part").over(earlier), F.lit(0)))
    sources = parts.groupBy("_source").agg(F.sum("_part").alias("source_size"))
    shares = stored(targets(sources, mix), "targets").withColumn("_quota_words", F.round("target").cast("bigint"))
    plan = _shard_plan(shares, mix)
    stretch = F.col("source_size").cast("bigint")

    def block(at: Column) -> Column:
        return F.floor(at / F.col("_block_words"))

    def lying_in(copy: int) -> Column:
        """The shares of the source's blocks that the slice touches in one round of the line."""
        first, last = (block(F.col("_offset") + copy * stretch + more) for more in (F.lit(0), F.col("_part")))
        return F.filter("_shares", lambda x: (x["first"] <= last) & (x["end"] > first))

    if fits_broadcast(plan, LOOKUP_ROWS):
        lookup = offsets.join(F.broadcast(plan), "_source")
    else:
        lookup = salted_join(offsets, plan, ["_source"], ["_slice"])
    lookup = lookup.withColumn("_rounds", F.array(*map(lying_in, range(mix.most_copies)))).drop("_shares", "_part")
    lookup = stored(lookup, "lookup")
    # Rounds are arrays of arrays: their bytes are those of the shares in them.
    size = F.aggregate("_rounds", F.lit(0).cast("bigint"), lambda n, x: n + 32 * F.size(x))
    small = fits_broadcast(lookup, LOOKUP_ROWS) and (lookup.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES

    within = Window.partitionBy("_source", "_slice").orderBy("_order", "_tie", "size", *names[:1])
    before = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        table.withColumn("_before", before)
        .join(F.broadcast(lookup) if small else lookup, ["_source", "_slice"])
        .withColumn("_place", F.col("_offset") + F.col("_before"))
    )

    def taken(copy):
        start = F.col("_place") + copy * F.col("source_size")
        shares = F.get("_rounds", copy.cast("int"))
        words = F.greatest(F.least(F.col("_quota_words") - start, F.col("size")), F.lit(0)).cast("bigint")
        # A text longer than a block: one of its words speaks for it, or the first shards would get too much.
        word = start + F.pmod(F.xxhash64("_order", copy), F.greatest(words, F.lit(1)))
        return F.struct(
            copy.alias("copy"),
            words.alias("words"),
            F.get(F.filter(shares, lambda x: x["end"] > block(word)), F.lit(0))["shard"].alias("shard"),
        )

    copies = F.array(*[F.lit(k).cast("bigint") for k in range(mix.most_copies)])
    draws = F.filter(F.transform(copies, taken), lambda d: d["words"] > 0)
    return placed.select(
        *[F.col(n).alias(c) for c, n in zip(carry, names)], "size", "source_size", "target", draws.alias("draws")
    )


def _shard_plan(shares: DataFrame, mix: Mix) -> DataFrame:
    """Add the block length and ``_shares``: per shard that has blocks of the source the first of them
    and the one after the last.

    The driver holds one number per group of sources and their shares, never rows of the corpus.
    """
    words = int(shares.agg(F.sum("_quota_words")).first()[0] or 0)
    shards = mix.shards(words)
    length = max(1, math.ceil(words / (shards * mix.shard_blocks)))
    quota = F.ceil(F.col("_quota_words") / length).cast("bigint")
    sized = shares.withColumns(
        {
            "_block_words": F.lit(length).cast("bigint"),
            "_quota": quota,
            "_group": F.floor(F.col("_rank") / GROUP_SOURCES),
        }
    )
    rows = sized.groupBy("_group").agg(F.sum("_quota").alias("q")).orderBy("_group").collect()
    quotas = np.array([r["q"] for r in rows], np.int64)
    total = int(quotas.sum())
    even = np.diff(np.array([total * k // shards for k in range(shards + 1)], np.int64))
    shard, group, held = split_quotas(quotas, even, mix.seed)
    schema = "_group bigint, _shards array<bigint>, _held array<bigint>"
    dealt = [
        (rows[g]["_group"], shard[group == g].tolist(), held[group == g].tolist()) for g in range(len(rows))
    ]
    totals = shares.sparkSession.createDataFrame(dealt, schema)

    def share(key: tuple, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("_rank", ignore_index=True)
        shards, held = sources["_shards"][0], sources["_held"][0]
        if not len(shards):
            return pd.DataFrame({"_source": [], "_shares": []})
        seed = mix.seed + 1 + int(key[0])
        at, source, blocks = split_quotas(sources["_quota"].to_numpy(), np.asarray(held), seed)
        # Shards come in any order along a source, so its last block, which may be short, is no one's lot.
        order = np.lexsort((np.random.default_rng([seed]).random(len(at)), source))
        at, source, blocks = np.asarray(shards)[at[order]], source[order], blocks[order]
        found: dict[int, list[dict[str, int]]] = {}
        for k, s in enumerate(source.tolist()):
            own = found.setdefault(s, [])
            first = own[-1]["end"] if own else 0
            own.append({"first": first, "end": first + int(blocks[k]), "shard": int(at[k])})
        return pd.DataFrame({"_source": sources["_source"][list(found)].tolist(), "_shares": list(found.values())})

    table = (
        sized.select("_source", "_rank", "_quota", "_group")
        .join(F.broadcast(totals) if fits_broadcast(totals, LOOKUP_ROWS) else totals, "_group")
        .groupBy("_group")
        .applyInPandas(share, "_source string, _shares array<struct<first: bigint, end: bigint, shard: bigint>>")
    )
    return stored(sized.drop("_quota", "_group", "_rank").join(table, "_source", "left"), "plan")


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and the draws behind it."""
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, d: a + d["words"])
    return draw(docs, ["doc_id"], mix).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed(docs: DataFrame, mix: Mix = Mix(), in_files: bool = False) -> DataFrame:
    """The mix itself: one row per document and copy with the columns of ``docs``, dealt to the
    shards and shuffled inside each. Texts are whole: the document at the end of a source's stretch
    comes in if half of its words lie before the end. Draws are made without the texts, which are joined
    to them by place (``in_files``: see :func:`riskloom.llm.tables.placed`). Each shard is
    written by as many tasks as its rows fill, each a range of the shard's order."""
    given, names = placed(docs, in_files, "doc_id", "text", "source")
    whole = F.filter("draws", lambda d: 2 * d["words"] >= F.col("size"))
    drawn = draw(given, PLACE, mix).select(*PLACE, whole.alias("draws")).where(F.size("draws") > 0)
    drawn = stored(drawn, "draws")
    small = fits_broadcast(drawn, LOOKUP_ROWS)
    copies, shards = drawn.agg(
        F.coalesce(F.sum(F.size("draws")), F.lit(0)), F.coalesce(F.max(F.array_max("draws.shard")) + 1, F.lit(1))
    ).first()
    rows = given.drop("doc_id", "text", "source").join(F.broadcast(drawn) if small else drawn, PLACE)
    rows = rows.withColumn("_draw", F.explode("draws"))
    out = rows.withColumn(
        "_shuffle", F.xxhash64(F.lit(mix.seed + 1), F.col(names[docs.columns.index("doc_id")]), "_draw.copy")
    )
    # The order within a shard is a hash, so ranges of it are even without a sample.
    bits = max(0, (copies // (shards * SHARD_ROWS)).bit_length())
    part = F.shiftrightunsigned("_shuffle", 64 - bits) if bits else F.lit(0)
    dealt = out.withColumn("_part", part).repartition(2 * shards << bits, "_draw.shard", "_part")
    return restored(dealt.sortWithinPartitions("_draw.shard", "_shuffle"), docs)
