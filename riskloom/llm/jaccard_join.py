"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles, as 64-bit hashes. Under any common order
of shingles, two sets that link share at least l shingles within their prefixes of
``n - need(n) + l`` shingles, where ``need(n)`` is the least overlap a set of n
shingles can link with. The prefix and l may differ from set to set; a pair then
needs the smaller of its two l, and more by as much as its own least overlap,
which follows from both sizes, exceeds ``need(n)``.

1. Equal sets become one class, so copies cost one row each.
2. Screen, in hash order: l grows with the set (a twentieth of it). A class goes on
   if as many shingles of its prefix occur in other prefixes. Most texts end here.
3. Join, on what is left, in order of frequency: each class picks the l whose cost
   (postings read, and sets compared for the candidates these can make) is least:
   the longer the prefix, the more shared shingles it asks for.
4. Each class first meets one partner, the one it shares most with among the pivots
   of its shingles: their most central sets, which most of a group links with. What this links is contracted, and only pairs of different
   components are then formed and verified, so a large group of near copies costs
   its size and not its square. More pivot rounds follow while the pairs left are
   many and each round at least halves them.
5. The last round orders the shingles of the open sets anew, by the pairs of
   different components that share them: what only one component holds comes first
   and costs nothing. Of a pair the smaller set is read by its index prefix, the
   larger one by a prefix for each bucket of smaller sizes, so both follow the
   overlap these sizes ask for; each picks its l by cost as before, and a pair is
   verified from the smaller l on. Components meet first and then their sets, so
   no row is made for two sets of one component.

Defined cases: a text of fewer words than a shingle is one shingle; without words
or null it has the empty set and links with nothing; a null ``doc_id`` is never a
component's number unless all its rows have none; equal rows are one class; an
empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import arrays
from riskloom.llm.graph import components
from riskloom.llm.tables import PLACE, narrow_lookup, placed, restored, small_batches, stored, without

#: Pairs left per posting below which the last round begins.
PAIRS_PER_POSTING = 4
#: Reading and comparing one shingle of a candidate, in postings.
COMPARE = 0.05
#: Ratio of the sizes at the ends of a bucket of the last round.
BUCKET = 1.02


@dataclass(frozen=True)
class Join:
    """Shingles of ``size`` words; sets link at ``percent`` or more of their union."""

    size: int = 4
    percent: int = 85

    def need(self, n):
        """The least overlap with which a set of n shingles can link."""
        return -(-self.percent * n // 100)

    def screen(self, n):
        """l of the screen."""
        return 1 + n // 20

    def prefix(self, n):
        return n - self.need(n) + self.screen(n)

    def overlap(self, n, m):
        """The least overlap of sets of n and m shingles that link."""
        return -(-self.percent * (n + m) // (100 + self.percent))


def bucket(n: int) -> int:
    """The bucket of a set size; it never falls as n grows."""
    return int(math.log(n) / math.log(BUCKET))


def bucket_floor(place: int) -> int:
    """A size no larger than any of the bucket, with one to spare for rounding."""
    return max(1, int(BUCKET**place) - 1)


def pick_level(n: int, need: int, reads: np.ndarray) -> tuple[int, int]:
    """The level of least cost and how many of the shared shingles its prefix holds.

    A set of n shingles must share ``need`` of them; ``reads`` are the postings behind
    each shingle that others have, in order. The rest, n - len(reads), come first in
    the order and take room. (0, 0) if the set cannot share enough.
    """
    if len(reads) < need:
        return 0, 0
    level = np.arange(1, min(need, 1 + n // 10) + 1)
    inside = np.clip(n - need + level - (n - len(reads)), 0, len(reads))
    if inside[0] < 1:
        return 0, 0
    read = np.concatenate([[0], np.cumsum(reads)])[inside]
    cost = np.where(inside >= level, read + COMPARE * n * read / level, np.inf)
    best = int(np.argmin(cost))
    return int(level[best]), int(inside[best])


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    found = arrays.words(texts, fold=True)
    hashes, rows = arrays.shingles(found, size)
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    sets = [np.unique(hashes[cuts[r] : cuts[r + 1]]) for r in range(len(texts))]
    for r in np.flatnonzero((found.counts > 0) & (found.counts < size)):
        part = found.hash[found.first[r] : found.first[r + 1]]
        whole = np.uint64(len(part))
        for h in part:
            whole = arrays.mix(np.array([whole ^ h], np.uint64))[0] + np.uint64(len(part))
        sets[r] = np.array([whole], np.uint64)
    return sets


def fingerprint(tokens: np.ndarray) -> bytes | None:
    """128 bits that depend on the set alone; None for the empty set."""
    if not len(tokens):
        return None
    one, two = arrays.mix(tokens + np.uint64(11)), arrays.mix(tokens ^ np.uint64(0xABCDEF0123456789))
    return np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)]).tobytes()


def _map_sets(df: DataFrame, join: Join, whole: bool) -> DataFrame:
    """Add ``n_shingles``, ``_fp`` and ``_tokens`` (the screen's prefix or the whole set) and drop ``_text``."""
    schema = df.drop("_text").schema.add("n_shingles", "long").add("_fp", "binary").add("_tokens", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("_text")
            texts = batch.column(place)
            for low, high in arrays.blocks(texts):
                part = batch.slice(low, high - low)
                sets = shingle_sets(texts.slice(low, high - low), join.size)
                kept = [s if whole else s[: join.prefix(len(s))] for s in sets]
                columns = [c for i, c in enumerate(part.columns) if i != place]
                names = [f.name for i, f in enumerate(part.schema) if i != place]
                columns += [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in kept], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_shingles", "_fp", "_tokens"])

    return df.mapInArrow(run, schema)


def _postings(df: DataFrame, key: str) -> DataFrame:
    """One row ``token, key`` per shingle in ``_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("_tokens").to_pylist()
            sizes = np.array([len(b) // 8 for b in blobs], np.int64)
            tokens = np.frombuffer(b"".join(blobs), np.int64)
            keys = np.repeat(np.asarray(batch.column(key)), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(keys)], names=["token", key])

    return df.select(key, "_tokens").mapInArrow(run, f"token bigint, {key} bigint")


def _shared(postings: DataFrame) -> DataFrame:
    """The shingles of two or more sets, with their number."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")


def _survivors(table: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The classes whose screen prefix shares enough shingles with other prefixes."""
    firsts = narrow_lookup(table, classes.select("row"), "row", "left_semi")
    postings = _postings(firsts, "row")
    hits = postings.join(_shared(postings), "token", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("hits"))
    least = F.ceil(F.col("n_shingles") * join.percent / 100)
    wanted = 1 + F.floor(least / 20)
    return stored(classes.join(hits, "row").where(F.col("hits") >= wanted).drop("hits"), "survivors")


def _adaptive(sets: DataFrame, join: Join) -> DataFrame:
    """``token, node, n, mean`` for the prefix each set picks, in order of frequency.

    ``mean`` is the overlap with all other sets together, over n: the more, the more central the set.

    Shingles of one set only come first in the order and take room in the prefix,
    but are no postings.
    """
    postings = _postings(sets, "node")
    known = postings.join(_shared(postings), "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared")
    )
    rows = known.join(sets.select("node", F.col("n_shingles").alias("n")), "node").select(
        "node", "n", F.col("shared.df").alias("df"), F.col("shared.token").alias("token")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, n, df, token in zip(*(batch.column(c) for c in ("node", "n", "df", "token"))):
                n = n.as_py()
                df, token = np.asarray(df.values), np.asarray(token.values)
                level, take = pick_level(n, join.need(n), df - 1)
                if level:
                    out.append((token[:take], node.as_py(), n, float((df - 1).sum() / n)))
            sizes = np.array([len(o[0]) for o in out], np.int64)
            columns = [np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64)]
            columns += [np.repeat(np.array([o[i] for o in out], np.int64), sizes) for i in (1, 2)]
            columns.append(np.repeat(np.array([o[3] for o in out], float), sizes))
            names = ["token", "node", "n", "mean"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return rows.mapInArrow(run, "token bigint, node bigint, n bigint, mean double")


def _verify(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose sets link, by an exact count of what they share."""
    one = sets.select(F.col("node").alias("a"), F.col("_tokens").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("_tokens").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb")):
                x, y = (np.frombuffer(t.as_py(), np.uint64) for t in (ta, tb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= join.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(
        run, "a bigint, b bigint"
    )


def _sizes_fit(n, m, join: Join):
    return (100 * n >= join.percent * m) & (100 * m >= join.percent * n)


def _contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Join the components that links connect."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b"
    )
    merged = components(ends, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("root"))
    joined = labels.join(merged, "component", "left")
    return stored(joined.select("node", F.coalesce("root", "component").alias("component")), "labels")


def _link(sets: DataFrame, join: Join) -> DataFrame:
    """``node, component`` of the stored sets that may link at all."""
    prefixes = stored(_adaptive(sets, join), "prefixes")
    labels = stored(prefixes.select("node", F.col("node").alias("component")).distinct(), "labels")
    turn, before = 0, None
    while True:
        placed = prefixes.join(labels, "node")
        per = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
        tokens = per.groupBy("token").agg(
            F.count(F.lit(1)).alias("parts"),
            ((F.sum("k") ** 2 - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"),
            F.sum("k").alias("postings"),
        )
        mixed = stored(tokens.where("parts > 1"), "mixed")
        left, postings = mixed.agg(F.sum("pairs"), F.sum("postings")).first()
        if not left:
            return labels
        # Components only grow, so a shingle within one of them never comes back.
        open_ = stored(placed.join(mixed.select("token"), "token", "left_semi"), "open")
        prefixes = open_.drop("component")
        if turn and (left <= PAIRS_PER_POSTING * postings or left > before / 2):
            break
        before = left
        # A central set links with most of its group; later rounds draw others, the central ones more often.
        draw = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << 20)) + 1 if turn else F.lit(1)
        pivot = open_.groupBy("token").agg(
            F.max(F.struct((F.col("mean") * draw).alias("h"), "node", "n", "component")).alias("p")
        )
        met = (
            open_.join(pivot, "token")
            .where((F.col("component") != F.col("p.component")) & _sizes_fit(F.col("n"), F.col("p.n"), join))
            .groupBy("node", F.col("p.node").alias("pivot"))
            .agg(F.count(F.lit(1)).alias("k"))
        )
        best = met.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("k", "pivot"))["pivot"].alias("b"))
        links = stored(_verify(stored(best, "met"), sets, join), "links")
        if not links.isEmpty():
            labels = _contract(labels, links)
        turn += 1
    pairs = stored(_open_pairs(sets, labels, open_.select("node").distinct(), join), "pairs")
    links = stored(_verify(pairs, sets, join), "links")
    return labels if links.isEmpty() else _contract(labels, links)


def _reordered(sets: DataFrame, placed: DataFrame, join: Join) -> DataFrame:
    """``token, bucket, node, component, n, level, probe``: what the sets of ``placed`` (node, component) read in the
    last round, as the smaller set of a pair (in the bucket of its own size) and as the larger one (``probe``)."""
    postings = _postings(sets.join(placed, "node", "left_semi"), "node").join(placed, "node")
    per = postings.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    tokens = per.groupBy("token").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("k").alias("all"),
        (F.sum("k").cast("double") ** 2 - F.sum(F.col("k").cast("double") ** 2)).alias("pairs"),
    )
    others = per.join(tokens.where("parts > 1"), "token").select(
        "token", "component", "pairs", (F.col("all") - F.col("k")).alias("others")
    )
    known = postings.join(others, ["token", "component"]).groupBy("node", "component").agg(
        F.sort_array(F.collect_list(F.struct("pairs", "token", "others"))).alias("shared")
    )
    rows = known.join(sets.select("node", F.col("n_shingles").alias("n")), "node").select(
        "node", "component", "n", F.col("shared.token").alias("token"), F.col("shared.others").alias("others")
    )
    names = ["bucket", "node", "component", "n", "level", "probe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, facts = [np.zeros(0, np.int64)], []
            for node, component, n, token, reads in zip(*(batch.column(i) for i in range(5))):
                node, component, n = node.as_py(), component.as_py(), n.as_py()
                token, reads = np.asarray(token.values), np.asarray(reads.values)
                # As the smaller set it meets sizes from n on, as the larger one those of each bucket below.
                turns = [(bucket(n), n, 0)]
                turns += [(b, max(join.need(n), bucket_floor(b)), 1) for b in range(bucket(join.need(n)), bucket(n) + 1)]
                for place, least, probe in turns:
                    level, take = pick_level(n, join.overlap(n, least), reads)
                    if level:
                        tokens.append(token[:take])
                        facts.append((take, place, node, component, n, level, probe))
            table = np.array(facts, np.int64).reshape(-1, 7)
            columns = [np.concatenate(tokens)] + [np.repeat(table[:, i], table[:, 0]) for i in range(1, 7)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", *names])

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ["token", *names]))


def _open_pairs(sets: DataFrame, labels: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of different components that share enough of their prefixes, among the open ``nodes``."""
    placed = stored(labels.join(nodes, "node", "left_semi"), "placed")
    reads = stored(_reordered(sets, placed, join), "reads")
    place = ["token", "bucket"]

    def side(probe: int, end: str) -> DataFrame:
        mine = [F.col(c).alias(f"{c}_{end}") for c in ("component", "node", "n", "level")]
        return reads.where(F.col("probe") == probe).select(*place, *mine)

    x, y = side(0, "a"), side(1, "b")
    meet = (
        x.select(*place, "component_a")
        .distinct()
        .join(y.select(*place, "component_b").distinct(), place)
        .where("component_a != component_b")
    )
    smaller = F.struct("n_a", "node_a") < F.struct(F.col("n_b").alias("n_a"), F.col("node_b").alias("node_a"))
    return (
        meet.join(x, [*place, "component_a"])
        .join(y, [*place, "component_b"])
        .where(smaller & _sizes_fit(F.col("n_a"), F.col("n_b"), join))
        .groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("k"), F.min(F.least("level_a", "level_b")).alias("wanted"))
        .where("k >= wanted")
        .select("a", "b")
    )


def linked(table: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """``_fp, group``: the group of every set that is no single. ``table`` has row, _key, n_shingles, _fp
    and _tokens (stored); ``texts`` the columns _key and _text from which sets are read again."""
    some = table.where("n_shingles > 0")
    classes = stored(
        some.groupBy("_fp").agg(
            F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("members")
        ),
        "classes",
    )
    survivors = _survivors(table, classes, join)
    keys = stored(table.join(survivors.select("row"), "row", "left_semi").select("_key").distinct(), "keys")
    again = _map_sets(narrow_lookup(texts, keys, "_key", "left_semi").select("_text"), join, whole=True)
    sets = stored(
        again.join(survivors.select("_fp"), "_fp", "left_semi").dropDuplicates(["_fp"]), "sets", uid="node"
    )
    labels = _link(sets, join).join(sets.select("node", "_fp"), "node").select("_fp", "component")
    copies = classes.where("members > 1").select("_fp").join(labels.select("_fp"), "_fp", "left_anti")
    named = labels.select("_fp", F.concat(F.lit("c"), "component").alias("group"))
    return stored(named.unionByName(copies.select("_fp", F.hex("_fp").alias("group"))), "groups")


def component_report(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    small_batches(docs.sparkSession)
    # A key that is never null; rows that share it are told apart by their sets.
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_key")
    source = docs.select("doc_id", key, F.col("text").alias("_text"))
    table = stored(_map_sets(source, join, whole=False), "prefix", uid="row")
    groups = linked(table, source.select("_key", "_text"), join)
    rows = narrow_lookup(table.select("doc_id", "n_shingles", "_fp", "row"), groups, "_fp", "left", spread="row")
    numbers = stored(rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "numbers")
    named = narrow_lookup(rows, numbers, "group", "left", spread="row")
    return named.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, join: Join = Join(), in_files: bool = False) -> DataFrame:
    """The documents that stay when one of each component does (smallest ``doc_id``), with all columns.
    ``in_files``: see :func:`riskloom.llm.tables.placed`."""
    small_batches(docs.sparkSession)
    given, _ = placed(docs, in_files, "doc_id", "text")
    # Texts are found again by their place; rows that share a key are told apart by their sets.
    source = given.select(*PLACE, "doc_id", F.xxhash64(*PLACE).alias("_key"), F.col("text").alias("_text"))
    table = stored(_map_sets(source, join, whole=False), "prefix", uid="row")
    groups = linked(table, source.select("_key", "_text"), join)
    rows = narrow_lookup(table.select("doc_id", "_fp", "row"), groups, "_fp", "inner", spread="row")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    gone = stored(rows.select("row").join(first.select("row"), "row", "left_anti"), "dropped")
    dropped = stored(narrow_lookup(table.select("row", *PLACE), gone, "row", "left_semi").select(*PLACE), "places")
    return restored(without(given, dropped), docs)
