"""Substring deduplication by difference-cover anchors.

A difference cover modulo ``period`` holds, for any two positions, a shift below
the period that takes both to cover positions. Hashes of runs of
``window - period + 1`` words at cover positions are the anchors: two equal
windows, wherever they start, share one that is aligned in both texts.

1. Texts with the same words are one class; only its smallest document has anchors.
2. Anchors found in more than one place mark where windows may repeat.
3. The match is extended there: every window around such an anchor is hashed whole
   (128 bits), and its smallest document is found by a map-side minimum.
4. Words under a window that also starts in a smaller document are removed.

Only texts with shared anchors are read again, and their removed words come back
as ranges. A window in a third of all texts is one row per task after the
map-side minimum, and adaptive execution splits the join back.

Defined cases: null text has no words; a null ``doc_id`` is larger than all others;
rows of equal ``doc_id`` remove nothing from each other; texts shorter than a window
lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import arrays
from riskloom.llm.tables import narrow_lookup, small_batches, stored


@dataclass(frozen=True)
class Cover:
    """``residues`` is a difference cover modulo ``period``: fixed values, checked on creation."""

    window: int = 50
    period: int = 31
    residues: tuple[int, ...] = (1, 5, 11, 24, 25, 27)

    def __post_init__(self):
        found = {(a - b) % self.period for a in self.residues for b in self.residues}
        if len(found) != self.period or self.window < self.period:
            raise ValueError("the residues are no difference cover, or the window is below the period")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1

    def positions(self, n: int) -> np.ndarray:
        """Where the anchors of a text of n words start."""
        at = np.arange(max(0, n - self.anchor + 1))
        return at[np.isin(at % self.period, self.residues)]


def joined_hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


NONE_LEFT = joined_hash([])


def _anchored(docs: DataFrame, cover: Cover) -> DataFrame:
    """doc_id, place, n_words, sha (of the words joined by a space) and the anchors' hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for low, high in arrays.blocks(texts):
                part = texts.slice(low, high - low)
                found = arrays.words(part)
                hashed = arrays.windows(found.hash, cover.anchor)
                blobs = []
                for first, count in zip(found.first.tolist(), found.counts.tolist()):
                    blobs.append(hashed[first + cover.positions(count)].tobytes() if count >= cover.window else b"")
                # Without an argument, bytes.split() cuts at the six ASCII white-space characters.
                shas = [hashlib.sha256(b" ".join((t or "").encode().split())).digest() for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        batch.column("_place").slice(low, high - low),
                        pa.array(found.counts.astype(np.int64)),
                        pa.array(shas, pa.binary()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["doc_id", "_place", "n_words", "sha", "anchors"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), _place().alias("_place"), "text").mapInArrow(
        run, "doc_id bigint, _place bigint, n_words bigint, sha binary, anchors binary"
    )


def _explode(firsts: DataFrame) -> DataFrame:
    """hash, row, index of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("anchors").to_pylist()
            sizes = np.array([len(b) // 8 for b in blobs], np.int64)
            ends = np.cumsum(sizes)
            index = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(b"".join(blobs), np.int64)),
                    pa.array(np.repeat(np.asarray(batch.column("row")), sizes)),
                    pa.array(index.astype(np.int32)),
                ],
                names=["hash", "row", "index"],
            )

    return firsts.select("row", "anchors").mapInArrow(run, "hash bigint, row bigint, index int")


def _again(docs: DataFrame, wanted: DataFrame, copies: DataFrame) -> DataFrame:
    """The texts of stored rows (row, _place, sha, ...), each once: found by document and text, and told apart by
    their words. ``copies`` are the places of several rows; one text of each goes on, so that rows of one
    doc_id, or of none, and one text cost no more than one of them."""
    places = stored(wanted.select("_place").distinct(), "places")
    texts = narrow_lookup(docs.select(_place().alias("_place"), "text"), places, "_place", "left_semi")
    if not copies.isEmpty():
        several = narrow_lookup(texts, copies, "_place", "left_semi").groupBy("_place").agg(F.first("text").alias("text"))
        texts = narrow_lookup(texts, copies, "_place", "left_anti").unionByName(several)
    return texts.join(wanted, "_place")


def _place():
    """A row's document and text in 64 bits; a null document is as good as any other."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("doc_id").isNull(), F.col("text"))


def _key():
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1))


def _candidate_windows(found: DataFrame, cover: Cover) -> DataFrame:
    """h1, h2, row, start, _key of every window that holds a shared anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for low, high in arrays.blocks(texts):
                words = arrays.words(texts.slice(low, high - low))
                one, two = (arrays.windows(words.hash, cover.window, seed) for seed in (0, 1))
                starts, rows = [], []
                for i in range(high - low):
                    n = int(words.counts[i])
                    text = texts[low + i].as_py() or ""
                    if hashlib.sha256(b" ".join(text.encode().split())).digest() != batch.column("sha")[low + i].as_py():
                        continue  # another text of the same 64 bits
                    index = np.asarray(batch.column("shared")[low + i].values)
                    at = cover.positions(n)[index]
                    # A window that starts up to period - 1 words before the anchor holds it whole.
                    mark = np.zeros(n + 2, np.int64)
                    np.add.at(mark, np.maximum(at - cover.period + 1, 0), 1)
                    np.add.at(mark, at + 1, -1)
                    here = np.flatnonzero(np.cumsum(mark)[: n - cover.window + 1] > 0)
                    starts.append(here)
                    rows.append(
                        (
                            batch.column("row")[low + i].as_py(),
                            int(words.first[i]),
                            len(here),
                            batch.column("_key")[low + i].as_py(),
                        )
                    )
                if not rows:
                    continue
                here = np.concatenate(starts)
                sizes = [r[2] for r in rows]
                at = here + np.repeat([r[1] for r in rows], sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one[at].view(np.int64)),
                        pa.array(two[at].view(np.int64)),
                        pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), sizes)),
                        pa.array(here.astype(np.int32)),
                        pa.array(np.repeat(np.array([r[3] for r in rows], np.int64), sizes)),
                    ],
                    names=["h1", "h2", "row", "start", "_key"],
                )

    return found.select("text", "sha", "row", "shared", "_key").mapInArrow(
        run, "h1 bigint, h2 bigint, row bigint, start int, _key bigint"
    )


def _cut(found: DataFrame, cover: Cover) -> DataFrame:
    """row, n_removed, kept_sha256 from the texts and the starts of their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, sha, row, starts in zip(*(batch.column(c) for c in ("text", "sha", "row", "starts"))):
                words = (text.as_py() or "").encode().split()
                if hashlib.sha256(b" ".join(words)).digest() != sha.as_py():
                    continue
                at = np.asarray(starts.values)
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + cover.window, -1)
                covered = np.cumsum(mark)[:-1] > 0
                kept = [w for w, gone in zip(words, covered.tolist()) if not gone]
                out.append((row.as_py(), int(covered.sum()), joined_hash(kept)))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
                names=["row", "n_removed", "kept_sha256"],
            )

    return found.select("text", "sha", "row", "starts").mapInArrow(
        run, "row bigint, n_removed bigint, kept_sha256 string"
    )


def removal_report(docs: DataFrame, cover: Cover = Cover()) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    small_batches(docs.sparkSession)
    table = stored(_anchored(docs, cover), "anchors", uid="row")
    long_ = table.where(F.col("n_words") >= cover.window)
    # One row stands for all that have the same words: the first of those with the smallest doc_id.
    classes = stored(
        long_.groupBy("sha").agg(
            F.min(F.struct(_key().alias("_key"), "row", "_place")).alias("first"), F.count(F.lit(1)).alias("members")
        ).select("sha", "first._key", "first.row", "first._place", "members"),
        "classes",
    )
    anchors = _explode(narrow_lookup(long_, classes.select("row"), "row", "left_semi"))
    shared = anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    places = anchors.join(shared, "hash", "left_semi").groupBy("row").agg(F.collect_list("index").alias("shared"))
    wanted = stored(places.join(classes.select("row", "_key", "_place", "sha"), "row"), "wanted")
    copies = stored(long_.groupBy("_place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_place"), "copies")
    # The texts are stored and their windows hashed twice: that is a fraction of storing the hashes.
    windows = _candidate_windows(stored(_again(docs, wanted, copies), "texts"), cover)
    least = windows.groupBy("h1", "h2").agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"))
    repeated = windows.join(least.where("_least < _most").select("h1", "h2", "_least"), ["h1", "h2"])
    starts = repeated.where("_key > _least").groupBy("row").agg(F.collect_list("start").alias("starts"))
    hit = stored(starts.join(wanted.select("row", "_place", "sha"), "row"), "starts")
    cut = stored(_cut(_again(docs, hit, copies), cover), "cut")
    return _assembled(table, classes, cut)


def _assembled(table: DataFrame, classes: DataFrame, cut: DataFrame) -> DataFrame:
    """All rows: copies of a smaller document lose every word, others what their class lost."""
    changed = classes.join(cut, "row", "left").where("members > 1 OR n_removed IS NOT NULL")
    entry = stored(changed.select("sha", F.col("_key").alias("_first"), "n_removed", "kept_sha256"), "changed")
    rows = narrow_lookup(table.select("doc_id", "n_words", "sha", "row"), entry, "sha", "left", spread="row")
    copy = F.coalesce(_key() > F.col("_first"), F.lit(False))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(NONE_LEFT))
        .otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha"))))
        .alias("kept_sha256"),
    )
