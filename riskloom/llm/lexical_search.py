"""Ranked lexical search: best-first intervals of documents under range-maximum bounds.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII,
with A-Z lower-cased. One pass over the documents keeps, of every document, its
length and the counts of the terms that some query asks for; a second pass works on
segments of that table. In a segment the documents get places in order of length and
every term a posting list by place, with the whole part it adds to a score (its
impact) beside each document. A sparse table over each list answers in two reads
where the largest impact between two places is. A query starts with the interval of
all places. The interval with the largest bound, the sum of its terms' range maxima,
is split at the document of the largest single impact; that document is scored
exactly and both sides get bounds of their own. The search ends when no bound reaches
the worst of the best documents so far, so every other document was ruled out and the
ranking is exact. The best documents of a task's segments carry over from one to the
next; those of all tasks are merged by one small shuffle. Postings are never shuffled.

Queries are taken in blocks of ``Search.block`` pairs of query and term, each with
its own passes, so what the driver and the tasks hold of them is bounded.

Defined cases: null and empty texts have no terms and are found by nothing; a query
without terms or without a document above 0 has no rows; repeated rows of documents
count as documents and repeated queries as queries; equal scores are ranked by
ascending id, null ids last; a text longer than a segment is a segment of its own;
empty tables give an empty result; further columns are left out. Terms are compared
by hashes of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import arrays
from riskloom.llm.tables import small_batches, stored

#: Everything in ASCII but digits and letters.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_LAST = np.iinfo(np.int64).max
_FOUND = "item long, item_id long, doc_id long, score long"


@dataclass(frozen=True)
class Search:
    """``top`` documents per query; ``segment`` postings are searched at once, ``width`` intervals are split
    at once, ``block`` pairs of query and term make a block of queries. The last three bound memory only."""

    top: int = 10
    segment: int = 1_000_000
    width: int = 128
    block: int = 1_000_000


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms with repeats, and the documents that hold each query term."""

    documents: int
    terms: int
    frequency: np.ndarray

    def weights(self) -> np.ndarray:
        """1000 times the logarithm of the inverse share of documents with the term, rounded down."""
        ratio = [(2 * self.documents + 2) / (2 * int(df) + 1) for df in self.frequency]
        return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)

    def impacts(self, weight: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term that occurs ``tf`` times adds to the score of a document of ``length`` terms."""
        if len(length) and 90 * int(length.max()) * self.documents < 2**63:
            m = 10 + 90 * length * self.documents // max(1, self.terms)
        else:
            m = np.array([10 + 90 * int(n) * self.documents // max(1, self.terms) for n in length], np.int64)
        return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Best:
    """The best documents of one query so far: scores, whether the id is null, ids."""

    def __init__(self, top: int):
        self.top = top
        self.score = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)
        self.id = np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this can't enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        enters = score >= self.least
        if enters.any():
            score = np.concatenate([self.score, score[enters]])
            none = np.concatenate([self.none, none[enters]])
            ids = np.concatenate([self.id, ids[enters]])
            order = np.lexsort((ids, none, -score))[: self.top]
            self.score, self.none, self.id = score[order], none[order], ids[order]


class Segment:
    """Posting lists of some documents, by place, with a range-maximum table over each of them.

    ``offsets`` cuts ``terms`` and ``counts`` into documents. Of documents that agree in
    length and all counts only the ``top`` smallest ids can be among the best; the others
    are left out, so a group of copies costs no more than ``top`` of them.
    """

    def __init__(
        self,
        ids: np.ndarray,
        none: np.ndarray,
        length: np.ndarray,
        offsets: np.ndarray,
        terms: np.ndarray,
        counts: np.ndarray,
        corpus: Corpus,
        weights: np.ndarray,
        top: int,
    ):
        row = np.repeat(np.arange(len(ids)), np.diff(offsets))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(
            terms.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64)
        ), dtype=np.uint64)])
        content = sums[offsets[1:]] - sums[offsets[:-1]]
        order = np.lexsort((ids, none, content, length))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (content[order][1:] != content[order][:-1]) | (length[order][1:] != length[order][:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        order = order[np.arange(len(order)) - first < top]
        place = np.full(len(ids), -1, np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.none, self.size = ids[order], none[order], max(1, len(order))

        use = (place[row] >= 0) & (weights[terms] > 0)
        row, terms, counts = row[use], terms[use].astype(np.int64), counts[use].astype(np.int64)
        key = terms * self.size + place[row]
        by = np.argsort(key)
        self.key = key[by]
        self.place = self.key % self.size
        self.impact = corpus.impacts(weights[terms[by]], counts[by], length[row[by]])
        self.start = np.searchsorted(self.key, np.arange(len(weights) + 1) * self.size)
        self.table = self._range_maxima()

    def _range_maxima(self) -> np.ndarray:
        """Row j holds, for each posting, where the largest impact of it and the 2^j - 1 after it is. The tables
        of all lists lie end to end; a range never leaves its list, so what crosses a border is never read."""
        longest = int(np.diff(self.start).max(initial=1))
        n = len(self.key)
        table = np.zeros((max(1, longest.bit_length()), n), np.int32)
        table[0] = np.arange(n)
        for j in range(1, len(table)):
            half = 1 << (j - 1)
            left, right = table[j - 1, : n - half], table[j - 1, half:]
            table[j, : n - half] = np.where(self.impact[left] >= self.impact[right], left, right)
            table[j, n - half :] = table[j - 1, n - half :]
        return table

    def _bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per interval the sum of its terms' range maxima and the place to split it at."""
        has = high > low
        level = np.frexp(np.where(has, high - low, 1))[1] - 1
        left = self.table[level, np.where(has, low, 0)]
        right = self.table[level, np.where(has, high - (1 << level), 0)]
        largest = np.where(has, np.maximum(self.impact[left], self.impact[right]), 0)
        term = largest.argmax(axis=1)
        rows = np.arange(len(low))
        l, r = left[rows, term], right[rows, term]
        return largest.sum(axis=1), self.place[np.where(self.impact[l] >= self.impact[r], l, r)]

    def search(self, terms: np.ndarray, best: Best, width: int) -> int:
        """Bring ``best`` up to date with this segment; returns how many documents were scored."""
        terms = terms[self.start[terms + 1] > self.start[terms]]
        if not len(terms):
            return 0
        base = terms * self.size
        low, high = self.start[terms][None, :], self.start[terms + 1][None, :]
        bound, split = self._bounds(low, high)
        scored = 0
        while True:
            open_ = np.flatnonzero(bound >= best.least)
            if not len(open_):
                return scored
            if len(open_) > width:
                part = np.argpartition(-bound[open_], width)
                now, later = open_[part[:width]], open_[part[width:]]
            else:
                now, later = open_, open_[:0]
            at = split[now]
            a, b = low[now], high[now]
            cut = np.searchsorted(self.key, base[None, :] + at[:, None])
            has = (cut < b) & (self.place[np.minimum(cut, len(self.key) - 1)] == at[:, None])
            score = np.where(has, self.impact[np.minimum(cut, len(self.key) - 1)], 0).sum(axis=1)
            best.add(score, self.none[at], self.ids[at])
            scored += len(now)
            new_low, new_high = np.concatenate([a, cut + has]), np.concatenate([cut, b])
            new_bound, new_split = self._bounds(new_low, new_high)
            keep = new_bound >= best.least
            low, high = np.concatenate([low[later], new_low[keep]]), np.concatenate([high[later], new_high[keep]])
            bound, split = np.concatenate([bound[later], new_bound[keep]]), np.concatenate([split[later], new_split[keep]])


def term_hashes(texts: pa.Array) -> arrays.Words:
    return arrays.words(texts, NO_TERM, fold=True)


def _query_terms(queries: DataFrame) -> DataFrame:
    """``item, item_id, term``: the different terms of every query row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in arrays.blocks(batch.column("text")):
                found = term_hashes(batch.column("text").slice(low, high - low))
                pairs = np.unique(np.stack([found.row.astype(np.uint64), found.hash], axis=1), axis=0)
                rows = pa.array(pairs[:, 0].astype(np.int64) + low)
                columns = [batch.column("item").take(rows), batch.column("item_id").take(rows), pairs[:, 1].view(np.int64)]
                yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(columns[2])], names=["item", "item_id", "term"])

    rows = stored(queries.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")), "items", uid="item")
    return stored(rows.mapInArrow(run, "item long, item_id long, term long"), "query_terms")


def _term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document; terms are places in the sorted vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in arrays.blocks(batch.column("text")):
                found = term_hashes(batch.column("text").slice(low, high - low))
                at = np.minimum(np.searchsorted(vocabulary, found.hash), len(vocabulary) - 1)
                hit = vocabulary[at] == found.hash
                pairs, counts = np.unique(found.row[hit] * len(vocabulary) + at[hit], return_counts=True)
                row, term = np.divmod(pairs, len(vocabulary))
                offsets = pa.array(np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, counts)]
                ids = batch.column("doc_id").slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(found.counts.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"]
                )

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def _flat(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(lists.flatten())


def _corpus(table: DataFrame, size: int) -> Corpus:
    """Counts over all documents; one row per term and task is shuffled, one per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(_flat(batch.column("terms")), minlength=size)
        term = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(seen[term])], names=["term", "df"])

    total = table.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    counted = table.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = counted.toArrow()
    frequency = np.zeros(size, np.int64)
    frequency[np.asarray(found["term"])] = np.asarray(found["df"])
    return Corpus(int(total[0]), int(total[1] or 0), frequency)


def segments(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents of the term counts table, as many at a time as have ``postings`` postings (one at least)."""
    held: list[tuple[np.ndarray, ...]] = []
    total = 0
    for batch in batches:
        doc_id = batch.column("doc_id")
        none = np.asarray(doc_id.is_null())
        sizes = np.asarray(batch.column("terms").value_lengths()).astype(np.int64)
        rest = (none, np.asarray(doc_id.fill_null(_LAST)), np.asarray(batch.column("n")), sizes)
        flat = _flat(batch.column("terms")), _flat(batch.column("counts"))
        ends = np.cumsum(sizes)
        row = 0
        while row < len(sizes):
            before = int(ends[row - 1]) if row else 0
            stop = max(row + (not held), int(np.searchsorted(ends, before + postings - total, side="right")))
            if stop > row:
                after = int(ends[stop - 1])
                held.append((*[x[row:stop] for x in rest], *[x[before:after] for x in flat]))
                total += after - before
            if stop < len(sizes):
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, total = [], 0
            row = stop
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _searched(table: DataFrame, corpus: Corpus, items: list[tuple], search: Search) -> DataFrame:
    """The best documents of each query among those of each task."""
    weights = corpus.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(search.top) for _ in items]
        for none, ids, length, sizes, terms, counts in segments(batches, search.segment):
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
            segment = Segment(ids, none, length, offsets, terms, counts, corpus, weights, search.top)
            for (_, _, wanted), mine in zip(items, best):
                segment.search(wanted, mine, search.width)
        for (item, item_id, _), mine in zip(items, best):
            if len(mine.id):
                n = len(mine.id)
                columns = [
                    pa.array([item] * n, pa.int64()),
                    pa.array([item_id] * n, pa.int64()),
                    pa.array(mine.id, mask=mine.none),
                    pa.array(mine.score),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return table.mapInArrow(run, _FOUND)


def search_documents(docs: DataFrame, queries: DataFrame, search: Search = Search()) -> DataFrame:
    """The ``search.top`` best documents of every query: item_id, rank (from 1), doc_id, score.

    ``docs`` has doc_id and text, ``queries`` item_id and text.
    """
    spark = small_batches(docs.sparkSession)
    asked = _query_terms(queries)
    blocks = -(-asked.count() // search.block)
    found = spark.createDataFrame([], _FOUND)
    for k in range(blocks):
        pairs = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow().combine_chunks()
        terms = np.asarray(pairs["term"]).view(np.uint64)
        vocabulary, places = np.unique(terms, return_inverse=True)
        if not len(vocabulary):
            continue
        item = np.asarray(pairs["item"])
        order = np.argsort(item, kind="stable")
        starts = np.flatnonzero(np.diff(item[order], prepend=item[order[0]] - 1))
        items = [
            (int(item[some[0]]), pairs["item_id"][int(some[0])].as_py(), places[some])
            for some in np.split(order, starts[1:])
        ]
        table = stored(_term_counts(docs, vocabulary), "term_counts")
        corpus = _corpus(table, len(vocabulary))
        found = found.unionByName(_searched(table, corpus, items, search))
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= search.top)
    return best.select("item_id", "rank", "doc_id", "score")
