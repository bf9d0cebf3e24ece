"""Language identification by multilingual mixture inference.

Each language has a distribution of hashed byte trigrams within runs of letters.
A document is a mixture: expectation-maximisation finds the share of its trigrams
that each language explains, for a whole block of documents at once. The set of
languages is then the one of highest likelihood less a penalty per language, among
the best single language and the growing sets of the largest shares.

Defined cases: null text and text without a letter are ``und`` with score 0, as is
everything when nothing could be learnt; a null language is not learnt from; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import arrays, learning
from riskloom.llm.tables import small_batches

UNDETERMINED = "und"
HASH_BITS = 40
HASHES = 1 << HASH_BITS
#: Languages up to which a block of texts has the usual size; with more it shrinks, as the work space is texts x languages.
USUAL_LANGUAGES = 200


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the documents learnt from of each language: all of a language with no more, else about so many."""

    rows: int = 20_000
    buckets: int = 1 << 15
    smoothing: float = 0.5
    tolerance: float = 1e-4
    penalty: float = 3.0
    largest_set: int = 4
    folds: int = 4
    remainder: int = 2


def trigrams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the distinct trigrams of each text, by row. Runs of letters are padded by one blank."""
    data, offsets = arrays.text_bytes(texts)
    letter = ~arrays.NO_LETTER[data]
    folded = np.where(letter, arrays.FOLD[data], 0).astype(np.uint32)
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.zeros(n, np.uint32)
    before[1:] = np.where(row[1:] == row[:-1], folded[:-1], 0)
    after = np.zeros(n, np.uint32)
    after[:-1] = np.where(row[1:] == row[:-1], folded[1:], 0)
    code = ((before << np.uint32(16)) | (folded << np.uint32(8)) | after)[letter]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - (buckets - 1).bit_length())).astype(np.int64)
    keys, counts = np.unique(row[letter] * buckets + bucket, return_counts=True)
    return keys // buckets, keys % buckets, counts


def ascii_lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of ASCII."""
    data, offsets = arrays.text_bytes(texts)
    letter = ~arrays.NO_LETTER[data] & (data < 128)
    before = np.concatenate([[0], np.cumsum(letter)])
    return before[offsets[1:]] > before[offsets[:-1]]


def learn(docs: DataFrame, settings: Settings) -> tuple[list[str], np.ndarray]:
    """The languages in order of their code, and the log-probability of each bucket (language x bucket)."""
    usable = docs.where(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & F.col("doc_id").isNotNull()
        & ~learning.held_out(F.col("doc_id"), settings.folds, settings.remainder)
    )
    usable = usable.select("doc_id", "text", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return names, np.zeros((0, settings.buckets))
    place = {name: i for i, name in enumerate(names)}
    # A language with more rows gives those below a bound on the hash of their id: no order, no hot task.
    limits = [(name, min(HASHES, settings.rows * HASHES // n)) for name, n in sizes.items()]
    limits = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, _limit bigint"))
    few = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS) < F.col("_limit")
    texts = usable.join(limits, "lang").where(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in arrays.blocks(batch.column("text")):
                row, bucket, count = trigrams(batch.column("text").slice(low, high - low), settings.buckets)
                lang = np.array([place[x] for x in batch.column("lang").slice(low, high - low).to_pylist()], np.int64)
                keys, at = np.unique(lang[row] * settings.buckets + bucket, return_inverse=True)
                total = np.bincount(at, count, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], names=["key", "n"])

    counts = np.full((len(names), settings.buckets), settings.smoothing)
    sums = texts.select("text", "lang").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    counts.reshape(-1)[found["key"].to_numpy(np.int64)] += found["n"].to_numpy(float)
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def mixture(
    row: np.ndarray, count: np.ndarray, log_p: np.ndarray, rows: int, start: np.ndarray, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """Shares (rows x languages) by expectation-maximisation from ``start``, and their log-likelihoods.

    A language with share 0 stays out. Rows whose shares move less than the
    tolerance are finished and leave the computation.
    """
    best = log_p.max(axis=1)
    p = np.exp(log_p - best[:, None])
    shares = start.copy()
    total = np.bincount(row, count, rows)
    open_ = np.arange(len(row))
    while len(open_):
        r = row[open_]
        joint = shares[r] * p[open_]
        joint *= (count[open_] / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        ids = r[begin]
        moved = np.add.reduceat(joint, begin, axis=0) / total[ids][:, None]
        far = np.abs(moved - shares[ids]).max(axis=1) > tolerance
        shares[ids] = moved
        moving = np.zeros(rows, bool)
        moving[ids[far]] = True
        open_ = open_[moving[r]]
    explained = np.log(np.maximum((shares[row] * p).sum(axis=1), 1e-300)) + best
    return shares, np.bincount(row, count * explained, rows)


def identify(texts: pa.Array, names: list[str], log_p: np.ndarray, settings: Settings) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of languages of each text of a block."""
    rows = len(texts)
    row, bucket, count = trigrams(texts, settings.buckets)
    languages = len(names)
    label = np.full(rows, -1)
    score, size = np.zeros(rows), np.zeros(rows, np.int64)
    if languages and len(row):
        lp = np.ascontiguousarray(log_p[:, bucket].T)
        total = np.bincount(row, count, rows)
        single = np.stack([np.bincount(row, count * lp[:, k], rows) for k in range(languages)], axis=1)
        shares, _ = mixture(row, count, lp, rows, np.full((rows, languages), 1 / languages), settings.tolerance)
        fine = settings.penalty * np.log(np.maximum(total, 2))
        first = single.argmax(axis=1)
        chosen = np.zeros((rows, languages))
        chosen[np.arange(rows), first] = 1
        value = single[np.arange(rows), first] - fine
        order = np.argsort(-shares, axis=1, kind="stable")
        for k in range(2, min(settings.largest_set, languages) + 1):
            start = np.zeros((rows, languages))
            np.put_along_axis(start, order[:, :k], np.take_along_axis(shares, order[:, :k], axis=1), axis=1)
            start /= np.maximum(start.sum(axis=1, keepdims=True), 1e-300)
            mixed, likelihood = mixture(row, count, lp, rows, start, settings.tolerance)
            better = likelihood - k * fine > value
            value = np.where(better, likelihood - k * fine, value)
            chosen[better] = mixed[better]
        has = total > 0
        label[has] = chosen.argmax(axis=1)[has]
        size[has] = (chosen[has] > 0).sum(axis=1)
        # How sure the first language is of its share: its posterior against the other single ones.
        odds = single - single.max(axis=1, keepdims=True)
        posterior = np.exp(odds) / np.exp(odds).sum(axis=1, keepdims=True)
        at = np.arange(rows)
        score = np.where(has, np.where(size > 1, chosen[at, label], posterior[at, label]), 0.0)
    # Bytes beyond ASCII may be no letters: ask Python where a text has no ASCII letter.
    lettered = ascii_lettered(texts)
    for i in np.setdiff1d(row, np.flatnonzero(lettered)):
        lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    label[~lettered] = -1
    score[~lettered] = 0
    size[~lettered] = 0
    return [names[k] if k >= 0 else UNDETERMINED for k in label], score, size


def language_report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_languages."""
    spark = small_batches(docs.sparkSession)
    names, log_p = learn(docs, settings)
    shared = spark.sparkContext.broadcast((names, log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = shared.value
        limit = arrays.BLOCK_BYTES * USUAL_LANGUAGES // max(USUAL_LANGUAGES, len(names))
        for batch in batches:
            for low, high in arrays.blocks(batch.column("text"), limit):
                part = batch.slice(low, high - low)
                label, score, size = identify(part.column("text"), names, log_p, settings)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(label, pa.string()), pa.array(score), pa.array(size)],
                    names=["doc_id", "lang_pred", "score", "n_languages"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, n_languages bigint"
    )
    held = learning.held_out(F.col("doc_id"), settings.folds, settings.remainder)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_languages")
