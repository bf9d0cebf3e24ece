"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are lower-cased runs of letters and the first few bytes of longer ones. The
log-odds of a token between toxic and clean texts carry an informative Dirichlet
prior (split like all counts), and only tokens whose counts chance doesn't explain
(likelihood ratio) have any. Every other token scores slightly below zero. A linear scan finds all
maximal segments of a text; extreme-value statistics tell how unlikely a segment
of that score is in a clean text of that length, and the significant ones add up
to the text's statistic, which a logistic curve makes a probability.

Defined cases: null and empty texts have no segment; without learning rows of both
labels every score is the label share (a half without any); labels other than 0
and 1 are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import arrays, learning
from riskloom.llm.tables import small_batches

#: The statistic of a text is held within these bounds before the curve.
LOW, HIGH = -5.0, 40.0


@dataclass(frozen=True)
class Settings:
    """``rows_per_label`` bounds the labelled rows learnt from, ``vocabulary`` the tokens kept of them.

    ``prior`` is how many texts the Dirichlet prior adds to every token; ``drift`` is what
    every token costs a segment; ``alpha`` the chance of a significant segment in a clean text.
    """

    rows_per_label: int = 4000
    vocabulary: int = 50_000
    prefixes: tuple[int, ...] = (7, 5)
    prior: float = 2.0
    least_g: float = 16.0
    drift: float = 0.05
    alpha: float = 0.05
    folds: int = 4
    remainder: int = 2
    threshold: float = 0.3


def token_kinds(found: arrays.Words, prefixes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of token, most specific first: its hashes, and which words have it."""
    length = found.end - found.start
    kinds = [(found.hash, length > 1)]
    for size in prefixes:
        kinds.append((arrays.prefix_hash(found, size), length > size))
    return kinds


def count_tokens(sample: DataFrame, settings: Settings) -> DataFrame:
    """``kind, token, y1, y0``: in how many texts of each label a token is, added up per block first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label = batch.column("text"), np.asarray(batch.column("label"))
            for low, high in arrays.blocks(texts):
                found = arrays.words(texts.slice(low, high - low), arrays.NO_LETTER, fold=True)
                for kind, (hashes, has) in enumerate(token_kinds(found, settings.prefixes)):
                    pairs = np.unique(np.rec.fromarrays([hashes[has], found.row[has]], names="h,r"))
                    tokens, place = np.unique(pairs.h, return_inverse=True)
                    toxic = np.bincount(place, label[low:high][pairs.r] == 1, len(tokens)).astype(np.int64)
                    total = np.bincount(place, minlength=len(tokens)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(tokens), kind, np.int32)),
                            pa.array(tokens.view(np.int64)),
                            pa.array(toxic),
                            pa.array(total - toxic),
                        ],
                        names=["kind", "token", "y1", "y0"],
                    )

    counts = sample.select("text", "label").mapInArrow(run, "kind int, token bigint, y1 bigint, y0 bigint")
    return counts.groupBy("kind", "token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


@dataclass
class Model:
    """Log-odds by kind and token hash, then the extreme-value constants and the curve."""

    tokens: list[np.ndarray]
    odds: list[np.ndarray]
    settings: Settings
    scale: float = 1.0
    log_k: float = 0.0
    theta: tuple[float, float] = (1.0, 0.0)
    maps: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        for tokens in self.tokens:
            seen = np.zeros(1 << 18, bool)
            seen[(tokens & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            self.maps.append(seen)

    def scores(self, found: arrays.Words) -> np.ndarray:
        """The score of every word: the log-odds of its most specific known token, less the drift."""
        out = np.full(len(found.hash), -self.settings.drift)
        open_ = np.ones(len(out), bool)
        for kind, (hashes, has) in enumerate(token_kinds(found, self.settings.prefixes)):
            tokens = self.tokens[kind]
            if not len(tokens):
                continue
            near = np.flatnonzero(open_ & has & self.maps[kind][(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
            at = np.searchsorted(tokens, hashes[near])
            at[at == len(tokens)] = 0
            known = tokens[at] == hashes[near]
            out[near[known]] += self.odds[kind][at[known]]
            open_[near[known]] = False
        return out


def learn_odds(counts: DataFrame, settings: Settings) -> Model:
    """The ``vocabulary`` tokens whose split between the labels is least like chance, by likelihood ratio."""
    totals = counts.groupBy("kind").agg(
        F.sum("y1").alias("n1"), F.sum("y0").alias("n0"), F.count("token").alias("v")
    )
    # The prior adds ``prior`` texts to every token, split as all counts are.
    weight = settings.prior * F.col("v")

    def log_odds(y, n):
        a = settings.prior * F.col(n) / (F.col("n1") + F.col("n0"))
        return F.log((F.col(y) + a) / (F.col(n) + weight * F.col(n) / (F.col("n1") + F.col("n0")) - F.col(y) - a))

    def surprise(y, n):
        expected = (F.col("y1") + F.col("y0")) * F.col(n) / (F.col("n1") + F.col("n0"))
        return F.when(F.col(y) > 0, 2 * F.col(y) * F.log(F.col(y) / expected)).otherwise(0.0)

    rows = (
        counts.join(F.broadcast(totals), "kind")
        .where("n1 > 0 AND n0 > 0")
        .withColumn("odds", log_odds("y1", "n1") - log_odds("y0", "n0"))
        .withColumn("g", surprise("y1", "n1") + surprise("y0", "n0"))
        .where(F.col("g") >= settings.least_g)
        .orderBy(F.desc("g"), "kind", "token")
        .limit(settings.vocabulary)
        .select("kind", "token", "odds")
        .collect()
    )
    tokens, odds = [], []
    for kind in range(1 + len(settings.prefixes)):
        mine = sorted((np.uint64(r["token"] % 2**64), r["odds"]) for r in rows if r["kind"] == kind)
        tokens.append(np.array([m[0] for m in mine], np.uint64))
        odds.append(np.array([m[1] for m in mine], float))
    return Model(tokens, odds, settings)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a sequence, in linear time.

    Only the sums before and after each positive score matter. ``smaller[k]`` is the
    last earlier segment whose sum before it is below that of segment k, so each
    step walks a chain that it then shortens.
    """
    after = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    begin: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    smaller: list[int] = []
    for i in at.tolist():
        b, l, r = i, float(after[i - 1]) if i else 0.0, float(after[i])
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j = smaller[j]
            if j < 0 or right[j] >= r:
                break
            b, l = begin[j], left[j]
            del begin[j:], end[j:], left[j:], right[j:], smaller[j:]
        begin.append(b)
        end.append(i + 1)
        left.append(l)
        right.append(r)
        smaller.append(j)
    return [(b, e, r - l) for b, e, l, r in zip(begin, end, left, right)]


def passages(model: Model, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Significant segments of one text: begin, end (in tokens), score, and its extreme-value statistic."""
    if not len(scores):
        return []
    bar = -np.log(-np.log1p(-model.settings.alpha))
    shift = model.log_k + np.log(len(scores))
    found = [(b, e, s, model.scale * s - shift) for b, e, s in maximal_segments(scores)]
    return [f for f in found if f[3] >= bar]


def statistic(model: Model, scores: np.ndarray) -> tuple[float, int]:
    """Sum of the significant segments' statistics, else that of the best one; and their number."""
    if not len(scores):
        return LOW, 0
    hits = passages(model, scores)
    if hits:
        return float(np.clip(sum(h[3] for h in hits), LOW, HIGH)), len(hits)
    best = max((s for _, _, s in maximal_segments(scores)), default=None)
    if best is None:
        return LOW, 0
    return float(np.clip(model.scale * best - model.log_k - np.log(len(scores)), LOW, HIGH)), 0


def _map_blocks(rows: DataFrame, model: Model, keep: str, schema: str, make) -> DataFrame:
    """One row per text from ``make(model, scores)``, next to ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for low, high in arrays.blocks(texts):
                found = arrays.words(texts.slice(low, high - low), arrays.NO_LETTER, fold=True)
                scores = model.scores(found)
                out = [make(model, scores[found.first[i] : found.first[i + 1]]) for i in range(high - low)]
                names = [f.split()[0] for f in schema.split(", ")]
                columns = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(keep).slice(low, high - low), *columns], names=[keep, *names]
                )

    kind = dict(rows.dtypes)[keep]
    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, {schema}")


def _sums(model: Model, scores: np.ndarray) -> tuple[int, float, int]:
    found = maximal_segments(scores)
    return len(found), float(sum(s for _, _, s in found)), len(scores)


def _extremes(model: Model, seen: DataFrame) -> None:
    """The law of segments in clean texts: they fall at a rate ``K`` per token, and their scores have an
    exponential tail of rate ``scale``, so the best of n tokens is Gumbel with location ``log(K n) / scale``.

    Half a segment more is counted, so a corpus without any still has a law.
    """
    rows = _map_blocks(
        seen.where("label = 0"), model, "label", "segments bigint, total double, words bigint", _sums
    )
    segments, total, words = rows.agg(F.sum("segments"), F.sum("total"), F.sum("words")).first()
    segments, total, words = (segments or 0) + 0.5, (total or 0.0) + 0.5, max(words or 0, 1)
    model.scale = min(1.0, segments / total)
    model.log_k = float(np.log(segments / words))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[Model | None, float]:
    share = learning.label_share(labels, "toxic", settings.folds, settings.remainder)
    sample = learning.labelled_sample(
        docs, labels, "toxic", settings.folds, settings.remainder, settings.rows_per_label, seed=3
    )
    sample = learning.without_copies(sample)
    if sample.select("label", "part").distinct().count() < 4:
        return None, share
    model = learn_odds(count_tokens(sample.where("part = 0"), settings), settings)
    seen = sample.where("part = 1")
    _extremes(model, seen)
    rows = _map_blocks(seen, model, "label", "statistic double, passages bigint", statistic).collect()
    y = np.array([r["label"] for r in rows], float)
    x = np.array([[r["statistic"]] for r in rows], float)
    theta = learning.logistic_fit(x, y, learning.class_weights(y, share))
    model.theta = (float(theta[0]), float(theta[1]))
    return model, share


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, number of toxic passages."""
    small_batches(docs.sparkSession)
    held = learning.held_out(F.col("doc_id"), settings.folds, settings.remainder).alias("held_out")
    model, share = learn(docs, labels, settings)
    if model is None:
        scored = docs.select("doc_id", F.lit(share).alias("score"), F.lit(0).cast("bigint").alias("passages"))
    else:
        found = _map_blocks(docs, model, "doc_id", "statistic double, passages bigint", statistic)
        z = F.col("statistic") * model.theta[0] + model.theta[1]
        score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(learning.LARGEST)), F.lit(-learning.LARGEST))))
        scored = found.select("doc_id", score.alias("score"), "passages")
    return scored.select(
        "doc_id", held, "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"), "passages"
    )
