"""Folds, bounded samples of labelled rows, and calibration, for the operators that learn."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import arrays
from riskloom.llm.tables import stored

#: No score of exactly 0 or 1 from a logistic curve.
LARGEST = 30.0


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, remainder: int, rows_per_label: int, seed: int
) -> DataFrame:
    """``text, label, part`` of at most ``rows_per_label`` learning rows of each label and of each part.

    Rows come in hashed order, the same on every run. Part 0 learns the model and
    part 1 its calibration, so no text is calibrated by a model that has seen it;
    documents of one text may still fall into both. Only ids are ordered; texts
    are looked up for those picked.
    """
    label_ = F.col(label).cast("int")
    usable = labels.where(label_.isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, remainder))
    ids = usable.select(F.col("doc_id").cast("bigint"), label_.alias("label")).distinct()
    hashed = ids.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("part", F.pmod("h", F.lit(2)))
    picked = None
    for value in (0, 1):
        for part in (0, 1):
            some = hashed.where((F.col("label") == value) & (F.col("part") == part))
            some = some.orderBy("h", "doc_id").limit(rows_per_label)
            picked = some if picked is None else picked.unionByName(some)
    # At most four times rows_per_label rows.
    picked = stored(picked, "picked")
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(picked), "doc_id")
    return stored(texts.select("text", "label", "part", "h"), "sample")


def without_copies(sample: DataFrame, sketches: int = 3) -> DataFrame:
    """One row of each group of texts with an equal sketch, for several sketches in turn.

    A sketch is the smallest hash of four-word shingles, so near copies nearly
    always have one in common and count once in what is learnt.
    """

    def run(batches):
        for batch in batches:
            out = []
            for low, high in arrays.blocks(batch.column("text")):
                found = arrays.words(batch.column("text").slice(low, high - low), fold=True)
                hashes, rows = arrays.shingles(found, 4)
                cuts = np.searchsorted(rows, np.arange(high - low + 1))
                for i in range(high - low):
                    mine = hashes[cuts[i] : cuts[i + 1]]
                    if not len(mine):
                        mine = found.hash[found.first[i] : found.first[i + 1]]
                    if not len(mine):
                        mine = np.zeros(1, np.uint64)
                    out.append([int(arrays.mix(mine + np.uint64(k)).min() >> np.uint64(1)) for k in range(sketches)])
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * sketches)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *[f"k{k}" for k in range(sketches)]]
            )

    schema = sample.select("*").schema
    for k in range(sketches):
        schema = schema.add(f"k{k}", "long")
    rows = stored(sample.mapInArrow(run, schema), "sketched")
    columns = [c for c in rows.columns]
    for k in range(sketches):
        first = F.min_by(F.struct(*columns), F.struct("h", "text"))
        rows = rows.groupBy(F.col(f"k{k}").alias("_k")).agg(first.alias("_r")).select("_r.*")
    return stored(rows.select("text", "label", "part"), "distinct")


def label_share(labels: DataFrame, label: str, folds: int, remainder: int) -> float:
    """Share of label 1 among the learning rows; a half if there are none."""
    label_ = F.col(label).cast("int")
    row = labels.where(label_.isin(0, 1) & ~held_out(F.col("doc_id"), folds, remainder)).agg(F.avg(label_)).first()
    return 0.5 if row[0] is None else float(row[0])


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression with an intercept (last), by Newton steps to convergence."""
    design = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(design.shape[1])

    def loss(t):
        z = design @ t
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (t[:-1] ** 2).sum() / 2)

    now = loss(theta)
    while True:
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -LARGEST, LARGEST)))
        gradient = design.T @ (weight * (p - y)) + ridge * np.append(theta[:-1], 0)
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design
        curve[np.diag_indices(len(theta))] += ridge
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while size > 1e-8 and loss(theta - size * step) > now:
            size /= 2
        theta, before, now = theta - size * step, now, loss(theta - size * step)
        if before - now <= 1e-10 * (1 + abs(now)):
            return theta


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -LARGEST, LARGEST)))


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights that give a sample drawn per label the label share of all learning rows."""
    positives = max(1, int(y.sum()))
    negatives = max(1, len(y) - int(y.sum()))
    return np.where(y == 1, share * len(y) / positives, (1 - share) * len(y) / negatives)
