"""Quality classifier by compression: one zstandard dictionary of good text, one of bad.

A text is compressed block by block with each dictionary. Blocks are short, so
what counts is the dictionary and not what the text has said before. The
difference of the two sizes over their sum becomes a probability by a logistic
curve fitted on labelled texts that no dictionary has seen.

Defined cases: null and empty texts have difference 0; without learning rows of
both labels every score is the label share (a half without any); labels other
than 0 and 1 are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import learning
from riskloom.llm.tables import small_batches


FEATURES = ("difference", "weighed", "rate", "rate_squared")


@dataclass(frozen=True)
class Settings:
    """``rows_per_label`` bounds the labelled rows learnt from, ``blocks_per_label`` the blocks of a dictionary."""

    rows_per_label: int = 3000
    blocks_per_label: int = 3000
    block: int = 2048
    dictionary_bytes: int = 112_640
    level: int = 3
    folds: int = 5
    remainder: int = 0
    threshold: float = 0.3


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False
    )


def compressed_size(raw: bytes, compressor: zstandard.ZstdCompressor, block: int) -> int:
    return sum(len(compressor.compress(raw[i : i + block])) for i in range(0, len(raw), block))


def features(raw: bytes, good, bad, block: int) -> tuple[float, ...]:
    """The normalised size difference (positive: more like good text), alone and weighed by the
    text's length, and the mean size per byte in logs with its square: text that repeats itself
    is small under either dictionary."""
    if not raw:
        return (0.0,) * len(FEATURES)
    a, b = compressed_size(raw, good, block), compressed_size(raw, bad, block)
    difference = (b - a) / (b + a)
    rate = float(np.log((a + b) / 2 / len(raw)))
    return difference, difference * float(np.log1p(len(raw))), rate, rate * rate


def _dictionaries(sample: DataFrame, settings: Settings) -> list[bytes]:
    """Dictionary of label 0 and of label 1 from blocks of the learning part, at most ``blocks_per_label`` each."""
    block = settings.block

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label")):
                raw = (text.as_py() or "").encode()
                parts = [raw[i : i + block] for i in range(0, len(raw), block)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label.as_py()] * len(parts), pa.int32()), pa.array(parts, pa.binary())],
                    names=["label", "part"],
                )

    blocks = sample.where("part = 0").select("text", "label").mapInArrow(cut, "label int, part binary")
    out = []
    for label in (0, 1):
        rows = (
            blocks.where(F.col("label") == label)
            .orderBy(F.xxhash64("part"), "part")
            .limit(settings.blocks_per_label)
            .collect()
        )
        parts = [bytes(r["part"]) for r in rows]
        try:
            trained = zstandard.train_dictionary(
                min(settings.dictionary_bytes, max(1024, sum(map(len, parts)) // 4)), parts, k=200, d=8
            )
            out.append(trained.as_bytes())
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            out.append(b"".join(parts)[: settings.dictionary_bytes])
    return out


def _differences(rows: DataFrame, dictionaries: list[bytes], settings: Settings, keep: str) -> DataFrame:
    schema = rows.select(keep).schema
    for name in FEATURES:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = (_compressor(d, settings.level) for d in dictionaries)
        for batch in batches:
            found = [features((t.as_py() or "").encode(), good, bad, settings.block) for t in batch.column("text")]
            columns = np.array(found, float).reshape(len(found), len(FEATURES)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(keep), *[pa.array(c) for c in columns]], names=[keep, *FEATURES]
            )

    return rows.select(keep, "text").mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the size difference behind them."""
    small_batches(docs.sparkSession)
    share = learning.label_share(labels, "quality", settings.folds, settings.remainder)
    sample = learning.labelled_sample(
        docs, labels, "quality", settings.folds, settings.remainder, settings.rows_per_label, seed=4
    )
    counts = {(r["label"], r["part"]): r["n"] for r in sample.groupBy("label", "part").agg(F.count("text").alias("n")).collect()}
    held = learning.held_out(F.col("doc_id"), settings.folds, settings.remainder).alias("held_out")
    if len(counts) < 4:
        score = F.lit(share)
        return docs.select(
            "doc_id", held, score.alias("score"), (score >= settings.threshold).cast("int").alias("predicted"),
            F.lit(0.0).alias("difference"),
        )
    dictionaries = _dictionaries(sample, settings)
    seen = _differences(sample.where("part = 1"), dictionaries, settings, "label").collect()
    y = np.array([r["label"] for r in seen], float)
    x = np.array([[r[f] for f in FEATURES] for r in seen], float)
    theta = learning.logistic_fit(x, y, learning.class_weights(y, share))
    scored = _differences(docs, dictionaries, settings, "doc_id")
    z = sum((F.col(f) * float(t) for f, t in zip(FEATURES, theta)), F.lit(float(theta[-1])))
    bounded = F.greatest(F.least(z, F.lit(learning.LARGEST)), F.lit(-learning.LARGEST))
    return scored.select(
        "doc_id", held, (1 / (1 + F.exp(-bounded))).alias("score"), "difference"
    ).select("doc_id", "held_out", "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"), "difference")
