"""Fill-in-middle form of texts, cut with a sparse index of the characters beyond ASCII.

A text is cut at two places drawn from the SHA-256 of a seed and its id and written
with markers: ``psm`` as prefix, suffix, middle, ``spm`` as suffix, prefix, middle,
``plain`` as it is. Cuts count code points (or bytes), texts are bytes in UTF-8. For
a block of texts only the multibyte characters are recorded, each with its position
and with the bytes beyond one that it and all before it take. ``searchsorted`` in
these positions then converts any number of cuts between code points and bytes;
between two recorded characters the conversion is an addition. ASCII text has an
empty index, and no text is decoded.

Defined cases: a null text is an empty one, which stays plain, as does a text that
holds a marker; a null id counts as empty behind the seed; repeated rows give
repeated rows; a text longer than a block is a block of its own; an empty table gives
an empty result; further columns are left out.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import arrays
from riskloom.llm.tables import small_batches

#: Bytes beyond one that a character takes, by its first byte.
EXCESS = np.zeros(256, np.int64)
EXCESS[0xC0:0xE0] = 1
EXCESS[0xE0:0xF0] = 2
EXCESS[0xF0:] = 3

_SPANS = ("prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes")


@dataclass(frozen=True)
class Forms:
    """Shares in percent, markers of prefix, suffix and middle, and whether cuts count ``chars`` or ``bytes``.

    A cut by bytes that falls inside a character moves to its begin.
    """

    seed: str = "1"
    plain_percent: int = 10
    spm_percent: int = 20
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    unit: str = "chars"


class SparseExceptions:
    """Where, in some text in UTF-8, characters take more than one byte: byte and code point at
    which each begins, and the bytes beyond one of all characters before it."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)
        self.extra = np.zeros(len(self.byte) + 1, np.int64)
        np.cumsum(EXCESS[data[self.byte]], out=self.extra[1:])
        self.char = self.byte - self.extra[:-1]

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        return chars + self.extra[np.searchsorted(self.char, chars)]

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points that end at or before each byte."""
        before = np.searchsorted(self.byte, cuts)
        last = np.maximum(before - 1, 0)
        if len(self.byte):
            end = self.byte[last] + 1 + self.extra[last + 1] - self.extra[last]
            inside = (before > 0) & (end > cuts)
            return np.where(inside, self.char[last], cuts - self.extra[before])
        return np.asarray(cuts)


def _draws(doc_id: Column, seed: str) -> list[Column]:
    """The first four groups of eight digits of the hash, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def _spans(texts: pa.Array, first: np.ndarray, second: np.ndarray, forms: Forms) -> tuple[np.ndarray, ...]:
    """Bytes, row bounds, length in code points, and the cuts of each text in code points and bytes."""
    data, offsets = arrays.text_bytes(texts)
    index = SparseExceptions(data)
    starts = index.to_chars(offsets)
    n = np.diff(starts)
    units = n if forms.unit == "chars" else np.diff(offsets)
    cuts = [np.minimum(first % (units + 1), second % (units + 1)), np.maximum(first % (units + 1), second % (units + 1))]
    if forms.unit == "chars":
        chars = [starts[:-1] + cut for cut in cuts]
    else:
        chars = [index.to_chars(offsets[:-1] + cut) for cut in cuts]
    places = [index.to_bytes(c) - offsets[:-1] for c in chars]
    return data, offsets, n, *[c - starts[:-1] for c in chars], *places


def fill_in_middle(docs: DataFrame, forms: Forms = Forms()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output`` of every text.

    ``n`` counts code points; the four lengths are null for plain texts.
    """
    if forms.unit not in ("chars", "bytes"):
        raise ValueError(f"unit is chars or bytes, not {forms.unit}")
    opening, ending, middle = (m.encode() for m in forms.markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in arrays.blocks(batch.column("text")):
                part = batch.slice(low, high - low)
                texts = part.column("text").fill_null("")
                h = [np.asarray(part.column(f"h{i}")) for i in (1, 2, 3, 4)]
                data, offsets, n, c1, c2, b1, b2 = _spans(texts, h[0], h[1], forms)
                marked = functools.reduce(operator.or_, [np.asarray(pc.match_substring(texts, m)) for m in forms.markers])
                plain = (n == 0) | marked | (h[2] % 100 >= 100 - forms.plain_percent)
                spm = h[3] % 100 < forms.spm_percent
                view = memoryview(np.ascontiguousarray(data))
                output = []
                for i in range(high - low):
                    start, end = int(offsets[i]), int(offsets[i + 1])
                    left, right = start + int(b1[i]), start + int(b2[i])
                    if plain[i]:
                        parts = [view[start:end]]
                    elif spm[i]:
                        parts = [ending, view[right:end], opening, view[start:left], middle, view[left:right]]
                    else:
                        parts = [opening, view[start:left], ending, view[right:end], middle, view[left:right]]
                    output.append(b"".join(parts))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                spans = [pa.array(x, pa.int64(), mask=plain) for x in (c1, c2 - c1, b1, b2 - b1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(form), *spans, pa.array(output, pa.binary()).view(pa.string())],
                    names=["doc_id", "n", "form", *_SPANS, "output"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *_draws(F.col("doc_id"), forms.seed))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    spans = ", ".join(f"{c} long" for c in _SPANS)
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, {spans}, output string")


def restored_text(output: Column, form: Column, forms: Forms = Forms()) -> Column:
    """The text that a form was made of, from the form alone: a text that holds a marker is always plain."""
    parts = F.split(output, "|".join(re.escape(m) for m in forms.markers), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def middle_report(docs: DataFrame, forms: Forms = Forms()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    made = fill_in_middle(docs, forms)
    restored = restored_text(F.col("output"), F.col("form"), forms)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )
