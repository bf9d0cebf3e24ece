"""Packing documents into sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The linear
program over the length histogram (how often to use each configuration so that
every length is covered) is solved by multiplicative weights: each length has a
price, a knapsack dynamic program finds the configuration of the highest price,
and covering a length lowers its price. The fractional solution is rounded down,
full configurations and others alike, and what is left of the histogram is packed
best-fit.

The histogram has at most ``capacity`` entries whatever the corpus, so this part
is small and runs on the driver; all passes over documents, the numbering of
pieces of equal length and the placement are distributed.

Defined cases: null text is empty and gives one piece holding the end id; equal
rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.joins import fits_broadcast
from riskloom.llm import arrays
from riskloom.llm.tables import LOOKUP_ROWS, small_batches, stored

CAPACITY = 2048
END_ID = 0
SLICE_ROWS = 50_000
#: White space of the tokenizer's rules beyond the six ASCII characters, and its special token.
UNUSUAL = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|endoftext\\|>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_UNITS = 2_000_000

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts by the tokenizer file.

    The rules of a byte-level tokenizer never join across the start of a run of
    white space, so a text is the sequence of its units, a run of white space with
    the word behind it. Each different unit is encoded once per worker. Texts with
    unusual white space or the special token are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)
        }
        # The special token's text may stand in the vocabulary too; no merge leads to it.
        ranks.pop(b"<|endoftext|>", None)
        self.units = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        encoded = [self.units.encode_ordinary(u.decode()) for u in units]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        begin = len(self.ids) + np.cumsum(size) - size
        fresh = np.fromiter((i for ids in encoded for i in ids), np.uint32, int(size.sum()))
        self.ids = np.concatenate([self.ids, fresh])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.size = np.concatenate([self.size, size])[order]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return at, known

    def block(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a block."""
        odd = np.asarray(pc.match_substring_regex(texts.fill_null(""), UNUSUAL))
        plain = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
        found = arrays.words(plain)
        data, offsets = arrays.text_bytes(plain)
        # Unit u of a text reaches from the end of the word before to the end of its own word;
        # white space at the end of a text is a unit without a word.
        begin = np.empty(len(found.row), np.int64)
        if len(begin):
            begin[0] = 0
            begin[1:] = found.end[:-1]
            begin = np.maximum(begin, offsets[found.row])
        last = np.full(len(offsets) - 1, -1)
        last[found.row] = np.arange(len(found.row))
        tail_begin = np.where(last >= 0, found.end[last] if len(last) and len(found.end) else 0, offsets[:-1])
        tail_rows = np.flatnonzero(tail_begin < offsets[1:])
        gap = found.start - begin
        lead = np.zeros(len(begin), np.uint64)
        one = gap == 1
        lead[one] = data[found.start[one] - 1]
        for u in np.flatnonzero(gap > 1):
            lead[u] = hash_bytes(data[begin[u] : found.start[u]])
        keys = arrays.mix(found.hash + lead * np.uint64(0x9E3779B97F4A7C15) + gap.astype(np.uint64))
        unit_rows, unit_begin, unit_end = found.row, begin, found.end
        if len(tail_rows):
            tails = [data[tail_begin[r] : offsets[r + 1]] for r in tail_rows]
            tail_keys = np.array([hash_bytes(t) for t in tails], np.uint64) ^ np.uint64(0x5555)
            keys = np.concatenate([keys, tail_keys])
            unit_begin = np.concatenate([begin, tail_begin[tail_rows]])
            unit_end = np.concatenate([found.end, offsets[1:][tail_rows]])
            unit_rows = np.concatenate([found.row, tail_rows])
            order = np.argsort(unit_rows, kind="stable")
            keys, unit_begin, unit_end, unit_rows = keys[order], unit_begin[order], unit_end[order], unit_rows[order]
        different, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        _, known = self._find(different)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHED_UNITS:
                # A block needs all its units at once, also those that were known before.
                self._forget()
                known[:] = False
            raw = data.tobytes()
            self._learn(different[~known], [raw[unit_begin[u] : unit_end[u]] for u in first[~known]])
        at, known = self._find(different)
        if not known.all():
            raise AssertionError("a unit of the block has not been learnt")
        size, source = self.size[at][inverse], self.begin[at][inverse]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) - np.repeat(ends - size - source, size)]
        per_row = np.zeros(len(offsets), np.int64)
        np.add.at(per_row, unit_rows + 1, size)
        cuts = np.cumsum(per_row)
        rows = [flat[cuts[r] : cuts[r + 1]] for r in range(len(offsets) - 1)]
        for r in np.flatnonzero(odd):
            rows[r] = np.array(self.whole.encode(texts[int(r)].as_py(), add_special_tokens=False).ids, np.uint32)
        return rows


def hash_bytes(data: np.ndarray) -> int:
    raw = data.tobytes()
    return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], 7)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file; what it has learnt serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: all full but the first, which may be shorter."""
    head = length % capacity if length > capacity else length
    starts = [0] if head else []
    starts += range(head, length, capacity)
    return [(s, min(capacity, (head or capacity) if s == 0 else capacity)) for s in starts]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            texts = batch.column("text")
            for low, high in arrays.blocks(texts):
                out: list[tuple] = []
                ids = batch.column("doc_id").slice(low, high - low).to_pylist()
                for doc, tokens in zip(ids, coder.block(texts.slice(low, high - low))):
                    tokens = np.concatenate([tokens, end]).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                        out.append((doc, k, start, length, zlib.crc32(tokens[start : start + length].tobytes())))
                columns = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


# ---------------------------------------------------------------- the linear program


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest price of a configuration within each capacity, and its last length (-1: one token unused)."""
    worth = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        options = worth[c - lengths[: fits[c]]] + price[: fits[c]]
        best = int(options.argmax())
        if options[best] > worth[c - 1]:
            worth[c], choice[c] = options[best], best
        else:
            worth[c] = worth[c - 1]
    return worth, choice


def trace(choice: np.ndarray, used: np.ndarray, lengths: np.ndarray, c: int) -> Counter:
    """The configuration behind ``choice[c]``, as places in ``lengths``; ``used`` has the capacity it fills."""
    picked: Counter = Counter()
    while (c := int(used[c])) > 0:
        picked[int(choice[c])] += 1
        c -= int(lengths[choice[c]])
    return picked


@dataclass
class Solution:
    """``plan``: configurations and how many sequences use each. ``bound``: sequences that any
    packing needs at least, from the best prices met."""

    plan: list[tuple[Counter, int]]
    bound: float

    def sequences(self) -> int:
        return sum(number for _, number in self.plan)


def solve(histogram: dict[int, int], capacity: int, gap: float = 0.001, finest: float = 1 / 64) -> Solution:
    """The best of some solutions with a smaller and smaller epsilon, until one is within ``gap`` and one
    sequence of the bound, halving epsilon saves no more than ``gap``, or epsilon is at its ``finest``."""
    lengths = np.array(sorted(n for n, k in histogram.items() if k), np.int64)
    if not len(lengths):
        return Solution([], 0.0)
    count = np.array([histogram[int(n)] for n in lengths], float)
    # Two prices at which no configuration is worth more than 1: the share of a sequence, and one for more than a half.
    price, halves = lengths / capacity, (np.sign(2 * lengths - capacity) + 1) / 2
    best, bound, epsilon = None, float((halves * count).sum()), 0.25
    if bound > float((price * count).sum()):
        price = price + halves
    while True:
        found = cover(histogram, lengths, price, capacity, epsilon)
        bound = max(bound, found.bound)
        better = best is None or found.sequences() < (1 - gap) * best.sequences()
        if best is None or found.sequences() < best.sequences():
            best = found
        if not better or epsilon <= finest or best.sequences() <= bound * (1 + gap) + 1:
            return Solution(best.plan, bound)
        epsilon /= 2


def cover(histogram: dict[int, int], lengths: np.ndarray, price: np.ndarray, capacity: int, epsilon: float) -> Solution:
    """Covering by multiplicative weights, rounding, and best-fit for the rest.

    A length is worth its ``price``, times a weight that falls exponentially
    until it is covered. A round prices every configuration by one
    knapsack table and uses all those "best with this length in it" that come
    within ``epsilon`` of the best, each until its scarcest length gained a share
    ``epsilon``. Lengths that are covered leave. All configurations, full or not,
    are rounded down to whole sequences. What is left of the histogram goes
    best-fit into the space they leave and into further sequences.
    """
    count = np.array([histogram[int(n)] for n in lengths], float)
    covered = np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    bound = 0.0
    while (covered < 1).any():
        live = np.flatnonzero(covered < 1)
        sizes = lengths[live]
        prices = price[live] * np.exp((covered[live].min() - covered[live]) / epsilon)
        worth, choice = knapsack(prices, sizes, capacity)
        filled = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))
        # Prices under which no configuration is worth more than 1 bound the program from below.
        bound = max(bound, float((prices * count[live]).sum()) / worth[capacity])
        values = prices + worth[capacity - sizes]
        room = np.minimum(epsilon, 1 - covered[live])
        gained = np.zeros(len(live))
        for first in np.argsort(-values, kind="stable"):
            if values[first] < (1 - epsilon) * worth[capacity]:
                break
            if gained[first] >= room[first]:
                continue
            picked = trace(choice, filled, sizes, int(capacity - sizes[first]))
            picked[int(first)] += 1
            at = np.fromiter(picked, np.int64, len(picked))
            if (gained[at] >= room[at]).any():
                continue
            times = np.fromiter(picked.values(), float, len(picked))
            amount = float(((room[at] - gained[at]) * count[live[at]] / times).min())
            key = tuple(sorted((int(sizes[i]), k) for i, k in picked.items()))
            used[key] = used.get(key, 0.0) + amount
            gained[at] += amount * times / count[live[at]]
        covered[live] += gained
        covered[covered > 1 - 1e-9] = 1
    left = {int(n): int(histogram[int(n)]) for n in lengths}
    plan: list[tuple[Counter, int]] = []
    # The fullest first.
    for key, amount in sorted(used.items(), key=lambda x: (-sum(n * k for n, k in x[0]), -x[1], x[0])):
        times = min(int(amount + 1e-6), *[left[n] // k for n, k in key])
        if times:
            plan.append((Counter(dict(key)), times))
            for n, k in key:
                left[n] -= k * times
    return Solution(best_fit(left, capacity, plan), bound)


def best_fit(
    histogram: dict[int, int], capacity: int, begun: list[tuple[Counter, int]] | None = None
) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on counts: equal sequences are one entry with a number. Sequences ``begun`` are filled up."""
    open_: dict[int, list[tuple[Counter, int]]] = {}
    for content, number in begun or []:
        open_.setdefault(capacity - sum(n * k for n, k in content.items()), []).append((content, number))
    for n in sorted((n for n, k in histogram.items() if k), reverse=True):
        left = histogram[n]
        while left:
            space = min((s for s in open_ if s >= n), default=None)
            if space is None:
                each = min(capacity // n, left)
                number = left // each
                open_.setdefault(capacity - each * n, []).append((Counter({n: each}), number))
                left -= each * number
                continue
            content, number = open_[space].pop()
            if not open_[space]:
                del open_[space]
            each = min(space // n, max(1, left // number))
            use = min(number, left // each) if left >= each else 0
            if use == 0:
                each, use = left, 1
            if use < number:
                open_.setdefault(space, []).append((content, number - use))
            grown = Counter(content)
            grown[n] += each
            open_.setdefault(space - each * n, []).append((grown, use))
            left -= each * use
    return [entry for entries in open_.values() for entry in entries]


def slots(plan: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: ranges of ranks with sequence, repeats and offset.

    At most one range per configuration and different length in it."""
    rows, used, sequence = [], Counter(), 0
    for content, number in plan:
        offset = 0
        for n in sorted(content, reverse=True):
            k = content[n]
            rows.append((n, used[n], sequence, k, offset))
            used[n] += k * number
            offset += n * k
        sequence += number
    rows.sort()
    columns = np.array(rows, np.int64).reshape(len(rows), 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), columns))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    spark = small_batches(docs.sparkSession)
    pieces = stored(token_pieces(docs, path or tokenizer_path(), capacity), "pieces", uid="_row")
    slices = max(8, pieces.count() // SLICE_ROWS)
    pieces = pieces.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices)))
    counts = stored(pieces.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = slots(solve(histogram, capacity).plan)
    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if fits_broadcast(counts, LOOKUP_ROWS):
        offsets = F.broadcast(offsets)
    inside = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("_row"))
    ranked = (
        pieces.withColumn("_rn", inside)
        .join(offsets, ["length", "_slice"])
        .select(*[f.name for f in PIECES], (F.col("_before") + F.col("_rn") - 1).alias("_rank"))
    )
    shared = spark.sparkContext.broadcast(table)
    names = [f.name for f in PIECES]
    schema = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        first = np.searchsorted(plan["length"], np.arange(capacity + 2))
        key = plan["length"] * 2**48 + plan["rank"] if len(first) else None
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("_rank"))
            at = np.searchsorted(key, length * 2**48 + rank, side="right") - 1
            inside = rank - plan["rank"][at]
            sequence = plan["sequence"][at] + inside // plan["each"][at]
            offset = plan["offset"][at] + inside % plan["each"][at] * length
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return ranked.mapInArrow(
        place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
