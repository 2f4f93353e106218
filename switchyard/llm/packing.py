"""Best-fit packing by exact complements.

Lengths run from one to the capacity, so however many pieces there are, their
histogram has at most ``capacity`` entries.  The plan is made on the histogram
alone: from the longest length down, the gap that a piece leaves is looked up
among the lengths themselves, then among the sums of two, then of three; a
combination that fills the gap exactly is used as often as the counts allow.
What has no complement is packed best fit, longest first, into classes of
equally filled sequences.  The plan says how many sequences have which lengths;
the pieces of each length are then numbered in parallel and look up their place.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.plans.scratch import materialize

Pattern = tuple[tuple[int, ...], int]


class _Available:
    """Counts of the lengths, and which sums of two are worth a look."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in histogram.items():
            self.n[length] += count
        self.capacity = capacity
        self.sums: np.ndarray | None = None

    def take(self, items: tuple[int, ...], times: int) -> None:
        for length, each in Counter(items).items():
            self.n[length] -= each * times
            if not self.n[length]:
                self.sums = None

    def times(self, items: tuple[int, ...]) -> int:
        return min(int(self.n[length]) // each for length, each in Counter(items).items())

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths that add up to ``total``, the larger as large as can be but at most ``most``."""
        top, low = min(most, total - 1), (total + 1) // 2
        if top < low:
            return None
        large = self.n[low : top + 1]
        small = self.n[total - top : total - low + 1][::-1]
        fits = (large > 0) & (small > 0)
        if total % 2 == 0 and fits[0] and self.n[low] < 2:
            fits[0] = False
        found = np.flatnonzero(fits)
        return (low + int(found[-1]), total - low - int(found[-1])) if len(found) else None

    def two_sums(self) -> np.ndarray:
        if self.sums is None:
            there = (self.n > 0).astype(np.float64)
            size = 1 << (2 * self.capacity + 1).bit_length()
            self.sums = np.fft.irfft(np.fft.rfft(there, size) ** 2, size)[: self.capacity + 1] > 0.5
        return self.sums

    def triple(self, total: int) -> tuple[int, int, int] | None:
        low, top = (total + 2) // 3, total - 2
        if top < low:
            return None
        lengths = np.arange(low, top + 1)
        for a in lengths[(self.n[low : top + 1] > 0) & self.two_sums()[total - lengths]][::-1].tolist():
            self.n[a] -= 1
            rest = self.pair(total - a, a)
            self.n[a] += 1
            if rest:
                return (a, *rest)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        if self.n[gap] > 0:
            return (gap,)
        return self.pair(gap, gap) or self.triple(gap)


def _exact_fills(counts: _Available) -> list[Pattern]:
    plan: list[Pattern] = []
    for length in range(counts.capacity, 0, -1):
        while counts.n[length] > 0:
            if length == counts.capacity:
                items: tuple[int, ...] | None = (length,)
            else:
                counts.n[length] -= 1
                rest = counts.complement(counts.capacity - length)
                counts.n[length] += 1
                items = (length, *rest) if rest else None
            if items is None:
                break
            times = counts.times(items)
            plan.append((items, times))
            counts.take(items, times)
    return plan


def _best_fit(counts: _Available) -> list[Pattern]:
    """Best fit, longest first, over classes of sequences that hold the same lengths."""
    classes: dict[int, list[list]] = {}  # gap: [lengths, number of sequences]
    gaps: list[int] = []

    def put(items: tuple[int, ...], number: int) -> None:
        gap = counts.capacity - sum(items)
        if gap not in classes:
            classes[gap] = []
            bisect.insort(gaps, gap)
        classes[gap].append([items, number])

    for length in range(counts.capacity, 0, -1):
        left = int(counts.n[length])
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                items, number = classes[gap].pop()
                if not classes[gap]:
                    del classes[gap], gaps[at]
            else:
                items, number = (), -(-left // (counts.capacity // length))
            each = (counts.capacity - sum(items)) // length
            full = min(number, left // each)
            if full:
                put(items + (length,) * each, full)
                left -= full * each
            if full < number and left:
                put(items + (length,) * min(left, each), 1)
                left -= min(left, each)
                full += 1
            if full < number and items:
                put(items, number - full)
        counts.n[length] = 0
    return [(items, number) for held in classes.values() for items, number in held]


def plan_packing(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of lengths with the number of sequences that follow each.

    Every length of the histogram, from 1 to ``capacity``, is placed as often
    as it is counted and no pattern exceeds the capacity.
    """
    bad = [length for length in histogram if not 1 <= length <= capacity]
    if bad:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    counts = _Available(histogram, capacity)
    plan = _exact_fills(counts)
    # lengths that were put aside may have found partners since
    return plan + _best_fit(counts)


class _Places:
    """For every length, the runs of its numbered pieces and where each run goes."""

    def __init__(self, plan: list[Pattern], capacity: int):
        used = [0] * (capacity + 1)
        runs: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        first_sequence = 0
        for items, number in plan:
            slots: dict[int, list[int]] = {}
            offset = 0
            for length in items:
                slots.setdefault(length, []).append(offset)
                offset += length
            for length, offsets in slots.items():
                runs.setdefault(length, []).append((used[length], first_sequence, len(offsets), offsets))
                used[length] += number * len(offsets)
            first_sequence += number
        self.sequences = first_sequence
        self.runs = {
            length: (
                np.array([r[0] for r in held]),
                np.array([r[1] for r in held]),
                np.array([r[2] for r in held]),
                np.cumsum([0, *(r[2] for r in held[:-1])]),
                np.concatenate([r[3] for r in held]),
            )
            for length, held in runs.items()
        }

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, sequences, each, slot_at, offsets = self.runs[length]
        run = np.searchsorted(starts, ranks, "right") - 1
        inside = ranks - starts[run]
        return sequences[run] + inside // each[run], offsets[slot_at[run] + inside % each[run]]


def _placed(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                sequence[rows], offset[rows] = table.find(int(length), ranks[rows])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (with columns doc_id, piece, start, length) plus ``sequence_id`` and ``offset``.

    ``pieces`` should be a written table: it is read twice.  Pieces of one
    length are numbered in buckets, more of them the more common the length, so
    one length may hold any share of the rows.  Only the histogram (at most
    ``capacity`` rows) comes to the driver and only the plan made from it, of
    bounded size too, is broadcast.  Repeated rows are separate pieces.  An
    empty table gives an empty one.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_Places(plan_packing(histogram, capacity), capacity))
    # rows of a bucket: small enough to spread one common length, few enough buckets to number them
    target = max(256, sum(histogram.values()) // 1_000_000)
    sizes = spark.createDataFrame([(length, -(-n // target)) for length, n in histogram.items()] or [(1, 1)], "length long, buckets long")
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")
    tally = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(offsets, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("skip") + F.col("nth") - 1).cast("long").alias("place"))
    schema = pieces.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return ranked.mapInArrow(_placed(places), f"{schema}, sequence_id:bigint, offset:bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenize, cut and pack whole documents: one row per piece with its sequence and offset."""
    from switchyard.llm.tokens import token_pieces

    return pack_pieces(materialize(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)`` from packed pieces that carry ``ids``; at most ``capacity`` ids a row."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ordered.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids")
    )
