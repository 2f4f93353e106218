"""Exact duplicates with a two-pass Bloom filter.

Pass one turns each text into a digest and sets its bits in two bitmaps: *seen*
and *again*.  A digest whose bits were all seen before, in the same partition
or in another, has its bits set in *again*.  Pass two tests every digest
against *again*: only digests that pass may repeat, and only those rows (id and
digest, never text) are shuffled; every other row is its own group and goes
straight through.  A Bloom filter has no false negatives, and rows let through
by mistake merely form groups of one, so the result is exact at any fill.

Bits grow with the rows: digests are divided by a prefix of theirs into as many
shards as it takes to keep 16 bits a row in bitmaps of bounded size, and the
shards are worked off one after the other.  Digest tables are sorted by that
prefix within their files, so a shard reads little else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.memo import small_parts
from switchyard.plans.scratch import materialize, scratch_scope

#: A bitmap never exceeds 2**29 bits (64 MiB), which is also the most that is broadcast.
MAX_LOG2_BITS = 29
#: Prefixes that digests are sorted by, and so the most shards.
SLICES = 4096
#: Digests that a task turns into bits at a time, whatever the size of the bitmap (16 bytes each, and copies for sorting).
SLAB = 500_000
BITS_PER_ROW = 16
PROBES = 4
#: Bits of a bitmap that travel as one row.
CHUNK_BITS = 1 << 16
#: Ways in which the rows of one digest are dealt.
SALTS = 64


def normalised_digest(text: bytes | None) -> bytes:
    """SHA-256 of the UTF-8 text with A-Z lower-cased and nothing else changed."""
    return hashlib.sha256((text or b"").lower()).digest()


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_parts(batches):
        digests = [normalised_digest(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        prefix = [int.from_bytes(d[-2:]) % SLICES for d in digests]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(prefix, pa.int32())], ["doc_id", "digest", "slice"])


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, slice)`` for every row; a null text counts as empty."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_digest_batches, "doc_id long, digest binary, slice int")


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    if not digests:
        return np.zeros((0, PROBES), np.int64)
    words = np.frombuffer(b"".join(digests), np.dtype("<u4")).reshape(len(digests), 8)
    return (words[:, :PROBES] & np.uint32(bits - 1)).astype(np.int64)


def _container(positions: np.ndarray) -> bytes:
    """Sorted positions of a chunk: as they are where they are few, else as a bitmap, which no list of few is as long as."""
    if 2 * len(positions) < CHUNK_BITS // 8:
        return positions.astype("<u2").tobytes()
    bitmap = np.zeros(CHUNK_BITS, bool)
    bitmap[positions] = True
    return np.packbits(bitmap, bitorder="little").tobytes()


def _bitmap(container: bytes) -> np.ndarray:
    if len(container) == CHUNK_BITS // 8:
        return np.frombuffer(container, np.uint8)
    bitmap = np.zeros(CHUNK_BITS, bool)
    bitmap[np.frombuffer(container, "<u2")] = True
    return np.packbits(bitmap, bitorder="little")


def _partial_bitmaps(bits: int):
    def parts(digests: list[bytes]) -> pa.RecordBatch:
        at = _positions(digests, bits)
        order = np.lexsort(at.T)
        same = np.zeros(len(at), bool)
        same[order[1:]] = (at[order[1:]] == at[order[:-1]]).all(axis=1)
        chunks: dict[int, list[bytes]] = {}
        for which, rows in ((0, at), (1, at[same])):
            found = np.unique(rows)
            of = found // CHUNK_BITS
            edges = np.flatnonzero(np.diff(of)) + 1
            for piece in np.split(found, edges) if len(found) else []:
                chunks.setdefault(int(piece[0] // CHUNK_BITS), [b"", b""])[which] = _container(piece % CHUNK_BITS)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(chunks), pa.int32()), pa.array([c[0] for c in chunks.values()], pa.binary()), pa.array([c[1] for c in chunks.values()], pa.binary())], ["chunk", "seen", "again"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            held += batch.column("digest").to_pylist()
            if len(held) >= SLAB:
                yield parts(held)
                held = []
        if held:
            yield parts(held)

    return run


def _merge_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit is set in *again* if any part set it there or two parts have seen it."""
    merged: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            seen, again = _bitmap(row["seen"]), _bitmap(row["again"])
            if (held := merged.get(row["chunk"])) is None:
                merged[row["chunk"]] = [seen, again]
            else:
                held[1] = held[1] | again | (held[0] & seen)
                held[0] = held[0] | seen
    for chunk, (_, again) in merged.items():
        if again.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "again": [again.tobytes()]})


def _flag_batches(again, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(again.value, np.uint8)
        for batch in batches:
            at = _positions(batch.column("digest").to_pylist(), bits)
            maybe = ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(maybe)], ["doc_id", "digest", "maybe"])

    return run


def _flagged(digests: DataFrame, bits: int) -> DataFrame:
    """``(doc_id, digest, maybe)``, written: whether a digest may occur again among ``digests``."""
    parts = digests.select("digest").mapInArrow(_partial_bitmaps(bits), "chunk int, seen binary, again binary")
    merged = parts.repartition("chunk").mapInArrow(_merge_bitmaps, "chunk int, again binary")
    bitmap = bytearray(bits // 8)
    for row in merged.toLocalIterator():
        bitmap[row["chunk"] * CHUNK_BITS // 8 : (row["chunk"] + 1) * CHUNK_BITS // 8] = row["again"]
    again = digests.sparkSession.sparkContext.broadcast(bytes(bitmap))
    flagged = materialize(digests.mapInArrow(_flag_batches(again, bits), "doc_id long, digest binary, maybe boolean"), "flagged")
    again.destroy()
    return flagged


def bloom_bits(rows: int, max_log2_bits: int = MAX_LOG2_BITS) -> int:
    """Size of the bitmaps: the power of two above 16 bits a row, between 2**16 and the bound."""
    return 1 << min(max_log2_bits, max(16, (BITS_PER_ROW * rows - 1).bit_length()))


def bloom_shards(rows: int, max_log2_bits: int = MAX_LOG2_BITS) -> int:
    """Shards, a power of two, in which a bitmap of the bound has 16 bits a row."""
    return min(SLICES, 1 << max(0, (BITS_PER_ROW * rows - 1).bit_length() - max_log2_bits))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_log2_bits: int = MAX_LOG2_BITS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)`` for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z.  The row with the
    largest id of a group stays.  A null text counts as empty.  Rows that
    repeat an id and a text are all counted and all marked as kept.  A null id
    loses to any id; a group without ids has a null ``keep_id`` and is kept.
    Other columns are not looked at.  An empty table gives an empty one.
    """
    with scratch_scope() as kept:
        digests = materialize(text_digests(docs, id_col, text_col).sortWithinPartitions("slice"), "digests")
        rows = digests.count()
        bits, shards = bloom_bits(rows, max_log2_bits), bloom_shards(rows, max_log2_bits)
        width = SLICES // shards
        kept += [_flagged(digests.where(F.col("slice").between(at, at + width - 1)), bits) for at in range(0, SLICES, width)]
    flagged = reduce(DataFrame.unionByName, kept)
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    rows = flagged.where("maybe").select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    salted = rows.groupBy("digest", "salt").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    totals = salted.groupBy("digest").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    held = salted.select("digest", "salt").join(totals, "digest")
    grouped = rows.join(held, ["digest", "salt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return alone.unionByName(grouped)
