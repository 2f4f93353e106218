"""Approximate nearest neighbours on shifted space-filling curves.

Each of several curves rotates the vectors, keeps the first few dimensions,
shifts them and orders all rows along a Hilbert curve through them.  The order
is made by a range partitioning and a sort; counts of the partitions turn
places in it into numbers, and numbers into blocks of fixed size, so copies or
dense regions never make a large group.  A query looks, on each curve, at the
blocks that overlap a window around its own place; the distances are computed
there on the original vectors, and the nearest of all windows are merged.

Of more than ``k`` equal vectors only the smallest ids can be anyone's
neighbours: they alone lie on the curves, and a query among such copies has
them at distance zero without a search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.plans.scratch import materialize

CURVES = 32
DIMENSIONS, BITS = 8, 7
#: Rows that a window spans to either side of the query, whatever the size of the table.
WINDOW = 512
BLOCK = 2048
SEED = 11
#: Ways in which the rows of one vector are dealt, and groups of copies up to which they are broadcast.
SALTS = 64
BROADCAST_GROUPS = 100_000
#: Pairs of a query and a row whose exact distances are taken at a time.
EXACT_PAIRS = 1 << 17


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer cells (rows of ``bits``-bit coordinates) along a Hilbert curve.

    The coordinates are turned into the curve's transposed index by the known
    sequence of exchanges and inversions from the highest bit down, then Gray
    decoded and interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << 1) | ((x[i] >> bit) & 1)
    return keys


def _curve(number: int, width: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection and shift of a curve."""
    rng = np.random.default_rng([seed, number])
    rotation, _ = np.linalg.qr(rng.standard_normal((width, min(width, dimensions))))
    return rotation, rng.random(rotation.shape[1])


def curve_keys(vectors: np.ndarray, number: int, scale: float, centre: np.ndarray, dimensions: int, bits: int, seed: int) -> np.ndarray:
    rotation, shift = _curve(number, vectors.shape[1], dimensions, seed)
    # four standard deviations and a shift of one cell in the upper half span the grid
    at = ((vectors - centre) @ rotation / (8 * scale) + 0.25 + shift / 2) * (1 << bits)
    return hilbert_keys(np.clip(at, 0, (1 << bits) - 1).astype(np.int64), bits)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _key_batches(curves: int, width: int, scale: float, centre: np.ndarray, dimensions: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), width)
            for number in range(curves):
                keys = curve_keys(vectors, number, scale, centre, dimensions, bits, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number, np.int32)), pa.array(keys), batch.column(0), batch.column(1)], ["curve", "key", "vec_id", "vector"])

    return run


def _window_neighbours(width: int, k: int):
    """Nearest rows of each query within each block; rows come sorted by curve, block and kind, queries first."""

    def flush(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held).combine_chunks()
        asked = np.asarray(table.column("asked"))
        queries, rows = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
        if not queries.num_rows or not rows.num_rows:
            return
        ids, near = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector").combine_chunks(), width)
        squares = np.einsum("ij,ij->i", near, near)
        for at in range(0, queries.num_rows, 512):
            part = queries.slice(at, 512)
            asked_ids = part.column("vec_id").to_numpy()
            points = _matrix(part.column("vector").combine_chunks(), width)
            low, high = part.column("low").to_numpy(), part.column("high").to_numpy()
            rank = rows.column("rank").to_numpy()
            rough = squares[None, :] - 2 * points @ near.T
            rough[(rank[None, :] < low[:, None]) | (rank[None, :] > high[:, None]) | (ids[None, :] == asked_ids[:, None])] = np.inf
            # all up to the k-th by the quick formula and what rounding may hide, then exactly: ties go to the smaller id
            mark = np.partition(rough, min(len(ids), k) - 1, axis=1)[:, min(len(ids), k) - 1]
            norms = np.sqrt(np.einsum("ij,ij->i", points, points))
            mark = mark + 8 * (width + 4) * np.finfo(np.float64).eps * (norms + np.sqrt(squares.max())) ** 2
            for row in range(0, len(points), step := max(1, EXACT_PAIRS // len(ids))):
                piece = slice(row, row + step)
                rows_of, columns = np.nonzero((rough[piece] <= mark[piece, None]) & np.isfinite(rough[piece]))
                gaps = points[rows_of + row] - near[columns]
                scores = np.sqrt(np.einsum("ij,ij->i", gaps, gaps))
                order = np.lexsort((ids[columns], scores, rows_of))
                rows_of, columns, scores = rows_of[order], columns[order], scores[order]
                good = np.arange(len(rows_of)) - np.searchsorted(rows_of, rows_of) < k
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[rows_of[good] + row]), pa.array(ids[columns[good]]), pa.array(scores[good])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        current = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            curve, block = table.column("curve").to_numpy(), table.column("block").to_numpy()
            edges = np.flatnonzero((np.diff(curve) != 0) | (np.diff(block) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, len(curve)], strict=True):
                if start == end:
                    continue
                name = (curve[start], block[start])
                if held and name != current:
                    yield from flush(held)
                    held = []
                current = name
                held.append(table.slice(start, end - start))
        if held:
            yield from flush(held)

    return run


def usable(vector: str = "vector") -> F.Column:
    """Whether a vector is there, has components that are all finite numbers, and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _with_copies(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``copies``: the ``k + 1`` smallest ids of a vector that more than ``k`` rows have, else null."""
    names = ["name", "other"]  # 128 bits of hash; zeros of either sign are one
    named = rows.withColumns({"name": F.xxhash64("vector"), "other": F.xxhash64(F.lit(1), "vector")})
    several = materialize(named.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > k).select(*names), "several")
    groups = several.count()
    if not groups:
        return rows.withColumn("copies", F.lit(None).cast("array<long>"))

    def sent(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if groups <= BROADCAST_GROUPS else frame

    members = named.select("vec_id", *names).join(sent(several), names).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for by in ([*names, "salt"], names):
        members = members.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    copies = materialize(members.groupBy(*names).agg(F.array_sort(F.collect_list("vec_id")).alias("copies")), "copies")
    return named.join(sent(copies), names, "left").drop(*names)


def nearest_neighbours(
    vectors: DataFrame,
    queries: F.Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    window: int = WINDOW,
    dimensions: int = DIMENSIONS,
    bits: int = BITS,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row that ``queries`` selects.

    Nearness is the Euclidean distance, in double precision, on the original
    vectors; ties, however many, go to the smaller id.  A query is never its own neighbour and
    gets all candidates if there are fewer than ``k``.  Vectors that are null,
    zero, of another width than most or hold null or non-finite components
    take no part, nor do rows without an id; rows that repeat an id count once.
    Scale and centre of the grid are fitted on all rows by aggregation.
    A query is compared with ``2 * window`` rows on each curve, so work grows
    with the queries and not with their product with the rows; what share of
    the true neighbours that finds depends on the table (README).
    """
    # four bytes a component are exact where the table has no more
    kind = "float" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "double"
    chosen = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"), queries.alias("asked"))
    chosen = chosen.where(usable()).withColumn("width", F.size("vector"))
    widths = chosen.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return vectors.sparkSession.createDataFrame([], out)
    width = widths[0]["width"]
    rows = materialize(chosen.where(F.col("width") == width).drop("width").dropDuplicates(["vec_id"]), "vectors")
    total = rows.count()
    marked = _with_copies(rows, k)
    others = F.slice(F.filter("copies", lambda x: x != F.col("vec_id")), 1, k)
    direct = marked.where(F.col("asked") & F.col("copies").isNotNull()).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "vec_id"))
    direct = direct.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    # the other copies are nobody's neighbours
    placeable = marked.where(F.col("copies").isNull() | F.array_contains("copies", F.col("vec_id")))
    sought = marked.where(F.col("asked") & F.col("copies").isNull()).select("vec_id")
    moments = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).collect()
    centre = np.zeros(width)
    for r in moments:
        centre[r["at"]] = r["m"]
    scale = float(np.sqrt(np.mean([r["v"] for r in moments]))) or 1.0
    keyed = placeable.select("vec_id", "vector").mapInArrow(_key_batches(curves, width, scale, centre, dimensions, bits, seed), f"curve int, key long, vec_id long, vector array<{kind}>")
    parts = max(curves, -(-total * curves // 65536))
    ordered = keyed.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    placed = materialize(ordered.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "curves")
    # a place's number: those before it in its partition less where its curve starts there, plus the curve's rows in earlier partitions
    tally = placed.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skips = tally.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("skip"))
    ranked = placed.join(F.broadcast(skips), ["curve", "part"]).withColumn("rank", F.col("nth") + F.col("skip")).drop("part", "nth", "skip", "key")
    span = max(k, window)
    block_rows = ranked.select("curve", F.floor(F.col("rank") / block).alias("block"), F.lit(False).alias("asked"), "vec_id", "vector", "rank", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    asked = ranked.join(sought, "vec_id").withColumns({"low": F.greatest(F.col("rank") - span, F.lit(0)), "high": F.least(F.col("rank") + span, F.lit(total - 1))})
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))))
    asked = asked.select("curve", "block", F.lit(True).alias("asked"), "vec_id", "vector", "rank", "low", "high")
    together = block_rows.unionByName(asked).repartition("curve", "block").sortWithinPartitions("curve", "block", F.desc("asked"))
    near = together.mapInArrow(_window_neighbours(width, k), "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    searched = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return searched.unionByName(direct)
