"""Connected components of an edge table, by contraction within partitions and alternating stars across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.plans.scratch import materialize, release

#: Edges that a task contracts at a time.
CHUNK = 250_000


def _roots(edges: Iterator[tuple]) -> tuple[list, list]:
    """Each id but the smallest of its component, and that smallest one."""
    above: dict = {}

    def root(x):
        top = x
        while above[top] != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for u, v in edges:
        above.setdefault(u, u)
        above.setdefault(v, v)
        a, b = root(u), root(v)
        if a < b:
            above[b] = a
        elif b < a:
            above[a] = b
    members = [x for x, up in above.items() if up != x]
    return members, [root(x) for x in members]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the smallest id of each component of a chunk, in place of its edges."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        members, roots = _roots(zip(table.column("u").to_pylist(), table.column("v").to_pylist(), strict=True))
        kind = table.schema.field("u").type
        return pa.RecordBatch.from_arrays([pa.array(members, kind), pa.array(roots, kind)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield stars()
            held.clear()
    if held:
        yield stars()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads to a root: no id has two edges up, nor one up and one down."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 64, written: bool = False) -> DataFrame:
    """``(id, component)`` for every id in ``edges``; a component is its smallest id.

    ``edges`` are written first unless they are said to be read from tables.

    Edges are first contracted in as many tasks as there are chunks of a fixed
    size, so what a task can see needs no round and few edges take one task.
    Every round after that is two grouped minima and two joins, so a hub with a
    third of all edges is pre-aggregated before the shuffle and its join side
    can be split by adaptive execution.  Rounds grow with the logarithm of the
    diameter.  Each round is written to the scratch folder, in place of the one
    before.

    Null ends and self loops make no edge; an id that has only those is not in
    the result.  Repeated edges count once.  An empty table gives an empty one.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    current = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if not written:
        current = materialize(current, "edges")
    shape = current.schema
    for done in range(max_rounds):
        parts = -(-current.count() // CHUNK)
        rows = current if done == 0 else _small_star(_large_star(current))
        last, current = current, materialize(rows.coalesce(max(1, parts)).mapInArrow(_contract, shape), "edges")
        if done or not written:
            release(last)
        if parts < 2 or _settled(current):
            break
    else:
        raise RuntimeError("star contraction did not settle")
    members = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
