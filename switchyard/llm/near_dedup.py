"""Near-duplicates by a chosen-path set similarity join.

A document is its set of word shingles and, for the search, a signature of
minwise tokens.  A tree starts with all documents in one node.  A node picks
coordinates of the signature by a hash of its own path, 4/3 of them on average
(one over the similarity), and sends every document, for each coordinate, to
the child of the value that it has there: a pair at the similarity sought
follows a critical branching process, unlike pairs part quickly.  Nodes of at
most ``node_limit`` documents are compared exhaustively, larger ones branch on.
Trees are repeated.  They read one signature of 128 minwise values, so that a
pair's misses are not independent: averaged over how much of the signature a
pair at 0.75 agrees in, 16 trees miss it with a probability of 5e-6 where nodes
are small at the first level that is looked at (3), of 2e-4 at level 5, 2e-3 at
level 7 and 1.4e-2 at level 11; only pairs within large groups of texts that
resemble each other without a link go so deep.

Documents compute the first levels by themselves, without a shuffle.  What then
shares a node is compared by a sketch of 512 bytes, whose five standard
deviations decide; pairs that may reach the threshold are confirmed on full
shingle sets.  Copies with equal sets are one document in all
of this.

A group of near copies keeps its nodes large however long they branch.  So the
rows of large nodes are first compared with a pivot and a neighbour; links that
full sets confirm label them by component.  Pairs within a component need no
comparison any more: a node of one label ends, and a node where few rows are
outside its largest label is compared outside against inside, in units of
bounded size.  Disagreement of signatures is a metric, so rows inside that are
so near their component's head that none of the outsiders can be near to them
stay out of it.  Only other nodes branch on, with all their rows.  What is still
large at the last level is compared by blocks, every pair of blocks in a unit.

Candidates are confirmed in two rounds.  The first takes one likely partner for
each row of a node, which joins groups of copies by few proofs; the second
takes every pair of a node that these links have left in different components.
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
from switchyard.llm.shingles import Minwise, Sketch, mix, shingle_set, sketch_similarity
from switchyard.operators.graph import connected_components
from switchyard.plans.scratch import materialize, release, scratch_scope

#: Minwise values that trees branch on, and ranges of the sketch that members of a node are compared by.
SIGNATURE, SKETCH = 128, 512
TREES = 16
FIRST_LEVELS = 3
#: Levels added in each further round, and the last level.
STEP, LAST_LEVEL = 2, 11
#: Trees in whose nodes each row's likely partner is looked for first.
LIKELY_TREES = 4
NODE_LIMIT = 64
#: What a signature's agreement may be under the similarity: five standard deviations at 0.75.
MARGIN = 0.20
#: Pairs of a node whose sketches are compared at a time.
COMPARED = 8192
#: Rows outside a large node's main component up to which they are compared with all of it at once.
OUTSIDERS = 256
#: Rows of the main component in a unit, and of a block of a node that is large at the last level.
UNIT, BLOCK = 512, 256
#: Rows of a large node that share a pivot, on average.
SEGMENT = 1024
#: More ids than this are not broadcast but joined by shuffling.
BROADCAST_IDS = 500_000
#: More bytes of sets than this are not broadcast either.
BROADCAST_BYTES = 12_000_000
#: Plain rows that a row with a sketch or a set counts for, where tasks are sized.
WIDE = 16

_SCHEMA = "doc_id long, n_shingles long, set_id binary, signature binary, sketch binary"


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minwise, sketch = Minwise(SIGNATURE), Sketch(SKETCH)
    for batch in small_parts(batches):
        sizes, names, signatures, sketches = [], [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            hashes = shingle_set(text)
            sizes.append(len(hashes))
            names.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
            signatures.append(minwise(hashes).tobytes() if len(hashes) else None)
            sketches.append(sketch(hashes).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (names, signatures, sketches))],
            ["doc_id", "n_shingles", "set_id", "signature", "sketch"],
        )


def _children(paths: np.ndarray, signatures: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths one level down and the row of each; a node has a second child for one path in three."""
    with np.errstate(over="ignore"):
        out_paths, out_rows = [], []
        for branch in (0, 1):
            use = slice(None) if branch == 0 else mix(paths ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(3) == 0
            chosen, at = paths[use], rows[use]
            pick = mix(chosen + np.uint64(0x9E3779B97F4A7C15) * np.uint64(branch + 1))
            coordinate = (pick % np.uint64(SIGNATURE)).astype(np.int64)
            value = signatures[at, coordinate].astype(np.uint64)
            below = mix(pick ^ mix(value + np.uint64(1)))
            out_paths.append((below & ~np.uint64(1)) | (chosen & np.uint64(1)))  # the last bit tells the first trees
            out_rows.append(at)
    return np.concatenate(out_paths), np.concatenate(out_rows)


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SIGNATURE)


def _first_paths(trees: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        roots = (roots & ~np.uint64(1)) | (np.arange(trees) < LIKELY_TREES).astype(np.uint64)
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                signatures = _signature_matrix(batch.column("signature"))
                paths, rows = np.repeat(roots, len(signatures)), np.tile(np.arange(len(signatures)), trees)
                for _ in range(levels):
                    paths, rows = _children(paths, signatures, rows)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), batch.column("doc_id").take(pa.array(rows))], ["path", "doc_id"])

    return run


def _next_paths(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = _signature_matrix(batch.column("signature"))
            paths, rows = batch.column("path").to_numpy().view(np.uint64), np.arange(batch.num_rows)
            for _ in range(levels):
                paths, rows = _children(paths, signatures, rows)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), batch.column("doc_id").take(pa.array(rows))], ["path", "doc_id"])

    return run


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).mean(axis=1)


def _node_pairs(threshold: float, likely: float | None):
    """Pairs of different labels within units, whose rows come sorted by path, each with a label.

    With ``likely``, each row gets only its first partner of at least that
    estimated similarity, which holds groups of copies together; without, all
    pairs that may reach the threshold, each from the least of the nodes that
    hold both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            paths = table.column("path").to_numpy()
            cut = int(np.searchsorted(paths, paths[-1])) if len(paths) else 0
            rest = table.slice(cut)  # the last node may go on in the next batch
            yield from pairs(table.slice(0, cut))
        if rest is not None:
            yield from pairs(rest)

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        paths, ids, labels, sizes = (table.column(c).to_numpy() for c in ("path", "doc_id", "label", "n_shingles"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(paths), SKETCH)
        nodes, units, homes = (table.column(c).to_numpy() for c in ("node", "unit", "home"))
        partner = np.full(len(paths), -1)
        held_by: dict[int, frozenset] = {}
        for step in range(1, len(paths)):
            same = np.flatnonzero(paths[step:] == paths[:-step])
            if not len(same):
                break
            same = same[(labels[same] != labels[same + step]) & ((homes[same] != homes[same + step]) | (homes[same] == units[same]))]
            for low in range(0, len(same), COMPARED):
                one = same[low : low + COMPARED]
                other = one + step
                estimate, may = sketch_similarity(sketches[one], sketches[other], sizes[one], sizes[other], threshold)
                if likely is not None:  # rows rise by id within a node, so the farthest partner is the first
                    good = estimate >= likely
                    partner[other[good]] = one[good]
                elif may.any():
                    one, other = one[may], other[may]
                    for row in {*one.tolist(), *other.tolist()} - held_by.keys():
                        held_by[row] = frozenset(table["nodes"][row].values.to_pylist())
                    least = [min(held_by[i] & held_by[j]) == node for i, j, node in zip(one.tolist(), other.tolist(), nodes[one].tolist(), strict=True)]
                    yield found(ids[one[least]], ids[other[least]])
        held = np.flatnonzero(partner >= 0)
        if len(held):
            yield found(ids[partner[held]], ids[held])

    def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _head_agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the agreement of their signature with that of their node's main head."""
    for batch in batches:
        agreement = _agreement(_signature_matrix(batch.column("signature")), _signature_matrix(batch.column("head")))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "doc_id", "inside")), pa.array(agreement)], ["path", "doc_id", "inside", "agreement"])


def _near_links(least: float):
    """Likely links within segments of nodes, whose rows come sorted: of each row to the first and to the one before."""

    def links(table: pa.Table) -> pa.RecordBatch:
        paths, parts, ids, labels = (table.column(c).to_numpy() for c in ("path", "part", "doc_id", "label"))
        signatures = _signature_matrix(table.column("signature").combine_chunks())
        row = np.arange(len(ids))
        starts = np.concatenate([[True], (paths[1:] != paths[:-1]) | (parts[1:] != parts[:-1])]) if len(ids) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(starts, row, 0))
        found = []
        for other in (first, np.where(starts, row, row - 1)):
            use = np.flatnonzero(labels != labels[other])
            agreement = _agreement(signatures[use], signatures[other[use]])
            good = agreement >= least
            found.append((ids[other[use[good]]], ids[use[good]], agreement[good]))
        a, b, agreement = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(agreement)], ["a", "b", "agreement"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            paths, parts = table.column("path").to_numpy(), table.column("part").to_numpy()
            same = (paths == paths[-1]) & (parts == parts[-1]) if len(paths) else np.zeros(0, bool)
            cut = int(np.argmax(same)) if len(paths) else 0
            rest = table.slice(cut)  # the last segment may go on in the next batch
            if cut:
                yield links(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield links(rest)

    return run


def _labelled(rows: DataFrame, joined: DataFrame | None, column: str = "doc_id", out: str = "label") -> DataFrame:
    """``rows`` with the component of the id in ``column``, by itself the id."""
    if joined is None:
        return rows.withColumn(out, F.col(column))
    named = joined.select(F.col("id").alias(column), F.col("component").alias("_c"))
    return rows.join(named, column, "left").withColumn(out, F.coalesce("_c", column)).drop("_c")


def _group_links(large: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """Likely links ``(a, b)``, at most two a row, of the labelled rows of large nodes.

    Nodes are dealt into segments of bounded size, in an order by hash.  A row
    is compared with the first of its segment and with the one before it, where
    the labels differ; of all it agrees with, the smallest and the nearest stay.
    """
    dealt = large.withColumn("part", F.pmod(F.xxhash64("doc_id", "path"), F.ceil(F.col("members") / SEGMENT)).cast("int"))
    rows = dealt.join(signatures.select("doc_id", "signature"), "doc_id").withColumn("chance", F.xxhash64("path", "doc_id"))
    ordered = rows.select("path", "part", "chance", "doc_id", "label", "signature").repartition("path", "part").sortWithinPartitions("path", "part", "chance", "doc_id")
    good = ordered.mapInArrow(_near_links(threshold), "a long, b long, agreement double")
    best = good.groupBy("b").agg(F.min("a").alias("low"), F.max_by("a", F.struct("agreement", "a")).alias("near"))
    return best.select(F.explode(F.array_distinct(F.array("low", "near"))).alias("a"), "b")


def _below(*parts) -> F.Column:
    """The path of a part of a node, which keeps the last bit."""
    return F.xxhash64("path", *parts).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("path").bitwiseAND(F.lit(1))).alias("path")


def _units(marked: DataFrame, joined: DataFrame | None, signatures: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Bounded units of nodes: all outsiders, at home in the first, with a share of the main component in each.

    An outsider that agrees with the component's head by x can only agree enough
    with rows that agree with the head by at most x + 1 - (threshold - MARGIN).
    """
    if joined is None:
        inside, outside = marked.where("label = main"), marked.where("label <> main")
    else:
        heads = signatures.select(F.col("doc_id").alias("main"), F.col("signature").alias("head"))
        both = marked.join(signatures.select("doc_id", "signature"), "doc_id").join(heads, "main").select("path", "doc_id", F.expr("label = main").alias("inside"), "signature", "head")
        met = materialize(both.mapInArrow(_head_agreements, "path long, doc_id long, inside boolean, agreement double"), "met", WIDE * rows)
        outside = met.where("not inside")
        nearest = outside.groupBy("path").agg(F.max("agreement").alias("nearest"))
        reach = F.col("nearest") + (1 - threshold + MARGIN + 1e-9)
        inside = met.where("inside").join(nearest, "path").where(F.col("agreement") <= reach).select("path", "doc_id")
    sizes = inside.groupBy("path").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("parts"))
    dealt = inside.join(sizes, "path").select("path", "doc_id", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("unit"))
    # outsiders of a node meet each other once, and again in each share
    parts = outside.join(sizes, "path", "left").select("path", "doc_id", F.coalesce("parts", F.lit(1)).alias("parts"))
    every = parts.select("path", "doc_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("unit"))
    return dealt.withColumn("home", F.col("unit")).unionByName(every.withColumn("home", F.lit(0))).select(_below("unit"), "doc_id", F.col("path").alias("node"), "unit", "home")


def _blocks(marked: DataFrame) -> DataFrame:
    """Units that hold two blocks of a node each, for all pairs of its blocks; a block is at home in the unit of itself."""
    parts = marked.withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
    home = parts.withColumn("home", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    dealt = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = F.when(F.col("home") == F.col("other"), F.col("home")).otherwise(F.lit(-1)).alias("unit")
    return dealt.select(_below(F.least("home", "other"), F.greatest("home", "other")), "doc_id", F.col("path").alias("node"), unit, "home")


def _whole(rows: DataFrame) -> DataFrame:
    """Small nodes as units of themselves."""
    return rows.select("path", "doc_id", F.col("path").alias("node"), F.lit(0).alias("unit"), F.lit(0).alias("home"))


def _shared(rows: DataFrame, documents: int) -> DataFrame:
    """``(path, doc_id, members)`` of the nodes of several documents; ``rows`` is written first, as it is read twice."""
    written = materialize(rows, "paths", documents)
    tallies = written.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(written.join(tallies, "path"), "nodes", written.count())
    release(written)
    return shared


def tree_nodes(shared: DataFrame, sets: DataFrame, signatures: DataFrame, threshold: float, node_limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Units ``(path, doc_id, node, unit, home)`` to be compared, and tables of the links ``(a, b)`` confirmed on the way.

    Rows of a unit that have one home there meet in other units too and are
    compared in that of their home.  ``shared`` has the nodes of several documents at the first level that is looked at.
    """
    nodes: list[DataFrame] = []
    links: list[DataFrame] = []
    joined: DataFrame | None = None
    level = FIRST_LEVELS
    while True:
        nodes.append(_whole(shared.where(F.col("members") <= node_limit)))
        large = shared.where(F.col("members") > node_limit)
        rows = large.count()
        if not rows:
            break
        likely = materialize(_group_links(_labelled(large, joined), signatures, threshold), "likely", rows)
        found = confirmed_links(sets, likely, threshold)
        release(likely)
        if not found.isEmpty():
            links.append(found)
            joined = _components(links)
        named = _labelled(large.select("path", "doc_id"), joined)
        sizes = named.groupBy("path", "label").agg(F.count("*").alias("n")).groupBy("path")
        mixed = sizes.agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("main_rows"), F.sum("n").alias("members")).where("main_rows < members")
        marked = materialize(named.join(mixed, "path"), "marked", rows)
        few = F.col("members") - F.col("main_rows") <= OUTSIDERS
        units = _units(marked.where(few & (F.col("main_rows") > OUTSIDERS)), joined, signatures, threshold, rows)
        nodes.append(materialize(units, "units", rows))
        rest = marked.where(~(few & (F.col("main_rows") > OUTSIDERS)))
        if level >= LAST_LEVEL:
            nodes.append(_blocks(rest))
            break
        down = rest.join(signatures.select("doc_id", "signature"), "doc_id").select("path", "doc_id", "signature")
        shared = _shared(down.mapInArrow(_next_paths(STEP), "path long, doc_id long"), WIDE * rows)
        release(marked)
        level += STEP
    return reduce(DataFrame.unionByName, nodes), links


def _components(links: list[DataFrame]) -> DataFrame:
    """``(id, component)`` of the links so far, which are read from tables."""
    return connected_components(reduce(DataFrame.unionByName, links), "a", "b", written=True)


def node_pairs(units: DataFrame, signatures: DataFrame, threshold: float, likely: float | None) -> DataFrame:
    """Distinct ``(a, b)`` of different labels from exhaustive comparison of units; ``units`` has a ``label`` for each row."""
    # a document is in few nodes, as trees and levels are
    nodes = units.groupBy("doc_id").agg(F.collect_set("node").alias("nodes"))
    rows = units.join(nodes, "doc_id").join(signatures.select("doc_id", "n_shingles", "sketch"), "doc_id")
    columns = ["path", "doc_id", "label", "node", "unit", "home", "n_shingles", "sketch", "nodes"]
    ordered = rows.select(*columns).repartition("path").sortWithinPartitions("path", "doc_id")
    return ordered.mapInArrow(_node_pairs(threshold, likely), "a long, b long").distinct()


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in small_parts(batches):
        sets = [shingle_set(t).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def _confirm(threshold_hundredths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            good = []
            for one, other in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                left, right = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * both >= threshold_hundredths * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one of the ``ids``, which are broadcast if they are few enough."""
    known = ids.count()
    return docs.join(F.broadcast(ids) if known <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def confirmed_links(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)``, read from a table, whose full shingle sets reach the threshold."""
    count = pairs.count()
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    used = materialize(sets.join(ends, "doc_id", "left_semi"), "used", WIDE * 2 * count)
    # groups that are dense have few sets and many pairs, so that it is the sets that travel, once
    small = (used.agg(F.sum(F.length("shingles"))).first()[0] or 0) <= BROADCAST_BYTES
    left, right = (used.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    if small:
        left, right = F.broadcast(left), F.broadcast(right)
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    found = materialize(joined.mapInArrow(_confirm(round(100 * threshold)), "a long, b long"), "links", WIDE * count)
    release(used)
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, trees: int = TREES, node_limit: int = NODE_LIMIT
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    A document is the set of its distinct five-word shingles after lower-casing
    A-Z, words being runs of anything but ASCII white space; fewer words are one
    shingle.  Documents are linked when their sets' Jaccard similarity reaches
    ``threshold``; a component is what links reach, named by its smallest id,
    which is the document that is kept.  Texts that are null, empty or blank
    have no shingle and no link.  A null id takes no part and keeps a null
    component.  Rows that repeat an id should repeat its text; they repeat its
    result.  Other columns are not looked at.  An empty table gives an empty one.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch_scope() as kept:
        described = materialize(chosen.mapInArrow(_signature_batches, _SCHEMA), "signatures")
        rows = described.count()
        linkable = described.where("doc_id is not null and set_id is not null")
        classes = linkable.groupBy("set_id").agg(F.min("doc_id").alias("class_id"))
        classed = materialize(linkable.select("doc_id", "set_id").distinct().join(classes, "set_id").select("doc_id", "class_id"), "classes", rows)
        heads = classed.where("doc_id = class_id").select("doc_id")
        signatures = materialize(linkable.select("doc_id", "n_shingles", "signature", "sketch").join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "heads", WIDE * rows)
        components = materialize(_linked(chosen, signatures, threshold, trees, node_limit), "components", rows)
        sizes = materialize(described.select("doc_id", "n_shingles"), "sizes", rows)
        kept += [sizes, classed, components]
    by_class = classed.join(components.withColumnRenamed("id", "class_id"), "class_id", "left")
    by_doc = by_class.select("doc_id", F.coalesce("component", "class_id").alias("component"))
    out = sizes.join(by_doc, "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept")
    )


def _linked(chosen: DataFrame, signatures: DataFrame, threshold: float, trees: int, node_limit: int) -> DataFrame:
    """``(id, component)`` of the documents with a link."""
    documents = signatures.count()
    shared = _shared(signatures.mapInArrow(_first_paths(trees, FIRST_LEVELS), "path long, doc_id long"), documents * trees)
    # only documents that meet another one somewhere need their sets
    meeting = shared.select("doc_id").distinct()
    sets = materialize(_only(chosen, meeting).mapInArrow(_set_batches, "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "sets", WIDE * documents)
    nodes, links = tree_nodes(shared, sets, signatures, threshold, node_limit)

    def pairs(units: DataFrame, likely: float | None) -> DataFrame:
        """Pairs of units of more than one component, whose rows are labelled by it."""
        labelled = materialize(_labelled(units, _components(links) if links else None), "labelled", rows)
        paths = labelled.groupBy("path").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("path")
        return node_pairs(labelled.join(paths, "path", "left_semi"), signatures, threshold, likely)

    rows = nodes.count()
    # first a likely partner for each row of the first trees' nodes: copies come together by few proofs
    near = pairs(nodes.where(F.col("path").bitwiseAND(F.lit(1)) == 1), threshold + 0.05)
    first = materialize(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first", rows)
    links.append(confirmed_links(sets, first, threshold))
    # then every pair of a node that is still apart
    links.append(confirmed_links(sets, materialize(pairs(nodes, None), "apart", rows), threshold))
    return _components(links)
