"""Prompt fingerprints, duplicate evidence and atomic duplicate clusters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.errors import DeduplicationError
from switchyard.functions import text as tx
from switchyard.operators.graph import connected_components
from switchyard.operators.validation import blank
from switchyard.plans.scratch import materialize

#: What the split engine reads of a query.
QUERY_SCHEMA = T.StructType(
    [
        T.StructField("query_id", T.StringType(), False),
        T.StructField("prompt", T.StringType(), False),
        T.StructField("task", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_query_id", T.StringType()),
        T.StructField("lineage_id", T.StringType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("is_probe", T.BooleanType(), False),
    ]
)

#: Kinds of evidence, as reports list them.
REASONS = ("exact_prompt", "normalized_prompt", "source_identity", "augmentation_lineage", "near_duplicate")


@dataclass(frozen=True)
class DeduplicationConfig:
    """Settings that decide what counts as a duplicate.

    The shingle hash is the first 64 bits of SHA-256, which Spark has built in.
    Without ``exact_folding`` the folding is Spark's own, which is quicker and
    goes by another version.  ``max_bucket_size`` and ``max_candidate_pairs``
    say how the work is dealt, not what is left out: larger buckets go by
    their rarest shingles, and a task compares at most so many candidates.
    """

    normalization_version: str = "nfkc-casefold-whitespace-v1"
    near_duplicate_threshold: float = 0.90
    shingle_size: int = 3
    signature_size: int = 8
    max_bucket_size: int = 128
    max_candidate_pairs: int = 1_000_000
    exact_folding: bool = True

    def validate(self) -> None:
        if not self.exact_folding and "nfkc" in self.normalization_version:
            raise DeduplicationError("built-in folding is no compatibility normalisation; name another normalization_version")
        if not self.normalization_version.strip():
            raise DeduplicationError("normalization_version must not be empty")
        if not 0.0 < self.near_duplicate_threshold <= 1.0:
            raise DeduplicationError("near_duplicate_threshold must be greater than zero and at most one")
        for name, least in (("shingle_size", 1), ("signature_size", 1), ("max_bucket_size", 2), ("max_candidate_pairs", 1)):
            if getattr(self, name) < least:
                raise DeduplicationError(f"{name} must be at least {least}")

    def as_dict(self) -> dict[str, object]:
        return asdict(self)


@dataclass(frozen=True)
class DeduplicationResult:
    """Fingerprints, clusters and confirmed near-duplicate pairs.

    ``members`` holds (query_id, cluster_id), ``reasons`` (cluster_id, reason),
    ``pairs`` the links of ``near_duplicate_pairs``; ``pair_count`` counts the
    pairs of queries behind them, those among copies too.
    """

    config: DeduplicationConfig
    fingerprints: DataFrame
    members: DataFrame
    reasons: DataFrame
    pairs: DataFrame
    skipped_buckets: int
    pair_count: int

    def clusters(self) -> DataFrame:
        """``(cluster_id, query_ids, reasons)`` with both arrays sorted."""
        ids = self.members.groupBy("cluster_id").agg(F.array_sort(F.collect_list("query_id")).alias("query_ids"))
        why = self.reasons.groupBy("cluster_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
        return ids.join(why, "cluster_id", "left").select("cluster_id", "query_ids", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def fingerprints(queries: DataFrame, exact: bool = True) -> DataFrame:
    """``(query_id, exact_sha256, normalized_sha256)``."""
    return queries.select("query_id", tx.sha256_hex("prompt").alias("exact_sha256"), tx.sha256_hex(tx.normalize_prompt("prompt", exact)).alias("normalized_sha256"))


def check_queries(queries: DataFrame) -> None:
    """Raise unless there are queries, their ids are unique and their texts not blank."""
    counted = queries.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"), *(F.count_if(blank(F.col(c))).alias(c) for c in ("query_id", "prompt", "task", "source"))).first()
    if not counted["n"]:
        raise DeduplicationError("at least one query is required")
    for name in ("query_id", "prompt", "task", "source"):
        if counted[name]:
            raise DeduplicationError(f"{counted[name]} queries have an empty {name}")
    if counted["ids"] < counted["n"]:
        again = queries.groupBy("query_id").count().where("count > 1").orderBy("query_id").first()
        raise DeduplicationError(f"duplicate query_id: {again['query_id']}")


def shingled(queries: DataFrame, config: DeduplicationConfig = DeduplicationConfig()) -> DataFrame:
    """``(query_id, hashes)``; hashes are numbers that sort as their hex digits."""
    hashes = tx.shingle_hashes(tx.normalize_prompt("prompt", config.exact_folding), config.shingle_size)
    return queries.select("query_id", F.transform(hashes, tx.hash_number).alias("hashes"))


def signature_buckets(shingles: DataFrame, config: DeduplicationConfig = DeduplicationConfig()) -> tuple[DataFrame, DataFrame]:
    """``(bucket, query_id, n_hashes)`` and ``(bucket, n)`` of buckets that at least two queries share."""
    rows = shingles.select("query_id", F.size("hashes").alias("n_hashes"), F.explode(tx.signature("hashes", config.signature_size)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return rows, sizes


def candidate_pairs(shingles: DataFrame, config: DeduplicationConfig = DeduplicationConfig()) -> tuple[DataFrame, DataFrame]:
    """Distinct ``(a, b)`` of like sizes that share a bucket of at most ``max_bucket_size``, and the larger buckets.

    The size is counted with partial aggregation before rows meet, so a larger
    bucket never comes together in a task; ``crowded_pairs`` has its links.
    """
    rows, sizes = signature_buckets(shingles, config)
    allowed = rows.join(sizes.where(F.col("n") <= config.max_bucket_size).select("bucket"), "bucket")
    return _met(allowed, "bucket", config), sizes.where(F.col("n") > config.max_bucket_size)


def _met(rows: DataFrame, key: str, config: DeduplicationConfig) -> DataFrame:
    """Distinct ``(a, b)`` that share a key and whose set sizes allow the similarity."""
    left, right = (rows.select(key, F.col("query_id").alias(x), F.col("n_hashes").alias(f"n_{x}")) for x in "ab")
    # the ratio of the sizes bounds the similarity, so most sets needn't travel
    alike = F.least("n_a", "n_b") + 1e-6 >= config.near_duplicate_threshold * F.greatest("n_a", "n_b")
    return left.join(right, key).where((F.col("a") < F.col("b")) & alike).select("a", "b").distinct()


#: Rows and hashes of a block of sets; two blocks meet in a task.
BLOCK_ROWS, BLOCK_HASHES = 1024, 1_000_000


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``left`` and ``right`` places of ``sets``, by blocks of columns."""
    out = np.zeros((len(left), len(right)), np.float32)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    rows, code = rows[shared], np.cumsum(times > 1)[code[shared]] - 1
    for low in range(0, int(code.max(initial=-1)) + 1, 4096):
        inside = (code >= low) & (code < low + 4096)
        cells = np.zeros((len(sets), 4096), np.float32)
        cells[rows[inside], code[inside] - low] = 1
        out += cells[left] @ cells[right].T
    return out


def _block_links(threshold: float):
    """Pairs of two blocks, each in the group of the first rare shingle that both have."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rare, i, j = (k.as_py() for k in key)
        block, names = table.column("block").to_numpy(), np.array(table.column("query_id").to_pylist(), object)
        hashes, prefix, buckets = ([np.asarray(v, np.int64) for v in table.column(c).to_pylist()] for c in ("hashes", "prefix", "buckets"))
        earlier = [p[: int(np.flatnonzero(p == rare)[0])] for p in prefix]
        sizes = np.array([len(h) for h in hashes], np.float64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        na, nb = sizes[left][:, None], sizes[right][None, :]
        open_ = (_overlaps(earlier, left, right) == 0) & (np.minimum(na, nb) + 1e-6 >= threshold * np.maximum(na, nb))
        if i == j:
            open_ = np.triu(open_, 1)
        if open_.any():
            open_ &= _overlaps(buckets, left, right) > 0
        some, other = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        left, right, open_ = left[some], right[other], open_[np.ix_(some, other)]
        both = _overlaps(hashes, left, right).astype(np.float64) if len(left) else np.zeros((0, 0))
        similarity = both / (sizes[left][:, None] + sizes[right][None, :] - both)
        x, y = np.nonzero(open_ & (similarity >= threshold))
        a, b = names[left[x]], names[right[y]]
        swap = a > b if len(a) else np.zeros(0, bool)
        first, second = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table({"a": pa.array(first, pa.string()), "b": pa.array(second, pa.string()), "similarity": pa.array(similarity[x, y], pa.float64())})

    return run


def crowded_pairs(shingles: DataFrame, buckets: DataFrame, config: DeduplicationConfig = DeduplicationConfig()) -> tuple[DataFrame, DataFrame] | None:
    """``(a, b)`` candidates and confirmed ``(a, b, similarity)`` among rows of buckets too large to pair, or none.

    Two sets of similarity t share one of their rarest ``n - ceil(t n) + 1``
    shingles in any order that all sets keep; that order is by number of
    owners.  Few owners of a rare shingle are paired as in a bucket; many, a
    family of near copies, are dealt into blocks, and every two blocks meet in
    a task, so work follows the links and no task holds a family.
    """
    rows = shingles.withColumn("buckets", tx.signature("hashes", config.signature_size))
    owners = rows.select("query_id", F.explode("buckets").alias("bucket")).join(buckets.select("bucket"), "bucket", "left_semi").select("query_id").distinct()
    sets = materialize(rows.join(owners, "query_id", "left_semi"), "crowded")
    if sets.isEmpty():
        return None
    each = sets.select("query_id", F.explode("hashes").alias("rare"))
    common = each.groupBy("rare").agg(F.count("*").alias("n")).where("n > 1")
    size = F.col("n_hashes")
    ranked = each.join(common, "rare").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "rare"))).alias("known"))
    ranked = ranked.join(sets.select("query_id", F.size("hashes").alias("n_hashes")), "query_id")
    # shingles of one owner are the rarest and lead nowhere
    length = size - F.ceil(config.near_duplicate_threshold * size - 1e-6) + 1 - (size - F.size("known"))
    firsts = materialize(ranked.select("query_id", "n_hashes", F.slice("known", 1, F.greatest(length, F.lit(0)).cast("int")).alias("known")), "rarest")
    keyed = firsts.select("query_id", "n_hashes", F.explode("known").alias("k")).select("query_id", "n_hashes", "k.rare")
    groups = materialize(keyed.groupBy("rare").agg(F.count("*").alias("n"), F.sum("n_hashes").alias("weight")).where("n > 1"), "rare_groups")
    few = keyed.join(groups.where(F.col("n") <= config.max_bucket_size).select("rare"), "rare")
    signed = (sets.select(F.col("query_id").alias(x), F.col("buckets").alias(f"s_{x}")) for x in "ab")
    met = _met(few, "rare", config)
    for side, x in zip(signed, "ab", strict=True):
        met = met.join(side, x)
    met = met.where(F.arrays_overlap("s_a", "s_b")).select("a", "b")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("weight") / BLOCK_HASHES)).cast("int")
    many = keyed.join(groups.where(F.col("n") > config.max_bucket_size).select("rare", parts.alias("parts"), F.col("n").alias("owners")), "rare")
    prefix = F.transform(F.array_sort(F.collect_list(F.struct("owners", "rare"))), lambda s: s["rare"]).alias("prefix")
    wide = sets.join(many.groupBy("query_id").agg(prefix), "query_id")
    dealt = many.select("query_id", "rare", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    dealt = dealt.select("query_id", "rare", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    linked = dealt.join(wide, "query_id").groupBy("rare", "i", "j").applyInArrow(_block_links(config.near_duplicate_threshold), "a string, b string, similarity double")
    return met, linked


def near_duplicate_pairs(queries: DataFrame, config: DeduplicationConfig = DeduplicationConfig(), prints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Confirmed ``(a, b, similarity)`` and the ``(query_id, n)`` of each distinct normalised text.

    A text's representative is its smallest id.  Copies are paired with their
    representative only, at similarity one; representatives with each other
    wherever they share a bucket and are similar enough.  No bucket is skipped.
    """
    if prints is None:
        prints = materialize(fingerprints(queries, config.exact_folding), "fingerprints")
    classes = materialize(prints.groupBy("normalized_sha256").agg(F.min("query_id").alias("query_id"), F.count("*").alias("n")).select("query_id", "n"), "classes")
    copies = _stars(prints, F.col("normalized_sha256"), "copy").select("a", "b", F.lit(1.0).alias("similarity"))
    shingles = materialize(shingled(queries.join(classes, "query_id", "left_semi"), config), "shingles")
    candidates, large = candidate_pairs(shingles, config)
    crowded = crowded_pairs(shingles, materialize(large, "large_buckets"), config)
    if crowded:
        candidates = candidates.unionByName(crowded[0]).distinct()
    candidates = materialize(candidates, "candidates")
    left = shingles.select(F.col("query_id").alias("a"), F.col("hashes").alias("ha"))
    right = shingles.select(F.col("query_id").alias("b"), F.col("hashes").alias("hb"))
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // config.max_candidate_pairs))
    scored = candidates.repartition(tasks, "a").join(left, "a").join(right, "b").select("a", "b", tx.jaccard("ha", "hb").alias("similarity"))
    links = scored.where(F.col("similarity") >= config.near_duplicate_threshold)
    if crowded:
        links = links.unionByName(crowded[1]).dropDuplicates(["a", "b"])
    return links.unionByName(copies), classes


def linked_pairs(links: DataFrame, classes: DataFrame) -> int:
    """Pairs of queries that ``near_duplicate_pairs`` stands for, counted without listing those among copies."""
    within = classes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n")).first()["n"] or 0
    a, b = (classes.select(F.col("query_id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    across = links.join(a, "a").join(b, "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n")).first()["n"] or 0
    return within + across


def _stars(rows: DataFrame, key: Column, reason: str) -> DataFrame:
    """``(a, b, reason)``: the least id of each group that shares a key, with every other id."""
    keyed = rows.select("query_id", key.alias("key")).where("key is not null")
    centres = keyed.groupBy("key").agg(F.min("query_id").alias("a"))
    return keyed.join(centres, "key").where("query_id > a").select("a", F.col("query_id").alias("b"), F.lit(reason).alias("reason"))


def duplicate_evidence(queries: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, reason)``: edges that hold all groups of equal keys and all near pairs together."""
    edges = _stars(prints, F.col("exact_sha256"), "exact_prompt").unionByName(_stars(prints, F.col("normalized_sha256"), "normalized_prompt"))
    own_id = F.when(~blank(F.col("source_query_id")), tx.joined("source", "source_query_id"))
    edges = edges.unionByName(_stars(queries, own_id, "source_identity"))
    edges = edges.unionByName(_stars(queries, F.when(~blank(F.col("lineage_id")), F.col("lineage_id")), "augmentation_lineage"))
    return edges.unionByName(pairs.select("a", "b", F.lit("near_duplicate").alias("reason")))


#: Members up to which a group's ids are gathered to be hashed; more are hashed as they come, in order.
GATHERED = 10_000


def _streamed_names(prefix: str):
    """The names of groups whose rows come sorted; only a hash is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, done = None, None, []
        for batch in batches:
            for group, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if group != current:
                    if digest:
                        done.append((current, digest))
                    current, digest = group, hashlib.sha256(item.encode())
                else:
                    digest.update((tx.UNIT + item).encode())
        if digest:
            done.append((current, digest))
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], pa.string()), pa.array([f"{prefix}-{d.hexdigest()[:20]}" for _, d in done], pa.string())], ["group", "name"])

    return run


def named_groups(members: DataFrame, group: str, item: str, prefix: str, name: str) -> DataFrame:
    """``(item, name)``: groups renamed by the hash of their sorted items.

    Groups of more than ``GATHERED`` items are sorted by Spark, which spills,
    and hashed row by row, so that no task holds a group.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_n"))
    large = materialize(sizes.where(F.col("_n") > GATHERED).select(F.col(group).cast("string").alias("group")), "large_groups")
    keyed = members.select(F.col(group).cast("string").alias("group"), F.col(item).alias("item"))
    if large.isEmpty():
        small, names = keyed, None
    else:
        ordered = keyed.join(large, "group", "left_semi").repartition("group").sortWithinPartitions("group", "item")
        small, names = keyed.join(large, "group", "left_anti"), ordered.mapInArrow(_streamed_names(prefix), "group string, name string")
    gathered = small.groupBy("group").agg(tx.set_id(prefix, F.collect_list("item")).alias("name"))
    names = gathered if names is None else gathered.unionByName(names)
    return keyed.join(names, "group").select(F.col("item").alias(item), F.col("name").alias(name))


def deduplicate_queries(queries: DataFrame, config: DeduplicationConfig = DeduplicationConfig()) -> DeduplicationResult:
    """Cluster queries that any evidence connects; a cluster's reasons are those that hold within it."""
    config.validate()
    queries = materialize(queries.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in QUERY_SCHEMA)), "queries")
    check_queries(queries)
    prints = materialize(fingerprints(queries, config.exact_folding), "fingerprints")
    pairs, classes = near_duplicate_pairs(queries, config, prints)
    pairs = materialize(pairs, "pairs")
    edges = materialize(duplicate_evidence(queries, prints, pairs), "evidence")
    joined = connected_components(edges, "a", "b")
    roots = queries.select("query_id").join(joined.withColumnRenamed("id", "query_id"), "query_id", "left").select("query_id", F.coalesce("component", "query_id").alias("root"))
    members = materialize(named_groups(roots, "root", "query_id", "dup", "cluster_id"), "members")
    reasons = edges.select(F.col("a").alias("query_id"), "reason").distinct().join(members, "query_id").select("cluster_id", "reason").distinct()
    return DeduplicationResult(config, prints, members, materialize(reasons, "reasons"), pairs.select("a", "b"), 0, linked_pairs(pairs, classes))


def report_counts(result: DeduplicationResult) -> DataFrame:
    """``(measure, value)`` rows of the deduplication report."""
    sizes = result.members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    totals = sizes.agg(F.sum("n").alias("queries"), F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("multi_query_clusters"))
    totals = totals.select(F.explode(F.create_map(*(x for c in ("queries", "clusters", "multi_query_clusters") for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0)))))).alias("measure", "value"))
    pairs = totals.limit(1).select(F.lit("near_duplicate_pairs").alias("measure"), F.lit(result.pair_count).cast("long").alias("value"))
    why = result.reasons.groupBy("reason").agg(F.count("*").alias("value")).select(F.concat(F.lit("reason:"), "reason").alias("measure"), "value")
    return totals.unionByName(pairs).unionByName(why)
