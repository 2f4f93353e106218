"""Canonical datasets and split bundles on disk."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.errors import CanonicalDataError, SplitIOError, SplitValidationError
from switchyard.operators.deduplication import REASONS, DeduplicationResult
from switchyard.operators.schemas import PRIMARY_KEYS, SCHEMA_VERSION, SCHEMAS, CanonicalTables
from switchyard.operators.splits import PARTITIONS, STRATEGIES, SplitBuildConfig, SplitRatios, SplitResult, boundaries, model_identities, ordered_digest, validate_split
from switchyard.operators.validation import validate


def write_text_atomic(path: Path, text: str) -> None:
    """Write beside the target, then put it in place."""
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(f"{path.name}.tmp")
    temporary.write_text(text, "utf-8", newline="\n")
    os.replace(temporary, path)


def _json(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True) + "\n"


def slugify(text: str) -> str:
    slug = re.sub(r"[^A-Za-z0-9._-]+", "--", text).strip("-.")
    if not slug:
        raise SplitIOError(f"nothing is left of {text!r} for a path")
    return slug


def write_canonical_table(name: str, rows: DataFrame, path: str) -> dict[str, object]:
    """Write a table as zstd Parquet; returns its rows and a digest of its content.

    The schema must be the canonical one.  Part files are not byte-stable, so
    the digest is of the rows.
    """
    if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in SCHEMAS[name]]:
        raise CanonicalDataError(f"{name} does not have the canonical schema")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    written = rows.sparkSession.read.parquet(path)
    return {"name": name, "rows": written.count(), "digest": ordered_digest(written)}


def write_jsonl_debug(rows: DataFrame, path: Path, limit: int, key: str) -> None:
    """The first ``limit`` rows by key as JSON lines with sorted keys and ISO times."""
    if limit < 0:
        raise CanonicalDataError("limit must not be negative")
    shown = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"})
    lines = [r[0] for r in rows.orderBy(key).limit(limit).select(shown).collect()]
    write_text_atomic(path, "".join(f"{line}\n" for line in lines))


def write_canonical_dataset(tables: CanonicalTables, root: Path, *, source_dataset: str, source_revision: str, source_manifest_sha256: str, debug_limit: int = 100) -> Path:
    """All tables, a bounded debug view of each, and the manifest, which is written last."""
    validate(tables)
    written = []
    for name, rows in tables.items():
        written.append(write_canonical_table(name, rows, str(root / f"{name}.parquet")) | {"path": f"{name}.parquet"})
        write_jsonl_debug(rows, root / "debug" / f"{name}.jsonl", debug_limit, PRIMARY_KEYS[name])
    manifest = root / "canonical_manifest.json"
    value = {
        "manifest_version": 1,
        "canonical_schema_version": SCHEMA_VERSION,
        "source_dataset": source_dataset,
        "source_revision": source_revision,
        "source_manifest_sha256": source_manifest_sha256,
        "debug_jsonl_limit": debug_limit,
        "temporal_metadata": {"available": False, "reason": "the source provides neither query timestamps nor model release dates"},
        "tables": sorted(written, key=lambda t: t["name"]),
    }
    write_text_atomic(manifest, _json(value))
    return manifest


def _partitions(placed: DataFrame, item: str) -> dict[str, list[str]]:
    held = {r["partition"]: sorted(r["ids"]) for r in placed.groupBy("partition").agg(F.collect_list(item).alias("ids")).collect()}
    return {name: held.get(name, []) for name in (*PARTITIONS, "probe", "shared")}


def split_manifest(split: SplitResult, queries: DataFrame, models: DataFrame, deduplication: DeduplicationResult) -> dict[str, object]:
    """A split as one JSON value.  It lists every id, so it is for corpora whose ids fit the driver."""
    placed_models = _partitions(split.models, "model_id")
    return {
        "manifest_version": split.config.manifest_version,
        "algorithm_version": split.config.algorithm_version,
        "strategy": split.strategy,
        "dataset_id": split.config.dataset_id,
        "dataset_revision": split.config.dataset_revision,
        "canonical_schema_version": split.config.canonical_schema_version,
        "seed": split.config.seed,
        "ratios": split.config.ratios.as_dict(),
        **_inputs(queries, models, deduplication),
        "queries": _partitions(split.queries, "query_id"),
        "models": placed_models,
        "held_out_tasks": list(split.held_out_tasks),
        "held_out_models": placed_models["test"],
        "held_out_families": list(split.held_out_families),
        "temporal_query_boundaries": list(split.query_boundaries),
        "temporal_model_boundaries": list(split.model_boundaries),
    }


def split_of_manifest(spark: SparkSession, manifest: dict) -> SplitResult:
    """The split that a manifest read from JSON describes."""

    def placed(held: dict[str, list[str]], item: str) -> DataFrame:
        return spark.createDataFrame([(i, name) for name, ids in held.items() for i in ids], f"{item} string, partition string")

    config = SplitBuildConfig(
        manifest["dataset_id"], manifest["dataset_revision"], manifest["canonical_schema_version"], manifest["seed"], SplitRatios(**manifest["ratios"]), manifest["manifest_version"], manifest["algorithm_version"]
    )
    lists = ("held_out_tasks", "held_out_families", "temporal_query_boundaries", "temporal_model_boundaries")
    return SplitResult(manifest["strategy"], config, placed(manifest["queries"], "query_id"), placed(manifest["models"], "model_id"), *(tuple(manifest[name]) for name in lists))


def validate_split_manifest(manifest: dict, queries: DataFrame, models: DataFrame, deduplication: DeduplicationResult) -> None:
    """Raise unless a manifest, as read from disk, belongs to these inputs and keeps its promises.

    First what it says of its inputs (digests, model identities), then what it
    says of itself (held-out models, boundaries), then the rules of a split.
    """
    try:
        split = split_of_manifest(queries.sparkSession, manifest)
        told = {name: manifest[name] for name in ("source_digest", "deduplication_digest", "model_identities", "held_out_models")}
    except (KeyError, TypeError) as error:
        raise SplitValidationError(f"not a split manifest: {error}") from error
    if split.strategy not in STRATEGIES:
        raise SplitValidationError(f"unknown strategy {split.strategy}")
    split.config.validate()
    found = _inputs(queries, models, deduplication)
    for name, what in (("source_digest", "other queries or models"), ("deduplication_digest", "another deduplication"), ("model_identities", "models of other names")):
        if told[name] != found[name]:
            raise SplitValidationError(f"{name}: the manifest was made from {what}")
    if told["held_out_models"] != sorted(manifest["models"].get("test", [])):
        raise SplitValidationError("held_out_models: not the test models")
    if split.strategy == "temporal":
        bounds = boundaries(split.queries, queries, "query_id", "observed_at"), boundaries(split.models, models, "model_id", "available_at")
        if bounds != (split.query_boundaries, split.model_boundaries):
            raise SplitValidationError("temporal boundaries: not the last moments of train and validation")
    elif split.query_boundaries or split.model_boundaries:
        raise SplitValidationError("temporal boundaries of a strategy without time")
    validate_split(split, queries, models, deduplication)


def _inputs(queries: DataFrame, models: DataFrame, deduplication: DeduplicationResult) -> dict[str, object]:
    """What a manifest records of its inputs."""
    return {
        "source_digest": ordered_digest(queries) + ordered_digest(models),
        "deduplication_digest": ordered_digest(deduplication.members),
        "model_identities": [r.asDict() for r in model_identities(models).orderBy("model_id").collect()],
    }


def write_split_tables(split: SplitResult, path: str) -> None:
    """A split as Parquet partitioned by ``partition``, for corpora of any size."""
    split.queries.write.mode("overwrite").partitionBy("partition").parquet(f"{path}/queries")
    split.models.write.mode("overwrite").partitionBy("partition").parquet(f"{path}/models")


def deduplication_manifest(result: DeduplicationResult) -> dict[str, object]:
    return {
        "schema_version": "deduplication-v1",
        "digest": ordered_digest(result.members),
        "config": result.config.as_dict(),
        "fingerprints": [r.asDict() for r in result.fingerprints.orderBy("query_id").collect()],
        "clusters": [r.asDict() for r in result.clusters().orderBy("cluster_id").collect()],
        "near_duplicate_pairs": sorted([r["a"], r["b"]] for r in result.pairs.collect()),
        "skipped_near_duplicate_buckets": result.skipped_buckets,
    }


def render_report(result: DeduplicationResult, manifests: dict[str, dict], unsupported: dict[str, str]) -> str:
    """A Markdown audit of counts; it holds no prompt text."""
    sizes = result.members.groupBy("cluster_id").count()
    queries, clusters, several = result.members.count(), sizes.count(), sizes.where("count > 1").count()
    why = {r["reason"]: r["n"] for r in result.reasons.groupBy("reason").agg(F.count_distinct("cluster_id").alias("n")).collect()}
    out = ["# Duplicates and leakage-safe splits", "", "Only counts and ids are shown, never prompt text.", "", "| Measure | Value |", "|---|---:|"]
    rows = {"Queries": queries, "Atomic clusters": clusters, "Clusters of several queries": several, "Near-duplicate pairs": result.pair_count, "Buckets over the limit": result.skipped_buckets}
    out += [f"| {name} | {value:,} |" for name, value in rows.items()]
    out += ["", "| Evidence | Clusters |", "|---|---:|", *(f"| {r} | {why.get(r, 0):,} |" for r in REASONS), ""]
    heads = [f"{p} {what}" for what, names in (("queries", (*PARTITIONS, "probe")), ("models", (*PARTITIONS, "shared"))) for p in names]
    out += [f"| Strategy | {' | '.join(heads)} |", "|---|" + "---:|" * len(heads)]
    for strategy in sorted(manifests):
        m = manifests[strategy]
        cells = [len(m["queries"][p]) for p in (*PARTITIONS, "probe")] + [len(m["models"][p]) for p in (*PARTITIONS, "shared")]
        out.append(f"| {strategy} | {' | '.join(f'{c:,}' for c in cells)} |")
    if unsupported:
        out += ["", "## Unsupported strategies", "", *(f"- `{s}`: {unsupported[s]}" for s in sorted(unsupported))]
    return "\n".join([*out, "", "Clusters are atomic, probes are apart from test traffic, aliases name one model; equal inputs, settings and seed give equal files.", ""])


def write_split_bundle(root: Path, queries: DataFrame, models: DataFrame, deduplication: DeduplicationResult, splits: dict[str, SplitResult], unsupported: dict[str, str] | None = None) -> Path:
    """One JSON file a strategy, the deduplication manifest and the report, under paths made of the dataset's names."""
    unsupported = unsupported or {}
    if splits.keys() & unsupported.keys():
        raise SplitIOError("a strategy is given both as built and as unsupported")
    if splits.keys() | unsupported.keys() != set(STRATEGIES):
        raise SplitIOError("a bundle needs each of the six strategies, built or unsupported")
    config = next(iter(splits.values())).config
    base = root / "data" / "processed" / "splits"
    folder = base / "manifests" / slugify(config.dataset_id) / slugify(config.dataset_revision) / slugify(config.manifest_version)
    write_text_atomic(folder / "deduplication.json", _json(deduplication_manifest(deduplication)))
    manifests = {name: split_manifest(split, queries, models, deduplication) for name, split in splits.items()}
    for name, manifest in sorted(manifests.items()):
        write_text_atomic(folder / f"{name}.json", _json(manifest))
    for name, reason in sorted(unsupported.items()):
        shared = {k: v for k, v in asdict(config).items() if k in ("manifest_version", "dataset_id", "dataset_revision", "canonical_schema_version")}
        write_text_atomic(folder / f"{name}.unsupported.json", _json(shared | {"strategy": name, "status": "unsupported", "reason": reason}))
    write_text_atomic(base / "reports" / f"{slugify(config.dataset_id)}_deduplication.md", render_report(deduplication, manifests, unsupported))
    return folder
