"""Inputs of the split engine, from canonical Parquet or exchange JSONL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.errors import SplitIOError
from switchyard.functions.text import parse_iso8601
from switchyard.operators.deduplication import QUERY_SCHEMA
from switchyard.operators.splits import MODEL_SCHEMA
from switchyard.sources.pinned import read_jsonl


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def _source() -> Column:
    """A query's source from the two parts of its name; null if one is missing."""
    return F.concat(F.nullif("source_dataset", F.lit("")), F.lit(":"), F.nullif("source_config", F.lit("")))


def _complete(rows: DataFrame, path: str) -> None:
    bare = rows.where("source is null").first()
    if bare:
        raise SplitIOError(f"{path}: query {bare['query_id']} names no source, or only half of one")


def queries_from_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Queries with outcomes; the filter and the few columns reach the scan.  None at all is an error."""
    rows = spark.read.parquet(path).where("has_outcomes").select(
        "query_id", "prompt", "task", _source().alias("source"), "source_query_id", F.lit(None).cast("string").alias("lineage_id"), "observed_at", "is_probe"
    )
    if rows.isEmpty():
        raise SplitIOError(f"{path} holds no query with outcomes")
    _complete(rows, path)
    return _conform(rows, QUERY_SCHEMA)


def queries_from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Exchange queries; only those marked as without outcomes are left out, so the result may be empty."""
    schema = "query_id string, prompt string, task string, source string, source_dataset string, source_config string, source_query_id string, lineage_id string, observed_at string, is_probe boolean, has_outcomes boolean"
    rows = read_jsonl(spark, path, schema, allow_empty=False).where(F.coalesce("has_outcomes", F.lit(True)))
    moment = parse_iso8601("observed_at")
    naive = rows.where(F.col("observed_at").isNotNull() & moment.isNull()).first()
    if naive:
        raise SplitIOError(f"{path}: observed_at must be an ISO-8601 timestamp with a timezone: {naive['observed_at']}")
    rows = rows.withColumns({"observed_at": moment, "source": F.coalesce("source", _source()), "is_probe": F.coalesce("is_probe", F.lit(False))})
    _complete(rows, path)
    return _conform(rows, QUERY_SCHEMA)


def models_from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _conform(spark.read.parquet(path), MODEL_SCHEMA)


def models_from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    schema = "model_id string, provider string, family string, version string, aliases array<string>, available_at string"
    rows = read_jsonl(spark, path, schema, allow_empty=False)
    moment = parse_iso8601("available_at")
    if not rows.where(F.col("available_at").isNotNull() & moment.isNull()).isEmpty():
        raise SplitIOError(f"{path}: available_at must be an ISO-8601 timestamp with a timezone")
    return _conform(rows.withColumns({"available_at": moment, "aliases": F.coalesce("aliases", F.array().cast("array<string>"))}), MODEL_SCHEMA)


def _by_suffix(path: str, parquet, jsonl):
    lowered = path.rstrip("/").lower()
    if lowered.endswith(".parquet"):
        return parquet
    if lowered.endswith(".jsonl"):
        return jsonl
    raise SplitIOError(f"unsupported input format: {path}")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    return _by_suffix(path, queries_from_parquet, queries_from_jsonl)(spark, path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return _by_suffix(path, models_from_parquet, models_from_jsonl)(spark, path)
