"""Raw source tables to the six canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.errors import CanonicalDataError
from switchyard.functions import text as tx
from switchyard.functions.prices import UNIT_TOKENS
from switchyard.operators.schemas import SCHEMAS, CanonicalTables
from switchyard.operators.validation import copied_field_differences, outcome_counts_off, validate
from switchyard.plans.scratch import materialize

#: Query configurations of the source and what their prompts hold.
QUERY_MODALITIES = {
    "llmrouter_generic_queries": "text",
    "memory_locomo_queries": "text",
    "memory_longmemeval_queries": "text",
    "multimodal_geometry3k_queries": "image",
    "multimodal_mathvista_queries": "image",
    "personalized_queries": "text",
    "timeseries_queries": "timeseries",
    "video_queries": "video",
}
#: Configurations with one outcome a row.
OUTCOME_CONFIGS = ("llmrouter_generic", "memory_locomo", "memory_longmemeval", "multimodal_geometry3k", "multimodal_mathvista", "timeseries", "video")
CORE_FIELDS = ("task_name", "query", "ground_truth", "metric", "choices", "task_id")
OUTCOMES_PER_QUERY = 18


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def metadata_rest(df: DataFrame, core: set[str]) -> Column:
    """JSON of all columns that are not core, keys sorted."""
    rest = {c: F.col(c) for c in df.columns if c not in core and not c.startswith("_")}
    return tx.canonical_json(rest) if rest else F.lit("{}")


def _field(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _conform(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]))


def build_queries(raw: DataFrame, *, dataset_id: str, revision: str, config: str, split: str, has_outcomes: bool) -> DataFrame:
    """Canonical queries of one source file; ``raw`` carries ``_row_index``, its rows' places in the file."""
    truth = F.col("ground_truth") if "ground_truth" in raw.columns else F.lit(None).cast("string")
    truth_text = truth if "ground_truth" not in raw.columns or _is_text(raw, "ground_truth") else F.when(truth.isNotNull(), tx.scalar_json(truth, quoted=False))
    choices = F.col("choices") if "choices" in raw.columns else F.lit(None).cast("string")
    choices_text = isinstance(raw.schema["choices"].dataType, T.StringType) if "choices" in raw.columns else True
    rows = raw.select(
        tx.canonical_id("qry", F.lit(dataset_id), F.lit(revision), F.lit(config), F.lit(split), "_row_index").alias("query_id"),
        F.lit(dataset_id).alias("source_dataset"),
        F.lit(revision).alias("source_revision"),
        F.lit(config).alias("source_config"),
        F.lit(split).alias("source_split"),
        F.col("_row_index").alias("source_row_index"),
        tx.source_query_id(_field(raw, "task_id", "string")).alias("source_query_id"),
        F.col("query").alias("prompt"),
        F.col("task_name").alias("task"),
        truth_text.alias("ground_truth"),
        tx.scalar_json(truth, quoted="ground_truth" not in raw.columns or _is_text(raw, "ground_truth")).alias("ground_truth_json"),
        "metric",
        F.lit(QUERY_MODALITIES.get(config, "text")).alias("modality"),
        (tx.scalar_json(choices, quoted=True) if choices_text else F.coalesce(F.to_json(choices) if not isinstance(raw.schema["choices"].dataType, T.NumericType) else choices.cast("string"), F.lit("null"))).alias("choices_json"),
        metadata_rest(raw, set(CORE_FIELDS)).alias("metadata_json"),
        tx.canonical_json({c: F.col(c) for c in raw.columns if not c.startswith("_")}).alias("raw_source_json"),
        F.lit(has_outcomes).alias("has_outcomes"),
        F.lit(False).alias("is_probe"),
        F.lit(None).cast("timestamp").alias("observed_at"),
    )
    return _conform(rows, "queries")


def _alias_rows(models: DataFrame) -> DataFrame:
    """``(alias_key, model_id)`` for every alias in its compared form."""
    return models.select("model_id", F.explode("aliases").alias("raw")).select(tx.normalize_alias("raw", exact=True).alias("alias_key"), "model_id").distinct()


def build_models(registry: DataFrame, observed: DataFrame, *, dataset_id: str, revision: str) -> DataFrame:
    """Canonical models: the registry's candidates, plus models only seen under an alias.

    An observed alias that names a candidate becomes one more alias of it.
    """

    def key(column: str) -> Column:
        return tx.normalize_alias(column, exact=True)

    def model_id(column: str) -> Column:
        return tx.canonical_id("mdl", F.lit(dataset_id), key(column))

    raw_json = tx.canonical_json({"raw_source": F.struct(*sorted(registry.columns)), "source_config": F.lit("llm_candidates")})
    listed = registry.select(
        model_id("api_model_id").alias("model_id"),
        F.col("model_name").alias("canonical_name"),
        F.col("service").alias("provider"),
        tx.developer("api_model_id").alias("developer"),
        tx.family("api_model_id").alias("family"),
        F.col("model_name").alias("version"),
        F.array("model_name", "api_model_id").alias("aliases"),
        "api_model_id",
        F.col("size").alias("size_label"),
        tx.parameter_billions("size").alias("parameter_count_billions"),
        "description",
        raw_json.alias("metadata_json"),
    )
    owners = _alias_rows(listed)
    clash = owners.groupBy("alias_key").agg(F.count_distinct("model_id").alias("n")).where("n > 1").orderBy("alias_key").first()
    if clash:
        raise CanonicalDataError(f"candidate alias collision: {clash['alias_key']}")
    seen = observed.select(F.col(observed.columns[0]).alias("alias")).distinct().withColumn("alias_key", key("alias"))
    more = seen.join(owners, "alias_key").groupBy("model_id").agg(F.collect_set("alias").alias("more"))
    known = listed.join(more, "model_id", "left").withColumn("aliases", F.concat("aliases", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    # several spellings of an unlisted alias are one model, named by the first in order
    spelled = seen.join(owners, "alias_key", "left_anti").groupBy("alias_key").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    null = F.lit(None).cast("string")
    name = F.col("aliases")[0]
    fresh = spelled.withColumn("first", name).select(
        model_id("first").alias("model_id"),
        F.col("first").alias("canonical_name"),
        tx.developer("first").alias("provider"),
        tx.developer("first").alias("developer"),
        tx.family("first").alias("family"),
        tx.base_name("first").alias("version"),
        "aliases",
        F.col("first").alias("api_model_id"),
        null.alias("size_label"),
        F.lit(None).cast("double").alias("parameter_count_billions"),
        null.alias("description"),
        tx.canonical_json({"observed_alias": F.col("first"), "source_config": F.lit("personalized")}).alias("metadata_json"),
    )
    rows = known.unionByName(fresh)
    each = rows.select("model_id", F.explode("aliases").alias("raw")).distinct().withColumn("k", key("raw"))
    names = each.groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "raw"))), lambda s: s["raw"]).alias("aliases"))
    rows = rows.drop("aliases").join(names, "model_id").withColumns({"capabilities": F.array(F.lit("text")), "source_revision": F.lit(revision), "available_at": F.lit(None).cast("timestamp")})
    return _conform(rows, "models")


def _must_match(joined: DataFrame, column: str, what: str) -> DataFrame:
    """Rows of a left join, failing where the right side is missing."""
    return joined.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(what)).cast("string")).otherwise(F.col(column)))


def _with_ids(raw: DataFrame, queries: DataFrame, models: DataFrame, config: str, split: str, alias: str) -> DataFrame:
    theirs = queries.where((F.col("source_config") == f"{config}_queries") & (F.col("source_split") == split)).select(F.col("source_row_index").alias("embedding_id"), "query_id")
    found = _must_match(raw.join(theirs, "embedding_id", "left"), "query_id", f"{config}/{split} references missing query index")
    keyed = found.withColumn("alias_key", tx.normalize_alias(alias, exact=True))
    return _must_match(keyed.join(_alias_rows(models), "alias_key", "left").drop("alias_key"), "model_id", f"{config}/{split} references an unknown model alias")


def build_outcomes(raw: DataFrame, queries: DataFrame, models: DataFrame, *, dataset_id: str, revision: str, config: str, split: str, per_query: int = OUTCOMES_PER_QUERY) -> DataFrame:
    """Canonical outcomes of a file with one outcome a row; ``raw`` carries ``_row_index``."""
    found = _with_ids(raw, queries, models, config, split, "model_name")
    extra = {c: F.col(c) for c in ("embedding_id", "category", "conversation_id") if c in raw.columns}
    rows = found.select(
        tx.canonical_id("out", F.lit(dataset_id), F.lit(revision), F.lit(config), F.lit(split), "_row_index").alias("outcome_id"),
        "query_id",
        "model_id",
        F.lit(config).alias("source_config"),
        F.lit(split).alias("source_split"),
        F.col("_row_index").alias("source_row_index"),
        F.col("embedding_id").alias("source_query_index"),
        F.lit(None).cast("byte").alias("candidate_position"),
        "metric",
        "response",
        F.col("performance").cast("double").alias("score"),
        F.col("token_num").alias("total_tokens"),
        "input_tokens",
        "output_tokens",
        F.col("response_time").alias("latency_seconds"),
        F.col("response").isNotNull().alias("succeeded"),
        F.when(F.col("response").isNull(), "missing_response").alias("failure_type"),
        tx.canonical_json(extra).alias("metadata_json"),
    )
    rows = _conform(rows, "outcomes")
    if not outcome_counts_off(rows, per_query).isEmpty():
        raise CanonicalDataError(f"{config}/{split} must contain exactly {per_query} outcomes per query")
    return rows


def unpivot_comparisons(raw: DataFrame) -> DataFrame:
    """Each comparison as two rows, one a candidate: position, model, response, score, the other's name."""
    both = F.array(
        *(
            F.struct(F.lit(p).cast("byte").alias("candidate_position"), F.col(f"model_{p}").alias("model"), F.col(f"answer_{p}").alias("response"), F.col(f"model_{3 - p}").alias("paired_model"))
            for p in (1, 2)
        )
    )
    judged = raw.withColumn("judge", F.when(F.col("judge").isin(1, 2), F.col("judge")).otherwise(F.raise_error(F.lit("judge must be 1 or 2")).cast("long")))
    rows = judged.withColumn("_c", F.explode(both)).select(*judged.columns, "_c.*")
    return rows.withColumn("score", F.when(F.col("judge") == F.col("candidate_position"), 1.0).otherwise(0.0)).drop("model_1", "model_2", "answer_1", "answer_2")


def build_comparison_outcomes(raw: DataFrame, queries: DataFrame, models: DataFrame, *, dataset_id: str, revision: str, split: str, config: str = "personalized") -> DataFrame:
    """Canonical outcomes of pairwise comparisons."""
    found = _with_ids(unpivot_comparisons(raw), queries, models, config, split, "model")
    null_long, null = F.lit(None).cast("long"), F.lit(None).cast("double")
    meta = {"embedding_id": F.col("embedding_id"), "judge": F.col("judge"), "persona_id": F.col("persona_id"), "persona": F.col("persona"), "paired_model_alias": F.col("paired_model")}
    rows = found.select(
        tx.canonical_id("out", F.lit(dataset_id), F.lit(revision), F.lit(config), F.lit(split), "_row_index", "candidate_position").alias("outcome_id"),
        "query_id",
        "model_id",
        F.lit(config).alias("source_config"),
        F.lit(split).alias("source_split"),
        F.col("_row_index").alias("source_row_index"),
        F.col("embedding_id").alias("source_query_index"),
        "candidate_position",
        "metric",
        "response",
        "score",
        null_long.alias("total_tokens"),
        null_long.alias("input_tokens"),
        null_long.alias("output_tokens"),
        null.alias("latency_seconds"),
        F.col("response").isNotNull().alias("succeeded"),
        F.when(F.col("response").isNull(), "missing_response").alias("failure_type"),
        tx.canonical_json(meta).alias("metadata_json"),
    )
    return _conform(rows, "outcomes")


def build_prices(registry: DataFrame, models: DataFrame, *, dataset_id: str, revision: str, effective_at: str, source: str) -> DataFrame:
    """One price a candidate, in force from the source revision's time."""
    snapshot = tx.canonical_id("price-snapshot", F.lit(dataset_id), F.lit(revision))
    keyed = registry.withColumn("alias_key", tx.normalize_alias("model_name", exact=True)).join(_alias_rows(models), "alias_key", "left")
    found = _must_match(keyed, "model_id", "llm_candidates references an unknown model alias")
    rows = found.select(
        tx.canonical_id("price", snapshot, "model_id").alias("price_id"),
        snapshot.alias("price_snapshot_id"),
        "model_id",
        tx.parse_iso8601(F.lit(effective_at)).alias("effective_at"),
        F.lit("USD").alias("currency"),
        F.lit(UNIT_TOKENS).alias("unit_tokens"),
        F.col("input_price_per_1m").alias("input_per_unit"),
        F.lit(None).cast("double").alias("cached_input_per_unit"),
        F.col("output_price_per_1m").alias("output_per_unit"),
        F.lit(source).alias("source"),
        F.lit(revision).alias("source_revision"),
        tx.canonical_json({"model_name": F.col("model_name"), "api_model_id": F.col("api_model_id")}).alias("metadata_json"),
    )
    return _conform(rows, "price_history")


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else empty


def build_canonical(source, *, per_query: int = OUTCOMES_PER_QUERY, check: bool = True) -> CanonicalTables:
    """All six tables from a pinned source (see ``switchyard.sources.pinned.PinnedSource``).

    Every source file is scanned lazily; queries and outcomes are written to
    the scratch folder once because building, checking and writing all read them.
    """
    spark, manifest = source.spark, source.manifest
    ids = {"dataset_id": manifest.dataset_id, "revision": manifest.revision}
    there = {(f.config, f.split) for f in manifest.files}
    empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}

    query_parts = [
        build_queries(source.scan(config, split), **ids, config=config, split=split, has_outcomes=(config.removesuffix("_queries"), split) in there)
        for config in QUERY_MODALITIES
        for split in ("train", "valid", "test")
        if (config, split) in there
    ]
    queries = materialize(_union(query_parts, empty["queries"]), "canonical-queries")
    compared = {split: source.scan("personalized", split) for split in ("train", "test") if ("personalized", split) in there}
    seen = [rows.select(F.col(f"model_{p}").alias("alias")) for rows in compared.values() for p in (1, 2)]
    registry = source.scan("llm_candidates", "train").drop("_row_index")
    models = materialize(build_models(registry, _union(seen, spark.createDataFrame([], "alias string")), **ids), "canonical-models")

    parts: list[DataFrame] = []
    for config in OUTCOME_CONFIGS:
        for split in ("train", "test"):
            if (config, split) in there:
                raw = source.scan(config, split)
                theirs = source.scan(f"{config}_queries", split).withColumnRenamed("_row_index", "embedding_id")
                if not copied_field_differences(raw, theirs, ["embedding_id"], list(CORE_FIELDS)).isEmpty():
                    raise CanonicalDataError(f"{config}/{split} differs from its query rows")
                parts.append(build_outcomes(raw, queries, models, **ids, config=config, split=split, per_query=per_query))
    for split, raw in compared.items():
        theirs = source.scan("personalized_queries", split).withColumnRenamed("_row_index", "embedding_id")
        if not copied_field_differences(raw, theirs, ["embedding_id"], ["task_name", "task_id", "query", "metric"]).isEmpty():
            raise CanonicalDataError(f"personalized/{split} differs from its query rows")
        parts.append(build_comparison_outcomes(raw, queries, models, **ids, split=split))
    outcomes = materialize(_union(parts, empty["outcomes"]), "canonical-outcomes")
    prices = build_prices(registry, models, **ids, effective_at=manifest.modified_at, source=f"{manifest.name}:llm_candidates")
    tables = CanonicalTables(queries, models, outcomes, materialize(prices, "canonical-prices"), empty["probe_profiles"], empty["online_route_log"])
    if check:
        validate(tables)
    return tables
