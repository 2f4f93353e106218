"""Rules of the canonical tables, as one table of violations.

Each rule is a filter, a grouped count or an anti-join, planned by Catalyst; a
table without violations passes.  ``validate`` stops at the first violation in
the order of the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.errors import CanonicalDataError
from switchyard.functions.text import normalize_alias
from switchyard.operators.schemas import PRIMARY_KEYS, SCHEMAS, CanonicalTables

#: Fixed values.
SPLITS = ("train", "valid", "test")
MODALITIES = ("text", "image", "video", "timeseries")

_REQUIRED = {
    "queries": "source_dataset source_revision source_config source_split prompt task metric modality ground_truth_json metadata_json raw_source_json",
    "models": "canonical_name provider developer family version source_revision metadata_json",
    "outcomes": "query_id model_id source_config source_split metric metadata_json",
    "price_history": "model_id price_snapshot_id currency source source_revision metadata_json",
    "probe_profiles": "probe_set_id metadata_json query_id model_id",
    "online_route_log": "metadata_json query_id selected_model_id",
}
_COUNTS = {
    "queries": ("source_row_index!",),
    "outcomes": ("source_row_index!", "source_query_index!", "candidate_position", "total_tokens", "input_tokens", "output_tokens"),
    "price_history": ("unit_tokens!",),
    "probe_profiles": ("input_tokens", "output_tokens"),
}
_NUMBERS = {
    "models": ("parameter_count_billions",),
    "outcomes": ("latency_seconds",),
    "price_history": ("input_per_unit!", "cached_input_per_unit", "output_per_unit!"),
    "probe_profiles": ("latency_seconds",),
    "online_route_log": ("predicted_output_tokens", "predicted_latency_seconds"),
}
_SHARES = {"outcomes": ("score",), "probe_profiles": ("score",), "online_route_log": ("selection_probability!", "predicted_quality", "feedback_score")}
_PRESENT = {"queries": ("has_outcomes", "is_probe"), "outcomes": ("succeeded",), "price_history": ("effective_at",), "online_route_log": ("event_time",)}


def blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column) == "")


def not_a_measure(column: Column, nullable: bool) -> Column:
    """Negative, not a number or infinite; null too unless it may be."""
    wrong = (column < 0) | F.isnan(column.cast("double")) | (column.cast("double") == float("inf"))
    return F.coalesce(wrong, F.lit(not nullable))


def not_a_share(column: Column, nullable: bool) -> Column:
    wrong = F.isnan(column) | (column < 0) | (column > 1)
    return F.coalesce(wrong, F.lit(not nullable))


def _found(rows: DataFrame, rule: str, table: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose ``column`` names no row of ``parent``; null names nothing and is left out."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def shared_aliases(models: DataFrame, own_id_too: bool = False, exact: bool = False) -> DataFrame:
    """``(alias, first, second, n)``: normalised aliases that several models claim."""
    names = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("model_id")) if own_id_too else F.col("aliases")
    each = models.select("model_id", F.explode(names).alias("raw")).select("model_id", normalize_alias("raw", exact).alias("alias"))
    owners = each.groupBy("alias").agg(F.min("model_id").alias("first"), F.max("model_id").alias("second"), F.count_distinct("model_id").alias("n"))
    return owners.where("n > 1")


def token_total_mismatches(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("total_tokens <> input_tokens + output_tokens")


def has_outcomes_drift(queries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Queries whose ``has_outcomes`` is not what the outcome table says."""
    seen = outcomes.select("query_id").distinct().withColumn("seen", F.lit(True))
    return queries.join(seen, "query_id", "left").where(F.col("has_outcomes") != F.coalesce("seen", F.lit(False)))


def violations(tables: CanonicalTables) -> DataFrame:
    """``(rule, table, key, detail)`` of every violation; empty means valid."""
    t = dict(tables.items())
    found: list[DataFrame] = []

    def add(n: int, table: str, rows: DataFrame, detail: Column | str, key: str | None = None) -> None:
        found.append(_found(rows, f"{n:02d}", table, F.col(key or PRIMARY_KEYS[table]), F.lit(detail) if isinstance(detail, str) else detail))

    for table, key in PRIMARY_KEYS.items():
        add(1, table, t[table].where(blank(F.col(key))), f"{table}.{key} must be a non-empty string")
        add(1, table, duplicate_keys(t[table], key), f"duplicate {table}.{key}")
    for table, names in _REQUIRED.items():
        for name in names.split():
            add(2, table, t[table].where(blank(F.col(name))), f"{table}.{name} must be a non-empty string")
    add(3, "queries", t["queries"].where(~F.col("source_split").isin(*SPLITS)), "queries.source_split is not recognized")
    add(3, "queries", t["queries"].where(~F.col("modality").isin(*MODALITIES)), "queries.modality is not recognized")
    for rules, wrong, say in ((_COUNTS, not_a_measure, "must be a non-negative integer"), (_NUMBERS, not_a_measure, "must be a finite non-negative number"), (_SHARES, not_a_share, "must be between 0 and 1")):
        for table, names in rules.items():
            for name in names:
                column = name.rstrip("!")
                add(4, table, t[table].where(wrong(F.col(column), not name.endswith("!"))), f"{table}.{column} {say}")
    for table, names in _PRESENT.items():
        for name in names:
            add(5, table, t[table].where(F.col(name).isNull()), f"{table}.{name} is missing")
    for table, column, parent in (
        ("outcomes", "query_id", "queries"),
        ("outcomes", "model_id", "models"),
        ("price_history", "model_id", "models"),
        ("probe_profiles", "query_id", "queries"),
        ("probe_profiles", "model_id", "models"),
        ("probe_profiles", "outcome_id", "outcomes"),
        ("online_route_log", "query_id", "queries"),
        ("online_route_log", "selected_model_id", "models"),
    ):
        word = {"queries": "query", "models": "model", "outcomes": "outcome"}[parent]
        add(6, table, orphans(t[table], column, t[parent], PRIMARY_KEYS[parent]), F.concat(F.lit(f"{table}.{column} references unknown {word} "), F.col(column)))
    add(7, "outcomes", token_total_mismatches(t["outcomes"]), "outcomes.total_tokens does not equal input_tokens + output_tokens")
    add(8, "queries", has_outcomes_drift(t["queries"], t["outcomes"]), "queries.has_outcomes disagrees with the outcome table")
    claims = shared_aliases(t["models"])
    found.append(_found(claims, "09", "models", F.col("first"), F.concat(F.lit("model alias '"), "alias", F.lit("' maps to both '"), "first", F.lit("' and '"), "second", F.lit("'"))))
    for name in ("aliases", "capabilities"):
        add(10, "models", t["models"].where(F.col(name).isNull() | (F.size(name) == 0)), f"models.{name} must be a non-empty list")
        add(10, "models", t["models"].where(F.exists(name, blank)), f"models.{name} contains an empty value")
    paired = t["probe_profiles"].alias("p").join(t["outcomes"].select("outcome_id", F.col("query_id").alias("oq"), F.col("model_id").alias("om")), "outcome_id")
    add(11, "probe_profiles", paired.where("not (query_id <=> oq) or not (model_id <=> om)"), "probe_profiles.outcome_id does not match its query and model")
    routes = t["online_route_log"]
    add(12, "online_route_log", routes.where(F.col("candidate_model_ids").isNull() | (F.size("candidate_model_ids") == 0)), "online_route_log.candidate_model_ids must not be empty")
    each = routes.select("route_id", F.explode("candidate_model_ids").alias("candidate"))
    add(12, "online_route_log", orphans(each, "candidate", t["models"], "model_id"), "online_route_log contains an unknown candidate model")
    add(12, "online_route_log", routes.where(~F.array_contains("candidate_model_ids", F.col("selected_model_id"))), "online_route_log.selected_model_id is not a candidate")
    add(12, "online_route_log", routes.where("selection_probability = 0"), "online_route_log.selection_probability must be greater than zero")
    return reduce(DataFrame.unionByName, found)


def validate(tables: CanonicalTables) -> None:
    """Raise for the first violation, in the order of rules, tables and keys."""
    for name, rows in tables.items():
        expected = [(f.name, f.dataType) for f in SCHEMAS[name]]
        if [(f.name, f.dataType) for f in rows.schema] != expected:
            raise CanonicalDataError(f"{name} does not have the canonical schema")
    first = violations(tables).orderBy("rule", "table", "key", "detail").limit(1).collect()
    if first:
        raise CanonicalDataError(f"{first[0]['detail']} (key {first[0]['key']})")


def copied_field_differences(outcomes: DataFrame, queries: DataFrame, on: list[str], copied: list[str]) -> DataFrame:
    """Rows whose copied fields are not those of their query; null equals null."""
    theirs = queries.select(*on, *(F.col(c).alias(f"_{c}") for c in copied))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in copied))
    return outcomes.join(theirs, on).where(~same)


def outcome_counts_off(outcomes: DataFrame, expected: int = 18) -> DataFrame:
    """Queries that appear with another number of outcomes than expected."""
    return outcomes.groupBy("source_config", "source_split", "query_id").agg(F.count("*").alias("n")).where(F.col("n") != expected)
