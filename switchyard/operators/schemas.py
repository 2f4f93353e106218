"""The six canonical tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA_VERSION = "canonical-v1"

_TYPES = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "y": T.ByteType(), "a": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    """``name:type`` words; a ``!`` marks what must not be null."""
    out = []
    for word in text.split():
        name, kind = word.split(":")
        out.append(T.StructField(name, _TYPES[kind[0]], not kind.endswith("!"), {"canonical_schema_version": SCHEMA_VERSION}))
    return T.StructType(out)


SCHEMAS: dict[str, T.StructType] = {
    "queries": _schema(
        "query_id:s! source_dataset:s! source_revision:s! source_config:s! source_split:s! source_row_index:l! source_query_id:s prompt:s! task:s! ground_truth:s "
        "ground_truth_json:s! metric:s! modality:s! choices_json:s metadata_json:s! raw_source_json:s! has_outcomes:b! is_probe:b! observed_at:t"
    ),
    "models": _schema(
        "model_id:s! canonical_name:s! provider:s! developer:s! family:s! version:s! aliases:a! api_model_id:s size_label:s parameter_count_billions:d "
        "capabilities:a! description:s source_revision:s! metadata_json:s! available_at:t"
    ),
    "outcomes": _schema(
        "outcome_id:s! query_id:s! model_id:s! source_config:s! source_split:s! source_row_index:l! source_query_index:l! candidate_position:y metric:s! response:s "
        "score:d total_tokens:l input_tokens:l output_tokens:l latency_seconds:d succeeded:b! failure_type:s metadata_json:s!"
    ),
    "price_history": _schema(
        "price_id:s! price_snapshot_id:s! model_id:s! effective_at:t! currency:s! unit_tokens:l! input_per_unit:d! cached_input_per_unit:d output_per_unit:d! "
        "source:s! source_revision:s! metadata_json:s!"
    ),
    "probe_profiles": _schema(
        "probe_profile_id:s! probe_set_id:s! query_id:s! model_id:s! outcome_id:s score:d input_tokens:l output_tokens:l latency_seconds:d observed_at:t metadata_json:s!"
    ),
    "online_route_log": _schema(
        "route_id:s! query_id:s! event_time:t! candidate_model_ids:a! selected_model_id:s! selection_probability:d! predicted_quality:d predicted_output_tokens:d "
        "predicted_latency_seconds:d feedback_score:d feedback_received_at:t metadata_json:s!"
    ),
}

PRIMARY_KEYS = {"queries": "query_id", "models": "model_id", "outcomes": "outcome_id", "price_history": "price_id", "probe_profiles": "probe_profile_id", "online_route_log": "route_id"}


@dataclass(frozen=True)
class CanonicalTables:
    """The six tables of one build."""

    queries: DataFrame
    models: DataFrame
    outcomes: DataFrame
    price_history: DataFrame
    probe_profiles: DataFrame
    online_route_log: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]
