from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

import pyarrow.parquet as pq
import pytest

from switchyard.errors import CanonicalDataError, SourceError
from switchyard.operators.canonical import build_canonical
from switchyard.operators.schemas import SCHEMAS, CanonicalTables
from switchyard.operators.validation import validate, violations
from switchyard.sources.pinned import PinnedSource, SourceFile, SourceManifest, load_manifest, read_jsonl
from switchyard.sources.sinks import write_canonical_dataset

AT = datetime(2026, 8, 15, tzinfo=timezone.utc)
ROWS = {
    "queries": [("query-1", "set", "r1", "queries", "train", 0, "s1", "What is two plus two?", "math", "4", '"4"', "em", "text", "null", "{}", "{}", True, True, None)],
    "models": [("model-1", "model-one", "provider", "developer", "family-one", "v1", ["model-one", "provider/model-one"], "provider/model-one", "1B", 1.0, ["text"], None, "r1", "{}", None)],
    "outcomes": [("outcome-1", "query-1", "model-1", "queries", "train", 0, 0, None, "em", "4", 1.0, 3, 2, 1, 0.1, True, None, "{}")],
    "price_history": [("price-1", "snapshot-1", "model-1", AT, "USD", 1_000_000, 1.0, 0.5, 2.0, "source", "r1", "{}")],
    "probe_profiles": [("probe-1", "set-1", "query-1", "model-1", "outcome-1", 1.0, 2, 1, 0.1, AT, "{}")],
    "online_route_log": [("route-1", "query-1", AT, ["model-1"], "model-1", 1.0, 0.9, 1.0, 0.1, 1.0, AT, "{}")],
}


def tables(spark, **changed) -> CanonicalTables:
    return CanonicalTables(**{name: spark.createDataFrame(changed.get(name, rows), SCHEMAS[name]) for name, rows in ROWS.items()})


def _with(table: str, column: str, value) -> list[tuple]:
    at = SCHEMAS[table].fieldNames().index(column)
    return [tuple(value if i == at else x for i, x in enumerate(ROWS[table][0]))]


def test_valid_tables_pass(spark):
    assert violations(tables(spark)).isEmpty()


@pytest.mark.parametrize(
    ("table", "column", "value", "message"),
    [
        ("outcomes", "model_id", "missing", "unknown model"),
        ("outcomes", "total_tokens", 99, "does not equal"),
        ("queries", "has_outcomes", False, "disagrees"),
        ("probe_profiles", "score", 1.1, "probe_profiles.score"),
        ("online_route_log", "selection_probability", 0.0, "greater than zero"),
        ("outcomes", "score", float("nan"), "between 0 and 1"),
        ("queries", "modality", "smell", "not recognized"),
        ("models", "aliases", [], "non-empty list"),
        ("online_route_log", "candidate_model_ids", ["model-1", "nobody"], "unknown candidate"),
    ],
)
def test_broken_rules(spark, table, column, value, message):
    with pytest.raises(CanonicalDataError, match=message):
        validate(tables(spark, **{table: _with(table, column, value)}))


def test_alias_owner(spark):
    other = list(ROWS["models"][0])
    other[0], other[6] = "model-2", [" MODEL-ONE "]
    with pytest.raises(CanonicalDataError, match="maps to both"):
        validate(tables(spark, models=[ROWS["models"][0], tuple(other)]))


def test_dataset_round_trip(spark, tmp_path):
    manifest = write_canonical_dataset(tables(spark), tmp_path, source_dataset="set", source_revision="r1", source_manifest_sha256="0", debug_limit=1)
    value = json.loads(manifest.read_text())
    assert [t["rows"] for t in value["tables"]] == [1] * 6
    assert json.loads((tmp_path / "debug/queries.jsonl").read_text())["prompt"] == "What is two plus two?"
    assert spark.read.parquet(str(tmp_path / "models.parquet")).collect() == tables(spark).models.collect()


def _source(spark, root, per_query=2) -> PinnedSource:
    """Two queries, two candidates, every outcome, one comparison."""
    q = "task_name string, query string, ground_truth string, metric string, choices string, task_id string"
    asked = [("math", f"prompt {i}", str(i), "em", None, f"t{i}") for i in range(2)]
    answers = [(*asked[i], name, None if i else "ok", 3, 2, 1, 0.5, 1.0 - i, i) for i in range(2) for name in ("Alpha-8B", "beta")]
    data = {
        ("llm_candidates", "train"): ([("Alpha-8B", "8B", 1.0, 2.0, "svc", "Org/Alpha-8B", "d"), ("beta", None, 0.5, 1.0, "svc", "beta", "d")], "model_name string, size string, input_price_per_1m double, output_price_per_1m double, service string, api_model_id string, description string"),
        ("video_queries", "train"): (asked, q),
        ("video", "train"): (answers, q + ", model_name string, response string, token_num long, input_tokens long, output_tokens long, response_time double, performance double, embedding_id long"),
        ("personalized_queries", "train"): (asked[:1], q),
        ("personalized", "train"): ([("math", "t0", "prompt 0", "em", 0, "ALPHA-8b", "new/Model", "a", None, 2, 7, "p")], "task_name string, task_id string, query string, metric string, embedding_id long, model_1 string, model_2 string, answer_1 string, answer_2 string, judge long, persona_id long, persona string"),
    }
    files = []
    for (config, split), (rows, schema) in data.items():
        frame = spark.createDataFrame(rows, schema)
        path = root / f"{config}-{split}.parquet"
        pq.write_table(frame.toArrow(), path)
        raw = path.read_bytes()
        files.append(SourceFile(config, split, path.name, len(rows), len(frame.columns), len(raw), hashlib.sha256(raw).hexdigest()))
    manifest = SourceManifest("Org/Set", "r1", "2026-01-01T00:00:00Z", "schema.json", "base", tuple(files))
    return PinnedSource(spark, root, manifest, {})


def test_build_from_source(spark, tmp_path):
    built = build_canonical(_source(spark, tmp_path), per_query=2)
    assert {name: rows.count() for name, rows in built.items()} == {"queries": 3, "models": 3, "outcomes": 6, "price_history": 2, "probe_profiles": 0, "online_route_log": 0}
    by_name = {r["canonical_name"]: r for r in built.models.collect()}
    assert by_name["Alpha-8B"]["aliases"] == ["Alpha-8B", "ALPHA-8b", "Org/Alpha-8B"] or by_name["Alpha-8B"]["aliases"] == ["ALPHA-8b", "Alpha-8B", "Org/Alpha-8B"]
    assert by_name["new/Model"]["developer"] == "new" and by_name["Alpha-8B"]["parameter_count_billions"] == 8.0
    failed = [r["failure_type"] for r in built.outcomes.where("not succeeded").collect()]
    assert failed == ["missing_response"] * 3
    assert {r["candidate_position"]: r["score"] for r in built.outcomes.where("candidate_position is not null").collect()} == {1: 0.0, 2: 1.0}
    with pytest.raises(CanonicalDataError, match="exactly 18"):
        build_canonical(_source(spark, tmp_path))


def test_source_checks(spark, tmp_path):
    source = _source(spark, tmp_path)
    path = source.local_path("video", "train")
    path.write_bytes(path.read_bytes() + b"extra")
    with pytest.raises(SourceError, match="size mismatch"):
        source.scan("video", "train")
    with pytest.raises(SourceError, match="no file"):
        source.scan("nothing", "train")
    source.schemas = {"video_queries": (("renamed", "string"),)}
    with pytest.raises(SourceError, match="column mismatch"):
        source.scan("video_queries", "train")
    (tmp_path / "m.json").write_text(json.dumps({"dataset_id": "d", "revision": "r", "schema_snapshot": "../s.json", "source_urls": {"resolve_base": "b"}, "files": [{"config": "c", "split": "s", "path": "p", "rows": 1, "columns": 1, "size_bytes": 1, "sha256": "x"}]}))
    with pytest.raises(SourceError, match="stay inside"):
        load_manifest(tmp_path / "m.json")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    with pytest.raises(SourceError, match="blank"):
        read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long")
