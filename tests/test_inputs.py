"""Loaders, settings, where data may lie, the command line, and split manifests read back."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from split_data import models, queries
from switchyard import cli
from switchyard.errors import SplitError, SplitIOError, SplitValidationError, StorageConfigurationError
from switchyard.operators import splits as sp
from switchyard.operators.deduplication import DeduplicationConfig, deduplicate_queries
from switchyard.sources.loaders import load_models, load_queries
from switchyard.sources.sinks import split_manifest, validate_split_manifest, write_split_bundle
from switchyard.sources.storage import StoragePolicy, load_project_config, load_split_settings

CONFIG = sp.SplitBuildConfig("data/set", "rev", "1.0.0")
SETTINGS = """
[split]
seed = 7
train_ratio = 0.8
validation_ratio = 0.1
test_ratio = 0.1
[deduplication]
normalization_version = "nfkc-casefold-whitespace-v1"
near_duplicate_threshold = 0.9
shingle_size = 3
signature_size = 8
max_bucket_size = 128
max_candidate_pairs = 1000
[manifest]
version = "1.0.0"
algorithm_version = "a"
[storage]
root_environment_variable = "ROOT_OF_TEST"
use_project_root_by_default = true
"""


def _lines(path: Path, rows: list[dict]) -> str:
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), "utf-8")
    return str(path)


def test_queries_from_lines(spark, tmp_path):
    rows = [
        {"query_id": "a", "prompt": "x", "task": "t", "source": "s", "observed_at": "2025-01-01T02:00:00+02:00"},
        {"query_id": "b", "prompt": "y", "task": "t", "source_dataset": "d", "source_config": "c", "is_probe": True, "has_outcomes": True},
        {"query_id": "c", "prompt": "z", "task": "t", "source": "s", "has_outcomes": False},
    ]
    got = {r["query_id"]: r for r in load_queries(spark, _lines(tmp_path / "q.jsonl", rows)).collect()}
    assert got.keys() == {"a", "b"} and got["b"]["source"] == "d:c" and got["b"]["is_probe"] and not got["a"]["is_probe"]
    assert got["a"]["observed_at"].astimezone(timezone.utc) == datetime(2025, 1, 1, tzinfo=timezone.utc)
    with pytest.raises(SplitIOError, match="timezone"):
        load_queries(spark, _lines(tmp_path / "naive.jsonl", [rows[0] | {"observed_at": "2025-01-01T02:00:00"}]))
    with pytest.raises(SplitIOError, match="source"):
        load_queries(spark, _lines(tmp_path / "half.jsonl", [{"query_id": "a", "prompt": "x", "task": "t", "source_dataset": "d"}]))
    with pytest.raises(SplitIOError, match="unsupported"):
        load_queries(spark, str(tmp_path / "q.csv"))


def test_queries_from_parquet(spark, tmp_path):
    base = spark.createDataFrame(
        [("a", "x", "t", "d", "c", None, None, False, True), ("b", "y", "t", "d", "c", None, None, False, False)],
        "query_id string, prompt string, task string, source_dataset string, source_config string, source_query_id string, observed_at timestamp, is_probe boolean, has_outcomes boolean",
    )
    base.write.parquet(f"{tmp_path}/q.parquet")
    assert [(r["query_id"], r["source"]) for r in load_queries(spark, f"{tmp_path}/q.parquet").collect()] == [("a", "d:c")]
    base.where("query_id = 'b'").write.parquet(f"{tmp_path}/none.parquet")
    with pytest.raises(SplitIOError, match="no query"):
        load_queries(spark, f"{tmp_path}/none.parquet")
    base.withColumn("source_config", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/half.parquet")
    with pytest.raises(SplitIOError, match="source"):
        load_queries(spark, f"{tmp_path}/half.parquet")


def test_models(spark, tmp_path):
    rows = [{"model_id": "m", "provider": "p", "family": "f", "version": "v", "available_at": "2025-01-01T00:00:00Z"}]
    got = load_models(spark, _lines(tmp_path / "m.jsonl", rows)).first()
    assert got["aliases"] == [] and got["available_at"] is not None
    models(spark).write.parquet(f"{tmp_path}/m.parquet")
    assert load_models(spark, f"{tmp_path}/m.parquet").count() == 12
    with pytest.raises(SplitIOError, match="timezone"):
        load_models(spark, _lines(tmp_path / "naive.jsonl", [rows[0] | {"available_at": "2025-01-01"}]))


def test_where_data_may_lie(tmp_path):
    repository, outside = tmp_path / "repo", tmp_path / "store"
    policy = StoragePolicy(repository, "ROOT_OF_TEST", {})
    assert policy.root() == repository and policy.root(outside) == outside
    named = StoragePolicy(repository, "ROOT_OF_TEST", {"ROOT_OF_TEST": str(outside)})
    assert named.root() == named.required() == outside and named.root(tmp_path / "other") == tmp_path / "other"
    assert policy.data(outside / "x") == outside / "x" and policy.data(repository / "data" / "x") == repository / "data" / "x"
    for call, said in (
        (policy.required, "not set"),
        (StoragePolicy(repository, "ROOT_OF_TEST", {"ROOT_OF_TEST": "here"}).required, "absolute"),
        (lambda: policy.root(Path("here")), "absolute"),
        (lambda: policy.root(repository / "src"), "outside"),
        (lambda: policy.data(repository / "src" / "x"), "beneath"),
    ):
        with pytest.raises(StorageConfigurationError, match=said):
            call()


def test_settings(tmp_path):
    path = tmp_path / "splits.toml"
    path.write_text(SETTINGS)
    settings = load_split_settings(path)
    assert settings.seed == 7 and settings.ratios == sp.SplitRatios() and settings.deduplication == DeduplicationConfig(max_candidate_pairs=1000)
    assert settings.build_config("d", "r", "s").algorithm_version == "a"
    for old, new in (("seed = 7", 'seed = "7"'), ("signature_size = 8", "signature_size = true"), ('version = "1.0.0"', 'version = ""'), ("[split]", "[split")):
        path.write_text(SETTINGS.replace(old, new, 1))
        with pytest.raises(SplitIOError):
            load_split_settings(path)
    path.write_text(SETTINGS.replace("train_ratio = 0.8", "train_ratio = 0.9"))
    with pytest.raises(SplitError, match="sum"):
        load_split_settings(path)
    project = '[project]\nname = "n"\nseed = 1\n[paths]\ndata_dir = "data"\nartifacts_dir = "a"\nreports_dir = "r"\n'
    path.write_text(project)
    assert load_project_config(path).data_dir == Path("data")
    for old, new in (("seed = 1", "seed = -1"), ("seed = 1", "seed = true"), ('name = "n"', 'name = " "')):
        path.write_text(project.replace(old, new))
        with pytest.raises(ValueError):
            load_project_config(path)


@pytest.fixture(scope="module")
def found(spark):
    return deduplicate_queries(queries(spark))


def test_only_an_undated_temporal_split_may_be_unsupported(spark, found):
    undated = queries(spark).withColumn("observed_at", F.lit(None).cast("timestamp"))
    with pytest.raises(SplitError, match="requires observed_at"):
        cli.build_splits(undated, models(spark), CONFIG, found, False)
    built, unsupported = cli.build_splits(undated, models(spark), CONFIG, found, True)
    assert unsupported.keys() == {"temporal"} and built.keys() == set(sp.STRATEGIES) - {"temporal"}
    with pytest.raises(SplitError, match="at least three"):
        cli.build_splits(queries(spark).where("query_id in ('q-28', 'q-29')"), models(spark), CONFIG, deduplicate_queries(queries(spark).where("query_id in ('q-28', 'q-29')")), True)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    assert cli.main([]) == 0 and "splits" in capsys.readouterr().out
    queries(spark).withColumns({"source_dataset": F.lit("d"), "source_config": F.lit("c"), "has_outcomes": F.lit(True)}).write.parquet(f"{tmp_path}/q.parquet")
    models(spark).write.parquet(f"{tmp_path}/m.parquet")
    (tmp_path / "s.toml").write_text(SETTINGS)
    monkeypatch.chdir(tmp_path)
    store = tmp_path.parent / f"{tmp_path.name}-store"
    done = cli.main(["splits", "--queries", f"{tmp_path}/q.parquet", "--models", f"{tmp_path}/m.parquet", "--settings", f"{tmp_path}/s.toml", "--dataset-id", "d", "--revision", "r", "--storage-root", str(store)])
    folder = Path(capsys.readouterr().out.strip().splitlines()[-1])
    assert done == 0 and folder.is_relative_to(store) and len(list(folder.iterdir())) == 7


def test_manifests_read_back(spark, found, tmp_path):
    q, m = queries(spark), models(spark)
    built = sp.build_all_splits(q, m, found, CONFIG)
    folder = write_split_bundle(tmp_path, q, m, found, built)
    held = {s: json.loads((folder / f"{s}.json").read_text("utf-8")) for s in sp.STRATEGIES}
    for manifest in held.values():
        validate_split_manifest(manifest, q, m, found)
    good = held["model_held_out"]
    other = q.withColumn("prompt", F.when(F.col("query_id") == "q-20", "changed").otherwise(F.col("prompt")))
    renamed = m.withColumn("aliases", F.when(F.col("model_id") == "model-00", F.array(F.lit("new"))).otherwise(F.col("aliases")))
    with pytest.raises(SplitValidationError, match="source_digest"):
        validate_split_manifest(good, other, m, found)
    moved_cluster = replace(found, members=found.members.withColumn("cluster_id", F.concat("cluster_id", F.lit("x"))))
    with pytest.raises(SplitValidationError, match="deduplication_digest"):
        validate_split_manifest(good, q, m, moved_cluster)
    same_digest = split_manifest(built["model_held_out"], q, renamed, found)["source_digest"]
    with pytest.raises(SplitValidationError, match="model_identities"):
        validate_split_manifest(good | {"source_digest": same_digest}, q, renamed, found)
    with pytest.raises(SplitValidationError, match="held_out_models"):
        validate_split_manifest(good | {"held_out_models": []}, q, m, found)
    with pytest.raises(SplitValidationError, match="boundaries"):
        validate_split_manifest(held["temporal"] | {"temporal_query_boundaries": ["a", "b"]}, q, m, found)
    with pytest.raises(SplitValidationError, match="not a split manifest"):
        validate_split_manifest({k: v for k, v in good.items() if k != "queries"}, q, m, found)
    torn = json.loads(json.dumps(good))
    for ids in torn["queries"].values():
        if "q-00" in ids:
            ids.remove("q-00")
    torn["queries"]["test" if "q-01" not in torn["queries"]["test"] else "train"].append("q-00")
    with pytest.raises(SplitValidationError, match="duplicate cluster"):
        validate_split_manifest(torn, q, m, found)
