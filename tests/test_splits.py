from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from split_data import model_rows, models, queries, query_rows
from switchyard.errors import DeduplicationError, SplitError, SplitValidationError
from switchyard.operators import splits as sp
from switchyard.operators.deduplication import DeduplicationConfig, deduplicate_queries
from switchyard.sources.sinks import write_split_bundle

CONFIG = sp.SplitBuildConfig("set/one", "r1", "canonical-v1")


@pytest.fixture(scope="module")
def found(spark):
    return deduplicate_queries(queries(spark))


def test_clusters_and_reasons(spark, found):
    clusters = {tuple(r["query_ids"]): r["reasons"] for r in found.clusters().collect()}
    several = {ids: reasons for ids, reasons in clusters.items() if len(ids) > 1}
    assert len(clusters) == 26
    assert several[("q-00", "q-01")] == ["exact_prompt", "near_duplicate", "normalized_prompt"]
    assert several[("q-02", "q-03")] == ["near_duplicate", "normalized_prompt"]
    assert several[("q-04", "q-05")] == ["near_duplicate"]
    assert several[("q-06", "q-07")] == ["source_identity"]
    assert several[("q-08", "q-09")] == ["augmentation_lineage"]
    assert ("probe-00", "probe-copy") in several


def test_order_does_not_matter(spark, found):
    turned = deduplicate_queries(queries(spark, query_rows()[::-1]).repartition(7))
    assert sp.ordered_digest(turned.members) == sp.ordered_digest(found.members)


def test_bad_input(spark):
    with pytest.raises(DeduplicationError, match="duplicate query_id"):
        deduplicate_queries(queries(spark, query_rows()[:3] + query_rows()[:1]))
    with pytest.raises(DeduplicationError, match="threshold"):
        DeduplicationConfig(near_duplicate_threshold=0.0).validate()
    with pytest.raises(DeduplicationError, match="at least one"):
        deduplicate_queries(queries(spark).limit(0))


def _walk(sizes: list[int]) -> list[str]:
    """The sequential rule, group by group."""
    out: list[str] = []
    total, consumed = sum(sizes), 0
    for i, size in enumerate(sizes):
        empty = [p for p in sp.PARTITIONS if p not in out]
        middle = consumed + size / 2
        if len(sizes) - i == len(empty):
            out.append(empty[0])
        elif middle <= 0.8 * total:
            out.append("train")
        elif middle <= (0.8 + 0.1) * total:
            out.append("validation")
        else:
            out.append("test")
        consumed += size
    return out


@pytest.mark.parametrize("sizes", [[1, 1, 1], [5, 1, 1, 1], [1, 1, 1, 50], [50, 1, 1, 1], [1] * 40, [9, 3, 1, 1, 1, 7, 2], [100, 1, 1]])
def test_ratio_walk(spark, sizes):
    rows = spark.createDataFrame([(i, f"g{i}", s) for i, s in enumerate(sizes)], "o int, group_id string, size long").repartition(3)
    placed = {r["o"]: r["partition"] for r in sp.ratio_partition(rows, ["o", "group_id"], sp.SplitRatios(), "x").collect()}
    assert [placed[i] for i in range(len(sizes))] == _walk(sizes)


def test_all_strategies(spark, found, tmp_path):
    q, m = queries(spark), models(spark)
    built = sp.build_all_splits(q, m, found, CONFIG)
    probes = {r["query_id"] for r in built["prompt_iid"].queries.where("partition = 'probe'").collect()}
    assert probes == {"probe-00", "probe-copy"}
    assert built["temporal"].query_boundaries[0] < built["temporal"].query_boundaries[1]
    assert built["task_held_out"].held_out_tasks and built["family_held_out"].held_out_families
    again = sp.build_split("prompt_iid", queries(spark, query_rows()[::-1]), m, found, CONFIG)
    assert sp.ordered_digest(again.queries) == sp.ordered_digest(built["prompt_iid"].queries)
    other = sp.build_split("prompt_iid", q, m, found, replace(CONFIG, seed=1))
    assert sp.ordered_digest(other.queries) != sp.ordered_digest(built["prompt_iid"].queries)
    moved = replace(built["prompt_iid"], queries=built["prompt_iid"].queries.withColumn("partition", F.when(F.col("query_id") == "q-00", "test").when(F.col("query_id") == "q-01", "train").otherwise(F.col("partition"))))
    with pytest.raises(SplitValidationError, match="duplicate cluster"):
        sp.validate_split(moved, q, m, found)
    folder = write_split_bundle(tmp_path, q, m, found, built)
    first = {p.name: p.read_bytes() for p in folder.iterdir()}
    write_split_bundle(tmp_path, q, m, found, built)
    assert first == {p.name: p.read_bytes() for p in folder.iterdir()} and len(first) == 7
    report = next((tmp_path / "data/processed/splits/reports").iterdir()).read_text()
    assert "Exactly duplicated" not in report


def test_models(spark):
    rows = model_rows()
    clash = [*rows[:1], (*rows[1][:4], [" model alias 00 "], rows[1][5])]
    with pytest.raises(SplitError, match="maps to both"):
        sp.check_models(models(spark, clash))
    same = [(*rows[0][:4], ["MODEL ALIAS 00", " MODEL ALIAS 00 ", "api/model-00"], rows[0][5])]
    assert sp.model_identities(models(spark, same)).first()["aliases"] == ["api/model-00", " MODEL ALIAS 00 ", "MODEL ALIAS 00", "model-00"]
    undated = [(*rows[0][:5], None), *rows[1:]]
    with pytest.raises(SplitError, match="available_at"):
        sp.model_groups(models(spark, undated), by_time=True)
