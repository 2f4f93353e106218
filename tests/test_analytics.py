from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchyard.operators import metrics as mt
from switchyard.operators import replay as rp
from switchyard.operators import routing as ro
from switchyard.operators.graph import connected_components


def test_components(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (5, 5), (None, 4), (8, 9)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["component"] for r in connected_components(path, "a", "b").collect()} == {0}
    assert connected_components(edges.limit(0), "a", "b").isEmpty()


def test_price_asof(spark):
    prices = spark.createDataFrame([("m", 10, 1.0), ("m", 20, 2.0)], "model_id string, effective_at long, p double")
    rows = spark.createDataFrame([(1, "m", 9), (2, "m", 10), (3, "m", 19), (4, "m", 20), (5, "x", 30)], "id long, model_id string, t long")
    assert {r["id"]: r["p"] for r in ro.price_asof(rows, prices, "t").collect()} == {1: None, 2: 1.0, 3: 1.0, 4: 2.0, 5: None}


def test_rank_metrics(spark):
    rng = np.random.default_rng(2)
    label, score = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, score, strict=True)], "label int, score double")
    wins = np.mean([(p > n) + 0.5 * (p == n) for p in score[label == 1] for n in score[label == 0]])
    assert mt.auroc(rows).first()[0] == pytest.approx(wins)
    assert mt.spearman(rows, "score", "score").first()[0] == pytest.approx(1.0)


def test_frontier(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0, 9.0), (2, 2.0, 0.5, 1.0), (3, 2.0, 3.0, 9.0), (4, 3.0, 3.0, 9.0), (5, 2.0, 3.0, 9.0)], "id int, cost double, quality double, latency double")
    assert {r["id"] for r in ro.pareto_frontier(points).collect()} == {1, 3, 5}
    assert {r["id"] for r in ro.pareto_frontier_3d(points).collect()} == {1, 2, 3, 5}


def _paced(costs: list[float]) -> list[float]:
    out, total = [0.0], 0.0
    for n, cost in enumerate(costs):
        total += cost
        out.append(min(10.0, max(0.0, out[-1] + 0.1 * (total / (n + 1) / 40.0 - 1))))
    return out[1:]


def test_every_stream_is_paced(spark):
    from switchyard.plans import registry, views

    folder = "/root/testdata/sf0.001"
    streams: dict[int, list] = {}
    for r in views.routes(spark, folder).orderBy("stream", "event_time", "route_id").collect():
        streams.setdefault(r["stream"], []).append((r["route_id"], float(r["k"])))
    got = {(r["stream"], r["n"]): (r["route_id"], r["multiplier"]) for r in registry.queries()["budget_pacer"](spark, folder).collect()}
    want = {(s, n): (held[n][0], m) for s, held in streams.items() for n, m in enumerate(_paced([k for _, k in held]))}
    assert got.keys() == want.keys() and any(s % 10 for s, _ in got)
    assert all(got[at][0] == want[at][0] and got[at][1] == pytest.approx(want[at][1], abs=1e-6) for at in want)


def test_streaming_route_log(spark, tmp_path):
    from switchyard.streaming.routes import deduplicated, model_windows

    rows = spark.createDataFrame([(1, "2025-01-01 00:05:00", "a", 1.0, 0.1), (1, "2025-01-01 00:05:00", "a", 1.0, 0.1), (2, "2025-01-01 01:10:00", "b", 0.0, 0.2)], "route_id long, t string, model_id string, reward double, cost double")
    rows.select("route_id", F.to_timestamp("t").alias("event_time"), "model_id", "reward", "cost").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = deduplicated(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("once").count() == 2
    batch = model_windows(spark.read.parquet(str(tmp_path / "in")))
    assert {(r["model_id"], r["routes"]) for r in batch.collect()} == {("a", 2), ("b", 1)}


def test_registry_is_consistent():
    from switchyard.plans import registry

    assert registry.oracle_sql().keys() <= registry.queries().keys()
