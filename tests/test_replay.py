"""Replays against second implementations, streams, and plans that go by ranges or blocks."""

from __future__ import annotations

import hashlib
import math
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchyard.errors import DeduplicationError
from switchyard.functions import text as tx
from switchyard.operators import deduplication as dd
from switchyard.operators import metrics as mt
from switchyard.operators import replay as rp
from switchyard.operators import routing as ro


def _pace(costs: list[float | None], target: float, eta: float, top: float) -> list[float]:
    out: list[float] = []
    for n in range(len(costs)):
        mean = sum(c or 0.0 for c in costs[: n + 1]) / (n + 1)
        out.append(min(top, max(0.0, (out[-1] if out else 0.0) + eta * (mean / target - 1))))
    return out


def test_pacing(spark):
    rng = random.Random(3)
    rows = [(s, i, None if rng.random() < 0.1 else rng.random() * 4) for s in (1, 2, 3) for i in range(40 * s)]
    table = spark.createDataFrame(rows, "stream int, at int, cost double").withColumn("n", F.lit("x")).repartition(7)
    got: dict[int, list[float]] = {}
    for r in rp.budget_pacer(table, "stream", ["at"], "cost", 1.5).orderBy("stream", "n").collect():
        assert r["at"] == r["n"]
        got.setdefault(r["stream"], []).append(r["multiplier"])
    assert {s: pytest.approx(path, abs=1e-9) for s, path in got.items()} == {s: _pace([c for x, _, c in rows if x == s], 1.5, 0.1, 10.0) for s in (1, 2, 3)}
    assert rp.budget_pacer(table.limit(0), "stream", ["at"], "cost", 1.5).isEmpty()


def _uniform(*parts) -> float:
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


def _replayed(rows: list[tuple], policy: str, forced: int, gamma: float) -> list[tuple]:
    """Chosen model and revealed reward of one stream's rows (model, reward, feature), from sums over the whole past."""
    past: list[tuple] = []  # (model, reward, x)
    out = []
    for n, (model, reward, feature) in enumerate(rows):
        x = np.array([1.0, feature])
        mine = {m: [p for p in past if p[0] == m] for m in ("a", "b", "c")}
        score: dict[str, float] = {}
        for m, held in mine.items():
            wins = sum(min(1.0, max(0.0, r)) for _, r, _ in held)
            if policy == "linucb":
                age = range(len(held) - 1, -1, -1)
                inverse = np.linalg.inv(gamma ** len(held) * np.eye(2) + sum((gamma**k * np.outer(p[2], p[2]) for k, p in zip(age, held, strict=True)), np.zeros((2, 2))))
                theta = inverse @ sum((gamma**k * p[1] * p[2] for k, p in zip(age, held, strict=True)), np.zeros(2))
                score[m] = round(float(theta @ x + 0.5 * math.sqrt(x @ inverse @ x)), 12)
            elif policy == "epsilon_greedy":
                score[m] = wins / len(held) if held else 1.0
        short = [m for m in mine if len(mine[m]) < forced]
        if short:
            pick = short[0]
        elif policy == "thompson":
            rng = np.random.default_rng(int(_uniform(0, 7, n) * 2**52))
            draws = [rng.beta(1 + sum(min(1.0, max(0.0, r)) for _, r, _ in mine[m]), 1 + len(mine[m]) - sum(min(1.0, max(0.0, r)) for _, r, _ in mine[m])) for m in mine]
            pick = "abc"[int(np.argmax(draws))]
        elif policy == "epsilon_greedy" and _uniform(0, 7, n) < 0.1:
            pick = "abc"[int(_uniform(0, 7, n, "pick") * 3)]
        else:
            pick = max(score, key=lambda m: (score[m], -ord(m)))
        if pick == model:
            past.append((model, reward, x))
        out.append((n, pick, reward if pick == model else None))
    return out


@pytest.mark.parametrize(("policy", "forced", "gamma"), [("linucb", 0, 1.0), ("linucb", 1, 0.9), ("epsilon_greedy", 0, 1.0), ("thompson", 2, 1.0)])
def test_bandits(spark, policy, forced, gamma):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), rng.random(), rng.random()) for _ in range(120)]
    table = spark.createDataFrame([(7, i, *r) for i, r in enumerate(rows)], "stream int, at int, model_id string, reward double, feature double").repartition(5)
    got = rp.bandit_replay(table, "stream", ["at"], ["a", "b", "c"], ["feature"], policy=policy, forced=forced, gamma=gamma).orderBy("n").collect()
    assert [(r["n"], r["chosen"], r["reward"]) for r in got] == _replayed(rows, policy, forced, gamma)
    assert [r["model_id"] for r in got] == [m for m, *_ in rows] and any(r["used"] for r in got)


def test_probes(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 6))
    vectors[50:60] = vectors[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, [0.0] * 6), (900, None)], "vec_id long, embedding array<double>").repartition(6)
    picked = [0]
    while len(picked) < 12:
        far = ((vectors[:, None, :] - vectors[picked][None, :, :]) ** 2).sum(axis=2).min(axis=1)
        picked.append(int(np.lexsort((np.arange(300), -far))[0]))
    got = rp.farthest_point_probes(table, 12).orderBy("place").collect()
    assert [r["id"] for r in got] == picked
    assert rp.farthest_point_probes(table.where("vec_id between 50 and 59"), 4).count() == 1
    medoids = rp.medoid_probes(table.where("vec_id < 300"), 5).collect()
    assert len({r["cluster"] for r in medoids}) == len(medoids) == 5 and all(0 <= r["id"] < 300 for r in medoids)


def test_events_and_recovery(spark):
    rows = spark.createDataFrame([(1, i, 900.0 if 3 <= i < 6 else 100.0) for i in range(12)], "stream int, at int, regret double")
    assert rp.recovery_time(rows, "stream", ["at"], 6, 200.0, 2).collect() == [(1, 2)]
    events = spark.createDataFrame([(1, 4, "shock"), (1, 8, "over")], "stream int, begins_at int, event string")
    assert [r["event"] for r in rp.replay_events(rows, events, "stream", "at").orderBy("at").collect()] == [None] * 4 + ["shock"] * 4 + ["over"] * 4


def test_ranks_of_many_scores(spark):
    rng = np.random.default_rng(6)
    label, score = rng.integers(0, 2, 3000), rng.random(3000)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, score, strict=True)], "label int, score double").repartition(6)
    order = np.argsort(-score)
    hits = np.cumsum(label[order])
    assert mt.auprc(rows).first()[0] == pytest.approx(float((label[order] * hits / np.arange(1, 3001)).sum() / label.sum()))
    wins = (score[label == 1][:, None] > score[label == 0][None, :]).mean()
    assert mt.auroc(rows).first()[0] == pytest.approx(wins) and mt.pairwise_ranking_loss(rows).first()[0] == pytest.approx(1 - wins)
    ranks = np.argsort(np.argsort(score))
    assert mt.spearman(rows, "label", "score").first()[0] == pytest.approx(float(np.corrcoef(np.where(label == 1, 1.0, 0.0), ranks)[0, 1]))
    interval = mt.confidence_interval(spark.createDataFrame([(float(i),) for i in range(101)], "mean double"), 0.9).first()
    assert tuple(interval) == pytest.approx((5.0, 50.0, 95.0))


def test_frontier_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = np.round(rng.random((600, 3)), 1)
    angle = rng.random(200) * math.pi / 2  # many that nothing beats
    points = np.concatenate([points, np.stack([np.cos(angle), 2 + np.cos(angle), np.sin(angle)], axis=1)])
    better = (points[None, :, 0] <= points[:, None, 0]) & (points[None, :, 1] >= points[:, None, 1]) & (points[None, :, 2] <= points[:, None, 2])
    strictly = (points[None, :, 0] < points[:, None, 0]) | (points[None, :, 1] > points[:, None, 1]) | (points[None, :, 2] < points[:, None, 2])
    want = {int(i) for i in np.flatnonzero(~(better & strictly).any(axis=1))}
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, cost double, quality double, latency double").repartition(5)
    monkeypatch.setattr(ro, "SKYLINE_BLOCK", 37)
    assert {r["id"] for r in ro.pareto_frontier_3d(table).collect()} == want and len(want) > 74
    assert ro.pareto_frontier_3d(table.limit(0)).isEmpty()


def test_times_do_not_follow_the_session(spark):
    moments = [datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 3, 10, 7, 30, 5, 120, timezone.utc), datetime(1969, 12, 31, 23, 59, 59, 999999, timezone.utc)]
    table = spark.createDataFrame([(m,) for m in moments], "t timestamp")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(r[0] for r in table.select(tx.isoformat("t")).collect()) == sorted(m.isoformat() for m in moments)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_folding_and_names(spark, monkeypatch):
    texts = ["ﬁne Ａbc ΣΑΣ", "Plain ASCII  text", "Straße", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(tx.normalize_prompt("t")).collect()] == ["fine abc σασ", "plain ascii text", "strasse", None]
    with pytest.raises(DeduplicationError, match="normalization_version"):
        dd.DeduplicationConfig(exact_folding=False).validate()
    numbers = spark.createDataFrame([("0" * 16,), ("7fffffffffffffff",), ("8000000000000000",), ("f" * 16,), ("00000000deadbeef",)], "h string").select("h", tx.hash_number("h").alias("n"))
    assert [r["h"] for r in numbers.orderBy("n").collect()] == sorted(r["h"] for r in numbers.collect())
    assert all(r["h"] == r["d"] for r in numbers.select("h", tx.hash_digits("n").alias("d")).collect())
    members = spark.createDataFrame([("g", f"q{i:03d}") for i in range(60)] + [("h", "x"), ("k", "é")], "root string, query_id string").repartition(5)
    gathered = {tuple(r) for r in dd.named_groups(members, "root", "query_id", "dup", "name").collect()}
    monkeypatch.setattr(dd, "GATHERED", 10)
    assert {tuple(r) for r in dd.named_groups(members, "root", "query_id", "dup", "name").collect()} == gathered and len(gathered) == 62


def test_sessions_and_feedback(spark, tmp_path):
    from switchyard.streaming.routes import user_sessions, with_feedback

    def moment(minute: int) -> datetime:
        return datetime(2025, 1, 1, minute // 60, minute % 60, tzinfo=timezone.utc)

    spark.createDataFrame([(i, moment(m), s) for i, (m, s) in enumerate([(0, "a"), (10, "a"), (70, "a"), (5, "b"), (300, "z")])], "route_id long, event_time timestamp, stream string").coalesce(1).write.parquet(f"{tmp_path}/routes")
    spark.createDataFrame([(0, moment(20), 1.0), (1, moment(200), 0.5), (3, moment(6), 0.0), (4, moment(301), 1.0)], "route_id long, feedback_received_at timestamp, score double").coalesce(1).write.parquet(f"{tmp_path}/feedback")
    routes, feedback = (spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}") for n in ("routes", "feedback"))

    def ran(frame, name: str) -> list:
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    # what the watermark of the last row has closed
    assert sorted((r["stream"], r["routes"]) for r in ran(user_sessions(routes), "sessions")) == [("a", 1), ("a", 2), ("b", 1)]
    got = {r["route_id"]: r["score"] for r in ran(with_feedback(routes, feedback), "joined")}
    assert got == {0: 1.0, 1: None, 2: None, 3: 0.0, 4: 1.0}


def test_streams_of_linucb_step_together(monkeypatch):
    """Streams in step, cut by batches anywhere, choose as each alone; steps are as many as the longest part has rows."""
    import pyarrow as pa

    rng = random.Random(3)
    streams = {s: [(rng.choice("abcd"), rng.random(), rng.random()) for _ in range(rng.randrange(1, 40))] for s in range(30)}
    rows = [(s, *r) for s, held in streams.items() for r in held]
    table = pa.table({"stream": [r[0] for r in rows], "model_id": [r[1] for r in rows], "reward": [r[2] for r in rows], "feature": [r[3] for r in rows]})
    calls, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: calls.append(1) or solve(*a))
    for size in (17, len(rows)):
        calls.clear()
        out = pa.Table.from_batches(list(rp._linucb(["a", "b", "c"], 2, 0.5, 1.0, 0)(table.to_batches(max_chunksize=size)))).to_pylist()
        for s, held in streams.items():
            assert [(r["n"], r["chosen"], r["reward"]) for r in out if r["stream"] == s] == _replayed(held, "linucb", 0, 1.0)
    assert len(calls) == max(map(len, streams.values()))
