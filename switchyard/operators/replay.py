"""Replay of a route log: regret, drift, budget pacing, bandits and probes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.operators.splits import running_before


def cumulative_regret(rows: DataFrame, order: list[str], regret: str = "regret") -> DataFrame:
    """Adds ``cumulative_regret`` along a total order; sums are taken in parallel over ranges."""
    walked = running_before(rows, order, regret, "_before")
    return walked.withColumn("cumulative_regret", F.col("_before") + F.col(regret)).drop("_before")


def sliding_regret(rows: DataFrame, stream: str, order: list[str], width: int, regret: str = "regret") -> DataFrame:
    """Adds ``sliding_regret``: the mean of the last ``width`` rows of a stream."""
    frame = Window.partitionBy(stream).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("sliding_regret", F.avg(regret).over(frame))


def selection_churn(rows: DataFrame, stream: str, order: list[str], model: str = "model_id") -> DataFrame:
    """``(stream, routes, switches, churn)``: how often a stream's choice differs from the one before."""
    before = F.lag(model).over(Window.partitionBy(stream).orderBy(*order))
    flagged = rows.select(stream, F.when(before.isNotNull() & (before != F.col(model)), 1).otherwise(0).alias("switched"))
    held = flagged.groupBy(stream).agg(F.count("*").alias("routes"), F.sum("switched").alias("switches"))
    return held.withColumn("churn", F.when(F.col("routes") > 1, F.col("switches") / (F.col("routes") - 1)).otherwise(F.lit(0.0)))


def adoption(rows: DataFrame, time: str, model: str = "model_id") -> DataFrame:
    """``(period, model, share)`` of each hour's routes."""
    counts = rows.groupBy(F.date_trunc("hour", time).alias("period"), model).agg(F.count("*").alias("n"))
    totals = counts.groupBy("period").agg(F.sum("n").alias("total"))
    return counts.join(totals, "period").select("period", model, (F.col("n") / F.col("total")).alias("share"))


def regret_half_life(rows: DataFrame, stream: str, order: list[str], regret: str = "regret") -> DataFrame:
    """``(stream, half_life)``: the place at which a stream has half of its regret behind it."""
    by = Window.partitionBy(stream).orderBy(*order)
    placed = rows.select(stream, F.row_number().over(by).alias("n"), F.sum(regret).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.sum(regret).over(Window.partitionBy(stream)).alias("total"))
    return placed.where(F.col("so_far") * 2 >= F.col("total")).groupBy(stream).agg(F.min("n").alias("half_life"))


def budget_violations(rows: DataFrame, period: Column, cost: str, budget: float) -> DataFrame:
    """Periods whose total cost exceeds the budget, with the excess."""
    spent = rows.groupBy(period.alias("period")).agg(F.sum(cost).alias("spent"))
    return spent.where(F.col("spent") > budget).withColumn("excess", F.col("spent") - budget)


def recovery_time(rows: DataFrame, stream: str, order: list[str], shock: int, level: float, width: int, regret: str = "regret") -> DataFrame:
    """``(stream, recovery)``: rows after the ``shock``-th until the sliding mean regret is at most ``level`` again."""
    by = Window.partitionBy(stream).orderBy(*order)
    placed = sliding_regret(rows, stream, order, width, regret).withColumn("n", F.row_number().over(by))
    return placed.where((F.col("n") > shock) & (F.col("sliding_regret") <= level)).groupBy(stream).agg((F.min("n") - shock).alias("recovery"))


def _pacer(target: float, eta: float, top: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, m, total = None, 0, 0.0, 0.0
        for batch in batches:
            numbers, path = [], []
            for stream, cost in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if stream != current:
                    current, n, m, total = stream, 0, 0.0, 0.0
                total += cost or 0.0
                m = min(top, max(0.0, m + eta * (total / (n + 1) / target - 1)))
                numbers.append(n)
                path.append(m)
                n += 1
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers, pa.int64()), pa.array(path, pa.float64())], [*names, "n", "multiplier"])

    return run


def budget_pacer(rows: DataFrame, stream: str, order: list[str], cost: str, target: float, eta: float = 0.1, top: float = 10.0) -> DataFrame:
    """``(stream, n, order, multiplier)``: clipped dual ascent on the running mean cost over its target.

    The recursion is sequential within a stream by definition; a stream is one
    budget.  Rows come sorted and only the state of one stream is held, so a
    stream may have any length.  A null cost spends nothing.  Rows without a
    stream are one stream.  ``order`` should be total within a stream.
    """
    chosen = rows.select(stream, *order, F.col(cost).cast("double").alias("_cost"))
    ordered = chosen.repartition(stream).sortWithinPartitions(stream, *order)
    shape = T.StructType([*chosen.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("multiplier", T.DoubleType())])
    return ordered.mapInArrow(_pacer(target, eta, top), shape).select(stream, "n", *order, "multiplier")


def _uniform(*parts: object) -> float:
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


def _linucb(choices: list[str], width: int, alpha: float, gamma: float, forced: int, ridge: float = 1.0):
    """Discounted linear bandits of sorted streams: ridge statistics for each stream and model.

    The streams of a batch take their steps together; of the batches before,
    only the state of the stream that goes on is held.
    """

    def fresh(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.tile(ridge * np.eye(width), (n, len(choices), 1, 1)), np.zeros((n, len(choices), width)), np.zeros((n, len(choices)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            starts = np.array([k for k in range(len(names)) if not k or names[k] != names[k - 1]])
            lengths = np.diff([*starts, len(names)])
            a, b, tries = fresh(len(starts))
            n = np.arange(len(names)) - np.repeat(starts, lengths)
            if state is not None and names[0] == last:
                a[0], b[0], tries[0] = state
                n[: lengths[0]] += done
            logged = np.array([choices.index(m) if m in choices else -1 for m in batch.column(1).to_pylist()])
            reward = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.stack([np.ones(len(names)), *(batch.column(3 + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(width - 1))], axis=1)
            picks = np.zeros(len(names), np.int64)
            for step in range(lengths.max()):
                live = np.flatnonzero(lengths > step)
                at = starts[live] + step
                now = np.broadcast_to(x[at][:, None, :], (len(at), len(choices), width))
                solved = np.linalg.solve(a[live], np.stack([b[live], now], axis=-1))
                score = (now * solved[..., 0]).sum(axis=-1) + alpha * np.sqrt(np.maximum(0.0, (now * solved[..., 1]).sum(axis=-1)))
                # an unknown score wins over none, and none over the first
                score[:, 1:] = np.where(np.isnan(score[:, 1:]), -np.inf, score[:, 1:])
                score[:, 0] = np.where(np.isnan(score[:, 0]), np.inf, score[:, 0])
                short = tries[live] < forced
                pick = np.where(short.any(axis=1), short.argmax(axis=1), score.argmax(axis=1))
                picks[at] = pick
                agree = pick == logged[at]
                who, model, seen = live[agree], pick[agree], x[at[agree]]
                a[who, model] = gamma * a[who, model] + seen[:, :, None] * seen[:, None, :]
                b[who, model] = gamma * b[who, model] + reward[at[agree]][:, None] * seen
                tries[who, model] += 1
            last, state, done = names[-1], (a[-1], b[-1], tries[-1]), int(n[-1]) + 1
            used = picks == logged
            chosen = pa.array([choices[k] for k in picks], pa.string())
            told = pa.array(reward, pa.float64(), mask=~used | np.isnan(reward))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(1), chosen, told, pa.array(used)], [batch.schema.names[0], "n", "model_id", "chosen", "reward", "used"])

    return run


def bandit_replay(rows: DataFrame, stream: str, order: list[str], models: list[str], features: list[str], policy: str = "linucb", alpha: float = 0.5, gamma: float = 1.0, epsilon: float = 0.1, forced: int = 0, seed: int = 0) -> DataFrame:
    """``(stream, n, model_id, chosen, reward, used)``: replay of logged routes, learning only from agreeing rows.

    ``rows`` log one model and reward each.  The policy chooses among
    ``models``; where it agrees with the log, the reward is revealed and learned.
    ``forced`` pulls of every model come first.  Policies: ``linucb`` (gamma
    under one discounts), ``epsilon_greedy``, ``thompson`` (Beta-Bernoulli).
    A stream is sequential by definition and runs in one task; streams run in
    parallel, and those of ``linucb`` in step.  Chance comes from hashes, so a retried task repeats itself.
    """
    choices = sorted(models)
    kind = dict(rows.dtypes)[stream]
    shape = f"{stream} {kind}, n long, model_id string, chosen string, reward double, used boolean"
    if policy == "linucb":
        ordered = rows.repartition(stream).sortWithinPartitions(stream, *(F.asc_nulls_last(c) for c in order))
        return ordered.select(stream, "model_id", "reward", *features).mapInArrow(_linucb(choices, len(features) + 1, alpha, gamma, forced), shape)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        wins, tries = dict.fromkeys(choices, 0.0), dict.fromkeys(choices, 0)
        out = []
        for n, row in enumerate(frame.itertuples(index=False)):
            name = getattr(row, stream)
            short = [m for m in choices if tries[m] < forced]
            if short:
                pick = short[0]
            elif policy == "thompson":
                rng = np.random.default_rng(int(_uniform(seed, name, n) * 2**52))
                draws = {m: rng.beta(1 + wins[m], 1 + tries[m] - wins[m]) for m in choices}
                pick = max(choices, key=draws.__getitem__)
            elif _uniform(seed, name, n) < epsilon:
                pick = choices[int(_uniform(seed, name, n, "pick") * len(choices))]
            else:
                pick = max(choices, key=lambda m: (wins[m] / tries[m] if tries[m] else 1.0, -choices.index(m)))
            used = pick == row.model_id
            if used:
                tries[pick] += 1
                wins[pick] += min(1.0, max(0.0, row.reward))
            out.append((name, n, row.model_id, pick, float(row.reward) if used else None, used))
        return pd.DataFrame(out, columns=[stream, "n", "model_id", "chosen", "reward", "used"])

    return rows.groupBy(stream).applyInPandas(one, shape)


def replay_events(requests: DataFrame, events: DataFrame, stream: str, time: str) -> DataFrame:
    """Requests with the latest event of their stream that began before them (an as-of join)."""
    from switchyard.operators.routing import price_asof

    return price_asof(requests, events, time, key=stream, start="begins_at")


def probe_profiles(outcomes: DataFrame, probes: DataFrame, models: DataFrame) -> DataFrame:
    """``(model_id, scores, log_tokens, latencies, missing)``: a vector over all probes, in the order of their ids.

    Probes are a set of at most some hundreds, chosen beforehand; every model
    has a row, with null where it has no outcome.
    """
    grid = models.select("model_id").crossJoin(F.broadcast(probes.select("query_id").distinct()))
    held = grid.join(outcomes.select("model_id", "query_id", "score", "output_tokens", "latency"), ["model_id", "query_id"], "left")
    cells = F.array_sort(F.collect_list(F.struct("query_id", "score", F.log1p("output_tokens").alias("t"), "latency")))
    rows = held.groupBy("model_id").agg(cells.alias("c"))
    return rows.select(
        "model_id",
        F.transform("c", lambda x: x["score"]).alias("scores"),
        F.transform("c", lambda x: x["t"]).alias("log_tokens"),
        F.transform("c", lambda x: x["latency"]).alias("latencies"),
        F.transform("c", lambda x: x["score"].isNull()).alias("missing"),
    )


def random_probes(queries: DataFrame, n: int, seed: int = 0, key: str = "query_id") -> DataFrame:
    """``n`` queries of the smallest hash."""
    return queries.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(n).drop("_h")


def stratified_probes(queries: DataFrame, stratum: str, each: int, seed: int = 0, key: str = "query_id") -> DataFrame:
    """``each`` queries of every stratum, by hash; a task keeps its smallest before strata meet."""
    hashed = queries.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256))
    order = Window.partitionBy(stratum, "_salt").orderBy("_h", key)
    some = hashed.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(32))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each)
    final = Window.partitionBy(stratum).orderBy("_h", key)
    return some.withColumn("_n", F.row_number().over(final)).where(F.col("_n") <= each).drop("_h", "_salt", "_n")


def active_probes(outcomes: DataFrame, n: int) -> DataFrame:
    """The ``n`` queries on which models disagree most, by the variance of their scores."""
    spread = outcomes.groupBy("query_id").agg(F.round(F.var_pop("score"), 9).alias("spread"))
    return spread.orderBy(F.desc("spread"), "query_id").limit(n)


def _squared_distance(vector: Column, other: list[float]) -> Column:
    target = F.array(*map(F.lit, other))
    return F.aggregate(F.zip_with(vector, target, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)


def _farthest(picked: list[list[float]]):
    """The row of each task that is farthest from the nearest of the picked points, the smaller id of equals."""
    centres = np.array(picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            points = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(ids), -1)
            far = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
            at = int(np.lexsort((ids, -far))[0])
            if best is None or (-far[at], ids[at]) < best[:2]:
                best = (-float(far[at]), int(ids[at]), points[at].tolist())
        if best and best[0] < 0:
            yield pa.RecordBatch.from_arrays([pa.array([best[1]], pa.int64()), pa.array([best[2]], pa.list_(pa.float64())), pa.array([-best[0]], pa.float64())], ["id", "v", "far"])

    return run


def farthest_point_probes(vectors: DataFrame, n: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(place, id)``: greedy farthest points, from the smallest id; ties go to the smaller id.

    Each of ``n`` passes reads the vectors once and brings a row a task
    together; nothing is written or shuffled but those.  Fewer places come back
    where all other rows equal a picked one.  Null ids and vectors take no part.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    chosen, picked = rows.orderBy("id").first(), []
    while chosen is not None and len(picked) < n:
        picked.append((chosen["id"], list(chosen["v"])))
        chosen = rows.mapInArrow(_farthest([v for _, v in picked]), "id long, v array<double>, far double").orderBy(F.desc("far"), "id").first()
    return spark.createDataFrame([(place, i) for place, (i, _) in enumerate(picked)], "place int, id long")


def medoid_probes(vectors: DataFrame, k: int, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(cluster, id)``: the row nearest to each centre of a k-means clustering."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("features", array_to_vector("v"))
    model = KMeans(k=k, seed=seed).fit(rows)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    distance = F.coalesce(*(F.when(F.col("prediction") == i, _squared_distance(F.col("v"), c)) for i, c in enumerate(centres)))
    near = model.transform(rows).select(F.col("prediction").alias("cluster"), "id", distance.alias("d"))
    return near.groupBy("cluster").agg(F.min_by("id", F.struct("d", "id")).alias("id"))
