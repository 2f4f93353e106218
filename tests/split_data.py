"""Thirty queries with every kind of duplicate evidence, two probes, twelve models."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from switchyard.operators.deduplication import QUERY_SCHEMA
from switchyard.operators.splits import MODEL_SCHEMA

START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def query_rows() -> list[tuple]:
    prompts = {i: " ".join(f"unique{i}token{k}" for k in range(8)) for i in range(30)}
    prompts[0] = prompts[1] = "Exactly duplicated prompt"
    prompts[2], prompts[3] = "Normalized  Prompt\nhere", "normalized prompt here"
    words = " ".join(f"shared{k}" for k in range(24))
    prompts[4], prompts[5] = words, words + " please"
    rows = []
    for i in range(30):
        rows.append((f"q-{i:02d}", prompts[i], f"task-{i // 3:02d}", "synthetic", "pair" if i in (6, 7) else None, "line" if i in (8, 9) else None, START + timedelta(days=i), False))
    rows.append(("probe-00", "Probe prompt text", "task-probe", "synthetic", None, None, START + timedelta(days=40), True))
    rows.append(("probe-copy", "probe  PROMPT text", "task-probe", "synthetic", None, None, START + timedelta(days=41), False))
    return rows


def model_rows() -> list[tuple]:
    first = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return [(f"model-{i:02d}", f"provider-{i % 2}", f"family-{i // 2:02d}", f"v{i + 1}", [f"MODEL ALIAS {i:02d}", f"api/model-{i:02d}"], first + timedelta(days=30 * i)) for i in range(12)]


def queries(spark, rows=None):
    return spark.createDataFrame(rows or query_rows(), QUERY_SCHEMA)


def models(spark, rows=None):
    return spark.createDataFrame(rows or model_rows(), MODEL_SCHEMA)
