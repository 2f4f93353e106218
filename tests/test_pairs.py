"""Near pairs in buckets over the limit, against all pairs compared in plain Python."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from split_data import queries
from switchyard.operators import deduplication as dd
from switchyard.plans.scratch import materialize

CONFIG = dd.DeduplicationConfig(max_bucket_size=4, max_candidate_pairs=1)


def _rows() -> list[tuple]:
    dice = random.Random(5)
    family = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(40):  # near copies of one text, that share its shingles
        words = list(family)
        for _ in range(dice.randrange(3)):
            words[dice.randrange(150)] = f"x{dice.randrange(9)}"
        texts.append(" ".join(words))
    for i in range(40):  # other texts with the same line
        texts.append(" ".join([f"o{i}n{k}" for k in range(dice.choice((5, 30)))] + family[:8]))
    texts += texts[:6] + [t.upper() for t in texts[:3]] + ["short one"] * 3
    return [(f"q{i:03d}", t, "t", "s", None, None, None, False) for i, t in enumerate(texts)]


def _truth(spark, rows) -> tuple[set, int]:
    sets = {r["query_id"]: set(r["hashes"]) for r in dd.shingled(queries(spark, rows)).collect()}
    near = {(a, b) for a, b in combinations(sorted(sets), 2) if set(sorted(sets[a])[:8]) & set(sorted(sets[b])[:8]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9}
    texts = {r[0]: " ".join(r[1].lower().split()) for r in rows}
    first = {}
    for q in sorted(texts):
        first.setdefault(texts[q], q)
    rep = {q: first[t] for q, t in texts.items()}
    return {(a, b) for a, b in near if rep[a] == a and (rep[b] == b or rep[b] == a)}, len(near)


def test_every_link_of_crowded_buckets_is_found(spark, monkeypatch):
    monkeypatch.setattr(dd, "BLOCK_ROWS", 7)
    rows = _rows()
    found, classes = dd.near_duplicate_pairs(queries(spark, rows), CONFIG)
    found = materialize(found, "found")
    truth, pairs = _truth(spark, rows)
    links = [(r["a"], r["b"]) for r in found.collect()]
    assert len(links) == len(set(links)) and set(links) == truth and len(truth) > 100
    assert dd.linked_pairs(found, classes) == pairs
    assert found.where(~F.col("similarity").between(0.9, 1.0)).isEmpty()


def test_copies_of_one_text_are_one_class(spark):
    rows = [(f"q{i:03d}", "all the same words here", "t", "s", None, None, None, False) for i in range(200)]
    result = dd.deduplicate_queries(queries(spark, rows), CONFIG)
    assert result.pairs.count() == 199 and result.pair_count == 199 * 100
    assert result.members.select("cluster_id").distinct().count() == 1
    assert {r["measure"]: r["value"] for r in dd.report_counts(result).collect()}["near_duplicate_pairs"] == 199 * 100
