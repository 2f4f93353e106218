"""Operators that compare rows: against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from switchyard.llm.curves import hilbert_keys, nearest_neighbours
from switchyard.llm.exact_dedup import bloom_shards, exact_duplicates
from switchyard.llm.near_dedup import near_duplicates
from switchyard.llm.packing import pack_documents, pack_pieces, plan_packing, sequences
from switchyard.llm.shingles import shingle_set
from switchyard.llm.tokens import token_pieces
from switchyard.llm.toxicity import ExampleIndex, score_toxicity

WORDS = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [29, 16])
def test_exact_duplicates(spark, bits):
    rows = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (6, ""), (None, "ab"), (7, "x" * 100_000), *((i, "hot") for i in range(100, 400)), *((i, f"single {i}") for i in range(400, 12_000))]
    assert bloom_shards(len(rows), bits) == (1 if bits == 29 else 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).repartition(5)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_duplicates(docs, max_log2_bits=bits).collect())
    groups: dict[str, list] = {}
    for i, text in rows:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(key, []).append(i)
    want = Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep) for i in ids)
    assert got == want
    assert exact_duplicates(docs.limit(0)).isEmpty()


def _shingles(text: str | None) -> set[tuple[str, ...]]:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def _components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(i, _shingles(t)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def root(i: int) -> int:
        while low[i] != i:
            i = low[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                low[y] = x
    return {i: root(i) for i, _ in rows}


def _near_rows() -> list[tuple[int, str | None]]:
    rng = random.Random(8)
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "one two three")]

    def text(n: int) -> list[str]:
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    for base in range(12):
        words = text(rng.choice([6, 30, 120, 400]))
        for _ in range(rng.choice([1, 3, 40])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, len(words) // 25])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    shared = text(40)
    rows += [(len(rows) + i, " ".join(shared + text(60))) for i in range(80)]  # a passage in common, no copies
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = _near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("x")).repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    want = _components(rows)
    assert got == {i: (len(_shingles(t)), want[i], want[i] == i) for i, t in rows}


def test_near_duplicates_of_single_members_of_large_groups(spark):
    """A hub whose copies are unlike each other, and texts that only one member of a tight group is near to."""
    rng = random.Random(3)

    def word() -> str:
        return f"w{rng.randrange(10**6)}"

    def edited(words: list[str], times: int) -> list[str]:
        copy = list(words)
        for at in rng.sample(range(2, len(words) - 3), times):
            copy[at] = word()
        return copy

    hub, core = [word() for _ in range(200)], [word() for _ in range(200)]
    tight = [edited(core, 2) for _ in range(250)]
    texts = [hub, *(edited(hub, 5) for _ in range(250)), *tight, *(edited(tight[7 * i], 4 + i % 2) for i in range(30))]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == _components(rows)


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(docs.limit(0)).isEmpty()


def test_words_that_fool_polynomials_modulo_a_power_of_two(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64 under any base."""
    first = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    second = first.translate(str.maketrans("ab", "ba"))
    rows = [(1, first), (2, second), (3, f"{first} {second} x y z u v w"), (4, f"{second} {first} x y z u v w"), (5, first)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == _components(rows)


def test_shingle_hashes_follow_words():
    assert len(shingle_set(b"a b c d e f a b c d e f")) == len(_shingles("a b c d e f a b c d e f"))
    assert (shingle_set(b"A  b\tc d E") == shingle_set(b"a b c d e")).all()
    assert len(shingle_set(None)) == len(shingle_set(b" \r\n")) == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25))
def test_packing_plan(histogram):
    plan = plan_packing(histogram, 64)
    placed = Counter()
    for items, number in plan:
        assert sum(items) <= 64 and number > 0
        for length in items:
            placed[length] += number
    assert placed == Counter(histogram)
    # no worse than first fit, longest first
    bins: list[int] = []
    for length in sorted(Counter(histogram).elements(), reverse=True):
        for i, room in enumerate(bins):
            if room >= length:
                bins[i] -= length
                break
        else:
            bins.append(64 - length)
    assert sum(n for _, n in plan) <= len(bins) + max(1, len(bins) // 8)


def test_packing_documents(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [None, "", "a", *(" ".join(rng.choice(["tree", "house", "walks", "zq"]) for _ in range(rng.randrange(60))) for _ in range(300)), "long " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("offset", F.lit(1))
    pieces = token_pieces(docs, WORDS, 64, with_ids=True).persist()
    rows = pack_pieces(pieces, 64).collect()
    library = Tokenizer.from_file(WORDS)
    by_doc: dict[int, list] = {}
    spans: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in got] == list(range(0, len(ids), 64))
        for r in got:
            raw = np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert bytes(r["ids"]) == raw and r["ids_crc32"] == zlib.crc32(raw)
    for held in spans.values():
        at = 0
        for offset, length, _ in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(spans) <= -(-sum(r["length"] for r in rows) // 64) + 2
    whole = sequences(pack_pieces(pieces, 64)).collect()
    assert sorted(bytes(r["ids"]) for r in whole) == sorted(b"".join(x for _, _, x in sorted(h)) for h in spans.values())
    assert pack_documents(docs.limit(0), WORDS).isEmpty()


def test_hilbert_curve_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(10)
    vectors = rng.standard_normal((1500, 24)).astype(np.float32)
    vectors[:400] = vectors[0]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0] * 23 + [None]), (None, [1.0] * 24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got: dict[int, list] = {}
    for r in nearest_neighbours(table, F.col("vec_id") % 100 == 0, block=128).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    exact = vectors.astype(np.float64)
    hits = total = 0
    for q in range(0, 1500, 100):
        distance = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(1500), distance)) if i != q][:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(distance[i], abs=1e-12) for i, s in got[q])
        mark = distance[order[-1]]
        hits, total = hits + sum(s <= mark + 1e-12 for _, s in got[q]), total + 10
    assert hits / total >= 0.9 and got.keys() == set(range(0, 1500, 100))
    few = nearest_neighbours(table.where("vec_id between 998 and 1003"), F.col("vec_id") == 1000).collect()
    assert len(few) == 5
    assert nearest_neighbours(table.limit(0), F.col("vec_id") % 100 == 0).isEmpty()


def test_window_search_finds_most_and_compares_few(spark):
    """Vectors near a surface of 5 dimensions in 32: windows of 40 of 6,000 rows, so a tenth of brute force, and a bound that blind windows miss."""
    rng = np.random.default_rng(19)
    vectors = (rng.standard_normal((6000, 5)) @ rng.standard_normal((5, 32)) + 0.01 * rng.standard_normal((6000, 32))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    want = _brute_neighbours(vectors, list(range(0, 6000, 100)))

    def recall(**settings) -> float:
        found = {(r["query_id"], r["vec_id"]) for r in nearest_neighbours(table, F.col("vec_id") % 100 == 0, **settings).collect()}
        return sum((q, i) in found for q, near in want.items() for i in near) / 600

    assert recall(curves=8, window=40) >= 0.9
    assert recall(curves=1, window=10) < 0.7


def _brute_neighbours(vectors: np.ndarray, queries: list[int], k: int = 10) -> dict[int, list[int]]:
    exact, ids = vectors.astype(np.float64), np.arange(len(vectors))
    return {q: [int(i) for i in np.lexsort((ids, np.sqrt(((exact - exact[q]) ** 2).sum(axis=1)))) if i != q][:k] for q in queries}


def test_ties_of_neighbours_go_to_the_smaller_id(spark):
    def found(vectors: np.ndarray, **settings) -> dict[int, list[int]]:
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
        got: dict[int, list[int]] = {}
        for r in nearest_neighbours(table, F.col("vec_id") % 100 == 0, **settings).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        return got

    rng = np.random.default_rng(14)
    copies = rng.standard_normal((1500, 24)).astype(np.float32)
    copies[100:800] = copies[100]  # more than a window and several blocks hold
    got = found(copies, block=128)
    assert {q: got[q] for q in range(100, 800, 100)} == _brute_neighbours(copies, list(range(100, 800, 100)))
    # equally far rows that are no copies, twice each so that a query sees 96 ties, in one window
    ties = (rng.integers(-50, 50, (600, 24)) * 4).astype(np.float32)
    ties[300] = 1
    for i in range(48):
        step = np.ones(24)
        step[i % 24] += 1 if i < 24 else -1
        ties[599 - i], ties[299 - i] = step, step
    ties[200:203] = ties[599]
    assert found(ties, window=600) == _brute_neighbours(ties, list(range(0, 600, 100)))


def test_block_search_is_exact():
    rng = np.random.default_rng(11)
    examples = []
    for i in range(700):
        terms = sorted(rng.choice(40, rng.integers(0, 6), replace=False).tolist())
        examples.append((i, int(rng.random() < 0.3), terms, rng.integers(1, 4, len(terms)).tolist()))
    index = ExampleIndex(examples, rng.random(40) * 3 + 0.1)
    for _, _, terms, counts in examples[:200]:
        if not terms:
            continue
        query = index.weights(terms, counts)
        scored = []
        for i, y, t, c in examples:
            weights = dict(zip(t, index.weights(t, c), strict=True))
            cosine = round(float(sum(q * weights.get(k, 0.0) for k, q in zip(terms, query, strict=True))), 12)
            if cosine > 0:
                scored.append((-cosine, i, y))
        want = [(-c, i, y) for c, i, y in sorted(scored)[:15]]
        got = index.nearest(terms, query, 15)
        assert [c for c, *_ in got] == pytest.approx([c for c, *_ in want], abs=1e-9)
        assert {i for c, i, _ in got if c > want[-1][0] + 1e-9} == {i for c, i, _ in want if c > want[-1][0] + 1e-9}


def test_toxicity(spark):
    rng = random.Random(12)
    calm, rude = [f"word{i}" for i in range(60)], ["grobber", "grobbing", "vilest"]
    rows, labels = [], []
    for i in range(400):
        toxic = rng.random() < 0.2
        words = [rng.choice(calm) for _ in range(rng.randint(5, 60))] + ([rng.choice(rude) for _ in range(rng.randint(1, 3))] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "vilest grobber"), (902, "grobbers")], "doc_id long, text string").withColumn("terms", F.lit(0))
    known = spark.createDataFrame([x for x in labels if x[0] % 4] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, known).collect()}
    truth = dict(labels)
    held = [i for i in truth if i % 4 == 0]
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97
    assert got[None]["predicted"] == 1 and got[902]["predicted"] == 1 and got[900]["predicted"] == got[901]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in score_toxicity(docs, known.limit(0)).collect()} == {0.0}


def test_examples_that_share_a_passage_all_count(spark):
    """A licence text in every row holds most rows' least shingle; only equal texts of one label are one example."""
    rng = random.Random(15)
    licence = " ".join(f"clause{i}" for i in range(300))
    rows, labels = [], []
    for i in range(160):
        own = [f"word{rng.randrange(60)}" for _ in range(8)]
        labels.append((i, int(i % 4 == 1)))
        rows.append((i, " ".join([*own, *(["vilest"] if labels[-1][1] else []), licence])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, known).collect()}
    assert got == dict(labels)


def test_a_rare_word_is_a_term_in_a_large_sample(spark):
    rng = random.Random(16)
    rows = [(i, f"word{rng.randrange(40)} other{i}" + (" vilest" if i % 10 == 0 else "") + (" grobber" if i < 3 else "")) for i in range(5000)]
    labels = [(i, int(i % 10 == 0 or i < 3)) for i, _ in rows]
    rows = [(i, t.replace(" vilest", "") if i < 3 else t) for i, t in rows] + [(9000, "grobber")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id = 9000").first()
    assert sorted(e["doc_id"] for e in got["evidence"]) == [0, 1, 2]


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [len(x) for x in cp.STAGES] == [2] * 5
    after = cp.exact_dedup(spark, docs, folder)
    texts = [r["text"] for r in docs.select("text").collect()]
    assert after.columns == docs.columns
    assert after.count() == len({hashlib.sha256(("" if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)).encode()).digest() for t in texts})
    twice = docs.limit(20).unionByName(docs.limit(20))
    assert cp.exact_dedup(spark, twice, folder).count() == docs.limit(20).select(F.lower("text")).distinct().count()
    masked = cp.secret_scan(spark, docs, folder)
    assert masked.count() == docs.count() and masked.columns == docs.columns


def test_pipeline_judges_rows_without_or_with_repeated_ids(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(i, f"word{i % 40} other{i}" + (" vilest" if i % 4 == 0 else "")) for i in range(200)]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(None, "vilest"), (None, "Clean words"), (None, "clean words"), (4, "clean row"), (500, "clean row"), (501, "clean row")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    left = cp.toxicity(spark, docs, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([x for x in rows + odd if "vilest" not in x[1]])
    got = Counter(r["text"].lower() for r in cp.exact_dedup(spark, spark.createDataFrame(odd, docs.schema), "").collect())
    assert got == Counter({"vilest": 1, "clean words": 1, "clean row": 1})


def test_near_copies_without_or_with_repeated_ids(spark):
    import corpus_pipeline as cp

    words = [f"word{i}" for i in range(60)]
    base, near = " ".join(words), " ".join(["other", *words[1:]])
    rows = [(1, base), (2, near), (None, "far away from all of that text here"), (3, None), (4, ""), (4, " ".join(f"own{i}" for i in range(30))), (None, " ".join(f"alone{i}" for i in range(30))), (None, " ".join(["x", *(f"alone{i}" for i in range(29))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_id": F.lit("own"), "kept": F.lit(1)})
    left = cp.near_dedup(spark, docs, "")
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert left.columns == docs.columns and len(got) == 6 and (1, base) in got and (2, near) not in got
    assert sum(t is not None and t.startswith(("alone", "x alone")) for _, t in got) == 1 and sum(i == 4 for i, _ in got) == 2
    unique = cp.near_dedup(spark, docs.where("doc_id < 4"), "")
    assert sorted(r["doc_id"] for r in unique.collect()) == [1, 3]


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, digest string, score double")
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.isEmpty()
    assert cp.packing(spark, docs, "").isEmpty()


def test_scores_against_plain_cosines(spark):
    """The score of every text by a plain cosine over all pairs, the vote and the curve of the fitted index."""
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice(["calm", "mild", "grob", "vile", "soft", f"w{rng.randrange(30)}"]) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    labels = [(i, int("grob" in t.split() and rng.random() < 0.9)) for i, t in rows if i % 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    truth = dict(labels)
    seen: dict[tuple, int] = {}
    for i, t in rows:  # equal sets of shingles and labels are one example
        if i in truth:
            words = t.split()
            shingles = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])
            seen.setdefault((shingles, truth[i]) if words else (i,), i)
    chosen = sorted(seen.values())
    text = dict(rows)
    bag = {i: Counter(text[i].split()) for i, _ in rows}
    n, p = len(chosen), sum(truth[i] for i in chosen)
    kept = []
    for term in sorted({w for i in chosen for w in bag[i]}):
        c, a = sum(term in bag[i] for i in chosen), sum(truth[i] for i in chosen if term in bag[i])
        spread = c * p / n * (1 - p / n) * (n - c) / n
        if c >= 3 and spread > 0 and (a - c * p / n) ** 2 / spread >= 15:
            kept.append(term)
    assert kept  # words of under five letters have no beginnings
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in b for b in bag.values()))) for t in kept}

    def vector(i: int) -> dict[str, float]:
        raw = {t: (1 + math.log(bag[i][t])) * idf[t] for t in kept if t in bag[i]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else raw

    held = {i: vector(i) for i in chosen}
    bare = [truth[i] for i in chosen if not held[i]]
    prior = (sum(bare) + 0.5 * p / n) / (len(bare) + 0.5)

    def vote(own: dict[str, float], skip: int | None) -> float:
        near = sorted(((-round(sum(w * held[j].get(t, 0.0) for t, w in own.items()), 12), j) for j in chosen if j != skip))
        near = [(-c, j) for c, j in near if c < 0][:15]
        mass = sum(c * c for c, _ in near)
        return (sum(c * c * truth[j] for c, j in near) + prior) / (mass + 1)

    points = sorted((vote(held[i], i), truth[i]) for i in chosen if held[i])
    blocks: list[list[float]] = []
    for x, y in points:
        blocks.append([y, 1, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, weight, last = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + mean * weight) / (blocks[-1][1] + weight), blocks[-1][1] + weight, last]
    for i, _ in rows:
        own = vector(i)
        want = prior if not own else 0.95 * float(np.interp(v := vote(own, None), [b[2] for b in blocks], [b[0] for b in blocks])) + 0.05 * v
        assert got[i]["score"] == pytest.approx(min(1.0, max(0.0, want)), abs=1e-6)
