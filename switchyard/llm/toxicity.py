"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine on a block-max inverted index.

Terms are words and the beginnings of longer words.  The vocabulary is every
term whose presence goes with the label on a bounded sample of labelled
documents; document frequencies are counted over all documents.  The sample's
vectors form an inverted index: a list of examples and weights for each term.
Examples are cut into blocks; for each term and block the largest weight is kept.  A document's score in a block
cannot exceed the sum of these, so blocks are visited from the highest bound
down and the search ends when no bound exceeds the k-th best cosine found.
Votes weigh by the square of the cosine against a prior of the examples that
share no term; an isotonic curve fitted on the sample, each example without
itself, makes them probabilities.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.memo import WordMemory, small_parts
from switchyard.llm.shingles import shingle_set
from switchyard.plans.scratch import materialize

#: Bound of the fitted model: labelled examples.
MAX_EXAMPLES = 8000
#: Evidence that a term must give: examples that hold it, and chi-squared with one degree of freedom.
MIN_SUPPORT = 3
MIN_CHI2 = 15.0
NEIGHBOURS = 15
PRIOR_WEIGHT = 1.0
BLOCK = 64
#: Blocks that are scored before any are passed over.
FIRST_BLOCKS = 6
EVIDENCE = 3
PREFIXES = (4, 5, 6)
MAX_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> list[str]:
    """A word and, marked by a star, its beginnings of a few lengths."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _example_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_parts(batches):
        texts = batch.column(2).to_pylist()
        terms = [sorted({t for w in set(_words(x)) for t in terms_of(w)}) for x in texts]
        keys = [hashlib.sha256(s.tobytes()).digest() if len(s := shingle_set((x or "").encode())) else None for x in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(terms, pa.list_(pa.string())), pa.array(keys, pa.binary())], ["doc_id", "toxic", "text", "terms", "key"])


def _count_batches(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value

        def learn(words: set[str]) -> dict[str, tuple[int, ...]]:
            return {w: tuple(numbers[t] for t in terms_of(w) if t in numbers) for w in words}

        memory = WordMemory(learn, MAX_WORDS)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [Counter(chain.from_iterable(filter(None, v))) for v in memory.look_up([_words(t) for t in part.column(1).to_pylist()])]
                ordered = [sorted(c.items()) for c in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([[t for t, _ in c] for c in ordered], pa.list_(pa.int32())), pa.array([[n for _, n in c] for c in ordered], pa.list_(pa.int32())), *part.columns[2:]],
                    ["doc_id", "terms", "counts", *part.schema.names[2:]],
                )

    return run


class ExampleIndex:
    """The examples' unit vectors as postings by term, with the largest weight of each block."""

    def __init__(self, examples: list[tuple[int, int, list[int], list[int]]], idf: np.ndarray):
        """``examples``: id, label, terms, counts; those without terms only make the prior."""
        self.idf = idf
        bare = [toxic for _, toxic, terms, _ in examples if not terms]
        everyone = [toxic for _, toxic, _, _ in examples]
        #: share of the label among examples without any term; a little of the overall share keeps it off zero
        self.prior = (sum(bare) + 0.5 * sum(everyone) / max(1, len(everyone))) / (len(bare) + 0.5) if everyone else 0.0
        vectors = [(doc_id, toxic, terms, self.weights(terms, counts)) for doc_id, toxic, terms, counts in examples if terms]
        # alike examples share a block: by their heaviest term, then the id
        vectors.sort(key=lambda v: (v[2][int(np.argmax(v[3]))], v[0]))
        self.ids = np.array([v[0] for v in vectors], np.int64)
        self.labels = np.array([v[1] for v in vectors], np.int64)
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        lists: list[tuple[list[int], list[float]]] = [([], []) for _ in idf]
        for at, (_, _, terms, weights) in enumerate(vectors):
            for term, weight in zip(terms, weights.tolist(), strict=True):
                lists[term][0].append(at)
                lists[term][1].append(weight)
        self.postings = [(np.array(places, np.int32), np.array(weights)) for places, weights in lists]
        self.bounds = np.zeros((len(idf), self.blocks))
        for term, (places, weights) in enumerate(self.postings):
            np.maximum.at(self.bounds[term], places // BLOCK, weights)
        self.curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def weights(self, terms: list[int], counts: list[int]) -> np.ndarray:
        raw = (1 + np.log(np.asarray(counts, float))) * self.idf[terms]
        norm = math.sqrt(float((raw * raw).sum()))
        return raw / norm if norm else raw

    def nearest(self, terms: list[int], weights: np.ndarray, k: int, skip: int | None = None) -> list[tuple[float, int, int]]:
        """The k examples of highest positive cosine as (cosine, id, label), ties to the smaller id; exact."""
        bounds = weights @ self.bounds[terms]
        order = np.argsort(-bounds, kind="stable")
        held = np.concatenate([self.postings[t][0] for t in terms])
        products = np.concatenate([w * self.postings[t][1] for t, w in zip(terms, weights.tolist(), strict=True)])
        block_of = held // BLOCK
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, FIRST_BLOCKS
        while at < len(order):
            least = -np.partition(-cosines, k - 1)[k - 1] if len(cosines) >= k else 0.0
            blocks = order[at : at + step]
            blocks = blocks[(bounds[blocks] > 0) & (bounds[blocks] >= least - 1e-9)]
            if not len(blocks):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[blocks] = True
            inside = chosen[block_of]
            sums = np.round(np.bincount(held[inside], products[inside], self.n), 12)
            columns = np.flatnonzero((sums > 0) & (sums >= least - 1e-9))
            if skip is not None:
                columns = columns[self.ids[columns] != skip]
            places, cosines = np.concatenate([places, columns]), np.concatenate([cosines, sums[columns]])
            at, step = at + step, 8 * step  # few blocks set the mark, then many are passed over at once
        first = np.lexsort((self.ids[places], -cosines))[:k]
        return [(float(cosines[i]), int(self.ids[places[i]]), int(self.labels[places[i]])) for i in first]

    def vote(self, found: list[tuple[float, int, int]]) -> float:
        mass = sum(c * c for c, _, _ in found)
        return (sum(c * c * label for c, _, label in found) + PRIOR_WEIGHT * self.prior) / (mass + PRIOR_WEIGHT)

    def calibrate(self, examples: list[tuple[int, int, list[int], list[int]]]) -> None:
        """Fit a rising step curve from votes, each example's without itself, to shares of the label."""
        points = sorted((self.vote(self.nearest(t, self.weights(t, c), NEIGHBOURS, skip=i)), y) for i, y, t, c in examples if t)
        steps: list[list[float]] = []  # mean, weight, last vote
        for vote, y in points:
            steps.append([float(y), 1.0, vote])
            while len(steps) > 1 and steps[-2][0] >= steps[-1][0]:
                mean, weight, last = steps.pop()
                total = steps[-1][1] + weight
                steps[-1] = [(steps[-1][0] * steps[-1][1] + mean * weight) / total, total, last]
        if len(steps) > 1:
            self.curve = (np.array([s[2] for s in steps]), np.array([s[0] for s in steps]))

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[tuple[float, int, int]]]:
        if not terms or not self.n:
            return self.prior, []
        found = self.nearest(terms, self.weights(terms, counts), NEIGHBOURS)
        vote = self.vote(found)
        # the curve is flat in places; a twentieth of the vote itself keeps the order
        return min(1.0, max(0.0, 0.95 * float(np.interp(vote, *self.curve)) + 0.05 * vote)), found


_OUT = "doc_id long, score double, predicted int, evidence array<struct<doc_id long, similarity double, toxic int>>"


def _score_batches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ExampleIndex = index.value
        kept: dict[tuple, tuple] = {}
        evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            out = []
            for terms, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = (*terms, *counts)
                if key not in kept:
                    if len(kept) > 50_000:
                        kept.clear()
                    kept[key] = model.score(terms, counts)
                out.append(kept[key])
            near = [[{"doc_id": i, "similarity": c, "toxic": y} for c, i, y in found[:EVIDENCE]] for _, found in out]
            scores = [s for s, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(near, evidence), *batch.columns[3:]],
                ["doc_id", "score", "predicted", "evidence", *batch.schema.names[3:]],
            )

    return run


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether the crc32 of an id as text leaves ``fold`` when divided by ``folds``; a row without an id is always held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds) == F.lit(fold), F.lit(True))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, digest_col: str | None = None
) -> DataFrame:
    """``(doc_id, score, predicted, evidence)`` for every row of ``docs``; ``evidence`` holds the nearest examples.

    ``labels`` has one or more rows an id with a 0/1 label; the largest counts
    and nulls don't.  Of rows of ``docs`` that repeat a labelled id the least
    text is the example.  At most ``max_examples`` labelled ids, by a hash of the
    id, are learned from, all but copies of equal shingle sets and labels.  Texts that are null, empty or without a term of the
    vocabulary get the label's share among such examples; without any labels
    all scores are 0.  Repeated rows repeat their scores, a null id is scored
    too.  Other columns are not looked at, but a ``digest_col`` of strings is
    handed on as ``digest``.
    """
    spark = docs.sparkSession
    carried = [F.col(digest_col).alias("digest")] if digest_col else []
    more = ", digest string" if digest_col else ""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    sample = materialize(sample, "sample")
    # at most max_examples ids, two numbers each
    # of rows that repeat an id, the least text counts
    texts = chosen.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    examples = texts.mapInArrow(_example_batches, "doc_id long, toxic int, text string, terms array<string>, key binary")
    examples = materialize(examples, "examples")
    # of copies, which have equal sets of shingles and one label, one is enough; examples without words all stay
    single = examples.where("key is not null").groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id").unionByName(examples.where("key is null").select("doc_id"))
    single = materialize(examples.join(single, "doc_id", "left_semi"), "single")
    totals = single.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    n, p = float(totals["n"]), float(totals["p"])
    by_term = single.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("c"), F.sum("toxic").cast("double").alias("a"))
    expected = F.col("c") * F.lit(p / n if n else 0.0)
    spread = expected * F.lit(1 - p / n if n else 0.0) * (F.lit(n) - F.col("c")) / F.lit(max(1.0, n))
    chi2 = F.when(spread > 0, (F.col("a") - expected) ** 2 / spread).otherwise(F.lit(0.0))
    strong = by_term.withColumn("chi2", chi2).where((F.col("c") >= MIN_SUPPORT) & (F.col("chi2") >= MIN_CHI2)).orderBy(F.desc("chi2"), "term")
    # terms of the sample, which is bounded
    vocabulary = [r["term"] for r in strong.select("term").collect()]

    count = _count_batches(spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)}))
    counted = materialize(chosen.mapInArrow(count, "doc_id long, terms array<int>, counts array<int>" + more), "counted")
    frequency = np.zeros(len(vocabulary))
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
        frequency[row["term"]] = row["n"]
    idf = np.log((1 + counted.count()) / (1 + frequency)) if vocabulary else np.zeros(0)
    held = single.select("doc_id", "text", "toxic").mapInArrow(count, "doc_id long, terms array<int>, counts array<int>, toxic int")
    learned = sorted((r["doc_id"], r["toxic"], r["terms"], r["counts"]) for r in held.collect())
    index = ExampleIndex(learned, idf)
    index.calibrate(learned)
    return counted.mapInArrow(_score_batches(spark.sparkContext.broadcast(index)), _OUT + more)
