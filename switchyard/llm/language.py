"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A run of three letters is bound
into one vector: the first letter's vector shifted twice, the second's shifted
once and the third's, multiplied.  A text's profile is the bundle, or sum, of
the vectors of its runs, a language's prototype the sum of the unit profiles of
its learned texts; a text has the language of the prototype with the largest
cosine.

Bundling is linear, so a batch of texts is a small matrix of counts of runs
times the matrix of the bound vectors; the runs of a batch are found and
counted in whole arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.plans.scratch import materialize

DIMENSIONS = 1024
SEED = 7
#: Labelled texts that the prototypes are fitted on, by a hash of the id.
MAX_EXAMPLES = 6000
#: Texts and code points that are counted together.
BATCH_TEXTS, BATCH_CHARS = 128, 400_000
#: Runs whose vectors a worker keeps.
MAX_RUNS = 60_000
#: Letters are numbered by code point; a run is three numbers of 21 bits.
_LETTER_BITS = 21


def _letter_table() -> np.ndarray:
    """For each code point its small letter, 0x20 for what is no letter."""
    table = np.full(0x110000, 0x20, np.int32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _table
    if _table is None:
        _table = _letter_table()
    return _table


def has_letter(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in text)


def run_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, run, count)`` of the runs of three letters, and whether each text has a letter.

    What is not a letter counts as one space, and so do a text's two ends.
    """
    joined = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    chars = _letters()[joined].astype(np.int64)
    lettered = np.bincount(owner, chars != 0x20, len(texts)) > 0
    keep = (chars != 0x20) | np.concatenate([[True], (chars[:-1] != 0x20) | (owner[1:] != owner[:-1])])
    chars, owner = chars[keep], owner[keep]
    runs = (chars[:-2] << (2 * _LETTER_BITS)) | (chars[1:-1] << _LETTER_BITS) | chars[2:]
    whole = (owner[:-2] == owner[2:]) & (chars[1:-1] != 0x20)  # the middle is a letter: no run joins two words
    runs, owner = runs[whole], owner[:-2][whole]
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    first = np.concatenate([[True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])]) if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return owner[at], runs[at], np.diff(at, append=len(runs)), lettered


class RunVectors:
    """Bound vectors of runs, made when first asked for."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((4096, dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.letters[point]

    def bound(self, run: int) -> np.ndarray:
        mask = (1 << _LETTER_BITS) - 1
        a, b, c = run >> (2 * _LETTER_BITS), (run >> _LETTER_BITS) & mask, run & mask
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def of(self, runs: np.ndarray) -> np.ndarray:
        """A row for each of some distinct runs."""
        if len(self.rows) + len(runs) > max(MAX_RUNS, len(runs)):
            self.rows = {}
        numbers = runs.tolist()
        for run in numbers:
            if run not in self.rows:
                at = len(self.rows)
                if at == len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                self.matrix[at] = self.bound(run)
                self.rows[run] = at
        return self.matrix[[self.rows[run] for run in numbers]].astype(np.float32)

    def profiles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit profiles of texts, zero where there is no run; and which texts have a letter."""
        owner, runs, counts, lettered = run_counts(texts)
        distinct, column = np.unique(runs, return_inverse=True)
        table = np.zeros((len(texts), len(distinct)), np.float32)
        table[owner, column] = counts
        bundle = table @ self.of(distinct) if len(distinct) else np.zeros((len(texts), self.dimensions), np.float32)
        bundle = bundle.astype(np.float64)
        norm = np.linalg.norm(bundle, axis=1, keepdims=True)
        return np.divide(bundle, norm, out=np.zeros_like(bundle), where=norm > 0), lettered


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, so many that the arrays stay small; null counts as empty."""
    start, held, size = 0, [], 0
    for at, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if len(held) == BATCH_TEXTS or size >= BATCH_CHARS:
            yield start, held
            start, held, size = at + 1, [], 0
    if held:
        yield start, held


_vectors: dict[tuple[int, int], RunVectors] = {}


def _run_vectors(dimensions: int, seed: int) -> RunVectors:
    if (dimensions, seed) not in _vectors:
        _vectors[dimensions, seed] = RunVectors(dimensions, seed)
    return _vectors[dimensions, seed]


def _learn_batches(dimensions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _run_vectors(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, texts in _groups(batch.column(1).to_pylist()):
                profiles, lettered = vectors.profiles(texts)
                for lang in sorted({x for x, good in zip(langs[start:], lettered, strict=False) if good}):
                    mine = [i for i in range(len(texts)) if langs[start + i] == lang]
                    sums[lang] = sums.get(lang, 0) + profiles[mine].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "bundle": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    return run


def _predict_batches(model, dimensions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = model.value
        vectors = _run_vectors(dimensions, seed)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for _, texts in _groups(batch.column(1).to_pylist()):
                profiles, lettered = vectors.profiles(texts)
                cosines = np.round(profiles @ prototypes.T, 9) if names else np.zeros((len(texts), 1))
                best = cosines.argmax(axis=1)  # ties to the first name
                langs += [names[b] if good and names else "und" for b, good in zip(best, lettered, strict=True)]
                scores += [float(np.clip(row[b], 0, 1)) if good and names else 0.0 for row, b, good in zip(cosines, best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def learn_prototypes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_examples: int = MAX_EXAMPLES, dimensions: int = DIMENSIONS, seed: int = SEED
) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from at most ``max_examples`` rows with a language."""
    ids = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"))
    sample = materialize(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).distinct(), "sample")
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # at most max_examples ids
    rows = rows.join(F.broadcast(sample), "doc_id", "left_semi").select("lang", "text")
    parts = rows.mapInArrow(_learn_batches(dimensions, seed), "lang string, bundle array<double>")
    sums: dict[str, np.ndarray] = {}
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    for r in summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).collect():
        sums[r["lang"]] = np.array([p["x"] for p in r["v"]])
    names = sorted(sums)
    return names, np.stack([sums[n] / (np.linalg.norm(sums[n]) or 1.0) for n in names]) if names else np.zeros((0, dimensions))


def identify_languages(docs: DataFrame, learned: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row; ``score`` is the cosine, cut to 0..1.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing was learned.  Ties go to the first language in order
    of names.  Repeated rows repeat their result, a null id stays null, other
    columns are not looked at.  One pass without a shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_predict_batches(model, dimensions, seed), "doc_id long, lang_pred string, score double")
