"""Token counts of a unigram model without making the tokens.

The vocabulary's matches in a word come from an Aho-Corasick automaton, end by
end and the longest first.  Dynamic programming carries, for each end, the best
score and the number of pieces of the best way there.  As in the tokenizer, a
later way has to be strictly better, and ways are tried from the earliest start;
a character that no single piece matches may go as unknown at the smallest score
less ten and then counts one piece a byte.

Words are what the tokenizer's word splitting makes of spaces.  They repeat, so
a Python worker remembers their counts; a new one is cut where no piece can
reach across before it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.memo import WordMemory
from switchyard.llm.piece_model import SPACE, PieceModel, safe_parts

UNKNOWN_PENALTY = 10.0
MAX_WORDS = 800_000
GROUP = 256


class UnigramCounter:
    """Counts as ``tokenizers`` does for a Unigram model with byte fallback behind a Metaspace splitting."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        model = PieceModel(path)
        self.automaton = ahocorasick.Automaton()
        last = {p: i for i, p in enumerate(model.pieces)}  # of equal pieces the last one counts
        for piece, i in last.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), float(model.scores[i])))
        self.automaton.make_automaton()
        self.unknown = min(map(float, model.scores)) - UNKNOWN_PENALTY
        # with whole numbers sums are exact, so the best way of the whole is the best ways of its parts
        self.exact = all(float(s).is_integer() for s in model.scores)
        self.neighbours = model.neighbours(list(last.values()))
        self.parts: dict[str, int] = {}
        self.max_words = max_words
        self.memory = WordMemory(lambda words: {w: self._word(w) for w in words}, max_words)

    def _part(self, text: str) -> int:
        best: list[float | None] = [None] * (len(text) + 1)
        count = [0] * (len(text) + 1)
        best[0] = 0.0
        single = [False] * len(text)
        done = 0  # ends up to here have had their last match

        def unknowns(upto: int) -> None:
            """Ways that end in an unknown character; it starts after all longer matches with the same end."""
            nonlocal done
            for end in range(done + 1, upto + 1):
                if not single[end - 1]:
                    score = best[end - 1] + self.unknown
                    if best[end] is None or score > best[end]:
                        best[end] = score
                        count[end] = count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            done = max(done, upto)

        for at, (size, score) in self.automaton.iter(text):
            end = at + 1
            if end - 1 > done:
                unknowns(end - 1)
            if size == 1:
                single[at] = True
            score += best[end - size]
            if best[end] is None or score > best[end]:
                best[end] = score
                count[end] = count[end - size] + 1
        unknowns(len(text))
        return count[-1]

    def _count(self, text: str) -> int:
        total = 0
        for part in safe_parts(text, self.neighbours) if self.exact else [text]:
            n = self.parts.get(part)
            if n is None:
                n = self._part(part)
                if len(self.parts) >= self.max_words:
                    self.parts = {}
                self.parts[part] = n
            total += n
        return total

    def _word(self, word: str) -> int:
        """Pieces of a word as split off: after a space, or after a line break where it starts with a null."""
        return self._count("\n" + word[1:] if word[:1] == "\0" else SPACE + word)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of pieces of each text; a null or empty text has none."""
        out = [0] * len(texts)
        places, split = [], []
        for at, text in enumerate(texts):
            if not text:
                continue
            text = text.replace(SPACE, " ")
            marked = self.exact and "\0" not in text
            # a line break is in no piece: what follows it is counted on its own
            words = (text.replace("\n", " \0") if marked else text).split(" ")
            if text[0] == " ":
                del words[0]  # the text's own space serves as the one put before it
            if marked:
                places.append(at)
                split.append(words)
            else:
                out[at] = sum(self._count(SPACE + w) for w in words)
        for at, parts in zip(places, self.memory.look_up(split), strict=True):
            out[at] = sum(parts)
        return out


_counters: dict[str, UnigramCounter] = {}


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = UnigramCounter(path)
        counter = _counters[path]
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter.counts(part.column(1).to_pylist()), pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` for every row, by the vocabulary and scores of a model file.

    A null or empty text has no token.  Repeated rows repeat their count, a null
    id stays null, other columns are not looked at.  One pass without a shuffle.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_count_batches(path), "doc_id long, n_tokens long")
