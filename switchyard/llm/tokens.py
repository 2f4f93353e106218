"""Token ids of whole texts by a public BPE with word ends, and their cutting into pieces.

The tokenizer drops white space and never joins characters across it, so a text
is encoded as the sequence of its space-separated words.  Words repeat, so each
Python worker keeps a bounded memory of encoded words; what is not in it goes
through the library in one call for many words.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.memo import WordMemory

#: Words that a worker remembers.
MAX_WORDS = 500_000
#: Texts whose words are looked up together.
GROUP = 512
#: Runs of marks at the end of words that are remembered; an apostrophe may join what follows it, so it is none.
MAX_MARKS = 10_000
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


class WordEncoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text of Latin-1 characters is lower-cased at once, which for those is
    what the tokenizer does, so that capitals share a memory entry; other texts
    keep their letters and leave it to the tokenizer.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: the merges alone, for words that are already in the form that the merges see
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.byte_letters = _byte_letters()
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for piece, number in self.tokenizer.get_vocab().items():
            self.ends[number] = piece.endswith("</w>")
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.byte_space = self.byte_letters[0x20]
        self.marks: dict[str, bytes] = {}
        self.memory = WordMemory(self._learn, max_words)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {"": b""}
        tails, plain, mixed = [], [], []
        for w in words:
            if w.isalpha():
                plain.append(w)
            elif (stem := w.rstrip(MARKS)) != w and stem.isalpha() and (stem.isascii() or _latin(stem)):
                tails.append((w, stem))  # letters, then marks: two runs to the tokenizer
            elif w:
                mixed.append(w)
        stems = {stem for _, stem in tails}.difference(plain)
        known = {stem: ids for stem in stems if (ids := self.memory.peek(stem)) is not None}
        plain += stems - known.keys()
        mixed += self._learn_plain(plain, found)
        mixed += {w[len(stem) :] for w, stem in tails} - self.marks.keys()
        for w, encoded in zip(mixed, self.tokenizer.encode_batch_fast(mixed, add_special_tokens=False), strict=True):
            found[w] = np.asarray(encoded.ids, "<u4").tobytes()
        for w, stem in tails:
            marks = w[len(stem) :]
            if marks not in self.marks:
                if len(self.marks) >= MAX_MARKS:
                    self.marks = {}
                self.marks[marks] = found.get(marks) or self._whole(marks)
            found[w] = (known.get(stem) or found[stem]) + self.marks[marks]
        return found

    def _learn_plain(self, words: list[str], found: dict[str, bytes]) -> list[str]:
        """Ids of words of letters, many to a call; those that the normaliser changes are handed back."""
        joined, rest = " ".join(words), []
        if not (_latin(joined) and joined == joined.lower()):
            rest = [w for w in words if not _in_final_form(w)]
            words = [w for w in words if _in_final_form(w)]
            joined = " ".join(words)
        forms = joined.encode().decode("latin-1").translate(self.byte_letters).replace(self.byte_space, " ")
        ids = np.asarray(self.merges.encode_batch_fast([forms], add_special_tokens=False)[0].ids, "<u4")
        # each word ends with the first piece that ends a word
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw, start = ids.tobytes(), 0
        for w, stop in zip(words, stops, strict=True):
            found[w] = raw[start:stop]
            start = stop
        return rest

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        out: list[bytes] = [b""] * len(texts)
        places, split = [], []
        for at, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.specials):
                out[at] = self._whole(text)
                continue
            places.append(at)
            split.append((text.lower() if _latin(text) else text).replace("\n", " ").split(" "))
        for at, parts in zip(places, self.memory.look_up(split), strict=True):
            out[at] = b"".join(parts)
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _in_final_form(word: str) -> bool:
    """Whether the tokenizer's normaliser leaves a word as it is: small letters of Latin-1."""
    return _latin(word) and word == word.lower()


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(0x100 + n) for n, b in enumerate(others)}


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, first in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[first : first + 4 * capacity]
                        rows.append((doc_id, piece, first // 4, len(cut) // 4, zlib.crc32(cut), cut))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(columns[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids and the end id, cut at ``capacity``.

    Only documents longer than ``capacity`` are cut; their last piece may be
    shorter.  A null text counts as empty and has the end id alone.  Repeated
    rows give repeated pieces, a null id keeps null.  ``ids`` holds
    little-endian unsigned 32-bit integers.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_pieces(path, capacity, end_id, with_ids), PIECE_SCHEMA + (", ids binary" if with_ids else ""))
