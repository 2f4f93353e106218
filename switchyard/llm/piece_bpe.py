"""Exact merge-type (BPE) encoding by backtracking, and decoding, of a sentencepiece model.

The encoder takes, from the left, the longest vocabulary match (Aho-Corasick)
whose end has not failed before (a bitfield) and that is compatible with the
piece before it: undoing the later merge of the two again and again, no merge
across their border may come before what was undone.  If no match at a place
will do, the place is marked as failed and the piece before it is taken back.
A sequence of pairwise compatible pieces is the one that merging arrives at.

Only pieces that merging makes of their own text are matched.  Pieces of equal
score (the runs of spaces) leave merging order to position; parts with such
runs are encoded by merging itself.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.memo import WordMemory, small_parts
from switchyard.llm.piece_model import BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, PieceModel, safe_parts

MAX_WORDS = 1_000_000
MAX_PAIRS = 2_000_000
GROUP = 512
#: Characters taken off the ends of words, and runs of them that are remembered.
MARKS, MAX_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()), 10_000


class PieceEncoder:
    """Encodes as the library does without begin or end ids and without sampling."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.model = model = PieceModel(path)
        unusual = sorted({k for k in model.kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE})
        if unusual:
            raise ValueError(f"pieces of kinds {unusual} are not supported")
        self.ids = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL}
        #: merges of a higher score come first
        order = sorted({model.scores[i] for p, i in self.ids.items() if len(p) > 1}, reverse=True)
        place = {score: n for n, score in enumerate(order)}
        self.rank = {i: place[model.scores[i]] if len(p) > 1 else -1 for p, i in self.ids.items()}
        self.tied = {r for r, n in Counter(self.rank.values()).items() if r >= 0 and n > 1}
        self.neighbours = model.neighbours(list(self.ids.values()))
        self.split: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.automaton.add_word(piece, (1, i))
            elif self.rank[i] not in self.tied:
                made = self._merge(piece)
                if len(made) == 1:
                    self.automaton.add_word(piece, (len(piece), i))
                    self.split[i] = self.last_merge
        self.automaton.make_automaton()
        # runs of two spaces are where tied pieces begin
        self.by_merging = {p[:2] for p, i in self.ids.items() if len(p) > 1 and self.rank[i] in self.tied}
        self.compatible: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        self.max_words = max_words
        self.memory = WordMemory(lambda words: {w: self._word(w) for w in words}, max_words)

    def _merge(self, text: str) -> list[int]:
        """Ids by merging the pair of the highest score, leftmost first; -1 for characters without a piece."""
        symbols: list[str | None] = list(text)
        following, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        queue: list[tuple[int, int, str]] = []

        def offer(left: int) -> None:
            right = following[left]
            if right < len(symbols):
                made = symbols[left] + symbols[right]
                if made in self.ids:
                    heapq.heappush(queue, (self.rank[self.ids[made]], left, made))

        for i in range(len(symbols) - 1):
            offer(i)
        while queue:
            _, left, made = heapq.heappop(queue)
            right = following[left]
            if symbols[left] is None or right >= len(symbols) or symbols[left] + symbols[right] != made:
                continue
            self.last_merge = (self.ids.get(symbols[left], -1), self.ids.get(symbols[right], -1))
            symbols[left], symbols[right] = made, None
            following[left] = following[right]
            if following[right] < len(symbols):
                before[following[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [self.ids.get(s, -1) for s in symbols if s is not None]

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two pieces alone."""
        pieces, ids, rank, split = self.model.pieces, self.ids, self.rank, self.split
        limit = float("inf")
        while True:
            made = ids.get(pieces[left] + pieces[right])
            if made is not None and rank[made] < limit:
                return False
            if rank[left] > rank[right]:
                limit = rank[left]
                left = split[left][1]
            elif rank[right] >= 0:
                # of two equal merges the left one goes first, so here an equal one crosses the border
                limit = rank[right] + 1
                right = split[right][0]
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MAX_PAIRS:
                self.compatible = {}
            known = self.compatible[key] = self._fit(left, right)
        return known

    def _part(self, text: str) -> list[int]:
        """Ids of a part whose characters are all pieces, by backtracking."""
        n = len(text)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for at, match in self.automaton.iter(text):
            matches[at + 1 - match[0]].append(match)  # ends rise, so the longest comes last
        open_ends = (1 << (n + 1)) - 1
        taken: list[tuple[int, int]] = []  # place among the matches, id
        pos, choice = 0, len(matches[0]) - 1
        while pos < n:
            last = taken[-1][1] if taken else -1
            here = matches[pos]
            while choice >= 0:
                size, piece = here[choice]
                if open_ends >> (pos + size) & 1 and (last < 0 or self._fits(last, piece)):
                    break
                choice -= 1
            if choice >= 0:
                taken.append((choice, piece))
                pos += size
                choice = len(matches[pos]) - 1 if pos < n else -1
            else:
                open_ends &= ~(1 << pos)
                choice, piece = taken.pop()
                pos -= len(self.model.pieces[piece])
                choice -= 1
        return [piece for _, piece in taken]

    def _encode_part(self, text: str) -> bytes:
        if len(text) == 1 and text not in self.ids:
            ids = [self.model.bytes[b] for b in text.encode("utf-8", "surrogatepass")]
        elif any(run in text for run in self.by_merging):
            ids = self._merge(text)
        else:
            ids = self._part(text)
        return np.asarray(ids, "<i4").tobytes()

    def _ids(self, text: str) -> bytes:
        out = []
        for part in safe_parts(text, self.neighbours):
            ids = self.parts.get(part)
            if ids is None:
                ids = self._encode_part(part)
                if len(self.parts) >= self.max_words:
                    self.parts = {}
                self.parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a word as split off: after a space, or after a line break where it starts with a null."""
        return self._ids("\n" + word[1:] if word[:1] == "\0" else SPACE + word.replace(" ", SPACE))

    def words(self, text: str) -> list[str] | None:
        """The words to look up in place of a text that is not empty; None if it has to be encoded as a whole."""
        text = text.replace(SPACE, " ")
        if "\0" in text:  # the mark of a line break is taken
            return None
        text = text.replace("\n", " \0")  # a line break is in no piece
        return self._runs(text) if "  " in text or text[0] == " " else text.split(" ")

    def whole(self, text: str) -> bytes:
        return self._ids((" " + text).replace(" ", SPACE))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null or empty text has none."""
        out: list[bytes] = [b""] * len(texts)
        places, split = [], []
        for at, text in enumerate(texts):
            if not text:
                continue
            words = self.words(text)
            if words is None:
                out[at] = self.whole(text)
                continue
            places.append(at)
            split.append(words)
        for at, parts in zip(places, self.memory.look_up(split), strict=True):
            out[at] = b"".join(parts)
        return out

    @staticmethod
    def _runs(text: str) -> list[str]:
        """Words that keep all the spaces before them but one; a line break's space is none."""
        out: list[str] = []
        spaces = 0
        for word in text.split(" "):
            if word[:1] == "\0":
                if spaces:
                    out.append(" " * (spaces - 1))
                out.append(word)
                spaces = 0
                continue
            spaces += 1
            if word:
                out.append(" " * (spaces - 1) + word)
                spaces = 0
        if spaces:
            out.append(" " * (spaces - 1))
        return out


class PieceDecoder:
    """Decodes ids as the library does."""

    def __init__(self, path: str):
        model = PieceModel(path)
        self.raw: list[bytes] = []
        for piece, kind in zip(model.pieces, model.kinds, strict=True):
            if kind == BYTE:
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif kind == CONTROL:
                self.raw.append(b"")
            elif kind == UNKNOWN:
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.kinds = model.kinds
        self.spaced = {i for i, p in enumerate(model.pieces) if p.startswith(SPACE) and model.kinds[i] == NORMAL}

    def decode(self, ids: list[int]) -> str:
        """The text; the space that encoding puts before it goes, bytes that are no UTF-8 become U+FFFD each."""
        start = 0
        while start < len(ids) and self.kinds[ids[start]] == CONTROL:
            start += 1
        return self.text(b"".join([self.raw[i] for i in ids]), start < len(ids) and ids[start] in self.spaced)

    @staticmethod
    def text(data: bytes, spaced: bool) -> str:
        """The text of the joined bytes of pieces, the first of which starts with a space if ``spaced``."""
        if spaced:
            data = data[1:]
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(data):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(data[at : at + size].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                at += size
            return "".join(out)


class PieceDigester:
    """Digests of a text's ids and of what they decode to.

    For each word the decimal text of its ids and the bytes of its pieces are
    remembered; both of a text are those of its words joined.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.encoder, self.decoder = PieceEncoder(path, max_words), PieceDecoder(path)
        self.decimal = [b"%d," % i for i in range(len(self.decoder.raw))]
        self.memory = WordMemory(self._learn, max_words)
        self.marks: dict[str, tuple[bytes, bytes]] = {}

    def _learn(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Values of words; of those that end in marks which no piece joins to the rest, the rest is often known."""
        found: dict[str, tuple[bytes, bytes]] = {}
        neighbours = self.encoder.neighbours
        for word in words:
            stem = word.rstrip(MARKS)
            if not stem or stem is word or len(stem) == len(word) or word[len(stem) - 1 : len(stem) + 1].replace(" ", SPACE) in neighbours:
                found[word] = self._both(self.encoder._word(word))
                continue
            value = found.get(stem) or self.memory.peek(stem)
            if value is None:
                value = found[stem] = self._both(self.encoder._word(stem))
            marks = word[len(stem) :]
            tail = self.marks.get(marks)
            if tail is None:
                if len(self.marks) >= MAX_MARKS:
                    self.marks = {}
                tail = self.marks[marks] = self._both(self.encoder._ids(marks))
            found[word] = (value[0] + tail[0], value[1] + tail[1])
        return found

    def _both(self, ids: bytes) -> tuple[bytes, bytes]:
        numbers = np.frombuffer(ids, "<i4").tolist()
        return b"".join([self.decimal[i] for i in numbers]), b"".join([self.decoder.raw[i] for i in numbers])

    def _digests(self, listed: bytes, data: bytes) -> tuple[int, str, str]:
        spaced = bool(listed) and int(listed[: listed.index(b",")]) in self.decoder.spaced
        text = self.decoder.text(data, spaced).encode()
        return listed.count(b","), hashlib.sha256(listed[:-1]).hexdigest(), hashlib.sha256(text).hexdigest()

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of their decimal text joined by commas, SHA-256 of the decoded text; a null text is empty."""
        out = [self._digests(b"", b"")] * len(texts)
        places, split = [], []
        for at, text in enumerate(texts):
            if not text:
                continue
            words = self.encoder.words(text)
            if words is None:
                out[at] = self._digests(*self._both(self.encoder.whole(text)))
                continue
            places.append(at)
            split.append(words)
        for at, values in zip(places, self.memory.look_up(split), strict=True):
            out[at] = self._digests(b"".join([v[0] for v in values]), b"".join([v[1] for v in values]))
        return out


_encoders: dict[str, PieceEncoder] = {}
_decoders: dict[str, PieceDecoder] = {}
_digesters: dict[str, PieceDigester] = {}


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = PieceEncoder(path)
        encoder = _encoders[path]
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                ids = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    return run


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _decoders:
            _decoders[path] = PieceDecoder(path)
        decoder = _decoders[path]
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                texts = [None if ids is None else decoder.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def _digest_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _digesters:
            _digesters[path] = PieceDigester(path)
        for part in small_parts(batches, GROUP):
            rows = _digesters[path].digests(part.column(1).to_pylist())
            counts, ids, decoded = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digest_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: texts encoded, and the ids decoded, in one pass without shuffle.

    Ids are joined by commas in decimal, digests are lowercase hexadecimal.  A
    null or empty text has no ids and decodes to the empty text.  Repeated rows
    repeat their digests, a null id stays null, other columns are not looked at.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_digest_batches(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row; a null or empty text has no ids.

    Repeated rows repeat their ids, a null id stays null, other columns are not
    looked at.  One pass without a shuffle.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_encode_batches(path), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, decoded)`` for every row; null ids give a null text."""
    chosen = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(_decode_batches(path), "doc_id long, ids array<int>, decoded string")
