"""A bounded memory of what Python workers have computed for single words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows, and so whole texts, that are in Python's hands at a time.
PART_ROWS = 256


def small_parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to a few rows each, so that texts are not all copied at once."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


class _Layer(dict):
    """Recent words.  A word that only the older layer has moves up when it is used."""

    def __init__(self, older: dict):
        super().__init__()
        self.older = older
        self.unknown: set[str] = set()

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            self.unknown.add(word)
        else:
            self[word] = value
        return value


class WordMemory:
    """Values of words, at most ``limit`` of them; words not used lately are forgotten.

    ``learn`` maps a set of words to a dict with a value (never None) for each.
    """

    def __init__(self, learn: Callable[[set[str]], dict], limit: int):
        self.learn = learn
        self.half = max(1, limit // 2)
        self.layer = _Layer({})

    def peek(self, word: str):
        """The value of a word if it is remembered, else None."""
        value = self.layer.get(word)
        return self.layer.older.get(word) if value is None else value

    def look_up(self, texts: list[list[str]]) -> list[list]:
        """The values of the words of each text."""
        layer = self.layer
        values = [list(map(layer.__getitem__, words)) for words in texts]
        if layer.unknown:
            found = self.learn(layer.unknown)
            layer.unknown = set()
            layer.update(found)
            for words, held in zip(texts, values, strict=True):
                at = -1
                try:
                    while True:
                        at = held.index(None, at + 1)
                        held[at] = found[words[at]]
                except ValueError:
                    pass
        if len(layer) > self.half:
            layer.older = {}
            self.layer = _Layer(layer)
        return values
