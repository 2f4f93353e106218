"""Vocabulary of a sentencepiece model file, and what follows from it for cutting texts.

A cut between two characters is safe if no piece of the vocabulary holds them
next to each other: no piece can then reach across it, so both sides can be
encoded on their own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from operator import add

SPACE = "▁"
#: Kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and kinds by id, from a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
        self.bytes = [0] * 256
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.bytes[int(self.pieces[i][1:-1], 16)] = i

    def neighbours(self, ids: list[int]) -> set[str]:
        """Two-character strings that occur inside the given pieces."""
        return {p[i : i + 2] for n in ids for p in (self.pieces[n],) for i in range(len(p) - 1)}


def safe_parts(text: str, neighbours: set[str]) -> list[str]:
    """The text cut wherever no piece can reach across."""
    inside = map(neighbours.__contains__, map(add, text, text[1:]))
    cuts = [i for i, held in enumerate(inside, 1) if not held]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]
