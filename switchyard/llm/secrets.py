"""Secrets in whole texts, with structural confirmation.

Three base patterns (assignments, access ids, long hexadecimal runs) are always
reported.  On top of them, candidates in base64 or hexadecimal are decoded and
reported only if what they hold parses: private keys as DER whose nested
lengths add up or as an OpenSSH key of length-prefixed fields, signed tokens
whose header and payload are JSON objects and whose header names an algorithm,
and encoded text that itself holds a base secret.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.memo import small_parts

#: Kinds in the order in which spans that start together are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "token", "key", "encoded")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([^-]*)-----END \1-----")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: From the length of the shortest encoded base secret on: an assignment of 12 characters such as ``token=abc123``.
_BASE64 = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{24,}")

_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")


def _marked(letters: bytes) -> bytes:
    return bytes(0x78 if b in letters else 0x20 for b in range(256))


_HEX_MARKS = _marked(b"0123456789abcdef")
_BASE64_MARKS = _marked(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def _der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER item at ``at``, if its length is well formed and fits."""
    if at + 2 > end:
        return None
    tag, first, start = data[at], data[at + 1], at + 2
    size = first
    if first & 0x80:
        n = first & 0x7F
        if not 1 <= n <= 4 or start + n > end or data[start] == 0:
            return None
        size = int.from_bytes(data[start : start + n])
        if size < 0x80:
            return None
        start += n
    return (tag, start, start + size) if start + size <= end else None


def _der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill a range exactly, or None."""
    items = []
    while at < end:
        item = _der_item(data, at, end)
        if item is None:
            return None
        items.append(item)
        at = item[2]
    return items


def is_der_private_key(data: bytes) -> bool:
    """Whether bytes are one DER sequence shaped as a private key, with lengths that nest exactly."""
    outer = _der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = _der_items(data, *outer[0][1:])
    if not inner:
        return False
    tags = [item[0] for item in inner]
    if tags == [0x30, 0x04]:  # encrypted: algorithm, then the sealed key
        algorithm = _der_items(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[0] != 0x02 or inner[0][2] - inner[0][1] != 1 or data[inner[0][1]] > 1:
        return False
    if tags[1:] and all(tag == 0x02 for tag in tags[1:]):  # numbers of RSA (eight) or DSA (five)
        return len(tags) in (6, 9)
    if tags[1:3] == [0x30, 0x04]:  # algorithm and wrapped key
        algorithm = _der_items(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[1:2] == [0x04] and all(tag in (0xA0, 0xA1) for tag in tags[2:])  # elliptic curve


def is_openssh_private_key(data: bytes) -> bool:
    """Whether bytes are the OpenSSH format: magic, then fields with lengths that end where the data end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4])
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):  # cipher, key derivation, its options
        return False
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    return 1 <= keys <= 16 and all(field() for _ in range(keys + 1)) and at == len(data)


def _is_key(data: bytes) -> bool:
    return is_der_private_key(data) or is_openssh_private_key(data)


def _from_base64(text: str, url: bool = False) -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    data = _from_base64(part, url=True)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(text: str) -> bool:
    """Whether three dotted parts are a signed token: JSON header with an algorithm, JSON payload, signature."""
    header, payload, signature = text.split(".")
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(payload) is None:
        return False
    return head["alg"].lower() == "none" or bool(signature and _from_base64(signature, url=True))


def _holds_secret(data: bytes) -> bool:
    if not data.isascii() or any(b < 0x20 and b not in b"\t\r\n" for b in data):
        return False
    text = data.decode("ascii")
    return any(len(m[1]) >= 6 for m in _ASSIGN.finditer(text)) or any(len(m[0]) >= 20 for m in _ACCESS.finditer(text))


def _pem_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    for m in _PEM.finditer(text):
        lines = [line for line in m[2].split("\n") if ":" not in line]
        data = _from_base64("".join("".join(lines).split()))
        if data and (_is_key(data) or ("ENCRYPTED" in m[2] and len(data) % 8 == 0)):
            spans.append(("pem", *m.span()))
    return spans


def scan_text(text: bytes | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of a UTF-8 text's secrets, in code points, by start and then kind."""
    if not text:
        return []
    low = text.lower()
    assigns, accesses = any(w in low for w in _WORDS), b"AKIA" in text
    hexes = b"x" * 24 in text.translate(_HEX_MARKS)
    runs = b"x" * 16 in text.translate(_BASE64_MARKS)
    pems, tokens = b"PRIVATE KEY-----" in text, b"eyJ" in text
    if not (assigns or accesses or hexes or runs or pems or tokens):
        return []
    chars = text.decode("utf-8", "replace")
    spans: list[tuple[str, int, int]] = []
    if assigns:
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(chars) if len(m[1]) >= 6]
    if accesses:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(chars) if len(m[0]) >= 20]
    if hexes:
        spans += [("hex", *m.span()) for m in _HEX.finditer(chars) if len(m[0]) >= 24]
    if pems:
        spans += _pem_spans(chars)
    if tokens:
        spans += [("token", *m.span()) for m in _TOKEN.finditer(chars) if is_signed_token(m[0])]
    if runs:
        inside = [(s, e) for kind, s, e in spans if kind in ("pem", "token")]
        found: dict[tuple[int, int], str] = {}
        for pattern, decode in ((_BASE64, _from_base64), (_ANY_HEX, lambda x: bytes.fromhex(x[: len(x) // 2 * 2]))):
            for m in pattern.finditer(chars):
                if any(s <= m.start() and m.end() <= e for s, e in inside):
                    continue
                data = decode(m[0])
                if data and _is_key(data):
                    found[m.span()] = "key"
                elif data and _holds_secret(data):
                    found.setdefault(m.span(), "encoded")
        spans += [(kind, *at) for at, kind in found.items()]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_parts(batches):
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t)] for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for every row: its secrets as structs ``kind, start, end`` in code points.

    One pass without a shuffle.  A null or empty text has no spans; repeated
    rows repeat theirs, a null id stays null, other columns are not looked at.
    Spans of different kinds may overlap.  Spans that start together come in
    the order of ``KINDS``.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_span_batches, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact_text(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with every stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    covered: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    for start, end in covered:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def _redacted(text_at: int, size_at: int | None, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            column = batch.column(text_at)
            found = {i: spans for i, t in enumerate(column.cast(pa.binary()).to_pylist()) if (spans := scan_text(t))}
            if found:
                texts = column.to_pylist()
                sizes = batch.column(size_at).to_pylist() if size_at is not None else []
                for i, spans in found.items():
                    texts[i] = redact_text(texts[i], spans, mark)
                    if size_at is not None:
                        sizes[i] = len(texts[i])
                columns = list(batch.columns)
                columns[text_at] = pa.array(texts, column.type)
                if size_at is not None:
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return run


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", mark: str = "<secret>") -> DataFrame:
    """``docs`` with secrets replaced by ``mark`` and ``size_col``, if there is one, counted anew where a text changed.

    Every row and column stays; rows without secrets pass unchanged.
    """
    text_at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None
    return docs.mapInArrow(_redacted(text_at, size_at, mark), docs.schema)
