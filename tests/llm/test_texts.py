"""Operators that work row by row: exact against libraries and plain re-statements."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from switchyard.llm import secrets as sc
from switchyard.llm.language import identify_languages, learn_prototypes
from switchyard.llm.piece_bpe import PieceDecoder, PieceDigester, PieceEncoder, decode_pieces, digest_pieces, encode_pieces
from switchyard.llm.piece_model import PieceModel
from switchyard.llm.tokens import WordEncoder
from switchyard.llm.unigram_counts import UnigramCounter, count_tokens
from switchyard.llm.url_filter import RuleIndex, SITE_RULES, Rule, filter_urls, split_url

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
BITS = ["a", "b", "aa", "the", " ", "  ", "   ", "\n", " \n", "\n ", "▁", "é", "日本", "\0", "<s>", "</s>", "<0x41>", "😀", "ing", "tion", "....", ",", "12", "\u200b", "\t", "İ", "ΑΣ", "ﷺ", "\r\n", "aaaaaaa", "<|endoftext|>", "it's", "Don't", "\x1c"]


def _fuzz(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["", " ", "\n", *("".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n))]


def test_piece_encoding_equals_the_library():
    import sentencepiece

    library, encoder, decoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceEncoder(PIECES), PieceDecoder(PIECES)
    texts = _fuzz(1500, 1)
    ids = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)]
    assert ids == library.encode(texts)
    assert [decoder.decode(x) for x in ids] == library.decode(ids)
    rng = random.Random(4)
    wild = [[rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randint(0, 9))] for _ in range(1500)]
    assert [decoder.decode(x) for x in wild] == [library.decode(x) for x in wild]


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_piece_digests_equal_the_library(limit):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceDigester(PIECES, limit)
    texts = _fuzz(800, 5)
    ids = library.encode(texts)
    expected = [(len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i).encode()).hexdigest()) for i in ids]
    assert [d for at in range(0, len(texts), 64) for d in own.digests(texts[at : at + 64])] == expected


def test_unigram_counts_equal_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = PieceModel(PIECES)
    library = Tokenizer(models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = _fuzz(1500, 2)
    assert UnigramCounter(PIECES).counts(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_word_encoding_equals_the_library(limit):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(WORDS), _fuzz(800, 3)
    own = WordEncoder(WORDS, max_words=limit)
    got = [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), 64) for x in own.encode(texts[at : at + 64])]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_coding_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (1, "a b")], "doc_id long, text string").withColumn("ids", F.lit(0))
    coded = decode_pieces(encode_pieces(docs, PIECES), PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in coded) == [(0, ""), (1, "a b"), (1, "a b"), (2, "")]
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in count_tokens(docs, PIECES).collect()) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert encode_pieces(docs.limit(0), PIECES).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    digests = digest_pieces(docs.withColumn("n_tokens", F.lit("x")), PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded_sha256"] == empty) for r in digests) == [(0, 0, True), (1, 2, False), (1, 2, False), (2, 0, True)]
    assert digest_pieces(docs.limit(0), PIECES).count() == 0


def _der(tag: int, body: bytes) -> bytes:
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2)
    return bytes([tag]) + size + body


RSA = _der(0x30, _der(2, b"\0") + b"".join(_der(2, bytes([1]) * 70) for _ in range(8)))


def test_secret_kinds():
    key = base64.b64encode(RSA).decode()
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "1"})) + ".c2ln"
    hidden = base64.b64encode(b"the password = hunter2hunter").decode()
    text = f"é pw PassWord: 'abc123' AKIA{'A' * 16} {'0f' * 12} {key} x {token} y {hidden} z"
    kinds = [(k, text[s:e]) for k, s, e in sc.scan_text(text.encode())]
    assert [k for k, _ in kinds] == ["assign", "access", "hex", "key", "token", "encoded"]
    assert dict(kinds)["key"] == key and dict(kinds)["token"] == token and dict(kinds)["hex"] == "0f" * 12
    broken = base64.b64encode(RSA[:-1]).decode()
    assert sc.scan_text(broken.encode()) == [] and sc.scan_text(token.replace("eyJ", "eyK").encode()) == []
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, *_ in sc.scan_text(pem.encode())] == ["pem"]
    assert sc.is_der_private_key(RSA) and not sc.is_der_private_key(RSA + b"\0")


@pytest.mark.parametrize("secret", [b"token=abc123", b"password=hunter2", b"AKIA" + b"A1" * 8])
def test_short_encoded_secrets(spark, secret):
    for coded in (base64.b64encode(secret).decode(), secret.hex().upper()):
        text = f"é see {coded} there"
        # a run of digits within upper-case hexadecimal is a base kind of its own
        assert [text[s:e] for k, s, e in sc.scan_text(text.encode()) if k == "encoded"] == [coded]
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert sc.redact_secrets(docs).first()["text"] == "é see <secret> there"
    for harmless in (b"token = abcde", b"just some words", b"AKIA" + b"A1" * 7 + b"A"):
        assert "encoded" not in {k for coded in (base64.b64encode(harmless), harmless.hex().upper().encode()) for k, *_ in sc.scan_text(coded)}


def _base_spans(text: str) -> list[tuple[str, int, int]]:
    """The three base patterns as agreed on, one after the other."""
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [("assign", *m.span())] if len(m[2]) >= 6 else []
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], sc.KINDS.index(s[0])))


def test_base_secrets_against_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["password", "API_KEY", "apikey", "tokEn", "ſecret", "toKen", ":", "=", " ", "'", '"', "abc", "AKIA", "ABCDEFGH", "0123456789ab", "é", "\n", "xyz", "==", "/"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for t in texts:
        assert [s for s in sc.scan_text(t.encode()) if s[0] in sc.BASE_KINDS] == _base_spans(t)
    docs = spark.createDataFrame([(1, "token=abcdef!", 13, "x"), (2, None, None, "y"), (3, "clean", 5, None)], "doc_id long, text string, n_chars long, spans string")
    out = {r["doc_id"]: (r["text"], r["n_chars"], r["spans"]) for r in sc.redact_secrets(docs).collect()}
    assert out == {1: ("<secret>!", 9, "x"), 2: (None, None, "y"), 3: ("clean", 5, None)}
    assert sc.scan_secrets(docs).where("size(spans) > 0").count() == 1


def test_url_rules(spark):
    urls = ["http://a.example.com/en/1", "https://WWW.example.com/en/x?q", "https://x.net/es/", "https://x.net/esx", "https://xnet/es/", "http://example.com", "no scheme", None, "http://a.com?b://c/", "https://cheap-pills.org/x", "https://ok.org/pills"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages).orderBy("page_id").collect()]
    assert got == [
        ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("x.net", "/es/", "net/es/", "block"),
        ("x.net", "/esx", None, "allow"),
        ("xnet", "/es/", None, "allow"),
        ("example.com", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.com", "", None, "allow"),
        ("cheap-pills.org", "/x", None, "block"),
        ("ok.org", "/pills", None, "allow"),
    ]


def test_url_index_equals_trying_every_rule():
    rng = random.Random(6)
    bits = ["com", "net", "example", "www", ".", "/", "en", "es", "fr", "-", "://", "http", "?", "EN", "Com"]
    plain = RuleIndex(tuple(Rule(r.name, r.verdict, r.pattern, ()) for r in SITE_RULES), {})
    filed = RuleIndex(SITE_RULES, {"com": 5, "net": 9, "en": 1, "es": 2, "fr": 3})
    for _ in range(3000):
        parts = split_url("http://" + "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))))
        a, b = filed.judge(*parts), plain.judge(*parts)
        assert (a and a.name) == (b and b.name)


def test_languages_against_plain_profiles(spark):
    """Every cosine from letter vectors bound and bundled run by run."""
    rng = random.Random(17)
    letters = ["abcde ", "éèxyz ", "αβγδΣ ", "日本語 1,"]
    rows = [(i, "".join(rng.choice(letters[(k := i % 4)] if rng.random() < 0.8 else letters[k - 1]) for _ in range(rng.randint(0, 60))), f"l{i % 4}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    vectors: dict[str, np.ndarray] = {}

    def vector(c: str) -> np.ndarray:
        if c not in vectors:
            vectors[c] = np.random.default_rng([7, ord(c)]).integers(0, 2, 1024) * 2 - 1
        return vectors[c]

    def profile(text: str) -> np.ndarray:
        folded = "".join(c.lower() if c.isalpha() else " " for c in text)
        padded = re.sub(" +", " ", f" {folded} ")
        runs = [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "]
        bundle = sum((np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in runs), np.zeros(1024))
        return bundle / (np.linalg.norm(bundle) or 1)

    own = {i: profile(t) for i, t, _ in rows}
    sums = {lang: sum(own[i] for i, _, x in rows if x == lang and i % 3 != 1) for lang in ("l0", "l1", "l2", "l3")}
    want = {i: [float(p @ (s / np.linalg.norm(s))) for s in sums.values()] for i, p in own.items()}
    for r in identify_languages(docs, learn_prototypes(docs.where("doc_id % 3 <> 1"))).collect():
        if any(c.isalpha() for c in rows[r["doc_id"]][1]):
            assert r["score"] == pytest.approx(max(0.0, max(want[r["doc_id"]])), abs=1e-5)
            assert want[r["doc_id"]][int(r["lang_pred"][1])] == pytest.approx(max(want[r["doc_id"]]), abs=1e-5)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_languages(spark):
    rng = random.Random(7)
    words = {"aa": ["bari", "lomu", "teka", "mino"], "bb": ["schrt", "grümpf", "kneck", "wolz"], "cc": ["éàu", "èoiê", "auxé", "çeau"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 30))), lang) for i in range(240) for lang in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    learned = learn_prototypes(docs.where("doc_id % 3 <> 0"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_languages(docs, learned).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows if i % 3 == 0) / sum(i % 3 == 0 for i, *_ in rows) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values()) and [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert identify_languages(docs, learn_prototypes(docs.limit(0))).where("lang_pred <> 'und'").isEmpty()
