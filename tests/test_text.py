from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from switchyard.functions import prices, text as tx


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalisation_and_shingles(spark):
    assert _one(spark, tx.normalize_prompt(F.lit("  Hello\n WORLD Straße "))) == "hello world strasse"
    assert _one(spark, tx.normalize_prompt(F.lit("ﬁne ①"), exact=True)) == "fine 1"
    assert _one(spark, tx.tokens(F.lit("a, b_1!"))) == ["a", ",", "b_1", "!"]
    expected = sorted(hashlib.sha256("\x1f".join(g).encode()).hexdigest()[:16] for g in (("a", "b", "c"), ("b", "c", "d")))
    assert _one(spark, tx.signature(tx.shingle_hashes(F.lit("a b c d")))) == expected
    assert _one(spark, tx.shingle_hashes(F.lit(""))) == [hashlib.sha256(b"").hexdigest()[:16]]
    assert len(_one(spark, tx.shingle_hashes(F.lit("a b")))) == 2


def test_identifiers_and_labels(spark):
    joined = "\x1f".join(("set", "None", "3"))
    assert _one(spark, tx.canonical_id("qry", F.lit("set"), F.lit(None).cast("string"), F.lit(3))) == "qry-" + hashlib.sha256(joined.encode()).hexdigest()[:24]
    assert [_one(spark, tx.family(F.lit(x))) for x in ("Meta/Meta-Llama-3-8B", "llama3-70b", "qwen/Qwen2.5-Coder-7B", "x/Other-1")] == ["llama-3", "llama-3", "qwen2.5-coder", "other-1"]
    assert [_one(spark, tx.developer(F.lit(x))) for x in ("Org/m", "m")] == ["org", "unknown"]
    assert [_one(spark, tx.parameter_billions(F.lit(x))) for x in ("8B", "0.5b", "8", "xB")] == [8.0, 0.5, None, None]
    assert _one(spark, tx.slug(F.lit("-a b/c.--"))) == "a--b--c"
    assert _one(spark, tx.parse_iso8601(F.lit("2025-01-01T00:00:00"))) is None
    assert _one(spark, tx.isoformat(tx.parse_iso8601(F.lit("2025-01-01T00:00:00.5Z")))) == "2025-01-01T00:00:00.500000+00:00"


def test_cost(spark):
    import pytest

    from switchyard.errors import CanonicalDataError

    rates = prices.PriceRates(1.0, 0.5, 2.0)
    assert prices.compute_cost_usd(input_tokens=1000, cached_input_tokens=200, output_tokens=500, rates=rates) == pytest.approx(0.0019)
    assert prices.compute_cost_usd(input_tokens=1000, cached_input_tokens=200, output_tokens=500, rates=prices.PriceRates(2.0, 1.0, 4.0)) == pytest.approx(0.0038)
    with pytest.raises(CanonicalDataError, match="cached-input price"):
        prices.compute_cost_usd(input_tokens=100, cached_input_tokens=50, output_tokens=0, rates=prices.PriceRates(1.0, None, 2.0))
    with pytest.raises(CanonicalDataError, match="non-negative integer"):
        prices.compute_cost_usd(input_tokens=1.5, output_tokens=0, rates=rates)
    column = prices.cost_usd(F.lit(1000), F.lit(200), F.lit(500), F.lit(1.0), F.lit(0.5), F.lit(2.0))
    assert _one(spark, column) == pytest.approx(0.0019)
    with pytest.raises(Exception, match="cached-input price"):
        _one(spark, prices.cost_usd(F.lit(100), F.lit(50), F.lit(0), F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0)))
