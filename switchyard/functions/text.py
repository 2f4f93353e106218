"""Text and identifier expressions, all of them JVM-side unless ``exact`` is asked for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separator of the parts of hashed identifiers.
UNIT = "\x1f"

#: White space as Python's ``str.split`` sees it.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: A run of letters, digits and underscores, or one other visible character.
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ ]"

#: Model families in the order in which their prefixes are tried.
FAMILY_PREFIXES = (
    "qwen2.5-coder",
    "qwen2.5",
    "qwen3-next",
    "qwen3-coder",
    "llama-3.3",
    "llama-3",
    "llama-4",
    "gemma-2",
    "mistral-large-3",
    "mistral-small-3",
    "mistral",
    "ministral",
    "mixtral",
    "devstral",
    "gpt-oss",
    "deepseek-v3",
    "cogito-v2",
    "kimi-k2",
    "nemotron-3",
    "nvidia-nemotron",
    "seed-oss",
    "eurollm",
    "bielik",
    "marin",
    "stockmark-2",
    "step-3.5",
    "rnj-1",
)


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


_ASCII = r"\A[\x00-\x7F]*\z"


@F.pandas_udf(T.StringType())
def _compatibility_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def fold(text: Column | str, exact: bool = False) -> Column:
    """Case-folded text.

    The built-in form lower-cases and writes ``ß`` as ``ss``, which is full
    folding for the Latin scripts of composed text; ``exact`` runs the complete
    compatibility normalisation and folding, in an Arrow UDF that only gets
    text with other characters than ASCII.
    """
    column = _column(text)
    if not exact:
        return F.replace(F.lower(column), F.lit("ß"), F.lit("ss"))
    plain = column.rlike(_ASCII)
    return F.when(plain, F.lower(column)).otherwise(_compatibility_fold(F.when(~plain, column)))


def squeeze(text: Column | str) -> Column:
    """Text with every run of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(_column(text), _SPACE, " "))


def normalize_prompt(prompt: Column | str, exact: bool = True) -> Column:
    """The form in which prompts are compared: folded, single-spaced."""
    return squeeze(fold(prompt, exact))


def normalize_alias(alias: Column | str, exact: bool = False) -> Column:
    """The form in which model aliases are compared.

    Registry and splits fold with compatibility normalisation (``exact``), the
    table rules without; only aliases in compatibility characters differ.
    """
    return squeeze(fold(alias, exact))


def sha256_hex(text: Column | str) -> Column:
    return F.sha2(_column(text), 256)


def joined(*parts: Column | str) -> Column:
    """Parts as text with unit separators; a null part is written ``None``."""
    return F.concat_ws(UNIT, *(F.coalesce(_column(p).cast("string"), F.lit("None")) for p in parts))


def canonical_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix-`` and 24 hex digits of the hash of the joined parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(sha256_hex(joined(*parts)), 1, 24))


def set_id(prefix: str, ids: Column | str) -> Column:
    """``prefix-`` and 20 hex digits of the hash of sorted ids."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(sha256_hex(F.array_join(F.array_sort(_column(ids)), UNIT)), 1, 20))


def tokens(normalized: Column | str) -> Column:
    """Words and single other characters of normalised text."""
    return F.regexp_extract_all(_column(normalized), F.lit(_TOKEN), F.lit(0))


def shingle_hashes(normalized: Column | str, size: int = 3) -> Column:
    """Distinct hashes, 16 hex digits each, of the ``size``-token windows.

    Text of fewer tokens is hashed token by token, text without any as one
    empty token.  Hex digits sort as the unsigned numbers that they stand for.
    """


    def windows(words: Column) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(size - 1)), lambda i: F.concat_ws(UNIT, F.slice(words, i, size)))
        short = F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words)
        return F.when(F.size(words) < size, short).otherwise(long)

    # as the variable of an outer lambda the words are found once, not once a window
    grams = F.transform(F.array(tokens(normalized)), windows)[0]
    return F.array_distinct(F.transform(grams, lambda g: F.substring(F.sha2(g, 256), 1, 16)))


_SIGN = -(1 << 63)


def hash_number(digits: Column | str) -> Column:
    """16 hex digits as a 64-bit integer; numbers sort as the digits do."""
    return F.conv(_column(digits), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))


def hash_digits(number: Column | str) -> Column:
    """The hex digits behind a ``hash_number``."""
    return F.lower(F.lpad(F.hex(_column(number).bitwiseXOR(F.lit(_SIGN))), 16, "0"))


def signature(hashes: Column | str, size: int = 8) -> Column:
    """The ``size`` smallest hashes, in order."""
    return F.slice(F.array_sort(_column(hashes)), 1, size)


def jaccard(left: Column | str, right: Column | str) -> Column:
    """Share of common elements of two arrays without repeats."""
    both = F.size(F.array_intersect(_column(left), _column(right)))
    return both / (F.size(_column(left)) + F.size(_column(right)) - both)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text of an object with sorted keys, nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def scalar_json(value: Column | str, quoted: bool) -> Column:
    """JSON text of one value; an absent value is the text ``null``."""
    column = _column(value)
    if not quoted:
        return F.coalesce(F.to_json(F.array(column)).substr(F.lit(2), F.length(F.to_json(F.array(column))) - 2), F.lit("null"))
    text = F.to_json(F.struct(column.alias("v")))
    return F.when(column.isNull(), F.lit("null")).otherwise(F.regexp_extract(text, r'(?s)\A\{"v":(.*)\}\z', 1))


def source_query_id(value: Column | str) -> Column:
    """A source's own id as text; empty counts as absent."""
    return F.nullif(_column(value).cast("string"), F.lit(""))


def parameter_billions(label: Column | str) -> Column:
    """Billions of parameters of a size label such as ``8B`` or ``0.5b``; null for anything else."""
    number = F.regexp_extract(_column(label), r"(?i)\A([0-9]+(?:\.[0-9]+)?)B\z", 1)
    return F.when(number != "", number).cast("double")


def developer(identifier: Column | str) -> Column:
    """What stands before the first slash, folded; ``unknown`` without a slash."""
    column = _column(identifier)
    return F.when(column.contains("/"), fold(F.substring_index(column, "/", 1))).otherwise(F.lit("unknown"))


def base_name(identifier: Column | str) -> Column:
    """What stands after the last slash."""
    return F.substring_index(_column(identifier), "/", -1)


def family(identifier: Column | str) -> Column:
    """Model family of an identifier: the first known prefix of its base name, else the name itself."""
    name = fold(base_name(identifier))
    name = F.when(name.startswith("meta-llama-"), F.substring(name, 6, 1_000_000)).otherwise(name)
    name = F.when(name.startswith("llama3-"), F.concat(F.lit("llama-3-"), F.substring(name, 8, 1_000_000))).otherwise(name)
    known = [F.when(name.startswith(prefix), F.lit(prefix)) for prefix in FAMILY_PREFIXES]
    return F.coalesce(*known, name)


def slug(text: Column | str) -> Column:
    """Text fit for a path: other characters become ``--``, dashes and dots go from the ends."""
    return F.regexp_replace(F.regexp_replace(_column(text), "[^A-Za-z0-9._-]+", "--"), r"\A[-.]+|[-.]+\z", "")


def parse_iso8601(text: Column | str) -> Column:
    """A timestamp from ISO text that names its offset; null where it doesn't."""
    column = _column(text)
    return F.when(column.rlike(r"(?:Z|[+-]\d{2}:?\d{2})\z"), F.try_to_timestamp(column))


def isoformat(moment: Column | str) -> Column:
    """UTC time, in whatever zone the session is, as Python writes it: microseconds only where there are any."""
    micros = F.unix_micros(_column(moment))
    inside = F.pmod(micros, F.lit(86_400_000_000))
    day = F.date_from_unix_date(((micros - inside) / F.lit(86_400_000_000)).cast("int")).cast("string")
    seconds = F.floor(inside / F.lit(1_000_000))
    clock = [F.lpad(x.cast("string"), 2, "0") for x in (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)]
    part = inside % 1_000_000
    fraction = F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(day, F.lit("T"), F.concat_ws(":", *clock), fraction, F.lit("+00:00"))
