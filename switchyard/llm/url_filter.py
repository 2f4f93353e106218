"""URL filters: pattern rules behind an index of their rarest literal token.

A rule is a regular expression over ``host + path`` that has been made from
literals, so it knows which whole tokens (runs of a-z and 0-9) a URL must hold
for it to match.  A first pass counts in how many URLs each of these tokens
occurs; each rule is then filed under its rarest one.  In the second pass a
URL's tokens fetch the rules filed under them, and only those run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rules are sent to every executor; more than this are refused.
MAX_RULES = 100_000

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """What to do with URLs that a pattern matches.

    ``pattern`` is searched in the host and path joined, A-Z of the host
    lower-cased.  ``tokens`` are whole tokens that every match implies; without
    any the rule runs on every URL.  Of the rules that match, those with
    ``listed`` go before others, then the longest name wins, then the first in
    order of names.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = True


def host_rule(spec: str, verdict: str) -> Rule:
    """A rule written ``host/path``: the host and its subdomains, paths that start with ``/path``."""
    host, slash, path = spec.partition("/")
    # the last token of a path may go on in the URL, so only tokens with an end count
    closed = _TOKEN.findall(host.lower()) + [t for t in re.findall(r"([a-z0-9]+)(?=[^a-z0-9A-Z])", path)]
    return Rule(spec, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(closed))


#: Fixed rules of the registered query, as agreed on.
SITE_RULES = (
    host_rule("com/", "allow"),
    host_rule("example.com/en/", "block"),
    host_rule("www.example.com/en/", "allow"),
    host_rule("net/es/", "block"),
    host_rule("net/fr/", "block"),
)

#: Words that name junk sites when they are a whole token of the host; they speak where no listed rule does.
JUNK_TOKENS = ("casino", "pills", "spam", "viagra", "porn", "xxx", "warez", "payday")
JUNK_RULES = tuple(Rule(f"junk:{t}", "block", rf"\A(?:[^/]*[^a-z0-9/])?{t}(?![a-z0-9])[^/]*(?:/|\Z)", (t,), listed=False) for t in JUNK_TOKENS)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a URL; both empty if it is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def url_tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(host + path))


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: tuple[Rule, ...], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            held = (rule, re.compile(rule.pattern))
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (frequency.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(held)
            else:
                self.always.append(held)

    def judge(self, host: str, path: str) -> Rule | None:
        """The rule that decides, or None."""
        found = [rule for rule, pattern in self.always if pattern.search(host + path)]
        for token in url_tokens(host, path) & self.by_token.keys():
            found += [rule for rule, pattern in self.by_token[token] if pattern.search(host + path)]
        return min(found, key=lambda r: (not r.listed, -len(r.name), r.name), default=None)


def _token_counts(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = wanted.value, Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                counts.update(url_tokens(*split_url(url)) & tokens)
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def _verdicts(index, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: RuleIndex = index.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [rules.judge(*p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([r.name if r and r.listed else None for r in found], pa.string()),
                    pa.array([r.verdict if r else default for r in found], pa.string()),
                    pa.array([r.name if r and not r.listed else None for r in found], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    return run


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + JUNK_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, pattern)`` for every row of ``pages``.

    ``rule`` names the listed rule that decided and ``pattern`` another one, if
    any did; where none matches the verdict is ``default``.  A null URL, or one
    without ``://``, has an empty host and path.  A rule ``host/`` needs a path
    that starts with ``/``.  Repeated rows repeat their verdict, other columns
    are not looked at.  Neither pass shuffles pages.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to the executors")
    spark = pages.sparkSession
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    wanted = spark.sparkContext.broadcast({t for r in rules for t in r.tokens})
    counts = chosen.select("url").mapInArrow(_token_counts(wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    index = RuleIndex(rules, {r["token"]: r["n"] for r in counts.collect()})
    out = "page_id long, host string, path string, rule string, verdict string, pattern string"
    return chosen.mapInArrow(_verdicts(spark.sparkContext.broadcast(index), default), out)
