"""URL filters: pattern rules found by their rarest literal token, and host and path rules.

Each pattern rule names literal tokens that any URL it fits contains. The rule is filed under the one that the fewest URLs
have: the rules' tokens are counted over the whole table first. A URL's tokens fetch the rules filed under them, and only
those run their regular expressions, which read ASCII classes and borders only. Host and path rules are looked up by the
host's suffixes, so no rule is tried in vain there either.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class PatternRule:
    """verdict holds where the regular expression is found in the lower-case URL; literals are whole tokens of it."""

    name: str
    pattern: str
    literals: tuple[str, ...]
    verdict: str = "block"


class RuleIndex:
    """Rules by their rarest literal token; counts: how many URLs have a token, none where it isn't named."""

    def __init__(self, rules: Sequence[PatternRule], counts: Mapping[str, int] | None = None):
        often, shared = counts or {}, Counter(t for r in rules for t in set(r.literals))
        self.by_token: dict[str, list[tuple[int, re.Pattern, str]]] = defaultdict(list)
        for n, r in enumerate(rules):
            if not r.literals:
                raise ValueError(f"rule {r.name} has no literal token")
            if any(not _TOKEN.fullmatch(t) for t in r.literals):
                raise ValueError(f"a literal of rule {r.name} is no token of a-z and 0-9")
            rarest = min(r.literals, key=lambda t: (often.get(t, 0), shared[t], -len(t), t))
            self.by_token[rarest].append((n, re.compile(r.pattern, re.ASCII), r.verdict))

    def verdict(self, url: str) -> str:
        """That of the first fitting rule in their order; allow without one."""
        low = url.translate(_LOWER)
        found = {n: (p, v) for t in set(_TOKEN.findall(low)) if t in self.by_token for n, p, v in self.by_token[t]}
        for n in sorted(found):
            if found[n][0].search(low):
                return found[n][1]
        return "allow"


class HostRules:
    """(verdict, host, path) rules; the longest that fits wins."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for verdict, host, path in rules:
            self.by_host[host].append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            at = ".".join(labels[i:])
            for prefix, verdict in self.by_host.get(at, ()):
                if path.startswith(prefix) and (best is None or len(at) + len(prefix) > len(best[0])):
                    best = (at + prefix, verdict)
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z in lower case, and path; both empty for null or without '://'."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    at = re.search(r"[/?#]", rest)
    host, tail = (rest[: at.start()], rest[at.start() :]) if at else (rest, "")
    return host.translate(_LOWER), re.split(r"[?#]", tail, maxsplit=1)[0]


SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_ARROW = pa.schema([("page_id", pa.int64()), *((x, pa.string()) for x in ("host", "path", "rule", "verdict"))])


def token_counts(pages: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """How many URLs have each of the tokens: a row a token reaches the driver."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)))
    wanted = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in sorted(set(tokens))], "token string"))  # the rules'
    rows = pages.select(F.explode(found).alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def url_verdicts(pages: DataFrame, host_rules: Sequence[tuple[str, str, str]], patterns: Sequence[PatternRule]) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A null url, or one without '://', has an empty host and path, fits no host rule and gets the pattern rules' verdict:
    that of the first fitting rule in their order, allow without one. Of host rules that fit the longest wins; of two as
    long, the first. Repeated rows are judged each for itself; a url of any length is read whole; an empty table gives no
    rows; other columns aren't read, whatever their names.
    """
    host_rules, patterns = tuple(host_rules), tuple(patterns)
    counts = token_counts(pages, [t for r in patterns for t in r.literals]) if patterns else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, index = HostRules(host_rules), RuleIndex(patterns, counts)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                fit = hosts.find(host, path)
                rows.append((host, path, *(fit or (None, index.verdict(url or "")))))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.string()) for c in columns)], schema=_ARROW)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, SCHEMA)
