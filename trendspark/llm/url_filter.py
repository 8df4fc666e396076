"""URL filters: host rules and pattern rules indexed by their rarest literal token.

A host rule names a host (with its subdomains) and the start of a path; among
those that fit the longest wins. A URL that no host rule fits is judged by
pattern rules: ``*`` stands for any text, ``^`` for a separator or the end,
``|`` at either end for the URL's own start or end, ``@@`` in front makes an
exception; case doesn't matter. The literal tokens of a pattern (runs of letters
and digits that it bounds on both sides) must occur in every URL it matches.
Each rule is filed under the one of them that the fewest URLs hold, counted over
all URLs; the tokens of a URL fetch the candidate rules, and only those run
their regular expression. A rule without such a token is a candidate for all.

Rules are a parameter, not data: their index travels with the tasks. A task compiles
a rule when the rule is first fetched, so tables of many thousands of rules are fine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


HOST_RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"),
              HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))

#: The method's rules for what no host rule fits.
PATTERN_RULES = ("/spam-farm.", ".spam-farm.", "/cheap-pills.", ".cheap-pills.", "/casino^", "-casino.", "/adult/*",
                 "/click-tracker^", "^utm_source=spam^", "@@/en/archive^")


def pattern_regex(rule: str) -> str:
    """The regular expression of a pattern, without its exception mark; the same in RE2."""
    body = rule.removeprefix("@@").lower()
    start, end = body.startswith("|"), body.endswith("|")
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
    out = "".join(parts.get(c) or (c if c.isalnum() else "\\" + c) for c in body[start:len(body) - end])
    return "^" * start + out + "$" * end


def literal_tokens(rule: str) -> list[str]:
    """Tokens that any URL matched by the rule has as whole tokens."""
    body = rule.removeprefix("@@").lower()
    found = []
    for m in _TOKEN.finditer(body):
        before, after = body[m.start() - 1:m.start()], body[m.end():m.end() + 1]
        if before not in ("", "*") and after not in ("", "*"):
            found.append(m.group())
    return found


def token_counts(urls: DataFrame, url_col: str, rules: tuple[str, ...]) -> dict[str, int]:
    """How many URLs hold each literal token of the rules (at most a few per rule)."""
    wanted = sorted({t for r in rules for t in literal_tokens(r)})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.split(F.lower(F.coalesce(F.col(url_col), F.lit(""))), "[^a-z0-9]+"))
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string"))  # a few per rule
    rows = urls.select(F.explode(tokens).alias("t")).join(wanted, "t").groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["t"]: r["n"] for r in rows}


def rule_index(rules: tuple[str, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules by their rarest token; under '' those that have none."""
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        tokens = literal_tokens(rule)
        index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else "", []).append(i)
    return index


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    at = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:at], rest[at:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), rest[:end]


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               host_rules: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[str, ...] = PATTERN_RULES) -> DataFrame:
    """One row per input row: the identifier, ``host``, ``path``, ``rule`` (the host
    rule that decided; else null), ``verdict`` and ``pattern`` (the pattern that
    decided; else null).

    Exceptions win over other patterns; without any match the verdict is allow.
    Null URLs and URLs without ``://`` have empty host and path. Rows that repeat
    are judged each; other columns are not read, so names can't clash. Very long URLs are
    judged whole. Of equally long host rules (ties) the last by name wins, of several patterns the
    first in the table. An empty table
    gives an empty result.
    """
    index = rule_index(patterns, token_counts(pages, url_col, patterns))
    by_host: dict[str, list[HostRule]] = {}
    for r in host_rules:
        by_host.setdefault(r.host, []).append(r)

    def host_rule(host: str, path: str) -> HostRule | None:
        labels = host.split(".")
        fits = [r for k in range(len(labels)) for r in by_host.get(".".join(labels[k:]), ()) if path.startswith(r.path)]
        return max(fits, key=lambda r: (len(r.name), r.name), default=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @cache
        def search(i: int) -> Callable:
            return re.compile(pattern_regex(patterns[i]), re.DOTALL).search

        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, pattern = host_rule(host, path), None
                if rule:
                    verdict = rule.action
                else:
                    low = (url or "").lower()
                    ids = sorted({i for t in {"", *_TOKEN.findall(low)} for i in index.get(t, ())})
                    hits = [patterns[i] for i in ids if search(i)(low)]
                    pattern = next((p for p in hits if p.startswith("@@")), hits[0] if hits else None)
                    verdict = "block" if pattern and not pattern.startswith("@@") else "allow"
                rows.append((host, path, rule.name if rule else None, verdict, pattern))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)],
                                             names=[id_col, "host", "path", "rule", "verdict", "pattern"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(url_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string, pattern string")
