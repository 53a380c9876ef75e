"""URL filters: host and path rules, and pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression with the literal tokens that any URL it matches must hold. Tokens are maximal runs of
``[a-z0-9]`` of the lower-cased URL. Of its tokens each rule is indexed under the one that is rarest among all URLs of the table
(counted by Spark, over the rules' own vocabulary only); a URL's tokens fetch candidate rules, and only those run their
expressions. Rules without a token are candidates everywhere. The index only spares work: it never changes a verdict.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no host rule and is allowed; repeated rows
are judged alike; an empty table gives an empty result; columns other than id and URL are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    tokens: tuple[str, ...] = ()


#: The contract's rules.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
#: Block lists of this kind name what spam hosts and tracking paths are called. Patterns are for lower-cased URLs.
PATTERN_RULES = (
    PatternRule(r"://[^/?#]*\bspam-farm\b", ("spam", "farm")),
    PatternRule(r"://[^/?#]*\bcheap-pills\b", ("cheap", "pills")),
    PatternRule(r"://[^/?#]*\blink-farm\b", ("link", "farm")),
    PatternRule(r"://[^/?#]*\b(?:free-)?casino\b", ("casino",)),
    PatternRule(r"://[^/?#]*\bviagra\b", ("viagra",)),
    PatternRule(r"://[^/?#]*\bporn\b", ("porn",)),
    PatternRule(r"://ads?\d*\.[^/?#]*/(?:banner|click)\b", ()),
    PatternRule(r"[?&]affiliate_id=\d+", ("affiliate", "id")),
)
_TOKEN = re.compile("[a-z0-9]+")


def lowered(url: str) -> str:
    """A-Z as a-z."""
    return url.lower() if url.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), url)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return lowered(m[1]), m[2]


class HostIndex:
    """Finds the longest rule that fits, asking once for each suffix of the host."""

    def __init__(self, rules: tuple[HostRule, ...]):
        self.by_host: dict[str, list[HostRule]] = defaultdict(list)
        for r in rules:
            self.by_host[r.host].append(r)

    def find(self, host: str, path: str) -> HostRule | None:
        best = None
        labels = host.split(".") if host else []
        for i in range(len(labels)):
            for r in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(r.path) and (best is None or len(r.host) + len(r.path) > len(best.host) + len(best.path)):
                    best = r
        return best


class PatternIndex:
    def __init__(self, rules: tuple[PatternRule, ...], counts: dict[str, int]):
        self.by_token: dict[str, list[re.Pattern]] = defaultdict(list)
        self.always = [re.compile(r.pattern) for r in rules if not r.tokens]
        for r in rules:
            if r.tokens:
                self.by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(re.compile(r.pattern))

    def hit(self, url: str) -> bool:
        low = lowered(url)
        seen = set(_TOKEN.findall(low)) & self.by_token.keys()
        return any(p.search(low) for t in seen for p in self.by_token[t]) or any(p.search(low) for p in self.always)


def token_counts(urls: DataFrame, url_col: str, rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; as many numbers as the rules have tokens, whatever the table's size."""
    names = sorted({t for r in rules for t in r.tokens})
    if not names:
        return {}
    held = F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, names)))
    found = urls.select(F.explode(held).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in found}


def judge(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (host rule that fits, else null), verdict (its own, else block if a pattern hits)."""
    ship(pages.sparkSession)
    counts = token_counts(pages, url_col, pattern_rules)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        hosts, patterns = HostIndex(host_rules), PatternIndex(pattern_rules, counts)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for url in b.column(1).to_pylist():
                host, path = parts(url)
                r = hosts.find(host, path)
                blocked = r.verdict == "block" if r else url is not None and patterns.hit(url)
                for x, v in zip(out, (host, path, f"{r.host}{r.path}" if r else None, "block" if blocked else "allow"), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.string()) for x in out]], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    ordered = sorted(host_rules, key=lambda r: -len(r.host) - len(r.path))
    cases = " ".join(f"WHEN ('.' || host) LIKE {_sql('%.' + r.host)} AND starts_with(path, {_sql(r.path)}) THEN {_sql(r.host + r.path)}" for r in ordered)
    blocked = ", ".join(_sql(r.host + r.path) for r in host_rules if r.verdict == "block")
    hits = " OR ".join(f"regexp_matches(lower(url), {_sql(r.pattern)})" for r in pattern_rules)
    return f"""
WITH p AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r AS (SELECT *, CASE {cases} END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ({blocked}) THEN 'block' ELSE 'allow' END
  WHEN url IS NOT NULL AND ({hits}) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
