"""URL filters: pattern rules indexed by their rarest literal token.

Every rule lists literal tokens (runs of a-z and 0-9) that any URL it fits must hold, or tokens of which any URL it fits
holds one. A rule is filed under the token that fewest URLs of the corpus hold, or under each of its alternatives; a
URL's tokens fetch candidate rules, and only those run their regular expression. The index is a folded array literal of hash buckets, so judging a URL is one projection without a shuffle.

Base rules are (host, path) suffix rules: a rule fits its host and all subdomains if the path starts with the rule's
path; the longest fitting rule wins, ties alphabetically. Where none fits, the method's verdict holds: block if a
pattern rule fits, else allow.

Defined results: a null URL or one without ``://`` has empty host and path; a null URL is allowed. Each input row gives
one row; repeated rows are judged each. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TOKEN = "[^a-z0-9]+"
#: The index is a literal in the plan; a rule list beyond this is refused rather than shipped with each task.
MAX_RULES = 20_000


@dataclass(frozen=True)
class BaseRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched in the lower-cased URL; each of ``literals`` is a whole token of any URL it fits, and so is
    at least one of ``any_of``, if there are any."""

    name: str
    pattern: str
    literals: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()


# The base rules.
BASE_RULES = (BaseRule("block", "net", "/"), BaseRule("allow", "example.net", "/en/"), BaseRule("block", "example.com", "/de/"), BaseRule("allow", "org", "/fr/"))
# Pattern rules for hosts and paths that carry no prose.
PATTERN_RULES = (
    PatternRule("spam-farm", r"://([^/?#]*[.-])?spam[.-]farm[.-]", ("spam", "farm")),
    PatternRule("link-farm", r"://([^/?#]*[.-])?link[.-]farm[.-]", ("link", "farm")),
    PatternRule("doorway", r"://([^/?#]*[.-])?doorway[.-]", ("doorway",)),
    PatternRule("casino", r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    PatternRule("poker", r"://([^/?#]*[.-])?poker[.-]", ("poker",)),
    PatternRule("porn", r"://([^/?#]*[.-])?porn[.-]", ("porn",)),
    PatternRule("xxx", r"://([^/?#]*[.-])?xxx[./-]", ("xxx",)),
    PatternRule("payday-loans", r"payday[-_/]loans?\b", any_of=("loan", "loans")),
    PatternRule("cheap-pills", r"cheap[-_/]pills\b", ("pills",)),
    PatternRule("wp-login", r"/wp[-_]login\b", ("wp", "login")),
    PatternRule("wp-admin", r"/wp[-_]admin\b", ("wp", "admin")),
    PatternRule("ad-server", r"://ads?\.|/ads/", any_of=("ad", "ads")),
    PatternRule("doubleclick", r"://([^/?#]*\.)?doubleclick\.", ("doubleclick",)),
    PatternRule("session-id", r"[?&;](phpsessid|jsessionid)=", any_of=("jsessionid", "phpsessid")),
    PatternRule("java-session", r"[?&;]jsessionid=", ("jsessionid",)),
)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), TOKEN), lambda t: t != ""))


def token_counts(urls: DataFrame, column: str, tokens: list[str]) -> dict[str, int]:
    """URLs holding each of the rules' tokens: one row a token, pre-aggregated on the executors."""
    wanted = F.array(*[F.lit(t) for t in tokens])
    hits = urls.select(F.explode(F.array_intersect(tokens_of(F.col(column)), wanted)).alias("token"))
    return {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rarest_index(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> tuple[str, int]:
    """The index as JSON, and its number of buckets."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    size = 1 << max(4, (2 * len(rules)).bit_length())
    import zlib

    buckets: list[list[dict]] = [[] for _ in range(size)]
    for r in rules:
        if not (r.literals or r.any_of):
            raise ValueError(f"rule {r.name} has no literal token")
        for key in {min(r.literals, key=lambda t: (counts.get(t, 0), t))} if r.literals else set(r.any_of):
            buckets[zlib.crc32(key.encode()) % size].append({"token": key, "name": r.name, "pattern": r.pattern})
    return json.dumps(buckets), size


def judge(pages: DataFrame, rules=PATTERN_RULES, base=BASE_RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule (the alphabetically first pattern rule that fits)."""
    literals = sorted({t for r in rules for t in r.literals + r.any_of})
    for t in literals:
        if re.search(TOKEN, t):
            raise ValueError(f"{t!r} is not a token")
    index, size = rarest_index(tuple(rules), token_counts(pages, url, literals) if literals else {})
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    buckets = F.from_json(F.lit(index), "array<array<struct<token:string,name:string,pattern:string>>>")
    # a token's bucket of the index, narrowed to the rules filed under this very token
    fetched = F.flatten(F.transform(tokens_of(F.col("url")), lambda t: F.filter(F.element_at(buckets, (F.pmod(F.crc32(t), F.lit(size)) + 1).cast("int")), lambda r: r["token"] == t)))
    lowered = F.lower(F.col("url"))
    fits = F.filter(fetched, lambda r: F.regexp_like(lowered, r["pattern"]))
    rows = rows.withColumn("pattern_rule", F.array_min(F.transform(fits, lambda r: r["name"])))
    ordered = sorted(base, key=lambda r: (-len(r.name), r.name))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("pattern_rule").isNotNull(), "block").otherwise("allow")
    for r in reversed(ordered):
        at = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(at, r.name).otherwise(rule), F.when(at, r.verdict).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "pattern_rule")
