"""Secret scans: a trigram inverted index chooses the texts on which a rule's regular expression runs.

1. *Queries.* From each rule's pattern a Boolean trigram query is derived: an AND of ORs of trigrams that any match must
   hold.
2. *Postings.* Each trigram that some rule asks for has a list of the texts that hold it, by the text's hash; copies of a
   text are one entry. Texts are dealt to blocks of about ``BLOCK_TEXTS`` by their hash, and a block's lists are a row, so
   no list grows with the corpus.
3. *Candidates.* In each block the lists are intersected and united rule by rule. A rule without mandatory trigrams scans
   every text.
4. *Verification.* Candidates meet the texts by hash (equal hashes of different texts only add candidates), and the rule's
   regular expression runs there.

Positions come from the texts between matches: ``split`` keeps them, ``regexp_extract_all`` keeps the matches, and running
sums of both lengths, made in as many passes as the number of matches has bits, give spans in code points. Matches are
leftmost and do not overlap within a kind.

Defined results: null text is empty and has no span. Each row gives one row, repeated ones too. Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ._common import bounded, partitions_for, stored

try:
    from re import _parser as sre
except ImportError:  # pragma: no cover
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """``least``: code points that a match (or its ``group``) must have, else it is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("git_pat", r"github_pat_[A-Za-z0-9_]{40,}"),
    Rule("lab_token", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat_token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("temporary_access", r"ASIA[A-Z0-9]{16}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@[A-Za-z0-9.-]+"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9+/_.=-]{24,}"),
)
_MOST_STRINGS = 64


# ---------------------------------------------------------------- trigram queries


def _strings(items) -> tuple[list[set[str]], set[str] | None]:
    """(sets of alternatives of which a match holds one, the finite set of strings that the items match, or None)."""
    must: list[set[str]] = []
    now: set[str] | None = {""}

    def flush():
        nonlocal now
        if now and all(len(s) >= 3 for s in now):
            must.append(now)
        now = {""}

    whole = True
    for op, arg in items:
        name = str(op)
        alt: set[str] | None = None
        inner: list[set[str]] = []
        if name == "LITERAL":
            alt = {chr(arg)}
        elif name == "SUBPATTERN":
            inner, alt = _strings(arg[3])
        elif name == "BRANCH":
            parts = [_strings(b) for b in arg[1]]
            alt = set().union(*[p[1] for p in parts]) if all(p[1] is not None for p in parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            got = _strings(body)
            if high == 1 and got[1] is not None:
                alt = got[1] | ({""} if low == 0 else set())
            elif low > 0:
                inner = got[0]
        elif name == "IN":
            chars = [chr(v) for o, v in arg if str(o) == "LITERAL"]
            alt = set(chars) if len(chars) == len(arg) and len(chars) <= 8 else None
        if alt is not None and now is not None and len(alt) * len(now) <= _MOST_STRINGS:
            now = {a + b for a, b in product(now, alt)}
        else:
            whole = False
            flush()
            if alt is not None:
                now = set(alt)
            must += inner
    if whole:
        return must, now
    flush()
    return must, None


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """AND of ORs of ANDs: each clause lists alternatives, each alternative the lower-cased trigrams of a string."""
    clauses, whole = _strings(sre.parse(pattern))
    if whole and all(len(s) >= 3 for s in whole):
        clauses = clauses + [whole]
    grams = lambda s: frozenset(s[i : i + 3].lower() for i in range(len(s) - 2))
    return [frozenset(grams(s) for s in c) for c in clauses]


#: Texts of a block of postings, about.
BLOCK_TEXTS = 1 << 15


def _asked(query, lists: Column, number: dict[str, int]) -> Column:
    """The texts of a block that meet a rule's query, by its lists (a map from a trigram's number to texts)."""
    none = F.array().cast("array<bigint>")
    held = lambda t: F.coalesce(F.element_at(lists, F.lit(number[t])), none)
    total = None
    for clause in query:
        either = None
        for alternative in sorted(clause, key=sorted):
            both = None
            for t in sorted(alternative):
                both = held(t) if both is None else F.array_intersect(both, held(t))
            either = both if either is None else F.array_union(either, both)
        total = either if total is None else F.array_intersect(total, either)
    return total


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block, lists): for each block of texts the trigrams' lists; ``texts``: (key, low), the lower-cased texts."""
    blocks = partitions_for(texts.sparkSession, texts.count(), BLOCK_TEXTS)
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    each = texts.select("key", F.explode(held).alias("gram")).distinct()
    lists = each.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_list("key").alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(of, rules): the texts, by key, on which rules with mandatory trigrams must run, as bits of the rules' numbers."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for c in q for a in c for t in a})
    number = {t: i for i, t in enumerate(trigrams)}
    index = stored(postings(texts, trigrams), "secret-postings")
    hits = [F.transform(_asked(q, F.col("lists"), number), _numbered(i)) for i, q in enumerate(queries) if q]
    found = index.select(F.explode(F.flatten(F.array(*hits))).alias("x"))
    return found.groupBy(F.col("x.key").alias("of")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.rule"))).alias("rules"))


def _numbered(i: int):
    return lambda key: F.struct(key.alias("key"), F.lit(i).alias("rule"))


# ---------------------------------------------------------------- spans


def running(values: Column, join) -> Column:
    """The values of an array joined from its start to each place (sums, largest), by doubling steps: the work is the
    length times its number of bits."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int"))

    def step(acc, k):
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, join(x, F.get(acc, i - back))).otherwise(x))

    return F.aggregate(steps, values, step)


def _spans(text: Column, rule: Rule, order: int, length) -> Column:
    """array<struct<s, o, e>> of the kept matches of a rule, in order; ``length`` measures texts."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    tested = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole, lambda t: F.char_length(t))
    wide = F.transform(whole, lambda m: length(m))
    steps = F.zip_with(wide, F.slice(between, 1, F.size(whole)), lambda m, b: m + length(b))
    ends = running(steps, lambda a, b: a + b)
    spans = F.zip_with(ends, wide, lambda e, m: F.struct((e - m).alias("s"), F.lit(order).alias("o"), e.alias("e")))
    kept = F.filter(F.arrays_zip(spans.alias("x"), tested.alias("n")), lambda z: z["n"] >= rule.least)
    return F.transform(kept, lambda z: z["x"])


def _digest(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, length=F.char_length) -> DataFrame:
    """All columns of ``docs`` and ``_spans``: array<struct<s, o, e>>, o the number of the rule, unsorted.

    ``length`` is what positions count: code points, or bytes by ``octet_length``."""
    keep = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text"), F.xxhash64(text).alias("_key"))
    found = stored(candidates(docs.select(F.xxhash64(text).alias("key"), F.lower(text).alias("low")), rules), "secret-candidates")
    rows = rows.join(bounded(found), F.col("_key") == F.col("of"), "left").withColumn("_rules", F.coalesce("rules", F.lit(0).cast("long")))
    none = F.array().cast("array<struct<s:int,o:int,e:int>>")
    spans = []
    for i, r in enumerate(rules):
        hit = F.regexp_like(F.col("_text"), F.lit(r.pattern))
        asked = F.col("_rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        spans.append(F.when(asked & hit if trigram_query(r.pattern) else hit, _spans(F.col("_text"), r, i, length)).otherwise(none))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.concat(*spans).alias("_spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as kind:start:end by start, then kind."""
    kinds = [r.kind for r in rules]
    found = find_spans(docs.select("doc_id", "text"), rules)
    base = [i for i, r in enumerate(rules) if r.base]
    count = lambda i: F.size(F.filter("_spans", lambda x: x["o"] == i)).cast("long")
    own = F.filter("_spans", lambda x: x["o"].isin(base))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{rules[i].kind}") for i in base], F.sha2(_digest(own, kinds), 256).alias("base_sha256"), _digest(F.col("_spans"), kinds).alias("spans")
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask`` (overlapping spans by one); same columns."""
    # by position: any column names pass through
    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    # in bytes: a piece of a byte string is cut without counting what stands before it
    found = find_spans(plain, rules, F.octet_length)

    def masked(v, upto):
        """``v``: the text's bytes and sorted spans; ``upto``: where each span and those before it end."""
        piece = lambda at, n: F.substring(v["bytes"], at + 1, n).cast("string")
        before = F.transform(v["spans"], lambda x, i: F.struct(x["s"].alias("s"), F.when(i > 0, F.get(upto, i - 1)).otherwise(0).alias("at")))
        parts = F.transform(F.filter(before, lambda x: x["s"] >= x["at"]), lambda x: F.concat(piece(x["at"], x["s"] - x["at"]), F.lit(mask)))
        return F.concat(F.array_join(parts, ""), piece(F.element_at(upto, -1), F.octet_length(v["bytes"])))

    # bound once: what a lambda refers to by a column would be computed again for each span
    bound = F.struct(F.col("text").cast("binary").alias("bytes"), F.array_sort("_spans").alias("spans"))
    clean = let(bound, lambda v: let(running(F.transform(v["spans"], lambda x: x["e"]), F.greatest), lambda upto: masked(v, upto)))
    clean = F.when(F.size("_spans") == 0, F.col("text")).otherwise(clean)
    return found.select(*[clean.alias(c) if c == "text" else F.col(c) for c in plain.columns]).toDF(*docs.columns)
