"""Text expressions: the code-aware tokenizer, identifiers, retrieval queries, prefixes, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Record prefixes and words that mark a query as being about code.
PREFIXES = ("TASK", "DECISION", "CONTEXT", "PROJECT", "USER", "EPIC", "RESEARCH")
CODE_TERMS = ("fn", "function", "class", "struct", "trait", "impl", "method", "module", "import", "enum", "interface")
SPLIT = r"[^\p{L}\p{N}]+"
_CAMEL = r"[a-z][A-Z]|[0-9][A-Za-z]|[A-Z][A-Z][a-z]"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for a body that uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def raw_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def camel_parts(word: Column) -> Column:
    """Lower-cased parts of an identifier: fooBar2baz -> foo, bar2, baz; HTTPServer -> http, server."""
    w = F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2")
    w = F.regexp_replace(w, "([0-9])([A-Za-z])", "$1 $2")
    w = F.regexp_replace(w, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.split(F.lower(w), " ")


def tokens(text: Column) -> Column:
    """Parts of each word, then the whole word unless it is its only part; repeats stay."""
    each = lambda w: F.when(w.rlike(_CAMEL), F.concat(camel_parts(w), F.array(F.lower(w)))).otherwise(F.array(F.lower(w)))
    return F.flatten(F.transform(raw_words(text), each))


def identifier_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(text)))


def codeish(query: Column) -> Column:
    marks = query.rlike(r"_|::|/|\.") | query.rlike("[a-z][A-Z]")
    return marks | F.arrays_overlap(F.split(F.lower(query), r"\s+"), F.array(*[F.lit(t) for t in CODE_TERMS]))


def single_identifier(query: Column) -> Column:
    return (F.char_length(query) >= 8) & query.rlike("^[A-Za-z0-9_:.]+$") & query.rlike("[a-z][A-Z]")


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dedup_key(content: Column, content_hash: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h:"), content_hash), F.concat(F.lit("c:"), F.lower(normalize_space(content))))


# What marks a wrapped prompt, its context block, task headings in order of rank, and the longest query.
WRAPPERS = ("<system-reminder", "<Work_Context>", "<!-- MEMORY_MCP_INTERNAL_INITIATOR -->")
CONTEXT_OPEN, CONTEXT_CLOSE = "<Work_Context>", "</Work_Context>"
TASK_MARKERS = ("## 1. TASK", "## TASK", "# TASK", "TASK:")
QUERY_CHARS = 4096
_WHITE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _from_last(text: Column, marker: str) -> Column:
    return F.concat(F.lit(marker), F.substring_index(text, marker, -1))


def _task_section(text: Column) -> Column:
    """From the last heading of the first kind that the text has; null without one."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(m)), _from_last(text, m)) for m in TASK_MARKERS])


def effective_query(text: Column) -> Column:
    """struct(query, origin, original_chars, effective_chars, truncated): the part of a prompt that asks, white space
    collapsed, ``QUERY_CHARS`` characters at most. Only wrapped prompts are taken apart."""
    has = lambda m: F.contains(text, F.lit(m))
    blank = lambda c: c.rlike(f"^[{_WHITE}]*$")
    after = F.when(has(CONTEXT_CLOSE), F.substring_index(text, CONTEXT_CLOSE, -1))
    rest = after.isNotNull() & ~blank(after)
    pick = lambda q, o: F.struct(q.alias("q"), F.lit(o).alias("o"))
    chosen = (
        F.when(~(has(WRAPPERS[0]) | has(WRAPPERS[1]) | has(WRAPPERS[2])), pick(text, "direct"))
        .when(rest & _task_section(after).isNotNull(), pick(_task_section(after), "task_section")).when(rest, pick(after, "post_work_context"))
        .when(_task_section(text).isNotNull(), pick(_task_section(text), "task_section")).when(has(CONTEXT_OPEN), pick(_from_last(text, CONTEXT_OPEN), "work_context"))
        .otherwise(pick(text, "prompt_context"))
    )
    chosen = let(chosen, lambda c: F.when(blank(c["q"]) & ~blank(text), pick(text, "direct_fallback")).otherwise(c))
    flat = lambda c: F.trim(F.regexp_replace(c, f"[{_WHITE}]+", " "))
    cut = lambda t, o: let(F.rtrim(F.left(t, F.lit(QUERY_CHARS))), lambda q: F.struct(q.alias("query"), o.alias("origin"), F.char_length(text).alias("original_chars"), F.char_length(q).alias("effective_chars"), (F.char_length(t) > QUERY_CHARS).alias("truncated")))
    return let(chosen, lambda c: let(flat(c["q"]), lambda t: cut(t, c["o"])))


def prefix_of(content: Column) -> Column:
    """The record prefix before the first colon, or an empty string."""
    return F.regexp_extract(content, rf"^\s*({'|'.join(PREFIXES)}):", 1)


def token_estimate(content: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(content) / 4)).cast("long")


def task_priority(content: Column) -> Column:
    low = F.lower(content)
    flag = lambda c, w: F.when(c, w).otherwise(0)
    return flag(F.contains(low, F.lit("in_progress")), 4) + flag(F.contains(low, F.lit("current:")), 2) + flag(F.contains(low, F.lit("[ ]")), 1)


def active_task(content: Column) -> Column:
    low = F.lower(content)
    return F.contains(low, F.lit("in_progress")) | F.contains(low, F.lit("current:")) | F.contains(low, F.lit("[ ]"))


def word_set(content: Column) -> Column:
    """Distinct lower-cased words of three characters or more; - and _ are part of words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"[^\p{L}\p{N}_-]+"), lambda w: F.char_length(w) >= 3))


def likeness(a: Column, b: Column) -> Column:
    """Overlap of the word sets of two texts; 0 where either has no word."""
    return jaccard(word_set(a), word_set(b))


# What marks a record as an operational detail.
DETAIL_MARKS = ("command:", "path:", "current:", "verification", "failed", "blocker", "updated:", "todo", "continue", "`", "/")


def operational(content: Column) -> Column:
    return let(F.lower(content), lambda low: F.exists(F.array(*[F.lit(m) for m in DETAIL_MARKS]), lambda m: F.contains(low, m)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def term_frequency(content: Column, words: list[str]) -> Column:
    """Occurrences of the words per byte, in thousands, between 0.01 and 1."""
    low = F.lower(content)
    hits = [(F.char_length(low) - F.char_length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words]
    raw = reduce(lambda a, b: a + b, hits, F.lit(0.0)) / (F.octet_length(content) + 1) * 1000
    return F.greatest(F.lit(0.01), F.least(F.lit(1.0), raw))


def document_text(path: Column, name: Column, context: Column, content: Column) -> Column:
    """What a code chunk is searched by: path, name and context raw and with separators opened, then the content."""
    opened = lambda c: F.translate(c, "/\\._-:", "      ")
    return F.concat_ws(" ", path, opened(path), name, opened(name), context, opened(context), content)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def needs_reembed(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new) | old.isNull()


def symbol_id(project: Column, path: Column, name: Column, line: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(project, path, name, line)), 16, "0"))


def import_id(old: Column, payload: Column) -> Column:
    """The id of an imported record whose own is taken: the same for the same payload."""
    return F.concat(old, F.lit("-import-"), F.left(F.md5(payload), F.lit(16)))


def project_id(path: Column, collides: Column) -> Column:
    leaf = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when(collides, F.concat_ws("-", leaf, F.left(F.sha2(path, 256), F.lit(6)))).otherwise(leaf)


def hash_embedding(text: Column, dim: int) -> Column:
    """A deterministic vector for tests: bytes of the text's SHA-256 over 255, repeated."""
    byte = lambda i: F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), i % 32 * 2 + 1, 2), 16, 10).cast("float") / F.lit(255.0)
    return F.array(*[byte(i).cast("float") for i in range(dim)])


def parse_time(text: Column) -> Column:
    """ISO 8601; blank is null, nonsense is null (compare with the input to tell them apart)."""
    return F.when(F.trim(text) == "", F.lit(None).cast("timestamp")).otherwise(F.try_to_timestamp(text))


# ---------------------------------------------------------------- lexical rerank


def lexical_rerank(query: Column, terms: Column, path: Column, name: Column, context: Column, content: Column, is_code: Column) -> Column:
    """0 to 1: a term counts once, where it stands first of name, path, context and content; name, path and the whole
    query are strong evidence. ``query`` is lower-cased, ``terms`` an array."""
    lo = lambda c: F.lower(F.coalesce(c, F.lit("")))
    use = F.filter(terms, lambda t: F.char_length(t) >= 2)

    def body(f):
        whole = (F.octet_length(query) >= 4) & (F.contains(f["p"], query) | F.contains(f["n"], query) | F.contains(f["x"], query))
        weight = lambda t: F.when(F.contains(f["n"], t), 0.7).when(F.contains(f["p"], t), 0.55).when(F.contains(f["x"], t), 0.45).when(F.contains(f["c"], t), 0.2).otherwise(0.0)
        got = F.transform(use, weight)
        strong = whole | F.exists(got, lambda w: w >= 0.55)
        share = F.when(F.size(terms) > 0, 0.8 * F.size(F.filter(got, lambda w: w > 0)) / F.size(terms)).otherwise(0.0)
        raw = F.when(whole, 1.8).otherwise(0.0) + F.aggregate(got, F.lit(0.0), lambda a, w: a + w) + share
        raw = raw + F.when(is_code & strong, 0.8).otherwise(0.0) - F.when((F.octet_length(F.coalesce(content, F.lit(""))) < 96) & ~strong, 0.6).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(4.0), raw)) / 4.0

    return let(F.struct(lo(path).alias("p"), lo(name).alias("n"), lo(context).alias("x"), lo(content).alias("c")), body)


def symbol_exactness(query: Column, terms: Column, name: Column, signature: Column) -> Column:
    """0 to 1: how exactly a symbol's name and signature meet the lower-cased query and its terms."""
    def body(f):
        n, s, own = f["n"], f["s"], f["own"]
        long = F.octet_length(query) >= 4
        raw = F.when(n == query, 2.2).when(long & F.contains(n, query), 1.6).otherwise(0.0) + F.when((s != "") & long & F.contains(s, query), 0.8).otherwise(0.0)
        use = F.filter(terms, lambda t: F.char_length(t) >= 2)
        got = F.transform(use, lambda t: F.when(F.array_contains(own, t), 0.55).when(F.contains(n, t) | F.contains(s, t), 0.35).otherwise(0.0))
        raw = raw + F.aggregate(got, F.lit(0.0), lambda a, w: a + w) + F.when(F.size(terms) > 0, 0.8 * F.size(F.filter(got, lambda w: w > 0)) / F.size(terms)).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(4.0), raw)) / 4.0

    return let(F.struct(F.lower(name).alias("n"), F.lower(F.coalesce(signature, F.lit(""))).alias("s"), identifier_tokens(name).alias("own")), body)


def symbol_probes(query: Column, terms: Column) -> Column:
    """The trimmed query and its four longest terms of three characters or more, sorted and distinct."""
    ranked = F.array_sort(F.transform(F.filter(terms, lambda t: F.octet_length(t) >= 3), lambda t: F.struct((-F.octet_length(t)).alias("n"), t.alias("t"))))
    longest = F.transform(F.slice(ranked, 1, 4), lambda x: x["t"])
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.trim(query)), longest), lambda q: q != "")))
