"""Filters as Columns: validity, scope, JSON subsets, metadata conditions, path and header rules."""

from __future__ import annotations

import fnmatch
import json
import re
from functools import reduce

from pyspark.sql import Column, functions as F


def valid_now(as_of: Column, until: str = "valid_until") -> Column:
    return F.col(until).isNull() | (F.col(until) > as_of)


def valid_at(at: Column, since: str = "valid_from", until: str = "valid_until") -> Column:
    """Half-open: valid_from <= at < valid_until."""
    return (F.col(since) <= at) & (F.col(until).isNull() | (F.col(until) > at))


def scope(**wanted) -> Column:
    """Equality on each given column; None is a wildcard."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in wanted.items() if v is not None], F.lit(True))


def time_range(column: str, after=None, before=None) -> Column:
    out = F.lit(True)
    if after is not None:
        out &= F.col(column) >= F.to_timestamp(F.lit(after))
    if before is not None:
        out &= F.col(column) <= F.to_timestamp(F.lit(before))
    return out


def gc(reason: str | None = None, cutoff: Column | None = None, **wanted) -> Column:
    out = F.col("valid_until").isNotNull() & scope(invalidation_reason=reason, **wanted)
    return out if cutoff is None else out & (F.col("valid_until") <= cutoff)


def json_contains(column: Column, wanted) -> Column:
    """Whether the JSON text holds ``wanted``: objects by key, array items by some item, scalars by equality."""
    return F.coalesce(_holds(F.try_parse_json(column), wanted), F.lit(False))


def _holds(v: Column, wanted) -> Column:
    if isinstance(wanted, dict):
        parts = [_holds(F.try_variant_get(v, "$['" + k.replace("'", "\\'") + "']", "variant"), x) for k, x in wanted.items()]
        return reduce(lambda a, b: a & b, parts, F.schema_of_variant(v).startswith("OBJECT"))
    if isinstance(wanted, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        parts = [_some(items, x) for x in wanted]
        return reduce(lambda a, b: a & b, parts, items.isNotNull())
    kind = F.schema_of_variant(v)
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == wanted)
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == wanted)
    return (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (F.try_variant_get(v, "$", "double") == float(wanted))


def _some(items: Column, wanted) -> Column:
    return F.exists(items, lambda e: F.coalesce(_holds(e, wanted), F.lit(False)))


def metadata_condition(column: Column, rule: dict) -> Column:
    """The condition language {field, op, value} and {and: [...]} over JSON text; ops eq, ne, in, not_in, exists."""
    if "and" in rule:
        return reduce(lambda a, b: a & b, [metadata_condition(column, r) for r in rule["and"]], F.lit(True))
    got = F.get_json_object(column, "$." + rule["field"])
    text = lambda x: x if isinstance(x, str) else json.dumps(x)
    op, value = rule.get("op", "eq"), rule.get("value")
    if op == "exists":
        return got.isNotNull() if value in (None, True) else got.isNull()
    if op == "in":
        return F.coalesce(got.isin([text(x) for x in value]), F.lit(False))
    if op == "not_in":
        return ~F.coalesce(got.isin([text(x) for x in value]), F.lit(False))
    if op == "ne":
        return ~got.eqNullSafe(F.lit(text(value)))
    if op == "eq":
        return F.coalesce(got == text(value), F.lit(False))
    raise ValueError(f"unknown op {op!r}")


def all_words(column: Column, query: str) -> Column:
    """Every white-space separated word of two characters or more is contained, whatever the case."""
    words = [w for w in query.lower().split() if len(w) >= 2]
    return reduce(lambda a, b: a & b, [F.contains(F.lower(column), F.lit(w)) for w in words], F.lit(bool(words)))


def generation_visible(generation: int | None, column: str = "generation") -> Column:
    return F.lit(True) if generation is None else (F.col(column) == generation) | F.col(column).isNull()


# Directories, files and suffixes that a corpus scan skips.
SKIP_DIRS = (
    "build", "dist", "out", "target", "node_modules", ".npm", ".yarn", ".pnp", ".dart_tool", ".pub-cache", ".gradle", ".android", "Pods", ".symlinks", "__pycache__", ".venv", "venv",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", "egg-info", ".cargo", ".idea", ".vscode", ".vs", "coverage", ".nyc_output", ".terraform", ".generated", ".next", ".nuxt", ".svelte-kit",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "cargo.lock", "pubspec.lock", "gemfile.lock", "poetry.lock")
GENERATED_SUFFIXES = (".g.dart", ".freezed.dart", ".gr.dart", ".config.dart", ".mocks.dart", ".arb", ".pb.swift", ".min.js", ".min.css", ".bundle.js", ".map", ".d.ts")
GENERATED_DIR = "generated"
# Extensions of code files, and the languages of those that have one.
CODE_EXTENSIONS = (
    "rs", "py", "js", "ts", "jsx", "tsx", "go", "java", "dart", "c", "cpp", "cc", "cxx", "h", "hpp", "hh", "hxx", "m", "mm", "rb", "php", "swift", "kt", "kts", "scala", "sh", "bash", "zsh",
)
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "dart": "dart", "c": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "m": "objective_c", "mm": "objective_c",
}
# Markers in the first 8192 characters of generated sources. A weak one counts beside a request not to edit.
STRONG_MARKERS = ("generated by the protocol buffer compiler", "generated by the swift generator plugin for the protocol buffer compiler", "generated by the swift generator", "@generated")
WEAK_MARKERS = ("auto-generated", "automatically generated", "this file was generated", "generated code", "generated file", "code generated")
DO_NOT_EDIT = ("do not edit", "do not modify", "do not change")
# What tells the language of a header.
OBJECTIVE_C_MARKERS = ("@interface", "@protocol", "@class", "@implementation", "#import <Foundation/", '#import "')
CPP_MARKERS = ("namespace ", "template <", "class ", "std::", "public:", "private:", "protected:")


def _some_of(text: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in markers])


def extension(path: Column) -> Column:
    """Lower-cased, of the last name; none if the name only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def path_kept(path: Column) -> Column:
    """Outside skipped and hidden directories, neither a hidden file nor a lock file nor a generated one, with a code
    extension."""
    low = F.lower(path)
    parts = F.split(low, r"[/\\]")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    bad = F.arrays_overlap(dirs, F.array(*[F.lit(x.lower()) for x in (*SKIP_DIRS, GENERATED_DIR)])) | F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", "..")) | name.isin(*LOCK_FILES)
    for s in GENERATED_SUFFIXES:
        bad = bad | name.endswith(s)
    return ~bad & extension(path).isin(*CODE_EXTENSIONS)


def generated_header(content: Column) -> Column:
    head = F.translate(F.left(content, F.lit(8192)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _some_of(head, STRONG_MARKERS) | (_some_of(head, WEAK_MARKERS) & _some_of(head, DO_NOT_EDIT))


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression; ``**`` crosses directories, ``*`` does not."""
    if "\\" in glob or glob.startswith("/"):
        raise ValueError(f"bad glob {glob!r}: relative paths with / only")
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]*\])", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (fnmatch.translate(part)[4:-3] if part.startswith("[") else re.escape(part))
    return f"^{out}$"


def globs(path: Column, include=(), exclude=()) -> Column:
    """Included by some glob (or no include given) and excluded by none."""
    inside = [path.rlike(glob_regex(g)) for g in include]
    outside = [path.rlike(glob_regex(g)) for g in exclude]
    ok = reduce(lambda a, b: a | b, inside) if inside else F.lit(True)
    return reduce(lambda a, b: a & ~b, outside, ok)


def language(path: Column, content: Column | None = None) -> Column:
    """By extension; headers are Objective-C, else C++, else C by what they hold (unknown where that is not given)."""
    by_ext = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    out = F.coalesce(F.try_element_at(by_ext, extension(path)), F.lit("unknown"))
    if content is None:
        return out
    held = F.coalesce(content, F.lit(""))
    header = F.when(_some_of(held, OBJECTIVE_C_MARKERS), "objective_c").when(_some_of(held, CPP_MARKERS), "cpp").otherwise("c")
    return F.when(extension(path) == "h", header).otherwise(out)


def protected(content: Column, importance: Column) -> Column:
    return content.rlike(r"^\s*(DECISION|PROJECT|USER):") | (importance >= 4.0)


def destructive_guard(id: str | None = None, include_status: list[str] | None = None, **scope_values) -> None:
    """Raise unless a deletion names an id, a scope (user_id, agent_id, run_id, namespace) or states."""
    if not (id and id.strip()) and not include_status and all(v is None for v in scope_values.values()):
        raise ValueError("a destructive operation needs an id, a scope or a status filter")
