"""Code-corpus ETL: chunks, symbols, references, containment, incremental actions, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import tightest_parent

MAX_CHUNK, MIN_CHUNK, WINDOW_LINES = 4000, 10, 150


def line_windows(files: DataFrame, id_col: str, text_col: str, lines: int = WINDOW_LINES) -> DataFrame:
    """(id, window, start_line, end_line, content): fixed windows of lines, 1-based; each row is cut on its own."""
    each = files.select(F.col(id_col).alias("id"), F.split(F.col(text_col), "\n").alias("ls"))
    flat = each.select("id", "ls", F.explode(F.sequence(F.lit(0), ((F.size("ls") - 1) / lines).cast("int"))).alias("window"))
    part = F.slice(F.col("ls"), F.col("window") * lines + 1, F.lit(lines))
    return flat.select("id", "window", (F.col("window") * lines + 1).alias("start_line"), F.least(F.size("ls"), (F.col("window") + 1) * lines).alias("end_line"), F.array_join(part, "\n").alias("content"))


def structural_chunks(files: DataFrame, id_col: str, text_col: str, most: int = MAX_CHUNK, least: int = MIN_CHUNK) -> DataFrame:
    """(id, chunk, start_line, end_line, content): paragraphs gathered up to ``most`` bytes.

    A chunk closed by the next paragraph ends one line before it and is kept whatever its length; the last one ends at the
    line counter itself and has at least ``least`` bytes."""
    kind = "struct<s:int,e:int,c:string>"
    zero = F.struct(F.lit("").alias("cur"), F.lit(1).alias("start"), F.lit(1).alias("line"), F.array().cast(f"array<{kind}>").alias("out"))
    # lines of a paragraph: one that ends with a line break has no further, empty line
    lines = lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit("\n"), F.lit(""))) + F.when((s == "") | s.endswith("\n"), 0).otherwise(1)
    closed = lambda s, end: F.concat(s["out"], F.array(F.struct(s["start"].alias("s"), end.cast("int").alias("e"), s["cur"].alias("c"))))

    def add(s, p):
        full = (s["cur"] != "") & (F.octet_length(s["cur"]) + F.octet_length(p) > most)
        cur = F.when(full | (s["cur"] == ""), p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p))
        start = F.when(full, s["line"]).otherwise(s["start"])
        return F.struct(cur.alias("cur"), start.cast("int").alias("start"), (s["line"] + lines(p) + 1).cast("int").alias("line"), F.when(full, closed(s, s["line"] - 1)).otherwise(s["out"]).alias("out"))

    folded = F.aggregate(F.split(F.col(text_col), "\n\n"), zero, add, lambda s: F.when(F.octet_length(s["cur"]) >= least, closed(s, s["line"])).otherwise(s["out"]))
    flat = files.select(F.col(id_col).alias("id"), F.posexplode(folded).alias("chunk", "x"))
    return flat.select("id", "chunk", F.col("x.s").alias("start_line"), F.col("x.e").alias("end_line"), F.col("x.c").alias("content"))


# What defines a symbol and what refers to one, by language; group 1 is the name. Line-wise patterns, not a parser.
DEFINITIONS = {
    "rust": (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)")),
    "python": (("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")),
    "typescript": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)")),
    "javascript": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?class\s+(\w+)")),
    "go": (("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("class", r"^type\s+(\w+)")),
    "java": (("class", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private|protected)\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|protected)\s+)*enum\s+(\w+)")),
    "c": (("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(\w+)"), ("function", r"^(?:\w[\w\s*]*\s[\s*]*)(\w+)\s*\([^;]*$")),
    "cpp": (("namespace", r"^\s*namespace\s+(\w+)"), ("class", r"^\s*class\s+(\w+)"), ("struct", r"^\s*struct\s+(\w+)"), ("enum", r"^\s*enum\s+(?:class\s+)?(\w+)"), ("function", r"^(?:\w[\w\s*:<>&]*\s[\s*&]*)(?:\w+::)?(\w+)\s*\([^;]*$")),
    "swift": (("interface", r"^\s*(?:public\s+)?protocol\s+(\w+)"), ("class", r"^\s*(?:public\s+|final\s+)*(?:class|struct)\s+(\w+)"), ("enum", r"^\s*(?:public\s+)?enum\s+(\w+)"), ("function", r"^\s*(?:public\s+|private\s+|static\s+)*func\s+(\w+)")),
    "dart": (("class", r"^\s*(?:abstract\s+)?class\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("class", r"^\s*(?:mixin|extension)\s+(\w+)"), ("function", r"^\s*(?:[\w<>?]+\s+)(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{")),
    "kotlin": (("module", r"^\s*package\s+([\w.]+)"), ("interface", r"^\s*interface\s+(\w+)"), ("class", r"^\s*(?:data\s+|open\s+|abstract\s+|sealed\s+)*(?:class|object)\s+(\w+)"), ("function", r"^\s*(?:private\s+|override\s+|suspend\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)")),
    "objective_c": (("interface", r"^\s*@protocol\s+(\w+)"), ("class", r"^\s*@(?:interface|implementation)\s+(\w+)"), ("method", r"^\s*[-+]\s*\([^)]*\)\s*(\w+)")),
}
CALL = r"(\w+)\s*\("
IMPORTS = r"^\s*(?:use|import|from|#include|#import|require)\s+[<\"']?([\w./:]+)"
EXTENDS = r"\b(?:extends|implements|:\s*public)\s+(\w+)|class\s+\w+\(([\w.]+)\)|impl\s+(\w+)\s+for"
KEYWORDS = ("if", "for", "while", "switch", "match", "return", "fn", "def", "func", "function", "class", "catch", "sizeof", "fun", "elif", "and", "or", "not", "print")


# What opens a scope without being a symbol; kinds whose inner definitions are chunks too; their labels in a
# context path.
SCOPES = {"rust": (("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"),)}
OPEN_KINDS = ("impl", "trait", "module", "class", "interface", "namespace", "enum")
LABELS = {"module": "mod", "impl": "impl", "trait": "trait", "class": "class", "function": "fn", "method": "fn", "namespace": "ns", "interface": "iface"}
MIN_OTHER_LINES = 3


def _defined(line: Column, language: Column) -> Column:
    """struct(kind, name) of the definition on a line, by its language's patterns alone; null if there is none."""
    out = None
    for lang, rules in DEFINITIONS.items():
        found = [F.when(F.regexp_extract(line, p, 1) != "", F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, p, 1).alias("name"))) for kind, p in (*SCOPES.get(lang, ()), *rules)]
        out = F.when(language == lang, F.coalesce(*found)) if out is None else out.when(language == lang, F.coalesce(*found))
    return out


def _code_lines(language: str, content: str) -> list[str]:
    """The lines without what is inside strings and comments; their number stays."""
    import re

    if language == "python":
        inside = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|#[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    else:
        # a quoted character, or where quotes hold strings a string; raw strings between backticks
        single = r"'(?:\\.|[^'\\\n])*'" if language in ("javascript", "typescript", "dart") else r"'(?:\\.|[^'\\\n])'"
        raw = r"|`[^`]*`" if language in ("javascript", "typescript", "go") else ""
        inside = r'/\*[\s\S]*?\*/|//[^\n]*|"(?:\\.|[^"\\])*"|' + single + raw
    keep = lambda m: "\n" * m.group().count("\n") or '""' * (m.group()[0] in "\"'`")
    return re.sub(inside, keep, content).split("\n")


def _block_end(lines: list[str], depth: list[int], start: int, language: str, indent: int, starts: dict[int, int]) -> int:
    """The last line of the definition on line ``start`` (both from 0). By indentation in Python; else by brackets: where
    the depth is back at what it was, or at a semicolon or another definition before any bracket opens."""
    if language == "python":
        end = start
        for j in range(start + 1, len(lines)):
            x = lines[j]
            if x.strip():
                # a closing bracket of a declaration over several lines may stand as far out as its beginning
                if len(x) - len(x.lstrip()) <= indent and x.lstrip()[0] not in ")]}":
                    break
                end = j
        return end
    if language == "objective_c" and lines[start].lstrip().startswith("@"):
        return next((j for j in range(start, len(lines)) if lines[j].lstrip().startswith("@end")), len(lines) - 1)
    before, opened, full = depth[start - 1] if start else 0, False, start
    for j in range(start, len(lines)):
        # no body: another definition comes, or the bracket around closes
        if j > start and not opened and (starts.get(j, indent + 1) <= indent or depth[j] < before):
            return full
        full = j if lines[j].strip() else full
        opened |= "{" in lines[j]
        if opened and depth[j] <= before:
            return j
        if not opened and lines[j].rstrip().endswith(";"):
            return j
    return len(lines) - 1


def _nodes(batches):
    """(row, language, content, defs) -> (row, nodes): the definitions with their ends, the scopes around them and whether
    they are chunks; and runs of other lines outside all of them."""
    import pyarrow as pa

    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("path", pa.string()), ("chunk", pa.bool_())])
    for b in batches:
        out = []
        for language, content, defs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            lines = _code_lines(language, content)
            depth, d = [], 0
            for x in lines:
                d += x.count("{") - x.count("}")
                depth.append(d)
            # a definition inside a comment or a string is none
            defs = [x for x in defs if lines[x["line"] - 1].strip()]
            starts = {x["line"] - 1: x["indent"] for x in defs}
            nodes, around, covered = [], [], -1
            for x in defs:
                at = x["line"] - 1
                while around and around[-1][1] < at:
                    around.pop()
                end = _block_end(lines, depth, at, language, x["indent"], starts)
                if around:
                    end = min(end, around[-1][1])
                path = " > ".join(f"{LABELS[k]}:{n}" for _, _, k, n in around if k in LABELS)
                if at > covered + 1:
                    nodes += _others(lines, covered + 1, at)
                nodes.append((at + 1, end + 1, x["kind"], x["name"], path or None, all(k in OPEN_KINDS for _, _, k, _ in around)))
                around.append((at, end, x["kind"], x["name"]))
                covered = max(covered, end)
            out.append([dict(zip(("start", "end", "kind", "name", "path", "chunk"), n)) for n in nodes + _others(lines, covered + 1, len(lines))])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(kind))], ["row", "nodes"])


def _others(lines: list[str], low: int, high: int) -> list[tuple]:
    """Runs of lines that are not blank, ``MIN_OTHER_LINES`` of them at least."""
    out, begin = [], None
    for j in range(low, high + 1):
        full = j < high and lines[j].strip() != ""
        if full and begin is None:
            begin = j
        elif not full and begin is not None:
            if j - begin >= MIN_OTHER_LINES:
                out.append((begin + 1, j, "other", None, None, True))
            begin = None
    return out


def nodes(files: DataFrame) -> DataFrame:
    """(file_path, content, start, end, kind, name, path, chunk) of ``files(file_path, language, content)``: definitions at
    any depth and other stretches of code, in order.

    A file is a row from end to end; its definitions are an array, whose ends one pass finds. Nothing is shuffled."""
    each = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line"), _defined(x, F.col("language")).alias("d"), F.char_length(F.regexp_extract(x, r"^(\s*)", 1)).alias("indent")))
    defs = F.transform(F.filter(each, lambda x: x["d"].isNotNull()), lambda x: F.struct(x["line"].alias("line"), x["indent"].alias("indent"), x["d"]["kind"].alias("kind"), x["d"]["name"].alias("name")))
    row = files.where("content is not null").select(F.struct("file_path", "content").alias("row"), "language", "content", defs.alias("defs"))
    out = row.mapInArrow(_nodes, f"row {row.schema['row'].dataType.simpleString()}, nodes array<struct<start:int,end:int,kind:string,name:string,path:string,chunk:boolean>>")
    return out.select("row.file_path", "row.content", F.explode("nodes").alias("x")).select("file_path", "content", "x.*")


def extract_symbols(files: DataFrame) -> DataFrame:
    """(file_path, name, symbol_type, start_line, end_line, signature): definitions and the lines of their blocks."""
    n = nodes(files).where("name is not null and kind <> 'impl'")
    return n.select("file_path", "name", F.col("kind").alias("symbol_type"), F.col("start").alias("start_line"), F.col("end").alias("end_line"), signature(F.get(F.split("content", "\n"), F.col("start") - 1)).alias("signature"))


def definition_chunks(files: DataFrame, most: int = MAX_CHUNK, least: int = MIN_CHUNK, lines: int = WINDOW_LINES) -> DataFrame:
    """(file_path, chunk, start_line, end_line, content, chunk_type, name, context_path): a chunk a definition, also inside
    classes, modules and the like, with the scopes around it as its path; other code in runs of ``MIN_OTHER_LINES`` lines.

    A definition of more than ``most`` bytes is cut every ``lines`` lines; files without any chunk are cut by paragraphs.
    Chunks are numbered by start, then end."""
    n = nodes(files).where("chunk")
    body = F.slice(F.split("content", "\n"), F.col("start"), F.col("end") - F.col("start") + 1)
    n = n.select("file_path", "start", "end", "kind", "name", "path", body.alias("body")).withColumn("text", F.array_join("body", "\n")).where(F.octet_length("text") >= least)
    step = F.when(F.octet_length("text") > most, F.lit(lines)).otherwise(F.size("body"))
    n = n.withColumn("step", step).withColumn("k", F.explode(F.expr("sequence(0, (size(body) - 1) div step)")))
    cut = n.select(
        "file_path", (F.col("start") + F.col("k") * F.col("step")).cast("int").alias("start_line"), F.least(F.col("end"), F.col("start") + (F.col("k") + 1) * F.col("step") - 1).cast("int").alias("end_line"),
        F.array_join(F.slice("body", (F.col("k") * F.col("step") + 1).cast("int"), F.col("step")), "\n").alias("content"), F.when(F.octet_length("text") > most, "other").otherwise(F.col("kind")).alias("chunk_type"), "name", F.col("path").alias("context_path"),
    ).where(F.octet_length("content") >= least)
    rest = files.join(cut.select("file_path").distinct(), "file_path", "left_anti")
    plain = structural_chunks(rest, "file_path", "content", most, least).select(F.col("id").alias("file_path"), "start_line", "end_line", "content", F.lit("other").alias("chunk_type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("context_path"))
    number = Window.partitionBy("file_path").orderBy("start_line", "end_line", "chunk_type")
    return cut.unionByName(plain).withColumn("chunk", (F.row_number().over(number) - 1).cast("int")).select("file_path", "chunk", "start_line", "end_line", "content", "chunk_type", "name", "context_path")


def signature(line: Column) -> Column:
    """The declaration up to its body, white space collapsed, 500 characters at most."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(line, r"\s*[{:]\s*$", ""), r"\s+", " ")), F.lit(500))


#: Lines of a stretch in which references meet the symbols that cover it.
STRETCH = 64


def extract_references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, owner, owner_line, to_name, relation_type, line_number): calls, imports, extends; the owner is the
    first symbol whose lines cover the reference and whose name it isn't, else ``global``, line 0.

    References and symbols meet by file and stretch of lines, so a long file is joined by pieces."""
    rows = files.select("file_path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("line_number", F.col("pos") + 1)
    calls = F.filter(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)), lambda n: ~n.isin(*KEYWORDS))
    tag = lambda xs, kind: F.transform(xs, lambda n: F.struct(F.lit(kind).alias("relation_type"), n.alias("to_name")))
    one = lambda p, g: F.filter(F.array(F.regexp_extract("line", p, g)), lambda n: n != "")
    parents = F.concat(one(EXTENDS, 1), one(EXTENDS, 2), one(EXTENDS, 3))
    refs = rows.select("file_path", "line_number", F.posexplode(F.concat(tag(calls, "calls"), tag(one(IMPORTS, 1), "imports"), tag(parents, "extends"))).alias("k", "r"))
    refs = refs.select("file_path", "line_number", "k", "r.relation_type", "r.to_name", F.floor(F.col("line_number") / STRETCH).cast("long").alias("stretch"))
    part = lambda c: F.floor(F.col(c) / STRETCH).cast("long")
    s = symbols.select(F.col("file_path").alias("sf"), F.col("name").alias("owner"), F.col("start_line").alias("sl"), F.col("end_line").alias("el"), F.explode(F.sequence(part("start_line"), part("end_line"))).alias("at"))
    both = refs.join(s, (F.col("file_path") == F.col("sf")) & (F.col("stretch") == F.col("at")) & F.col("line_number").between(F.col("sl"), F.col("el")) & (F.col("owner") != F.col("to_name")), "left")
    first = both.groupBy("file_path", "line_number", "k", "relation_type", "to_name").agg(F.min(F.struct("sl", "owner")).alias("o"))
    return first.select("file_path", F.coalesce("o.owner", F.lit("global")).alias("owner"), F.coalesce("o.sl", F.lit(0)).alias("owner_line"), "to_name", "relation_type", "line_number")


def containment(symbols: DataFrame) -> DataFrame:
    return tightest_parent(symbols.select("file_path", F.col("id"), F.col("start_line").alias("start"), F.col("end_line").alias("end")), "file_path")


def manifest_diff(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, action): deleted, added or changed files; unchanged ones are left out. One full join by path."""
    s, n = stored.select("path", F.col("hash").alias("old")), scanned.select("path", F.col("hash").alias("new"))
    both = s.join(n, "path", "full")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("new"), "update")
    return both.select("path", action.alias("action")).where("action is not null")


def incremental_actions(changed: DataFrame, hashes: DataFrame) -> DataFrame:
    """(path, action): missing or generated files are deleted, equal hashes skipped, all else replaced.

    ``changed``: (path, hash or null if missing, generated); ``hashes``: (path, hash) of the store."""
    h = hashes.select("path", F.col("hash").alias("known"))
    both = changed.join(h, "path", "left")
    action = F.when(F.col("hash").isNull() | F.col("generated"), "delete").when(F.col("hash") == F.col("known"), "skip").otherwise("upsert")
    return both.select("path", action.alias("action"))


def abandoned_generations(tables: list[DataFrame], active: DataFrame) -> DataFrame:
    """(project_id, generation) present in some table but not active."""
    every = tables[0].select("project_id", "generation")
    for t in tables[1:]:
        every = every.union(t.select("project_id", "generation"))
    return every.where("generation is not null").distinct().join(active.select("project_id", "generation"), ["project_id", "generation"], "left_anti")


def progress(files_done: Column, files: Column, embedded: Column, chunks: Column) -> Column:
    """Percent done: parsing, of which 30 parts in 100 wait for the vectors."""
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return F.round(share(files_done, files) * (0.70 + 0.30 * share(embedded, chunks)) * 100, 6)



#: Larger files are recorded as failed, not read further.
MAX_FILE_BYTES = 1_000_000


def marked(files: DataFrame) -> DataFrame:
    """``files`` with the state of each; what isn't indexed keeps its state only, not its content."""
    from ..functions.predicates import generated_header

    state = F.when(generated_header(F.col("content")), "skipped").when(F.octet_length("content") > MAX_FILE_BYTES, "failed").otherwise("indexed")
    return files.withColumn("state", state).withColumn("content", F.when(F.col("state") == "indexed", F.col("content")))


def extract(files: DataFrame) -> dict[str, DataFrame]:
    """What became of each of the ``marked`` files (file_path, language, content, state, further columns), and the
    ``chunks``, ``symbols`` and ``references`` of those indexed; generated files are skipped and oversized ones fail.

    Stored files are best, as they are read several times; symbols and references are stored, as relations read them."""
    from ..functions.text import symbol_id
    from ..workspace import stored

    good = files.where("state = 'indexed'").select("file_path", "language", "content")
    chunks = definition_chunks(good)
    symbols = stored(extract_symbols(good).withColumn("id", symbol_id(F.lit("project"), F.col("file_path"), F.col("name"), F.col("start_line").cast("string"))), "index-symbols")
    refs = extract_references(good, symbols).withColumn("ref_id", F.xxhash64("file_path", "line_number", "relation_type", "to_name", "owner")).withColumn("name", F.col("to_name"))
    return {"files": files.drop("content", "language"), "chunks": chunks, "symbols": symbols, "references": stored(refs, "index-references")}


def relate(symbols: DataFrame, refs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """References with the symbols that they mean, of this run before ``known`` ones (id, name, file_path)."""
    from .joins import resolve_relations

    fresh = symbols.select("id", "name", "file_path")
    return resolve_relations(refs.select("ref_id", "name", "file_path").distinct(), fresh, fresh.limit(0) if known is None else known)


def index_project(files: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """One generation of a project from its files (file_path, language, content): ``files`` with what became of each,
    ``chunks``, ``symbols``, ``references`` and ``relations`` between symbols. ``known``: symbols of earlier generations."""
    from ..workspace import stored

    got = extract(stored(marked(files), "index-files"))
    return got | {"relations": relate(got["symbols"], got["references"], known)}
