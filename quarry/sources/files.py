"""File sources: source trees, JSONL, change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import predicates
from ..workspace import hadoop_path, stored


def source_tree(spark: SparkSession, root: str, include=(), exclude=(), max_bytes: int = 1_000_000) -> DataFrame:
    """(file_path, content, language, hash, skipped): code files below ``root`` that no ignore file rules out; large and
    generated ones are marked.

    Paths are filtered before contents are read; of other files only the ignore files are."""
    include, exclude = list(include), list(exclude)
    for g in include + exclude:
        predicates.glob_regex(g)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.substring_index("path", base.lstrip("/") + "/", -1), "^/+", "")
    kept = files.withColumn("file_path", rel).where(predicates.path_kept(F.col("file_path")) & predicates.globs(F.col("file_path"), include, exclude))
    deepest = kept.agg(F.max(F.size(F.split("file_path", "/")))).first()[0] or 0
    held = _ignore_files(spark, root, deepest)
    if held:
        rules = ignore_rules(spark.createDataFrame(held, "path string, content string").select(rel.alias("file_path"), "content"))
        kept = kept.join(ignored(kept.select("file_path"), rules), "file_path", "left_anti")
    text = kept.withColumn("content", F.when(F.col("length") <= max_bytes, F.decode("content", "UTF-8")))
    skipped = F.when(F.col("length") > max_bytes, "too_large").when(predicates.generated_header(F.col("content")), "generated")
    return text.select("file_path", "content", predicates.language(F.col("file_path"), F.coalesce("content", F.lit(""))).alias("language"), F.sha2("content", 256).alias("hash"), skipped.alias("skipped"))


def jsonl_lines(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(line_no, raw): the lines of a file, or of a folder's files in order of name, numbered from 1; blank lines count and
    are left out.

    The file is read in splits of bytes, each by a task; lines are numbered within their split, splits get their first
    line's number from the running sum of their counts, so no task reads a whole file."""
    from pyspark.sql import Window

    conf, key = spark.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(key)
    conf.set(key, str(split_bytes))
    try:
        # a split's lines come in their order: their ids rise within it
        rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        rows = stored(rows, "jsonl-lines")
    finally:
        conf.set(key, before)
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a row a split: the running count is one small window
    offset = splits.withColumn("before", F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")).select("file", "start", "first", "before")
    out = rows.join(F.broadcast(offset), ["file", "start"])
    return out.select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), F.col("value").alias("raw")).where(F.trim("raw") != "")


def _ignore_files(spark: SparkSession, root: str, deepest: int) -> list[tuple[str, str]]:
    """(path, content) of the ignore files of the folders above files of a depth. Spark's readers leave hidden files out,
    so they are found by name and read by the driver: small files, a bounded number."""
    out: list[tuple[str, str]] = []
    utils = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    for d in range(deepest):
        fs, p = hadoop_path(spark, f"{root.rstrip('/')}{'/*' * d}/{{{','.join(IGNORE_FILES)}}}")
        for f in fs.globStatus(p) or []:
            if len(out) >= MOST_IGNORE_FILES:
                raise ValueError(f"more than {MOST_IGNORE_FILES} ignore files")
            stream = fs.open(f.getPath())
            out.append((str(f.getPath()), utils.toString(stream, "UTF-8")))
            stream.close()
    return out


#: More ignore files than these are an error.
MOST_IGNORE_FILES = 10_000
#: Files that hold the ignore rules of a folder.
IGNORE_FILES = (".gitignore", ".ignore")


def ignore_rules(files: DataFrame) -> DataFrame:
    """(folder, n, pattern, keep, dirs): the rules of the ignore files among ``files(file_path, content)``, in order of
    force within a folder, as regular expressions over paths relative to the folder.

    Blank lines and comments are none. ``!`` takes a path back in, a trailing ``/`` means folders only, a slash elsewhere
    ties the rule to its folder, ``*`` and ``?`` stay within a name, ``**`` crosses names."""
    name = F.element_at(F.split("file_path", "/"), -1)
    mine = files.where(name.isin(*IGNORE_FILES)).select(F.regexp_extract("file_path", "^(.*/)?[^/]*$", 1).alias("folder"), F.array_position(F.array(*[F.lit(x) for x in IGNORE_FILES]), name).alias("which"), F.posexplode(F.split("content", "\r?\n")).alias("k", "line"))
    r = mine.withColumn("line", F.regexp_replace("line", r"(?<!\\)\s+$", "")).where("line <> '' and not startswith(line, '#')")
    r = r.withColumn("keep", F.startswith("line", F.lit("!"))).withColumn("p", F.regexp_replace(F.regexp_replace("line", "^!", ""), r"^\\([!#])", "$1"))
    r = r.withColumn("dirs", F.endswith("p", F.lit("/"))).withColumn("p", F.regexp_replace("p", "/+$", "")).where("p <> ''")
    tied = F.contains(F.regexp_replace("p", "/+$", ""), F.lit("/"))
    quoted = F.regexp_replace(F.regexp_replace("p", "^/", ""), r"([.+(){}^$|\\])", r"\\$1")
    marked = F.replace(F.replace(F.replace(quoted, F.lit("**/"), F.lit("\u0001")), F.lit("/**"), F.lit("\u0002")), F.lit("**"), F.lit("\u0003"))
    plain = F.replace(F.replace(marked, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    plain = F.replace(plain, F.lit("[!"), F.lit("[^"))
    body = F.replace(F.replace(F.replace(plain, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit("/.*")), F.lit("\u0003"), F.lit("[^/]*"))
    pattern = F.concat(F.lit("^"), F.when(tied, "").otherwise("(?:.*/)?"), body, F.lit("$"))
    return r.select("folder", (F.col("which") * 1_000_000 + F.col("k")).alias("n"), pattern.alias("pattern"), "keep", "dirs")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths(file_path)`` that some rule ignores: the last fitting rule of the deepest folder decides, for the path and
    each folder above it; what is inside an ignored folder can't be taken back.

    Paths and rules meet by folder: a path is joined with the rules of the folders above it, nothing else."""
    depth = F.size(F.split("file_path", "/"))
    names = F.split("file_path", "/")
    # each part of a path, with each folder above that part
    each = paths.select("file_path").distinct().select("file_path", F.explode(F.sequence(F.lit(1), depth)).alias("d")).withColumn("part", F.array_join(F.slice(names, 1, F.col("d")), "/"))
    above = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), k), "/"), F.lit("/"))))
    met = each.withColumn("folder", F.explode(above)).withColumn("rest", F.expr("substring(part, length(folder) + 1)")).withColumn("whole", F.col("d") == depth)
    hit = met.join(rules, "folder").where((~F.col("dirs") | ~F.col("whole")) & F.expr("rest rlike pattern"))
    last = hit.groupBy("file_path", "d").agg(F.max_by("keep", F.struct(F.char_length("folder"), "n")).alias("keep"))
    return last.where("not keep").select("file_path").distinct()


def change_stream(spark: SparkSession, path: str, schema, max_files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
