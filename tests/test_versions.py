"""Versions, generations and the living index: what is published is whole, and what grew equals what is built anew."""

import random

import pytest
from pyspark.sql import functions as F
from quarry.operators import generations, index, living_index, retrieve
from quarry.sources import versions
from quarry.workspace import fresh_path, hadoop_path


def test_versions_are_exclusive(spark):
    root = fresh_path(spark, "versions")
    assert versions.latest(spark, root) == (0, {})
    versions.publish(spark, root, 1, {"a": "é"})
    with pytest.raises(Exception, match="[Ee]xist"):
        versions.publish(spark, root, 1, {"a": 2})
    versions.publish(spark, root, 2, {"a": 3})
    assert versions.latest(spark, root) == (2, {"a": 3}) and versions.read(spark, root, 1) == {"a": "é"}


@pytest.mark.parametrize("most", [2, 16])
def test_living_index_equals_rebuild(spark, monkeypatch, most):
    """Inserts, patches, deletes, deletes of the unknown, and inserts of the deleted, with and without merges between."""
    monkeypatch.setattr(living_index, "MOST_SEGMENTS", most)
    r = random.Random(most)
    words = "alpha beta gammaDelta eta2Theta iota kappa lambda".split()
    text = lambda: " ".join(r.choice(words) for _ in range(r.randrange(0, 12)))
    kind = "id long, text string"
    root, docs = fresh_path(spark, "living"), {}
    queries = spark.createDataFrame([(i, w) for i, w in enumerate([*words, "alpha beta beta", "none", "theta kappa"])], "q_id int, text string")
    for step in range(6):
        if step % 3 == 2:
            gone = r.sample(range(60), 15)
            living_index.delete(spark, root, spark.createDataFrame([(i,) for i in gone], "id long"))
            docs = {i: t for i, t in docs.items() if i not in gone}
        else:
            batch = {r.randrange(60): r.choice([text(), None]) if r.random() < 0.1 else text() for _ in range(25)}
            living_index.upsert(spark, root, spark.createDataFrame(list(batch.items()), kind), "id", "text")
            docs |= batch
    got = {(x.q_id, x.id): x.score for x in retrieve.bm25_scores(living_index.opened(spark, root), queries).collect()}
    new = index.build(spark.createDataFrame(list(docs.items()), kind), "id", "text")
    want = {(x.q_id, x.id): x.score for x in retrieve.bm25_scores(new, queries).collect()}
    assert got == want and len(want) > 50
    last = versions.latest(spark, root)[1]["segments"]
    assert len(last) <= max(most, 6)


def test_living_index_versions(spark):
    """A reader that holds a version keeps its scores while changes and merges go on; an empty index answers nothing."""
    root = fresh_path(spark, "living")
    df = spark.createDataFrame([(1, "red ring"), (2, "red"), (3, "blue")], "id long, text string")
    q = spark.createDataFrame([(0, "red")], "q_id int, text string")
    first = living_index.upsert(spark, root, df, "id", "text")
    scores = lambda n=None: sorted(map(tuple, retrieve.bm25_scores(living_index.opened(spark, root, n), q).collect()))
    before = scores(first)
    living_index.delete(spark, root, df.select("id"))
    assert scores() == [] and scores(first) == before
    living_index.merge(spark, root)
    assert scores() == [] and scores(first) == before and len(before) == 2


TREE = {
    "a.py": "import os\nclass A(Base):\n    def run(self):\n        return go(1)\n", "b.py": "def go(x):\n    return A()\n", "c.py": "# @generated\nx = 1\n", "d.rs": "pub fn start() {\n    go();\n}\n",
}


def tree(spark, files):
    return spark.createDataFrame([(p, "rust" if p.endswith("rs") else "python", t) for p, t in files.items()], "file_path string, language string, content string")


def rows(tables):
    return {t: sorted(map(str, df.select(*sorted(df.columns)).collect())) for t, df in tables.items()}


def test_generations(spark, monkeypatch):
    """Incremental equals full; a publisher that dies leaves the old generation; a job goes on where it stopped; clean-up
    spares protected generations."""
    root, other = fresh_path(spark, "generations"), fresh_path(spark, "generations")
    assert generations.build(spark, root, "one", tree(spark, TREE), parts=2) == 1
    first = rows(generations.served(spark, root))
    files = {**TREE, "b.py": "def go(x, y):\n    return start()\n", "e.py": "class B:\n    pass\n"}
    del files["d.rs"]
    done = []
    real = generations.extract

    def dying(part):
        if done:
            raise RuntimeError("killed")
        done.append(1)
        return real(part)

    monkeypatch.setattr(generations, "extract", dying)
    with pytest.raises(RuntimeError, match="killed"):
        generations.build(spark, root, "two", tree(spark, files), parts=4)
    assert rows(generations.served(spark, root)) == first
    # dead while writing the tables: nothing is named by a version
    monkeypatch.setattr(generations, "extract", real)
    monkeypatch.setattr(generations.versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        generations.build(spark, root, "two", tree(spark, files), parts=4)
    assert rows(generations.served(spark, root)) == first
    monkeypatch.undo()
    # the parts are all done: nothing is extracted again
    monkeypatch.setattr(generations, "extract", lambda part: pytest.fail("extracted again"))
    assert generations.build(spark, root, "two", tree(spark, files), parts=4) == 2
    monkeypatch.undo()
    generations.build(spark, other, "full", tree(spark, files))
    assert rows(generations.served(spark, root)) == rows(generations.served(spark, other)) != first
    generations.build(spark, root, "three", tree(spark, files))
    generations.build(spark, root, "four", tree(spark, files))
    assert rows(generations.served(spark, root)) == rows(generations.served(spark, other))
    fs, base = hadoop_path(spark, f"{root}/generations")
    assert len(fs.listStatus(base)) == 5
    assert generations.clean(spark, root, protected=[1], orphans_before_ms=1 << 62) == [2, 3]
    assert versions.numbers(spark, root) == [1, 4] and len(fs.listStatus(base)) == 2
    assert rows(generations.served(spark, root, 1)) == first


def test_generation_reads_contents_once(spark):
    """A build makes each file's content once, also beside a served generation, and goes on with what is indexed only."""
    root, made = fresh_path(spark, "generations"), spark.sparkContext.accumulator(0)

    def text(t):
        made.add(1)
        return t

    make = F.udf(text).asNondeterministic()
    files = {**TREE, "big.py": "x" * 1_000_001}
    for n, more in enumerate(({}, {"b.py": "def go(x, y):\n    return start()\n"}), 1):
        generations.build(spark, root, str(n), tree(spark, files | more).withColumn("content", make("content")), parts=2)
        assert made.value == n * len(files)
    states = {r.file_path: r.state for r in generations.served(spark, root)["files"].collect()}
    assert states == {"a.py": "indexed", "b.py": "indexed", "c.py": "skipped", "d.rs": "indexed", "big.py": "failed"}
