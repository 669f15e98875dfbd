"""Every operator and pipeline stage on odd rows and on empty tables."""

import pytest
from quarry.llm import decontam, fingerprint, langid, packing, passages, secretscan, sharding, simjoin, tokens, urlfilter

import corpus_pipeline

BENCH = "item_id long, text string, n int, key string"
OPS = {
    "langid": lambda d: langid.identify(d),
    "simjoin": lambda d: simjoin.jaccard_components(d),
    "fingerprint": lambda d: fingerprint.edited_likeness(d),
    "tokens": lambda d: tokens.round_trip(d),
    "passages": lambda d: passages.repeated_passages(d),
    "secretscan": lambda d: secretscan.scan(d),
    "packing": lambda d: packing.pack(d),
    "sharding": lambda d: sharding.shard_rows(d),
}
EACH_ROW = {"langid", "simjoin", "fingerprint", "tokens", "secretscan", "sharding"}


@pytest.mark.parametrize("name", sorted(OPS))
def test_odd_rows(odd, name):
    got = OPS[name](odd).collect()
    if name in EACH_ROW:
        assert len(got) == odd.count()


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty(empty, name):
    assert OPS[name](empty).count() == 0


def test_leaks_odd(spark, odd, empty, prose):
    b = spark.createDataFrame([(1, prose(1, 300), 1, "k"), (2, None, 1, "k"), (None, "", 1, "k"), (3, "few words", 1, "k"), (4, "one", 1, "k")], BENCH)
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(odd, b).collect()}
    assert got == {(1, 1), (2, 1), (10, 1), (None, 1), (6, 4)}
    assert decontam.find_leaks(empty, b).count() == 0 and decontam.find_leaks(odd, b.where("1 = 0")).count() == 0


def test_urls_odd(spark):
    rows = [(1, None), (None, "http://a.net/x"), (2, ""), (3, "no scheme/net/"), (4, "HTTP://B.Example.NET/en/x?y#z"), (4, "HTTP://B.Example.NET/en/x?y#z"), (5, "ftp://"), (6, "http://x.net")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'q' as host", "1 as rule")
    got = sorted(map(tuple, urlfilter.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert len(got) == 8 and got.count((4, "b.example.net", "/en/x", "example.net/en/", "allow")) == 2
    assert (None, "a.net", "/x", "net/", "block") in got and (6, "x.net", "", None, "allow") in got and (1, "", "", None, "allow") in got
    assert urlfilter.judge(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_odd(spark, odd, empty, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, sf)
    out.collect()
    if k < 4:
        assert out.columns == odd.columns
    assert stage(spark, empty, sf).count() == 0


def test_stage_decisions(spark, odd, sf):
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, odd, sf).collect()}
    assert {1, 2, 8, 10} <= kept and not kept & {3, 4, 5, 7}
    ids = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, sf).collect()]
    assert 1 in ids and 2 not in ids and 10 not in ids and ids.count(None) == 2 and 4 in ids
    masked = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, odd, sf).collect()}
    assert "hunter2" not in masked[11] and masked[11].endswith("<SECRET>") and masked[3] is None
