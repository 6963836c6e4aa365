"""Host lists by the cascade of filters; archives with damaged parts."""

import io
import random
import zlib

import pytest
from geobucket.llm import bloom_cascade as C
from geobucket.llm import warc as W

RULED = [("http://a.example.net/en/x", "allow"), ("http://b.net/", "block"), ("https://x.example.com/de/1", "block"), ("x://Sub.ORG/fr/?q", "allow")]


def test_cascade_is_exact_over_several_levels(spark, monkeypatch):
    r = random.Random(1)
    keys = [f"host{i}.example" for i in range(3000)]
    listed = set(r.sample(keys, 400)) | {"only.in.the.list"}
    rows = spark.createDataFrame([(k, "x", "y", "z") for k in keys + keys[:50] + [None, ""]], "host string, key string, listed string, at string").drop("listed")
    table = spark.createDataFrame([(k,) for k in listed] * 2 + [(None,)], "h string")
    universe = rows.selectExpr("host AS key", "false AS listed").union(table.selectExpr("h", "true"))
    made = C.cascade(universe)
    assert len(made.levels) > 3 and made.bytes < C.MOST_BYTES
    less = made.bytes - C.BUCKET // 8  # too small for one cascade: keys are dealt to several
    parts = C.cascades(universe, less)
    assert len(parts) > 1 and all(p.bytes <= less for p in parts)
    for most in (C.MOST_BYTES, less):
        got = C.with_listed(rows, "host", table, "found", most).select("host", "found").collect()
        assert len(got) == len(keys) + 52 and all(x.found == (x.host in listed) for x in got)
    monkeypatch.setattr(C, "MOST_SHARDS", 1)
    with pytest.raises(ValueError):
        C.cascades(table.limit(1).selectExpr("'x' AS key", "true AS listed"), 100)


def test_odd_urls_and_empty_tables(spark):
    urls = [*RULED, (None, "allow"), ("", "allow"), ("no scheme", "allow"), ("://", "allow"), ("http://ads.x/a#b", "block"), ("http://ADS.X", "block"), ("http://ads.x.y/", "allow")]
    pages = spark.createDataFrame([(i, u, "host", "rule") for i, (u, _) in enumerate(urls)], "page_id long, url string, host string, listed string")
    table = spark.createDataFrame([("ads.x",)], "host string")
    found = {r.page_id: r.verdict for r in C.judge_urls(pages, table).collect()}
    assert found == {i: v for i, (_, v) in enumerate(urls)}
    assert C.judge_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in C.judge_urls(pages, table.limit(0)).filter("rule is null").collect()} == {"allow"}


def test_inflating_is_bounded():
    raw = b"a" * 50_000_000 + bytes(range(256)) * 1000
    whole = zlib.compress(raw, 9, 31) + zlib.compress(b"", 9, 31) + zlib.compress(raw[:10], 9, 31)
    parts = list(W.inflated(io.BytesIO(whole).read, 1 << 16))
    assert max(map(len, parts)) <= 1 << 16 and b"".join(parts) == raw + raw[:10]
    with pytest.raises(ValueError):
        list(W.inflated(io.BytesIO(whole[:-20]).read, 1 << 16))


def test_revisits_are_held_against_their_response(spark):
    names = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    good = [(2, 5, "A", "response", None, None), (1, 5, "A", "revisit", 2, None)]
    assert W.resolved(spark.createDataFrame(good, names)).count() == 2
    for bad in ((1, 5, "A", "revisit", 3, None), (1, 5, "B", "revisit", 2, None), (1, 6, "A", "revisit", 2, None)):
        with pytest.raises(Exception, match="does not match"):
            W.resolved(spark.createDataFrame([good[0], bad], names)).collect()
