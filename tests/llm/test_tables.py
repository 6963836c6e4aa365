"""Queries that SQL can't express, end to end against brute-force versions; odd rows and empty tables."""

import base64
import collections
import functools
import hashlib
import math
import os
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyarrow import orc
from geobucket.llm import feistel, guess_cost, kneser_ney, quality, sentencepiece_sa, token_orc, warc
from geobucket.llm import queries as llm
from geobucket.llm.containment import without_items

from ..support import DATA, sql_rows
from .test_probminhash import brute

SF = DATA / "sf0.001"
DOCS = "doc_id long, text string, ids string, size string, words string, node string, n string"
ODD_ROWS = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (4, "password: abcdef123456789"), (5, "é漢😀 \t\n<s>"), (None, "no id"), (6, "word " * 40000)]


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(str(SF / "documents.parquet")).collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, *["x"] * 5) for d, t in ODD_ROWS], DOCS)


def in_order(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)


def archive(pages) -> list[tuple]:
    """(page_id, bytes, digest, type, refers_to) of (page_id, url, html)."""
    raw = [(p, (h or "").encode()) for p, _, h in pages]
    last, n = {}, collections.Counter(h for _, h in raw)
    for p, h in raw:
        if p is not None:
            last[h] = max(p, last.get(h, p))
    out = []
    for p, h in raw:
        again = n[h] > 1 and p != last.get(h, p)  # ids that are all null: responses
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", last[h] if again else None))
    return in_order(out)


FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archives(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(str(SF / "pages.parquet")).collect()]
    assert in_order(llm.op2_warc(spark, str(SF)).select(*FIELDS).collect()) == archive(pages)


def test_archives_of_odd_pages(spark):
    pages = [(1, "http://a/ b", None), (2, None, ""), (3, "x\r\ny", "WARC/1.1\r\n\r\nContent-Length: 3"), (4, "u", "é" * 70000), (5, "u", "é" * 70000), (5, "u", "é" * 70000), (6, "", "\r\n\r\n")]
    df = spark.createDataFrame([(*p, "k", "k") for p in pages], "page_id long, url string, html string, sha string, latest string")
    assert in_order(warc.archived_pages(df, file_bytes=1000).select(*FIELDS).collect()) == archive(pages)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_revisits_of_hot_and_rare_payloads(spark, monkeypatch):
    """Payloads of many and of few records, at every limit between the two, in files of any size; a revisit has no payload in the archive."""
    pages = [(i, f"u{i}", "" if i % 3 == 0 else f"body {i % 7}" * 9 if i % 3 == 1 else f"only {i}") for i in range(300)]
    pages += [(None, None, "no id"), (None, None, "no id"), (7, "u", "body 0" * 9), (298, "u", "body 4" * 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for hot, size in ((1, 1 << 20), (4, 3000), (40, 500), (10**6, 1)):
        monkeypatch.setattr(warc, "HOT", hot)
        assert in_order(warc.archived_pages(df, file_bytes=size).select(*FIELDS).collect()) == archive(pages)
    raw = warc.record(1, "u", b"x\r\n\r\ny", hashlib.sha1(b"x\r\n\r\ny").digest())
    head, block = warc.fields(warc.revisit(raw, 5))
    assert block.endswith(b"Content-Length: 6\r\n\r\n") and head["warc-refers-to"] == "<urn:page:5>" and head["content-length"] == str(len(block)) and head["warc-type"] == "revisit"
    assert list(warc.records(iter([warc.revisit(raw, 5), raw]))) == [warc.revisit(raw, 5), raw]


def check_shards(found, texts, shards=40):
    size = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts]
    assert in_order((r.doc_id, r["size"], r.text_crc32) for r in found) == in_order(size)
    slots = collections.defaultdict(list)
    for r in found:
        assert (r.law, r.grown_shard) == ("rows", None) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards(spark, texts, odd):
    found = llm.op3_feistel_shards(spark, str(SF)).collect()
    check_shards(found, texts)
    assert in_order(found) == in_order(llm.op3_feistel_shards(spark, str(SF)).collect())
    check_shards(feistel.shard_documents(odd).collect(), ODD_ROWS)
    assert feistel.shard_documents(odd.limit(0)).count() == 0


def pieces(texts):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return in_order((d, sp.encode(t or ""), True) for d, t in texts)


def test_sentencepiece(spark, texts, odd):
    found = lambda df: in_order(df.select("doc_id", "ids", "round_trip").collect())
    assert found(llm.op4_sentencepiece(spark, str(SF))) == pieces(texts)
    file = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_sa.encode_documents(odd, file)
    assert found(encoded) == pieces(ODD_ROWS)
    assert in_order(sentencepiece_sa.decode_documents(encoded, file).collect()) == in_order((d, t or "") for d, t in ODD_ROWS)
    assert sentencepiece_sa.encode_documents(odd.limit(0), file).count() == 0


def tokens(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it is, unlike the operator's
    out = []
    for d, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return in_order(out)


def check_tokens(found, texts):
    assert in_order((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == tokens(texts)
    before = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == before
        before += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_token_files(spark, texts, odd):
    check_tokens(llm.op7_token_orc(spark, str(SF)).collect(), texts)
    file = public_tokenizers.path("byte_bpe_50k.json")
    check_tokens(token_orc.token_documents(odd, file).collect(), ODD_ROWS)
    end = "<|endoftext|>"
    special = list(enumerate([end, f"end {end} here", f"{end}{end}", f"{end} first", f"last {end}", f"\n{end}\nx", f"a{end}b {end}", f"plain words\n{end} and  more", "<|endoftext", "the plain words"]))
    check_tokens(token_orc.token_documents(spark.createDataFrame(special, "doc_id long, text string").coalesce(1), file).collect(), special)
    assert token_orc.token_documents(odd.limit(0), file).count() == 0


def written(spark, docs, name, **options):
    path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/{name}"
    token_orc.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), **options)
    return path


def test_token_starts_follow_the_files(spark):
    """Repeated and null ids: starts are those of a scan of the files, file by file and row by row."""
    rows = [(k % 3 or None, "word " * (k * 7 % 31)) for k in range(200)] + [(1, "word ")] * 20
    path = written(spark, spark.createDataFrame(rows, "doc_id long, text string"), "ties", file_bytes=2000)
    scanned, at = [], 0
    for f in sorted(Path(path.removeprefix("file://")).glob("part-*.orc")):
        for r in orc.read_table(f).to_pylist():
            scanned.append((r["doc_id"], at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())))
            at += len(r["ids"])
    assert len({x.split("-")[1] for x in os.listdir(path.removeprefix("file://")) if x.startswith("part-")}) > 3
    assert in_order(token_orc.token_table(spark, path).collect()) == in_order(scanned)


def test_token_files_prune(spark):
    """Files hold row indexes and Bloom filters on doc_id, and reads of single ids skip row groups and files."""
    n = 6000
    path = written(spark, spark.range(n).selectExpr("2 * id AS doc_id", "concat('text ', id) AS text"), "prune", file_bytes=1 << 30)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (file,) = Path(path.removeprefix("file://")).glob("part-*.orc")
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    streams = reader.rows().readStripeFooter(reader.getStripes()[0]).getStreamsList()
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= {str(x.getKind()) for x in streams if x.getColumn() == 1}
    assert reader.getRowIndexStride() == 1000

    def scanned(condition):
        q = token_orc.read_tokens(spark, path).filter(condition)
        rows = len(q.collect())
        return rows, q._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    assert scanned("doc_id = 2468") == (1, 1000)
    assert scanned("doc_id BETWEEN 4000 AND 4100") == (51, 1000)
    assert scanned("doc_id = 2469") == (0, 0)  # inside the range of a row group: its Bloom filter says no
    assert scanned("doc_id > 20000") == (0, 0)


#: The base patterns, and the least length of a match (assign: of its value).
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18),
    ("hex", re.compile(r"[0-9a-f]+"), 16),
)


def secrets(texts):
    out = []
    for d, t in texts:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, least) in enumerate(PATTERNS) for m in p.finditer(t or "") if len(m[m.lastindex or 0]) >= least)
        said = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        out.append((d, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    return in_order(out)


def test_secrets(spark, texts, odd):
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    found = llm.op10_secret_scan(spark, str(SF)).collect()
    assert in_order(tuple(r[c] for c in names) for r in found) == secrets(texts)
    assert all(len([s for s in r.spans.split(",") if s]) == r.n_assign + r.n_access + r.n_hex + r.n_guess for r in found)
    assert in_order(guess_cost.scan_secrets(odd).select(*names).collect()) == secrets(ODD_ROWS)
    assert guess_cost.scan_secrets(odd.limit(0)).count() == 0
    assert guess_cost.redact_secrets(odd).columns == odd.columns


def test_other_operators_take_odd_rows(spark, odd):
    assert quality.quality_documents(odd).count() == len(ODD_ROWS)
    assert quality.quality_documents(odd.limit(0)).count() == 0
    items = spark.createDataFrame([(1, "one two"), (2, None), (2, "")], "item_id long, text string")
    kept = without_items(odd, items)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6]
    assert without_items(odd.limit(0), items).count() == without_items(odd, items.limit(0)).count() - len(ODD_ROWS) == 0


def test_pipeline(spark, texts):
    """Quality and containment by their SQL, classes by all pairs, ids by the library."""
    import corpus_pipeline

    text = dict(texts)
    assert len(text) == len(texts)
    good = {r[0] for r in sql_rows(f"SELECT doc_id FROM ({llm.oracle_sql()['op5_quality_cascade']}) WHERE kept", SF)}
    classes = brute([(d, t) for d, t in texts if d in good])
    one = {d for d, c in classes if d == c}
    leaked = {r[0] for r in sql_rows(f"SELECT DISTINCT doc_id FROM ({llm.oracle_sql()['op9_benchmark_containment']})", SF)}
    left = [(d, guess_cost.redacted(text[d])) for d in one - leaked]
    assert 0 < len(left) < len(one) < len(good) < len(text)
    assert in_order(corpus_pipeline.run(spark, str(SF)).select("doc_id", "ids", "round_trip").collect()) == pieces(left)


def discount(of: collections.Counter) -> list[float]:
    """0 and the modified discounts for 1, 2 and 3 or more, from counts of counts."""
    if not all(of[k] for k in (1, 2, 3, 4)):
        return [0, 0.5, 0.75, 0.9]
    y = of[1] / (of[1] + 2 * of[2])
    return [0] + [min(k, max(0, k - (k + 1) * y * of[k + 1] / of[k])) for k in (1, 2, 3)]


def scores(texts) -> dict:
    """Per (doc_id, text): held_out, n_tokens, n_known, N, base score, and the model's score by its formula."""
    rows = []
    for d, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        rows.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1, [*words, "\n"]))
    uni, pair = collections.Counter(), collections.Counter()
    for _, out, w in rows:
        if not out:
            uni.update(w)
            pair.update(zip([" ", *w], w))
    total, after, of = uni.total(), collections.Counter(c for _, c in pair), collections.defaultdict(list)
    for (b, _), n in pair.items():
        of[b].append(n)
    d, e = discount(collections.Counter(pair.values())), discount(collections.Counter(after.values()))
    rest = sum(e[min(3, m)] for m in after.values()) / len(pair) if pair else 1

    def chance(b, c):
        m = after[c]
        low = (max(m - e[min(3, m)], 0) / len(pair) if pair else 0) + rest / (len(uni) + 1)
        if b not in of:
            return low
        n, all_ = pair[b, c], sum(of[b])
        return max(n - d[min(3, n)], 0) / all_ + sum(d[min(3, x)] for x in of[b]) / all_ * low

    chance = functools.cache(chance)
    base = lambda w: math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1)))
    return in_order((d, out, len(w), sum(x in uni for x in w), total, round(sum(map(base, w)), 5), round(sum(math.log10(chance(b, c)) for b, c in zip([" ", *w], w)), 5)) for d, out, w in rows)


def check_scores(df, texts):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    found = in_order(tuple(r[c] for c in names) for r in df.collect())
    key = lambda r: repr(r[:5]) + f"{r[5]:.3f}"
    for a, b in zip(sorted(found, key=key), sorted(scores(texts), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-4)


def test_scores(spark, texts, odd):
    check_scores(llm.op6_kneser_ney(spark, str(SF)), texts)
    check_scores(kneser_ney.score_documents(odd), ODD_ROWS)
    assert kneser_ney.score_documents(odd.limit(0)).count() == 0


def test_counts_beyond_32_bits_are_kept(tmp_path):
    """Counts in the model's files are 64-bit."""
    keys, n = np.array([3, 9], np.uint64), np.array([2**32 + 5, 7], np.int64)
    model = kneser_ney.Model(1, total=2**33, words=2, unigrams=[kneser_ney._write(str(tmp_path), "unigrams", keys, n, n)], continuations=2**33)
    assert model.unigram(keys)[0].tolist() == n.tolist()
