"""The conditional random field: chains against sums over all labellings, held-out accuracy, code-switched texts."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from geobucket.llm import crf_language as C
from geobucket.llm.queries import op13_crf_language

from ..support import DATA


def test_marginals_are_sums_over_all_labellings(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    monkeypatch.setattr(C, "FLOOR", 1e-12)
    rng = np.random.default_rng(1)
    counts, k = np.array([1, 0, 3, 7, 4, 0, 6]), 3
    scores, first, steps = rng.normal(0, 2, (counts.sum(), k)), rng.normal(size=k), rng.normal(0, 1.5, (k, k))
    got, at = C.marginals(scores, counts, first, steps), 0
    for n in counts:
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            weight = np.exp(sum(scores[at + t, y] for t, y in enumerate(path)) + (first[path[0]] if n else 0) + sum(steps[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += weight
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True) if n else want)
        at += n


def test_long_chains_stay_finite():
    rng = np.random.default_rng(2)
    p = C.marginals(rng.normal(0, 60, (50_000, 4)), np.array([49_000, 1000]), np.zeros(4), rng.normal(0, 9, (4, 4)))
    assert np.isfinite(p).all() and np.allclose(p.sum(1), 1)


def test_gradient_is_that_of_the_likelihood():
    """Expected transitions of padded sequences equal those of the unpadded chains."""
    rng = np.random.default_rng(3)
    x, mask = rng.normal(size=(4, 2, 3)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    first, steps = rng.normal(size=3), rng.normal(size=(3, 3))
    p, moves = C._expected(x, mask, first, steps)
    want = np.zeros((3, 3))
    for n, size in ((0, 4), (1, 2)):
        total, own = 0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=size):
            w = np.exp(first[path[0]] + sum(x[t, n, y] for t, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
            total += w
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        want += own / total
    assert np.allclose(moves, want) and np.allclose(p.sum(2), 1)


def test_features_of_a_word():
    grams = [{w: len(i[a:z]) for w, a, z in zip("xyz", [0, *e], e)} for i, e in C.features(["a", "bcd", "éfghij"])]
    assert grams == [{"x": 1, "y": 3, "z": 6}, {"x": 2, "y": 4, "z": 7}, {"x": 1, "y": 3, "z": 6}, {"x": 0, "y": 2, "z": 5}, {"x": 0, "y": 1, "z": 4}]
    one, two = ([x[0] for x in C.features([w])] for w in ("ab", "ba"))
    assert set(one[0]) == set(two[0]) and not set(one[1]) & set(two[1])


def test_held_out_accuracy(spark):
    sf = str(DATA / "sf0.01")
    got = {r.doc_id: r for r in op13_crf_language(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 100 and np.mean([got[i].lang_pred == truth[i] for i in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    return docs, C.fit(docs)


def test_code_switched_text(spark, parts):
    """Runs of two languages in one text are told apart."""
    docs, model = parts
    own = {r.lang: r.text.split()[:30] for r in docs.filter("lang IN ('en', 'de', 'fr')").collect() if len(r.text.split()) > 200}
    rows = [(k, " ".join([w for lang in langs for w in own[lang]]), "x") for k, langs in enumerate((("en", "fr"), ("de", "en", "de")))]
    got = {r.doc_id: r for r in C.labelled(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()}
    for k, langs in enumerate((("en", "fr"), ("de", "en", "de"))):
        words = [r.lang for r in got[k].runs for _ in range(r.words)]
        truth = [lang for lang in langs for w in own[lang] if C.letters(w)]
        assert len(words) == len(truth) == got[k].n_words and np.mean([a == b for a, b in zip(words, truth)]) > 0.9


def test_odd_rows(spark, parts):
    _, model = parts
    rows = [(1, None), (2, ""), (3, "123 ... 4²"), (4, "the and of " * 60_000), (4, "the and of"), (None, "le la et"), (6, "日本語"), (7, "x" * 100_000), (8, "\n\t the\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(C.labelled(docs, model).select("doc_id", "lang_pred", "score", "n_words").collect(), key=repr)
    assert [r for r in got if r.doc_id in (1, 2, 3)] == [(1, "und", 0.0, 0), (2, "und", 0.0, 0), (3, "und", 0.0, 0)]
    assert {r.n_words for r in got if r.doc_id == 4} == {3, 180_000} and all(r.lang_pred in model.labels for r in got if r.doc_id not in (1, 2, 3))
    assert C.labelled(docs.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.language_documents(empty).count() == 0
    nothing = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in C.language_documents(nothing).select("lang_pred", "score").collect()] == [("und", 0.0)]
    with pytest.raises(ValueError):
        C.fit(spark.createDataFrame([(i, "a", f"l{i}") for i in range(C.MOST_LABELS + 1)], "doc_id long, text string, lang string"))


def test_memory_changes_nothing(parts):
    own, text = C.Labeller(parts[1]), pa.array(["the and (the) of x1y 12", "la le la", None])
    first, again = own.texts(text), own.texts(text)
    assert len(own.known) and np.allclose(first[0], again[0]) and list(first[1]) == [5, 3, 0]


def test_labels_and_ids_are_no_inputs(spark, parts):
    """Predictions of held-out rows don't change with their label, source and id."""
    docs, _ = parts
    rows = docs.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0")
    rest = docs.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    wrong = rows.withColumns({"lang": rows["lang"].substr(1, 1), "source": rows["lang"]})
    a = C.language_documents(docs).filter("held_out").select("doc_id", "lang_pred", "score").collect()
    b = C.language_documents(rest.unionByName(wrong)).filter("held_out").select("doc_id", "lang_pred", "score").collect()
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in a} == {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in b}
