"""Near-duplicate classes against all pairs compared by the definition."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from geobucket.llm import probminhash as M
from geobucket.llm.common import WordHashes, shingled, worded

from ..support import DATA

SCHEMA = "doc_id long, text string"


def weights(text: str) -> dict:
    w = (text or "").lower().translate({c: " " for c in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    runs = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    return {s: 1 + math.log(n) for s, n in collections.Counter(runs).items()}


def by_definition(a: dict, b: dict) -> float:
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in a if i in b)


def brute(rows: list[tuple]) -> list[tuple]:
    sets = [weights(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    holds = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holds[x] if j < i}:
            if root(i) != root(j) and by_definition(s, sets[j]) >= 0.8 - 1e-12:
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def classes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.doc_id, r.class_id) for r in M.duplicate_classes(df).collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
    return " ".join(words)


def test_similarity_is_the_definition():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (" ".join(rng.choice("xyz") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        own = []
        for t in (a, b):
            _, sh, w = M.weighted(*shingled(*worded(pa.array([t]), WordHashes()), 5))
            order = np.argsort(sh)
            own.append((sh[order], w[order]))
        assert math.isclose(M.similarity(*own), by_definition(weights(a), weights(b)), abs_tol=1e-9)


def test_registers_agree_with_similarity():
    rng = random.Random(2)
    words = [f"a{i}" for i in range(60)]
    a, b = " ".join(words), edited(rng, words, 2)
    kept = M.sketch(*M.weighted(*shingled(*worded(pa.array([a, b]), WordHashes()), 5)), 2, registers=4096)
    assert abs((kept[0] == kept[1]).mean() - by_definition(weights(a), weights(b))) < 0.05


def test_families_of_edited_copies(spark):
    """A family with distances on both sides of the threshold, a shared passage, and repeated words."""
    rng, rows = random.Random(3), []
    base = [f"b{i}" for i in range(120)]
    rows += [edited(rng, base, rng.randrange(0, 9)) for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [passage + " " + " ".join(f"u{k}.{i}" for i in range(rng.randrange(2, 40))) for k in range(60)]
    loop = ["la", "li", "lu", "lo"] * 20
    rows += [edited(rng, loop, rng.randrange(0, 4)) for _ in range(40)]
    rows = list(enumerate(rows))
    assert classes(spark, rows) == brute(rows)


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()]
    assert classes(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (5, "ONE\ttwo"), (6, "x " * 9000), (None, "one two"), (8, None), (8, None)]
    found = classes(spark, [r for r in rows if r[0] is not None])
    assert found == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (8, 8), (8, 8)]
    assert spark.createDataFrame(rows, SCHEMA).count() == M.duplicate_classes(spark.createDataFrame(rows, SCHEMA)).count()
    assert classes(spark, []) == []


def test_deduplicated_keeps_columns_and_one_row(spark):
    df = spark.createDataFrame([(1, "a b c", "k"), (2, "a b c", "l"), (2, "a  b c", "m"), (3, None, "n"), (1, "a b c", "o")], "doc_id long, text string, node string")
    got = M.deduplicated(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == [1, 3]
    assert M.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [M.SENT_NODES, 0])
def test_deduplicated_moves_no_text_beside_a_short_list(spark, monkeypatch, sent):
    """The rows that go are listed; a list short enough is sent to the tasks that read the texts once."""
    monkeypatch.setattr(M, "SENT_NODES", sent)
    base = " ".join(f"b{i}" for i in range(60))
    once = [(1, "a b c"), (2, "a B c"), (3, None), (3, None), (None, "d e"), (None, None), (4, "x"), (6, "m n"), (None, "m n"), (7, base), (7, base + " z"), (8, base + " y")]
    twice = [(1, "a  b c"), (5, "p q"), (5, "P q"), (5, "p q"), (9, ""), (9, "")]
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = M.deduplicated(spark.createDataFrame(once, SCHEMA))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ids(got) == [1, 3, 3, 4, 6, 7, None, None]
        assert not sent or "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "Union" not in plan
        assert ids(M.deduplicated(spark.createDataFrame(once + twice, SCHEMA))) == [1, 3, 3, 4, 5, 6, 7, 9, 9, None, None]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_candidates_of_a_family_with_repeated_lines(spark):
    """Texts that share some 70 % of their shingles, a few of them repeated, meet in few candidate pairs, and in none of the links."""
    rng, n = random.Random(5), 300
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join([*base, "same line of words here", "same line of words here", *[f"u{i}.{k}" for k in range(45)]])) for i in range(n)]
    rng.shuffle(rows)
    own = spark.createDataFrame(rows, SCHEMA).selectExpr("unhex(md5(text)) AS node", "unhex(md5(text)) AS class", "true AS open", "text AS words")
    assert by_definition(weights(rows[0][1]), weights(rows[1][1])) < 0.75
    assert M.prefix_pairs(M.prefix_rows(own)).count() < n
    near = [" ".join([*base, "same line of words here", "same line of words here", *[f"u{i}.{k}" for k in range(9)]]) for i in range(8)]
    assert classes(spark, list(enumerate(near))) == brute(list(enumerate(near)))
