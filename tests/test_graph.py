"""Trace windows, pairs under hubs, places of lines, fetches by position, and carts folded from a log."""

import random

import pytest
from geobucket.functions import store as S
from geobucket.operators import graph
from geobucket.sources import edges


@pytest.mark.parametrize("k", [1, 2, 3, 5, 9])
@pytest.mark.parametrize("block", [4, 1000])
def test_windows_of_a_trace(spark, k, block):
    r = random.Random(k)
    nodes = [r.randrange(6) for _ in range(60)]
    trace = spark.createDataFrame(list(enumerate(nodes, 1)), "pos long, node int").repartition(5)
    got = graph.trace_windows(trace, k, block)
    assert sorted(map(tuple, got.collect())) == sorted({tuple(nodes[i : i + k]) for i in range(len(nodes) - k + 1)})
    assert graph.trace_windows(trace.limit(0), k, block).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(block") == 1 and "Join" not in plan


def test_pairs_of_a_hub_are_dealt(spark):
    r = random.Random(3)
    rows = [(r.randrange(300), 0) for _ in range(400)] + [(0, r.randrange(300)) for _ in range(90)] + [(r.randrange(30), r.randrange(30)) for _ in range(200)] + [(5, 5), (7, None), (None, 0)]
    df = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(rows)], "pos long, edge_id long, src int, dst int")
    want = sorted((i, j) for i, (a, b) in enumerate(rows) for j, (c, d) in enumerate(rows) if b is not None and b == c)
    for side in (7, 1000):
        got = graph.edge_pairs(df, side)
        assert sorted((x.pos1, x.pos2) for x in got.collect()) == want
    assert {c: t for c, t in got.dtypes} == {"pos1": "bigint", "pos2": "bigint", "edge1_id": "bigint", "edge2_id": "bigint", "n1": "int", "n2": "int", "n3": "int"}


def test_places_of_lines(spark, tmp_path):
    """Places are dense, and follow files and lines whatever the splits."""
    lines = {f"f{k}.txt": [f"e{k}{i} n{i} n{i + 1}" if i % 7 else "" for i in range(n)] for k, n in enumerate((40, 0, 1, 90))}
    for name, own in lines.items():
        (tmp_path / name).write_text("\n".join(own) + ("\n" if own else ""))
    want = [x for name in sorted(lines) for x in lines[name]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "300", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.pos, r.value) for r in edges.numbered_lines(spark, str(tmp_path)).collect())
            assert got == list(enumerate(want, 1))
            assert sorted(r.pos for r in edges.read_edges(spark, str(tmp_path)).collect()) == [i for i, x in enumerate(want, 1) if x]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fetch_by_position(spark, monkeypatch):
    monkeypatch.setattr(S, "STEP", 37)
    rows = [(i * 7 % 1000, f"v{i}") for i in range(1000)]
    index = S.position_index(spark.createDataFrame(rows, "id int, range string"), "id")
    own, wanted = sorted(rows), [0, 999, 1000, -1, 5, 5, *range(100, 900, 3), None]
    got = index.fetch(spark.createDataFrame([(i,) for i in wanted], "i long"))
    assert sorted(map(tuple, got.collect())) == [(i, f'{{"id":{own[i][0]},"range":"{own[i][1]}"}}') for i in sorted({i for i in wanted if i is not None and 0 <= i < 1000})]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("parts", ["1", "8"])
def test_carts_from_a_log(spark, parts):
    """A frequent pair may be cut into many parts."""
    r = random.Random(8)
    log = [(r.choice([1, 1, 1, 2, 3]), r.choice([9, 9, 9, 8]), r.choice([1, 1, -1, -1, -2]), t) for t in range(3000)] + [(4, 4, -1, 1), (5, 5, 1, 1), (None, 1, 1, 1), (5, 5, None, 2)]
    want = {}
    for user, item, change, _ in sorted(log[:3000], key=lambda x: x[3]) + [(4, 4, -1, 0), (5, 5, 1, 0)]:
        want[user, item] = max(0, want.get((user, item), 0) + change)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = S.folded_carts(spark.createDataFrame(log, "userid int, id int, change int, at int").repartition(4), "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(x.userid, x.id): x.quantity for x in got} == {k: v for k, v in want.items() if v}
