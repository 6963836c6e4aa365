"""Edge pairs, traces and coverage of the fixtures, and bucket lookups by hand."""

import pytest
from geobucket.operators import bucketing as B
from geobucket.operators import graph, rules

#: The 62 edges, and the items of the three fixtures.
EDGES = """1>2 1>3 3>4 3>5 5>6 6>7 6>8 7>6 7>42 8>9 8>10 9>6 9>42 10>11 10>20 10>29 10>38
11>12 11>15 11>18 12>13 12>14 13>19 14>19 15>16 15>17 16>19 17>19 18>19 19>39
20>21 20>27 21>22 21>25 21>26 22>23 22>24 23>28 24>28 25>28 26>28 27>28 28>39
29>30 30>31 30>34 30>35 31>32 31>33 32>36 33>36 34>36 35>37 36>30 36>37 37>39
38>39 39>40 39>41 40>41 41>6 41>42"""
SMALL = [(15, "normal"), (25, "special"), (5, None)]
MEDIUM = [*SMALL, (35, "normal"), (45, "special"), (55, None)]
LARGE = [*MEDIUM, (65, "normal"), (75, "special"), (85, None), (95, "normal"), (105, "special"), (115, None), (125, "normal"), (135, "special")]
OPTIONS = {"doubleHighAlpha": True, "addLowAlpha": True, "logAll": True}
SMALL_TRACE = "1 3 5 6 8 10 11 15 16 19 39 40 41 6 8 10 11 12 13 19 39 40 41 6 8 10 11 15 16 19 39 40 41 42"


def items(spark, values):
    return spark.createDataFrame([(i, False, True, True, v, c is not None, c) for i, (v, c) in enumerate(values)], rules.ITEMS)


def nodes(df):
    return [r.node for r in df.orderBy("item_pos", "k").collect()]


@pytest.fixture
def pairs(spark):
    edges = [(i, i + 1, *map(int, e.split(">"))) for i, e in enumerate(EDGES.split())]
    return graph.numbered_pairs(spark.createDataFrame(edges, "pos long, edge_id int, src int, dst int"))


@pytest.mark.parametrize(("values", "length"), [(SMALL, 34), (MEDIUM, 64), (LARGE, 144)])
def test_traces_and_coverage(spark, pairs, values, length):
    trace = nodes(rules.process(items(spark, values), "alpha", 20, OPTIONS))
    assert len(trace) == length and (values is not SMALL or trace == list(map(int, SMALL_TRACE.split())))
    at = spark.createDataFrame(list(enumerate(trace)), "pos long, node int")
    assert pairs.count() == 90
    assert graph.covered_pairs(pairs, at).count() == 18 and graph.uncovered_pairs(pairs, at).count() == 72
    assert graph.coverage(pairs, at).first() == (90, 18, False)


def test_odd_items_and_modes(spark):
    odd = spark.createDataFrame([(0, True, False, False, None, False, None), (1, False, False, False, None, True, "x"), (2, False, True, False, None, False, None), (3, False, True, True, 20, True, None)], rules.ITEMS)
    assert nodes(rules.process(odd, "alpha", 20, OPTIONS)) == [1, 3, 5, 6, 7, 6, 7, 6, 8, 9, 6, 8, 10, 11, 18, 19, 39, 40, 41, 42]
    assert nodes(rules.process(odd, None, 20, OPTIONS)) == [1, 3, 4]
    assert nodes(rules.process(odd.limit(0), "alpha", 20, OPTIONS)) == [1, 2]
    assert nodes(rules.process(odd.filter("item_pos = 3"), "other", 20, {})) == [1, 3, 5, 6, 8, 10, 38, 39, 41, 42]
    assert nodes(rules.process(odd.filter("item_pos = 3"), "beta", 20, {})) == [1, 3, 5, 6, 8, 10, 20, 21, 26, 28, 39, 41, 42]
    assert nodes(rules.process(odd.filter("item_pos = 3"), "gamma", 20, {})) == [1, 3, 5, 6, 8, 10, 29, 30, 35, 37, 39, 41, 42]


def test_nearest_lower_of_the_fixture(spark):
    buckets = spark.createDataFrame([(1,), (5,), (9,)], "bucket_min long")
    got = B.assign_to_existing(spark.createDataFrame([(0,), (1,), (7,), (100,)], "k long"), "k", buckets)
    assert {r.k: r.bucket_min for r in got.collect()} == {0: 1, 1: 1, 7: 5, 100: 9}
