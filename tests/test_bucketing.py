"""Splits and lookups against plain Python, without lists of keys or bounds on the driver."""

import bisect
import math

import pytest
from geobucket.operators import bucketing as B
from geobucket.operators.numbering import numbered
from pyspark.sql import DataFrame


@pytest.fixture
def keys(spark):
    """Ties, negative keys and nulls."""
    return [None if i % 97 == 0 else 5 if i % 3 == 0 else (i * 7919) % 20011 - 10000 for i in range(6000)]


def frame(spark, keys):
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long").repartition(7)


def test_splits_and_buckets(spark, keys):
    df, own = frame(spark, keys), sorted(k for k in keys if k is not None)
    b = math.ceil(len(keys) / 64)
    splits = [own[max(1, math.ceil(i * 1.0 / b * len(own))) - 1] for i in range(b + 1)]
    assert sorted(tuple(r) for r in B.equi_depth_splits(df, "k", rel_error=0.0).collect()) == list(enumerate(map(float, splits)))
    found = {r.id: r.bucket_min for r in B.equi_depth_bucket(df, "k", rel_error=0.0).collect()}
    bounds = sorted(set(splits[:-1]))
    assert found == {i: None if k is None else bounds[bisect.bisect_right(bounds, k) - 1] for i, k in enumerate(keys)}
    assert B.equi_depth_splits(df.limit(0), "k").count() == B.equi_depth_bucket(df.limit(0), "k").count() == 0
    assert [r.bucket_min for r in B.equi_depth_bucket(frame(spark, [None, None]), "k").collect()] == [None, None]


def test_nearest_lower(spark, keys):
    bounds = [b for b in range(-9000, 9000, 13)]
    found = {r.id: r.bucket_min for r in B.assign_to_existing(frame(spark, keys), "k", spark.createDataFrame([(b,) for b in bounds + bounds], "bucket_min long")).collect()}
    assert found == {i: None if k is None else bounds[max(0, bisect.bisect_right(bounds, k) - 1)] for i, k in enumerate(keys)}
    with pytest.raises(ValueError):
        B.assign_to_existing(frame(spark, keys), "k", spark.createDataFrame([], "bucket_min long"))


def test_driver_gets_one_row_a_range(spark, keys, monkeypatch):
    """No list of quantiles or bounds reaches the driver."""
    sizes = []
    classes = {DataFrame, type(spark.range(0))}
    for c in classes:
        monkeypatch.setattr(c, "collect", lambda self, f=c.collect: sizes.append(len(out := f(self))) or out)
        monkeypatch.setattr(c, "approxQuantile", None)
    df = frame(spark, keys)
    B.equi_depth_bucket(df, "k", target=2, rel_error=0.0)
    B.assign_to_existing(df, "k", df.selectExpr("k AS bucket_min"))
    assert sizes and max(sizes) <= 16


@pytest.mark.parametrize("rel_error", [0.001, 0.02, 0.4])
@pytest.mark.parametrize("shape", ["sorted", "skewed", "repeated", "reversed"])
def test_splits_within_their_error(spark, shape, rel_error):
    n = 5000
    own = {"sorted": range(n), "skewed": [int(1.002**i) for i in range(n)], "repeated": [i % 7 for i in range(n)], "reversed": [-i for i in range(n)]}[shape]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(own)], "id long, k long").unionByName(spark.createDataFrame([(-1, None)], "id long, k long"))
    got = {r.split_no: r.split for r in B.equi_depth_splits(df, "k", 64, rel_error).collect()}
    b, keys = math.ceil((n + 1) / 64), sorted(own)
    assert got.keys() == set(range(b + 1))
    for i, v in got.items():
        assert bisect.bisect_left(keys, v) - rel_error * n <= i / b * n <= bisect.bisect_right(keys, v) + rel_error * n + 1
    assert all(r.within for r in B.within_rank(df, "k", B.equi_depth_splits(df, "k", 64, rel_error), rel_error).collect())
    found = {r.id: r.bucket_min for r in B.equi_depth_bucket(df, "k", target=64, rel_error=rel_error).collect()}
    bounds = sorted({math.floor(v) for i, v in got.items() if i < b})
    assert found == {-1: None} | {i: bounds[max(0, bisect.bisect_right(bounds, k) - 1)] if k >= bounds[0] else bounds[-1] for i, k in enumerate(own)}


def halved(rows, most, label):
    """Labels of sorted keys by halving one bucket after the other."""
    out, open_ = {}, [(sorted(rows), label)]
    while open_:
        own, b = open_.pop()
        least, median = own[0], own[(len(own) + 1) // 2 - 1]
        split = median if median > least else min((k for k in own if k > median), default=None)
        if len(own) <= most or split is None:
            out |= {k: b for k in own}
        else:
            open_ += [([k for k in own if k < split], least if split <= b else b), ([k for k in own if k >= split], split)]
    return out


@pytest.mark.parametrize("group", [200_000, 40, 1])
def test_split_tree(spark, group):
    """One task a label, or rounds of joins before it, make the same labels."""
    keys = {0: [(i * i) % 997 for i in range(900)], 5000: [5000] * 300 + [5001] * 2, 6000: [6000 + i // 40 for i in range(900)], 9000: [8000 + i for i in range(300)] + [9000 + i for i in range(10)], 20000: [20000] * 400, 30000: [30000 + i for i in range(9)]}
    df = spark.createDataFrame([(k, b) for b, own in keys.items() for k in own], "k long, bucket_min long").repartition(5)
    want = {(b, k): v for b, own in keys.items() for k, v in halved(own, 128, b).items()}
    got = B.split_labels(df, "k", group=group).collect()
    assert {(r.old_label, r.k): r.bucket_min for r in got} == want and sum(r.cnt for r in got) == df.count()


def test_columns_of_any_name(spark):
    """No name that a table has is used for an intermediate column."""
    names = "__key __part __found __old __n key bound part at start mark old new n cnt keys".split()
    df = spark.createDataFrame([(i, i % 50, 0, *[f"{c}{i}" for c in names]) for i in range(400)], "id long, k long, bucket_min long, " + ", ".join(f"`{c}` string" for c in names))
    for got in (B.equi_depth_bucket(df.drop("bucket_min"), "k", rel_error=0.0), B.equi_depth_bucket(df.drop("bucket_min"), "k"), B.assign_to_existing(df.drop("bucket_min"), "k", df.selectExpr("k AS bucket_min")), B.split_oversize(df, "k"), numbered(df, ["id"])):
        assert {(r.id, *[r[c] for c in names]) for r in got.collect()} == {(i, *[f"{c}{i}" for c in names]) for i in range(400)}
