"""Reads from and appends to an external database, an embedded one of Spark's own libraries; parameters as literals; bucketed tables."""

import datetime
import uuid

import pytest
from geobucket import queries as own
from geobucket.sources import database as D
from pyspark.sql import functions as F

from .support import DATA


@pytest.fixture(scope="module")
def store(spark):
    """(url, options) of an empty database in memory; its reader wants dates and times as calls."""
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def called(value):
    text = D.literal(value)
    return f"{text.split()[0]}({text.split(' ', 1)[1]})" if isinstance(value, datetime.date) else text


def test_rows_come_back(spark, store):
    url, options = store
    rows = spark.read.parquet(f"{DATA}/sf0.001/customer.parquet").select("c_custkey", "c_name", "c_nationkey", F.to_date(F.lit("2024-01-31")).alias("since"))
    D.append_jdbc(rows.filter("c_custkey % 2 = 0"), url, "customer", options)
    D.append_jdbc(rows.filter("c_custkey % 2 = 1"), url, "customer", options)
    want = sorted(map(tuple, rows.collect()))
    sql = 'SELECT "c_custkey", "c_name", "c_nationkey", "since" FROM customer'
    assert sorted(map(tuple, D.read_jdbc(spark, url, sql, options).collect())) == want
    dealt = D.read_jdbc(spark, url, sql, options, by='"c_custkey"', parts=5)
    assert sorted(map(tuple, dealt.collect())) == want
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 2 * len(want) / 5
    few = D.read_jdbc(spark, url, sql + ' WHERE "c_nationkey" < ? AND CAST("c_name" AS VARCHAR(99)) <> ?', options, 10, "it's", by='"c_custkey"')
    assert sorted(map(tuple, few.collect())) == [r for r in want if r[2] < 10]
    dated = D.bound(sql + ' WHERE "since" = ?', datetime.date(2024, 1, 31), shown=called)
    assert D.read_jdbc(spark, url, dated, options).count() == len(want)
    assert D.read_jdbc(spark, url, sql + ' WHERE "c_custkey" < ?', options, 0, by='"c_custkey"').count() == 0


def test_rows_without_a_number_are_read(spark, store):
    url, options = store
    rows = spark.createDataFrame([(k if k % 3 else None, "x" * k) for k in range(30)], "k int, t string")
    D.append_jdbc(rows, url, "gaps", options)
    got = D.read_jdbc(spark, url, 'SELECT "k", "t" FROM gaps', options, by='"k"', parts=4)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_parameters():
    when = datetime.datetime(2024, 1, 31, 5, 6, 7)
    assert D.bound("a = ? AND b = '?' AND \"c?\" = ? AND d > ? AND e < ?", 5, "o'x?", when, when.date()) == "a = 5 AND b = '?' AND \"c?\" = 'o''x?' AND d > TIMESTAMP '2024-01-31 05:06:07.000000' AND e < DATE '2024-01-31'"
    for args in ((1,), (1, 2, 3), (True, 1), (1.5, 1), (None, 1)):
        with pytest.raises(ValueError):
            D.bound("? = ?", *args)


def test_buckets_need_no_shuffle(spark):
    found = own.queries()["bucketed_join"](spark, str(DATA / "sf0.001"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
