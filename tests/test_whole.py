"""Queries over whole tables leave no row out."""

from geobucket import queries as own

from .support import DATA

SF = str(DATA / "sf0.001")


def test_every_event_becomes_a_line(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert sum(r["lines"] for r in own.queries()["ndjson_lines"](spark, SF).collect()) == events > 300


def test_every_order_reaches_the_graph(spark):
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    found = own.queries()["edge_parse"](spark, SF)
    assert {(r.src, r.dst) for r in found.collect()} == {(c, (7 * c + k % 8) % n if k % 8 else 0) for c, k in orders}
    pairs = own.queries()["pair_coverage"](spark, SF).first()
    assert 0 < pairs["covered"] < pairs["pairs"] and not pairs["all_covered"]
    assert found.filter("dst = 0").count() > 8 * found.filter("dst = 1").count()  # a hub
