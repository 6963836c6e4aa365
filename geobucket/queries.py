"""Registered queries of the engine's own operators, and their SQL equivalents.

The fixtures have no geometry, so coordinates come from integers by one
division, edges from orders, traces from events; text is built of integers.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geohash as H
from .functions import geometry as G
from .functions import store as S
from .operators import bucketing as B
from .operators import graph, rules
from .operators.numbering import numbered
from .plans import pipeline, tables
from .plans.scratch import scratch_path, stored
from .plans.tables import TableSpec
from .sources import database, edges, formats
from .sources.collections import features_in

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SERIAL = itertools.count()


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Points of events, and their key, in both languages.
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = "((event_id * 7919 + user_id * 104729) % 360000) / 1000.0D - 180"
    lat = "((event_id * 6101 + user_id * 15485863) % 180000) / 1000.0D - 90"
    return _table(spark, sf_dir, "events").selectExpr("event_id", f"{lon} AS lon", f"{lat} AS lat")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("event_id", H.geohash_numeric(F.col("lon"), F.col("lat")).alias("geohash_numeric"))


_XY = """xy AS (SELECT event_id, ((event_id * 7919 + user_id * 104729) % 360000) / 1000.0::DOUBLE - 180 AS lon,
  ((event_id * 6101 + user_id * 15485863) % 180000) / 1000.0::DOUBLE - 90 AS lat FROM events),
cells AS (SELECT event_id, least(floor((lon + 180) / 360 * 32768), 32767)::BIGINT AS x, least(floor((lat + 90) / 180 * 32768), 32767)::BIGINT AS y FROM xy),
keyed AS (SELECT event_id, (SELECT sum((((x >> i) & 1) << (2 * i + 1)) + (((y >> i) & 1) << (2 * i))) FROM range(15) t(i))::BIGINT AS geohash_numeric FROM cells)"""
_ALPHABET = H.ALPHABET
_TEXT = " || ".join(f"substr('{_ALPHABET}', ((geohash_numeric >> {5 * k}) & 31)::INT + 1, 1)" for k in range(5, -1, -1))


@_query(f"WITH {_XY} SELECT event_id, geohash_numeric FROM keyed")
def geohash_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir)


@_query(f"WITH {_XY} SELECT event_id, {_TEXT} AS geohash FROM keyed")
def geohash_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).select("event_id", H.geohash_text(F.col("geohash_numeric")).alias("geohash"))


@_query(f"WITH {_XY} SELECT event_id, geohash_numeric AS decoded FROM keyed")
def geohash_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geohash_string(spark, sf_dir).select("event_id", H.geohash_to_long(F.col("geohash")).alias("decoded"))


@_query(f"WITH {_XY} SELECT event_id, (x + 0.5) * (360.0::DOUBLE / 32768) - 180.0 AS lon, (y + 0.5) * (180.0::DOUBLE / 32768) - 90.0 AS lat FROM cells")
def geohash_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = H.geohash_center(F.col("geohash_numeric"))
    return keyed(spark, sf_dir).select("event_id", lon.alias("lon"), lat.alias("lat"))


@_query(f"WITH {_XY} SELECT (geohash_numeric // 1048576) * 1048576 AS bucket_min, count(*) AS record_count FROM keyed GROUP BY 1")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).withColumn("bucket_min", F.shiftleft(F.shiftright("geohash_numeric", 20), 20))
    return B.bucket_counts(rows)


_SPLITS = """n AS (SELECT count(*) AS n FROM keyed), b AS (SELECT (n + 63) // 64 AS b, n FROM n),
ranked AS (SELECT geohash_numeric AS k, row_number() OVER (ORDER BY geohash_numeric) AS r FROM keyed),
splits AS (SELECT i AS split_no, k::DOUBLE AS split FROM b, range((n + 63) // 64 + 1) t(i), ranked WHERE r = greatest(1, ceil(i * 1.0::DOUBLE / b * n)::BIGINT))"""


@_query(f"WITH {_XY}, {_SPLITS} SELECT split_no, split FROM splits")
def equi_depth_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.equi_depth_splits(keyed(spark, sf_dir), "geohash_numeric", rel_error=0.0)


@_query(f"WITH {_XY}, {_SPLITS} SELECT i AS split_no, true AS within FROM b, range(b.b + 1) t(i)")
def equi_depth_splits_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the rank of each split of a relative error of 0.01 within it?"""
    rows = keyed(spark, sf_dir)
    return B.within_rank(rows, "geohash_numeric", B.equi_depth_splits(rows, "geohash_numeric", rel_error=0.01), 0.01)


@_query(f"""WITH {_XY}, {_SPLITS}, own AS (SELECT DISTINCT split::BIGINT AS s FROM splits WHERE split_no < (SELECT b FROM b))
SELECT event_id, geohash_numeric, s AS bucket_min FROM keyed ASOF JOIN own ON geohash_numeric >= s""")
def static_bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.equi_depth_bucket(keyed(spark, sf_dir), "geohash_numeric", rel_error=0.0)


@_query(f"""WITH {_XY}, own AS (SELECT DISTINCT geohash_numeric AS s FROM keyed WHERE event_id % 8 = 0), low AS (SELECT min(s) AS m FROM own)
SELECT event_id, geohash_numeric, coalesce(s, m) AS bucket_min FROM (SELECT * FROM keyed WHERE event_id % 8 <> 0) ASOF LEFT JOIN own ON geohash_numeric >= s, low""")
def nearest_lower_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir)
    buckets = rows.filter("event_id % 8 = 0").select(F.col("geohash_numeric").alias("bucket_min")).distinct()
    return B.assign_to_existing(rows.filter("event_id % 8 <> 0"), "geohash_numeric", buckets)


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).withColumn("bucket_min", F.shiftleft(F.shiftright("geohash_numeric", 24), 24))


_LAID = f"{_XY}, laid AS (SELECT event_id, geohash_numeric, (geohash_numeric // 16777216) * 16777216 AS bucket_min FROM keyed)"


@_query(f"WITH {_LAID} SELECT bucket_min, count(*) AS record_count FROM laid GROUP BY 1 HAVING count(*) > 128")
def oversize_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.oversize(B.bucket_counts(_laid(spark, sf_dir)))


@_query(f"WITH {_LAID} SELECT bucket_min, count(*) AS record_count, quantile_disc(geohash_numeric, 0.5) AS median FROM laid GROUP BY 1")
def bucket_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = _laid(spark, sf_dir).groupBy("bucket_min", "geohash_numeric").agg(F.count("*").alias("cnt"))
    return B.medians(histogram, "bucket_min", "geohash_numeric").select("bucket_min", F.col("n").alias("record_count"), "median")


@_query(f"WITH {_LAID} SELECT bucket_min, count(*) AS record_count, min(geohash_numeric) AS least, true AS within FROM laid GROUP BY 1")
def bucket_medians_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the rank of each label's median of a relative error of 0.02 within it?"""
    rows = _laid(spark, sf_dir)
    found = B.approximate_medians(rows, "bucket_min", "geohash_numeric", 0.02)
    both = rows.join(found, "bucket_min").groupBy("bucket_min", "n", "least").agg(F.count_if(F.col("geohash_numeric") < F.col("median")).alias("below"), F.count_if(F.col("geohash_numeric") <= F.col("median")).alias("upto"))
    within = (F.col("below") <= 0.52 * F.col("n")) & (F.col("upto") >= 0.48 * F.col("n"))
    return both.select("bucket_min", F.col("n").alias("record_count"), "least", within.alias("within"))


@_query(f"""WITH {_LAID}, m AS (SELECT bucket_min, count(*) AS n, min(geohash_numeric) AS lo, quantile_disc(geohash_numeric, 0.5) AS median FROM laid GROUP BY 1)
SELECT CASE WHEN n > 128 AND median > lo AND geohash_numeric >= median THEN median ELSE bucket_min END AS bucket_min, count(*) AS record_count FROM laid JOIN m USING (bucket_min) GROUP BY 1""")
def median_split_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = B.split_labels(_laid(spark, sf_dir), "geohash_numeric", rounds=1)
    return moved.groupBy("bucket_min").agg(F.sum("cnt").alias("record_count"))


@_query(f"""WITH RECURSIVE {_LAID}, h AS (SELECT bucket_min AS b, geohash_numeric AS k, count(*) AS c FROM laid GROUP BY ALL),
s AS (SELECT 0 AS step, b, k, c FROM h UNION ALL
  SELECT step + 1, CASE WHEN n > 128 AND p IS NOT NULL AND k >= p THEN p ELSE b END, k, c FROM (
    SELECT *, CASE WHEN med > lo THEN med ELSE nxt END AS p FROM (
      SELECT *, min(CASE WHEN k > med THEN k END) OVER (PARTITION BY b) AS nxt FROM (
        SELECT *, sum(c) OVER (PARTITION BY b) AS n, min(k) OVER (PARTITION BY b) AS lo, min(CASE WHEN run >= (tot + 1) // 2 THEN k END) OVER (PARTITION BY b) AS med FROM (
          SELECT *, sum(c) OVER (PARTITION BY b ORDER BY k) AS run, sum(c) OVER (PARTITION BY b) AS tot FROM s)))) WHERE step < 16)
SELECT b AS bucket_min, sum(c)::BIGINT AS record_count FROM s WHERE step = 16 GROUP BY 1""")
def median_split_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bucket_counts(B.split_oversize(_laid(spark, sf_dir), "geohash_numeric"))


# Integer rectangles of parts: x, y, width and height, with a hole in every third.
_RECT = "p_partkey, p_partkey % 100 AS x, p_partkey % 70 AS y, 4 + p_size AS w, 6 + p_size % 20 AS h, p_partkey % 3 = 0 AS hole"


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").selectExpr(*_RECT.split(", "))
    shell = "format_string('[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]', x, y, x+w, y, x+w, y+h, x, y+h, x, y)"
    inner = "format_string(',[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]', x+1, y+1, x+1, y+2, x+2, y+2, x+2, y+1, x+1, y+1)"
    text = f"concat('{{\"type\":\"Polygon\",\"coordinates\":[', {shell}, if(hole, {inner}, ''), ']}}')"
    return rows.withColumn("geojson", F.expr(text))


def _shown(df: DataFrame, key: str) -> DataFrame:
    """Type, parts, points and ordinate sums of a geometry struct."""
    points_ = F.flatten(F.transform("g.part", lambda p: p["coordinate"]))
    total = lambda k: F.aggregate(points_, F.lit(0.0), lambda s, p: s + p[k])
    return df.select(key, F.col("g.type").alias("type"), F.size("g.part").cast("long").alias("parts"), F.size(points_).cast("long").alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@_query("SELECT p_partkey, 1 AS type, 1::BIGINT AS parts, 1::BIGINT AS points, (p_partkey % 180)::DOUBLE AS sum_x, (p_size - 40)::DOUBLE AS sum_y FROM part")
def parse_point_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").withColumn("wkt", F.expr("format_string('POINT (%d %d)', p_partkey % 180, p_size - 40)"))
    return _shown(rows.withColumn("g", G.geometry_struct(F.col("wkt"), "wkt")), "p_partkey")


@_query("SELECT o_orderkey, 2 AS type, 1::BIGINT AS parts, 3::BIGINT AS points, (o_orderkey % 90 + 90 + o_custkey % 50)::DOUBLE AS sum_x, (o_custkey % 40 + 1)::DOUBLE AS sum_y FROM orders")
def parse_linestring_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("wkt", F.expr("format_string('LINESTRING (%d %d, 90 0, %d 1)', o_orderkey % 90, o_custkey % 40, o_custkey % 50)"))
    return _shown(rows.withColumn("g", G.geometry_struct(F.col("wkt"), "wkt")), "o_orderkey")


@_query(f"""SELECT p_partkey, 3 AS type, (CASE WHEN hole THEN 2 ELSE 1 END)::BIGINT AS parts, (CASE WHEN hole THEN 10 ELSE 5 END)::BIGINT AS points,
(5 * x + 2 * w + CASE WHEN hole THEN 5 * x + 7 ELSE 0 END)::DOUBLE AS sum_x, (5 * y + 2 * h + CASE WHEN hole THEN 5 * y + 7 ELSE 0 END)::DOUBLE AS sum_y FROM (SELECT {_RECT} FROM part)""")
def parse_polygon_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_rectangles(spark, sf_dir).withColumn("g", G.geometry_struct(F.col("geojson"), "geojson")), "p_partkey")


@_query("SELECT s_suppkey, 6 AS type, 2::BIGINT AS parts, 8::BIGINT AS points, (8 * (s_suppkey % 50) + 22)::DOUBLE AS sum_x, (8 * s_nationkey + 2)::DOUBLE AS sum_y FROM supplier")
def parse_multipolygon_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = "s_suppkey % 50", "s_nationkey"
    ring = lambda d: f"format_string('[[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]', {a}+{d}, {b}, {a}+{d}+1, {b}, {a}+{d}, {b}+1, {a}+{d}, {b})"
    rows = _table(spark, sf_dir, "supplier").withColumn("t", F.expr(f"concat('{{\"type\":\"MultiPolygon\",\"coordinates\":[', {ring(0)}, ',', {ring(5)}, ']}}')"))
    return _shown(rows.withColumn("g", G.geometry_struct(F.col("t"), "geojson")), "s_suppkey")


@_query("SELECT s_suppkey, 1 AS type, 1::BIGINT AS parts, 1::BIGINT AS points, CASE WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE 2.0 END::DOUBLE AS sum_x, 1.0::DOUBLE AS sum_y FROM supplier")
def parse_wkb_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian points (0 1) and big-endian points (2 1)."""
    little, big = "0101000000" + "00" * 8 + "000000000000F03F", "0000000001" + "4000000000000000" + "3FF0000000000000"
    rows = _table(spark, sf_dir, "supplier").withColumn("wkb", F.unhex(F.when(F.col("s_suppkey") % 2 == 0, little).otherwise(big)))
    return _shown(G.with_geometry(rows, "wkb", "wkb").withColumnRenamed("wkb", "g"), "s_suppkey")


def _wkb_shape(kind: str, end: str) -> str:
    """SQL for hexadecimal WKB of the points (x y), (7 0), (0 7), (x y) and (y x), with ordinates from 0 to 7, as the kind asks for."""
    known = ", ".join(f"'{struct.pack(end + 'd', v).hex()}'" for v in range(8))
    at = lambda v: f"element_at(array({known}), cast({v} AS int) + 1)"
    n = lambda v: f"'{struct.pack(end + 'I', v).hex()}'"
    head = lambda code: f"'{'01' if end == '<' else '00'}', {n(code)}"
    dot = lambda a, b: f"{at(a)}, {at(b)}"
    line, ring = f"{n(2)}, {dot('x', 'y')}, {dot('y', 'x')}", f"{n(1)}, {n(4)}, {dot('x', 'y')}, {dot(7, 0)}, {dot(0, 7)}, {dot('x', 'y')}"
    inner = {"points": (4, f"{head(1)}, {dot('x', 'y')}, {head(1)}, {dot('y', 'x')}"), "lines": (5, f"{head(2)}, {line}, {head(2)}, {line}"), "polygons": (6, f"{head(3)}, {ring}, {head(3)}, {ring}")}
    if kind in inner:
        code, body = inner[kind]
        return f"concat({head(code)}, {n(2)}, {body})"
    return f"concat({head(2)}, {line})" if kind == "line" else f"concat({head(3)}, {ring})"


_WKB_KINDS = ("line", "polygon", "points", "lines", "polygons")
_EACH_KIND = "CASE p_partkey % 5 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END"


@_query(f"""SELECT p_partkey, ({_EACH_KIND.format(2, 3, 4, 5, 6)})::INT AS type, ({_EACH_KIND.format(1, 1, 2, 2, 2)})::BIGINT AS parts, ({_EACH_KIND.format(2, 4, 2, 4, 8)})::BIGINT AS points,
({_EACH_KIND.format("x + y", "2 * x + 7", "x + y", "2 * (x + y)", "4 * x + 14")})::DOUBLE AS sum_x, ({_EACH_KIND.format("x + y", "2 * y + 7", "x + y", "2 * (x + y)", "4 * y + 14")})::DOUBLE AS sum_y FROM (SELECT p_partkey, p_partkey % 8 AS x, p_size % 8 AS y FROM part)""")
def parse_wkb_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary lines, polygons and multi types in either byte order."""
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 8 AS x", "p_size % 8 AS y")
    little, big = (_EACH_KIND.format(*[_wkb_shape(k, end) for k in _WKB_KINDS]) for end in "<>")
    rows = rows.withColumn("g", F.unhex(F.expr(f"CASE WHEN p_partkey % 2 = 0 THEN {little} ELSE {big} END")))
    return _shown(G.with_geometry(rows, "g", "wkb"), "p_partkey")


_DOT, _BEND = "'[' || x::DOUBLE || ',' || y::DOUBLE || ']'", "'[' || (x + 3)::DOUBLE || ',' || y::DOUBLE || '],[' || (x + 3)::DOUBLE || ',' || (y + 3)::DOUBLE || ']'"


@_query(f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN '{{"type":"Point","coordinates":' || dot || '}}' WHEN 1 THEN '{{"type":"LineString","coordinates":[' || dot || ',[5.0,6.5]]}}'
WHEN 2 THEN '{{"type":"Polygon","coordinates":[[' || ring || ']]}}' WHEN 3 THEN '{{"type":"MultiPoint","coordinates":[' || dot || ',[1.0,2.0]]}}' WHEN 4 THEN '{{"type":"MultiLineString","coordinates":[[' || dot || ',[1.0,2.0]],[[3.0,4.0],[5.0,6.0]]]}}'
WHEN 5 THEN '{{"type":"MultiPolygon","coordinates":[[[' || ring || ']]]}}' WHEN 6 THEN '{{"type":"GeometryCollection","geometries":[{{"type":"Point","coordinates":' || dot || '}},{{"type":"LineString","coordinates":[[1.0,2.0],[5.0,6.0]]}}]}}' END AS geometry
FROM (SELECT *, dot || ',' || bend || ',' || dot AS ring FROM (SELECT o_orderkey, {_DOT} AS dot, {_BEND} AS bend FROM (SELECT o_orderkey, o_orderkey % 90 AS x, o_custkey % 40 AS y FROM orders)))""")
def geometry_as_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WKT of all kinds as GeoJSON text, null where it is damaged."""
    ring = "format_string('%d %d, %d %d, %d %d, %d %d', x, y, x + 3, y, x + 3, y + 3, x, y)"
    text = f"""CASE o_orderkey % 8 WHEN 0 THEN format_string('POINT (%d %d)', x, y) WHEN 1 THEN format_string('LINESTRING (%d %d, 5 6.5)', x, y) WHEN 2 THEN concat('POLYGON ((', {ring}, '))') WHEN 3 THEN format_string('MULTIPOINT ((%d %d), (1 2))', x, y)
      WHEN 4 THEN format_string('MULTILINESTRING ((%d %d, 1 2), (3 4, 5 6))', x, y) WHEN 5 THEN concat('MULTIPOLYGON (((', {ring}, ')))') WHEN 6 THEN format_string('GEOMETRYCOLLECTION (POINT (%d %d), GEOMETRYCOLLECTION (LINESTRING (1 2, 5 6)))', x, y) ELSE 'POINT (1' END"""
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 90 AS x", "o_custkey % 40 AS y")
    return G.with_geojson(rows.select("o_orderkey", F.expr(text).alias("geometry")), "geometry", "wkt")


@_query(f"SELECT p_partkey, x::DOUBLE AS minx, y::DOUBLE AS miny, (x + w)::DOUBLE AS maxx, (y + h)::DOUBLE AS maxy FROM (SELECT {_RECT} FROM part)")
def geom_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.geometry_struct(F.col("geojson"), "geojson", ["bbox"])
    return _rectangles(spark, sf_dir).withColumn("g", g).select("p_partkey", "g.bbox.*")


@_query(f"SELECT p_partkey, (w * h - CASE WHEN hole THEN 1 ELSE 0 END)::DOUBLE AS area FROM (SELECT {_RECT} FROM part)")
def geom_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.geometry_struct(F.col("geojson"), "geojson", ["area"])
    return _rectangles(spark, sf_dir).withColumn("g", g).select("p_partkey", "g.area")


@_query(f"""SELECT p_partkey, round((w * h * (x + w / 2) - CASE WHEN hole THEN x + 1.5 ELSE 0 END) / (w * h - CASE WHEN hole THEN 1 ELSE 0 END), 6)::DOUBLE AS cx,
round((w * h * (y + h / 2) - CASE WHEN hole THEN y + 1.5 ELSE 0 END) / (w * h - CASE WHEN hole THEN 1 ELSE 0 END), 6)::DOUBLE AS cy FROM (SELECT {_RECT} FROM part)""")
def geom_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.geometry_struct(F.col("geojson"), "geojson", ["center"])
    return _rectangles(spark, sf_dir).withColumn("g", g).select("p_partkey", F.round("g.center.x", 6).alias("cx"), F.round("g.center.y", 6).alias("cy"))


@_query("""SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN x WHEN 1 THEN x + 1 WHEN 2 THEN (4 * (x + 2) + 2 * (x + 4)) / 6 ELSE x + 4 END, 6)::DOUBLE AS cx,
round(CASE o_orderkey % 4 WHEN 0 THEN y WHEN 1 THEN y + 2 WHEN 2 THEN (4 * y + 2 * (y + 1)) / 6 ELSE y + 1 END, 6)::DOUBLE AS cy, (o_orderkey % 4)::INT AS kind FROM (SELECT o_orderkey, o_orderkey % 90 AS x, o_custkey % 40 AS y FROM orders)""")
def geom_center_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centers of points, multi-points, lines, and of nested collections, where the highest dimension decides."""
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 4 AS int) AS kind", "o_orderkey % 90 AS x", "o_custkey % 40 AS y")
    text = """CASE kind WHEN 0 THEN format_string('POINT (%d %d)', x, y) WHEN 1 THEN format_string('MULTIPOINT ((%d %d), (%d %d))', x, y, x + 2, y + 4)
      WHEN 2 THEN format_string('LINESTRING (%d %d, %d %d, %d %d)', x, y, x + 4, y, x + 4, y + 2)
      ELSE format_string('GEOMETRYCOLLECTION (POINT (1 1), GEOMETRYCOLLECTION (LINESTRING (%d %d, %d %d)))', x, y, x + 8, y + 2) END"""
    found = rows.select("o_orderkey", "kind", G.geometry_struct(F.expr(text), "wkt", ["center"]).alias("g"))
    return found.select("o_orderkey", F.round("g.center.x", 6).alias("cx"), F.round("g.center.y", 6).alias("cy"), "kind")


@_query("SELECT o_orderkey, (o_orderkey % 90)::DOUBLE AS sx, (o_custkey % 40)::DOUBLE AS sy, (o_custkey % 50)::DOUBLE AS ex, 1.0::DOUBLE AS ey FROM orders")
def geom_startend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("wkt", F.expr("format_string('LINESTRING (%d %d, 90 0, %d 1)', o_orderkey % 90, o_custkey % 40, o_custkey % 50)"))
    rows = rows.withColumn("g", G.geometry_struct(F.col("wkt"), "wkt", ["startpoint", "endpoint"]))
    return rows.select("o_orderkey", F.col("g.startpoint.x").alias("sx"), F.col("g.startpoint.y").alias("sy"), F.col("g.endpoint.x").alias("ex"), F.col("g.endpoint.y").alias("ey"))


@_query("SELECT event_id FROM events WHERE event_id % 5 NOT IN (0, 1)")
def geom_null_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE event_id % 5 WHEN 0 THEN 'POLYGON ((0 0, 1 1' WHEN 1 THEN 'POINT EMPTY' ELSE format_string('POINT (%d 5)', event_id % 100) END"
    rows = _table(spark, sf_dir, "events").select("event_id", G.geometry_struct(F.expr(text), "wkt", ["geohash"]).alias("g"))
    return rows.filter(F.col("g").isNotNull()).select("event_id")


@_query("SELECT event_id, k, ('{\"k\":' || (event_id * 3 + k)::VARCHAR || '}') AS feature FROM events, range(2) t(k)")
def feature_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.expr("format_string('{\"type\":\"FeatureCollection\",\"features\":[{\"k\":%d},{\"k\":%d}]}', event_id * 3, event_id * 3 + 1)")
    return _table(spark, sf_dir, "events").select("event_id", F.posexplode(formats.features_of(document)).alias("k", "feature")).withColumn("k", F.col("k").cast("long"))


#: Features of a document that the fixture is written in, and folders of these.
DOCUMENT, FOLDERS = 2000, 16


@_query(f"SELECT 'c' || (event_id // {DOCUMENT} % {FOLDERS})::VARCHAR || '_ndjson.json' AS lines_file, count(*) AS lines, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def ndjson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as documents of bounded size in few folders, cut into features again, whose lines go to a folder for each."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(f"event_id div {DOCUMENT}").cast("int").alias("doc"))
    files = (rows.agg(F.max("doc")).first()[0] or 0) + 1
    line = F.concat(F.when(F.col("event_id") % DOCUMENT == 0, "").otherwise(","), F.to_json(F.struct("event_id")))
    lines = rows.select("doc", F.col("event_id").alias("at"), line.alias("value"))
    ends = rows.groupBy("doc").agg(F.lit(None).cast("long").alias("at")).withColumn("value", F.lit('{"type":"FeatureCollection","features":['))
    ends = ends.unionByName(ends.select("doc", F.lit(1 << 62).alias("at"), F.lit("]}").alias("value")))
    docs = lines.unionByName(ends).withColumn("name", F.format_string("c%d", F.col("doc") % FOLDERS))
    folder, target = scratch_path(spark, "documents"), scratch_path(spark, "lines")
    # a document is a file, and a file a task's
    docs.repartitionById(files, F.col("doc")).sortWithinPartitions("name", "doc", "at").drop("doc", "at").write.partitionBy("name").text(folder)
    found = features_in(spark, f"{folder}/name=*").select("feature", formats.lines_name(F.concat(F.regexp_extract("path", "name=(c[0-9]+)/", 1), F.lit(".geojson"))).alias("lines_file"))
    found.write.partitionBy("lines_file").text(target)
    return spark.read.text(target).groupBy("lines_file").agg(F.count("*").alias("lines"), F.sum(F.get_json_object("value", "$.event_id").cast("long")).alias("ids"))


@_query(f"SELECT 'r' || c_nationkey % 5 || '.geojson' AS file, 'r' || c_nationkey % 5 || '_ndjson.json' AS lines_file, count(*) AS features FROM customer GROUP BY ALL")
def ndjson_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as documents of five names, each of at most 2,000 features, turned into lines under the names' counterparts."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("c_custkey", "c_name").alias("properties")))
    rows = _table(spark, sf_dir, "customer").select(F.format_string("r%d.geojson", F.col("c_nationkey") % 5).alias("name"), F.expr(f"c_custkey div {DOCUMENT}").alias("doc"), feature.alias("feature"))
    document = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}"))
    folder = scratch_path(spark, "batch")
    rows.groupBy("name", "doc").agg(document.alias("value")).drop("doc").write.option("maxRecordsPerFile", 1).partitionBy("name").text(folder)
    return formats.collections_to_lines(spark, folder, scratch_path(spark, "lines"))


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def format_dispatch_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.read_by_extension(spark, f"{sf_dir}/nation.parquet")


@_query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def format_dispatch_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "nation") + ".csv"
    _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(path, header=True)
    return formats.read_by_extension(spark, path)


@_query("SELECT n_name, n_nationkey::VARCHAR AS key, '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey::VARCHAR || ',1]}' AS geometry FROM nation")
def format_dispatch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "nation") + ".geojson"
    line = F.expr("""format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%d,1]},"properties":{"name":"%s","key":%d}}', n_nationkey, n_name, n_nationkey)""")
    _table(spark, sf_dir, "nation").select(line.alias("value")).write.text(path)
    return formats.read_by_extension(spark, path).select(F.col("properties")["name"].alias("n_name"), F.col("properties")["key"].alias("key"), "geometry")


@_query("""SELECT p_partkey AS "key", p_partkey % 7 = 3 AS flag, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 1.5 ELSE p_partkey END::DOUBLE AS half, CASE WHEN p_partkey % 5 > 0 THEN p_partkey::VARCHAR ELSE 'none of "it"' END AS mixed, '{"a":' || p_size || '}' AS nested, NULL::VARCHAR AS nothing, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT END AS "some", '{"type":"Point","coordinates":[' || p_size || ',1]}' AS geometry FROM part""")
def property_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of parts with properties of all kinds, read as columns of the types that are found in them."""
    path = scratch_path(spark, "parts") + ".geojson"
    pairs = """concat('"key":', p_partkey, ',"flag":', p_partkey % 7 = 3, ',"half":', if(p_partkey % 3 > 0, format_string('%.1f', p_partkey * 1.5D), cast(p_partkey AS string)), ',"mixed":', if(p_partkey % 5 > 0, cast(p_partkey AS string), '"none of \\\\"it\\\\""'), ',"nested":{"a":', p_size, '},"nothing":null', if(p_partkey % 2 = 0, concat(',"some":', p_size), ''))"""
    line = F.expr(f"""concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', p_size, ',1]}},"properties":{{', {pairs}, '}}}}')""")
    _table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return formats.read_geojson_lines(spark, path, formats.ALL)


@_query()
def schema_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = tables.create_sql(TableSpec("lake", "events"), _table(spark, sf_dir, "events").schema, partitioned_by=["bucket_min"])
    return spark.createDataFrame(list(enumerate(statements)), "no int, statement string")


def _fresh(spark: SparkSession, df: DataFrame, partitioned_by: list[str]) -> TableSpec:
    spec = TableSpec("default", f"geobucket_{spark.sparkContext.applicationId.replace('-', '_')}_{next(_SERIAL)}")
    spark.sql(f"DROP TABLE IF EXISTS {spec.name}")
    tables.create_table(spark, spec, df.schema, partitioned_by=partitioned_by)
    return spec


@_query("SELECT o_orderkey, o_custkey, count(*) AS lines, sum(l_quantity::BIGINT)::BIGINT AS pieces FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines in a database of its own, in tables of as many buckets of the order's key as shuffles have partitions, joined and grouped without a shuffle."""
    database_, buckets = f"geobucket_{spark.sparkContext.applicationId.replace('-', '_')}_{next(_SERIAL)}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows, spec = _table(spark, sf_dir, name), TableSpec(database_, name)
        tables.create_table(spark, spec, rows.schema, partitioned_by=[f"bucket({buckets}, {key})"])
        tables.append(rows.repartition(buckets, key), spec)
    orders, lines = (spark.table(f"{database_}.{name}") for name in ("orders", "lineitem"))
    both = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("pieces"))


def _feature_file(rows: DataFrame, name: str) -> str:
    """Points (event_id, lon, lat) as a folder of feature lines."""
    path = f"{scratch_path(rows.sparkSession, name)}.geojson"
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(F.col("event_id").cast("string").alias("event_id")).alias("properties"))
    rows.select(F.to_json(feature).alias("value")).write.text(path)
    return path


def _loaded(spark: SparkSession, rows: DataFrame) -> tuple[TableSpec, TableSpec]:
    """Bronze and silver tables of points, by an initial load."""
    tag = f"{spark.sparkContext.applicationId.replace('-', '_')}_{next(_SERIAL)}"
    bronze, silver = (TableSpec("default", f"geobucket_{x}_{tag}") for x in ("bronze", "silver"))
    pipeline.initial_load(spark, _feature_file(rows, "first"), bronze, silver, rel_error=0.0, properties=["event_id"])
    return bronze, silver


_SHOWN = ("CAST(event_id AS bigint) AS event_id", "geohash_numeric", "bucket_min")


@_query(f"""WITH {_XY}, {_SPLITS}, own AS (SELECT DISTINCT split::BIGINT AS s FROM splits WHERE split_no < (SELECT b FROM b))
SELECT event_id, geohash_numeric, s AS bucket_min FROM keyed ASOF JOIN own ON geohash_numeric >= s""")
def initial_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from feature lines to bronze and silver."""
    return spark.table(_loaded(spark, points(spark, sf_dir))[1].name).selectExpr(*_SHOWN)


@_query(f"""WITH RECURSIVE {_XY}, even AS (SELECT * FROM keyed WHERE event_id % 2 = 0), n AS (SELECT count(*) AS n FROM even), b AS (SELECT (n + 63) // 64 AS b, n FROM n),
ranked AS (SELECT geohash_numeric AS k, row_number() OVER (ORDER BY geohash_numeric) AS r FROM even),
own AS (SELECT DISTINCT k AS s FROM b, range((n + 63) // 64) t(i), ranked WHERE r = greatest(1, ceil(i * 1.0::DOUBLE / b * n)::BIGINT)), low AS (SELECT min(s) AS m FROM own),
placed AS (SELECT event_id, geohash_numeric AS k, coalesce(s, m) AS b FROM keyed ASOF LEFT JOIN own ON geohash_numeric >= s, low),
h AS (SELECT b AS b0, b, k, count(*) AS c FROM placed WHERE b IN (SELECT b FROM placed WHERE event_id % 2 = 1) GROUP BY ALL),
s AS (SELECT 0 AS step, b0, b, k, c FROM h UNION ALL
  SELECT step + 1, b0, CASE WHEN n <= 128 OR p IS NULL THEN b WHEN k >= p THEN p WHEN p <= b THEN lo ELSE b END, k, c FROM (
    SELECT *, CASE WHEN med > lo THEN med ELSE nxt END AS p FROM (
      SELECT *, min(CASE WHEN k > med THEN k END) OVER (PARTITION BY b) AS nxt FROM (
        SELECT *, tot AS n, min(k) OVER (PARTITION BY b) AS lo, min(CASE WHEN run >= (tot + 1) // 2 THEN k END) OVER (PARTITION BY b) AS med FROM (
          SELECT *, sum(c) OVER (PARTITION BY b ORDER BY k) AS run, sum(c) OVER (PARTITION BY b) AS tot FROM s)))) WHERE step < 12)
SELECT event_id, placed.k AS geohash_numeric, coalesce(s.b, placed.b)::BIGINT AS bucket_min FROM placed LEFT JOIN (SELECT * FROM s WHERE step = 12) s ON s.b0 = placed.b AND s.k = placed.k""")
def incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events added to the silver table of the even ones, with splits of oversize buckets."""
    rows = points(spark, sf_dir)
    bronze, silver = _loaded(spark, rows.filter("event_id % 2 = 0"))
    pipeline.incremental_load(spark, _feature_file(rows.filter("event_id % 2 = 1"), "second"), bronze, silver, properties=["event_id"])
    return spark.table(silver.name).selectExpr(*_SHOWN)


@_query(f"WITH {_XY} SELECT event_id, geohash_numeric FROM keyed WHERE geohash_numeric BETWEEN 200000000 AND 500000000")
def key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the silver table in a range of keys, from the buckets that may hold them."""
    silver = _loaded(spark, points(spark, sf_dir))[1]
    return pipeline.in_key_range(spark, silver, 200000000, 500000000).selectExpr(*_SHOWN[:2])


@_query(f"WITH {_LAID} SELECT event_id, geohash_numeric, bucket_min FROM laid")
def bronze_silver_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table partitioned by bucket, filled by two appends and read back."""
    rows = _laid(spark, sf_dir)
    spec = _fresh(spark, rows, ["bucket_min"])
    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")):
        tables.append(part.repartition("bucket_min"), spec)
    return spark.table(spec.name)


@_query(f"WITH {_LAID} SELECT event_id, CASE WHEN bucket_min = 0 THEN -1 ELSE geohash_numeric END AS geohash_numeric, bucket_min FROM laid")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(_laid(spark, sf_dir), "rows")
    spec = _fresh(spark, rows, ["bucket_min"])
    tables.append(rows.repartition("bucket_min"), spec)
    tables.overwrite_partitions(rows.filter("bucket_min = 0").withColumn("geohash_numeric", F.lit(-1).cast("long")), spec)
    return spark.table(spec.name)


# Edges of all orders: a node for each customer, with an edge to node 0, a hub, and up to seven others. The trace of all events walks along three nodes for each.
_STEP = "CASE WHEN {j} = 0 THEN 0 ELSE ({at} * 7 + {j}) % n END"
_EDGES = f"""nodes AS (SELECT count(*) AS n FROM customer),
edges AS (SELECT row_number() OVER (ORDER BY src, dst) AS pos, src, dst FROM (SELECT DISTINCT (o_custkey % n)::INT AS src, ({_STEP.format(j="(o_orderkey % 8)", at="o_custkey")})::INT AS dst FROM orders, nodes))"""
_PAIRS = f"{_EDGES}, pairs AS (SELECT row_number() OVER (ORDER BY a.pos, b.pos) AS pair_no, a.pos AS edge1_id, b.pos AS edge2_id, a.src AS n1, a.dst AS n2, b.dst AS n3 FROM edges a JOIN edges b ON a.dst = b.src)"
_TRIPLES = f"""w1 AS (SELECT ts, event_id, n, (event_id * 31 + user_id) % n AS a FROM events, nodes),
w2 AS (SELECT *, {_STEP.format(j="(event_id % 8)", at="a")} AS b FROM w1), w3 AS (SELECT *, {_STEP.format(j="(event_id // 8 % 8)", at="b")} AS c FROM w2),
steps AS (SELECT ts, event_id, 0 AS k, a AS node FROM w3 UNION ALL SELECT ts, event_id, 1, b FROM w3 UNION ALL SELECT ts, event_id, 2, c FROM w3),
trace AS (SELECT node::INT AS n1, lead(node::INT, 1) OVER w AS n2, lead(node::INT, 2) OVER w AS n3 FROM steps WINDOW w AS (ORDER BY ts, event_id, k)),
triples AS (SELECT DISTINCT n1, n2, n3 FROM trace WHERE n3 IS NOT NULL)"""


def _with_nodes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _table(spark, sf_dir, name).withColumn("n", F.lit(_table(spark, sf_dir, "customer").count()))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = _STEP.format(j="(o_orderkey % 8)", at="o_custkey")
    rows = _with_nodes(spark, sf_dir, "orders").selectExpr("cast(o_custkey % n as int) AS src", f"cast({step} as int) AS dst").distinct()
    return stored(numbered(rows, ["src", "dst"], "pos").withColumn("edge_id", F.col("pos")), "edges")


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_nodes(spark, sf_dir, "events").withColumn("a", F.expr("(event_id * 31 + user_id) % n"))
    rows = rows.withColumn("b", F.expr(_STEP.format(j="(event_id % 8)", at="a")))
    rows = rows.withColumn("c", F.expr(_STEP.format(j="(event_id div 8 % 8)", at="b")))
    steps = rows.select("ts", "event_id", F.posexplode(F.array("a", "b", "c")).alias("k", "node"))
    return stored(numbered(steps, ["ts", "event_id", "k"], "pos").select("pos", F.col("node").cast("int").alias("node")), "trace")


@_query(f"WITH {_EDGES} SELECT pos, src, dst FROM edges")
def edge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges printed as text and parsed again."""
    lines = _edges(spark, sf_dir).select("pos", F.format_string("Edge %d: Node %d → Node %d; rest", "pos", "src", "dst").alias("t"))
    return lines.select("pos", F.explode(edges.parsed_edges(F.col("t"))).alias("e")).select("pos", "e.src", "e.dst")


@_query(f"WITH {_EDGES} SELECT pos, pos AS edge_id, src, dst FROM edges")
def edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as lines of three tokens to a folder of files in order, and read again with the lines' places."""
    path = scratch_path(spark, "edges")
    rows = _edges(spark, sf_dir).repartitionByRange("pos").sortWithinPartitions("pos")
    rows.select(F.format_string("e%d n%d n%d", "pos", "src", "dst").alias("value")).write.text(path)
    return edges.read_edges(spark, path).select("pos", F.col("edge_id").cast("long").alias("edge_id"), "src", "dst")


@_query(f"WITH {_PAIRS} SELECT edge1_id, edge2_id, n1, n2, n3 FROM pairs")
def edge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_pairs(_edges(spark, sf_dir)).select("edge1_id", "edge2_id", "n1", "n2", "n3")


@_query(f"WITH {_PAIRS} SELECT pair_no, edge1_id, edge2_id, n1, n2, n3 FROM pairs")
def edge_pairs_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.numbered_pairs(_edges(spark, sf_dir))


@_query(f"WITH {_PAIRS} SELECT pair_no, 'Paired Edge ' || pair_no || ': Node ' || n1 || ' → Node ' || n2 || ' , Node ' || n2 || ' → Node ' || n3 AS line FROM pairs")
def edge_pairs_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rendered_pairs(_edges(spark, sf_dir))


@_query(f"WITH {_PAIRS}, {_TRIPLES} SELECT pair_no, n1, n2, n3 FROM pairs SEMI JOIN triples USING (n1, n2, n3)")
def pair_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.covered_pairs(graph.numbered_pairs(_edges(spark, sf_dir)), _trace(spark, sf_dir)).select("pair_no", "n1", "n2", "n3")


@_query(f"WITH {_PAIRS}, {_TRIPLES} SELECT pair_no, n1, n2, n3 FROM pairs ANTI JOIN triples USING (n1, n2, n3)")
def pair_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.uncovered_pairs(graph.numbered_pairs(_edges(spark, sf_dir)), _trace(spark, sf_dir)).select("pair_no", "n1", "n2", "n3")


@_query(f"""WITH {_EDGES.split(",")[0]}, {_TRIPLES.split("trace AS")[0]} five AS (SELECT node::INT AS n1, lead(node::INT, 1) OVER w AS n2, lead(node::INT, 2) OVER w AS n3, lead(node::INT, 3) OVER w AS n4, lead(node::INT, 4) OVER w AS n5 FROM steps WINDOW w AS (ORDER BY ts, event_id, k))
SELECT DISTINCT n1, n2, n3, n4, n5 FROM five WHERE n5 IS NOT NULL""")
def trace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different runs of five nodes of the trace."""
    return graph.trace_windows(_trace(spark, sf_dir), 5)


@_query(f"WITH {_PAIRS}, {_TRIPLES} SELECT count(*) AS pairs, count(t.n1) AS covered, count(*) = count(t.n1) AS all_covered FROM pairs p LEFT JOIN triples t ON p.n1 = t.n1 AND p.n2 = t.n2 AND p.n3 = t.n3")
def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coverage(graph.numbered_pairs(_edges(spark, sf_dir)), _trace(spark, sf_dir))


# Items of events: value rounded, category by type, with gaps of each kind.
_ITEM = "event_id AS item_pos, event_id % 17 = 3 AS is_null, event_id % 13 <> 5 AS has_value, event_id % 11 <> 7 AS value_is_int, cast(floor(value) AS int) AS value, event_id % 7 <> 2 AS has_category, CASE event_id % 4 WHEN 0 THEN 'Special' WHEN 1 THEN 'normal' WHEN 2 THEN event_type END AS category"
OPTIONS = {"doubleHighAlpha": True, "addLowAlpha": False, "negateSpecialBeta": True, "logAll": True}
THRESHOLD = 20
_SKIP = "WHEN is_null OR NOT has_value THEN [6, 7] WHEN NOT value_is_int OR value IS NULL THEN [6, 8, 9]"
_ALPHA = "CASE WHEN value > 20 THEN [11, 12, 13] WHEN value < 20 THEN [11, 15, 16] ELSE [11, 18] END || [19]"
_BETA = "CASE WHEN NOT has_category THEN [20, 27] WHEN lower(category) = 'special' THEN [20, 21, 22, 23] WHEN lower(category) = 'normal' THEN [20, 21, 25] ELSE [20, 21, 26] END || [28]"


def _gamma_sql() -> str:
    step = lambda j: f"CASE WHEN value > {20 + 5 * j} THEN [30, 31, 33, 36] WHEN value < {20 - 5 * j} THEN [30, 34, 36] ELSE [30, 35] END"
    out = lambda j: f"(value > {20 + 5 * j} OR value < {20 - 5 * j})"
    return f"[29] || {step(0)} || CASE WHEN {out(0)} THEN {step(1)} ELSE [] END || CASE WHEN {out(0)} AND {out(1)} THEN {step(2)} ELSE [] END || [37]"


def _rule_sql(middle: str) -> str:
    own = f"SELECT item_pos, CASE {_SKIP} ELSE [6, 8, 10] || {middle} || [39, 40, 41] END AS t FROM (SELECT {_ITEM} FROM events)"
    return f"SELECT item_pos, array_to_string(t, ',') AS trace FROM ({own})"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*[x.strip() for x in _ITEM.split(", ")])


def _traced(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return rules.item_traces(_items(spark, sf_dir), mode, THRESHOLD, OPTIONS).select("item_pos", F.concat_ws(",", F.col("trace").cast("array<string>")).alias("trace"))


@_query(_rule_sql(_ALPHA))
def rules_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir, "alpha")


@_query(_rule_sql(_BETA))
def rules_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir, "beta")


@_query(_rule_sql(_gamma_sql()))
def rules_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir, "gamma")


@_query(_rule_sql("[38]"))
def rules_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir, "delta")


@_query(f"""WITH i AS (SELECT item_pos, CASE {_SKIP} ELSE [6, 8, 10] || {_ALPHA} || [39, 40, 41] END AS t FROM (SELECT {_ITEM} FROM events))
SELECT -1::BIGINT AS item_pos, k, node FROM (VALUES (0, 1), (1, 3), (2, 5)) v(k, node)
UNION ALL SELECT item_pos, (unnest(range(len(t))))::INT AS k, unnest(t)::INT AS node FROM i
UNION ALL SELECT 9223372036854775807, 0, 42""")
def rules_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.process(_items(spark, sf_dir), "alpha", THRESHOLD, OPTIONS)


@_query(f"""SELECT item_pos, CASE WHEN is_null OR NOT has_value THEN 'Warning: Skipping invalid data item.'
WHEN NOT value_is_int OR value IS NULL THEN 'Warning: Skipping item with non-integer value.'
ELSE CASE WHEN value > 20 THEN 'Alpha: High value doubled: ' || (value * 2)::VARCHAR WHEN value < 20 THEN 'Alpha: Low value adjusted: ' || (value + 5)::VARCHAR ELSE 'Alpha: Threshold value: ' || value::VARCHAR END
  || '|Logged: {{' || CASE WHEN has_category THEN 'category=' || coalesce(category, 'null') || ', ' ELSE '' END || 'value=' || value::VARCHAR || '}}' END AS messages
FROM (SELECT {_ITEM} FROM events)""")
def rules_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.item_traces(_items(spark, sf_dir), "alpha", THRESHOLD, OPTIONS)
    return rows.select("item_pos", F.concat_ws("|", "messages").alias("messages"))


@_query("SELECT l_orderkey, l_linenumber, (l_extendedprice::BIGINT * (100 - (l_discount * 100)::BIGINT)) // 100 AS discounted FROM lineitem")
def discount_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    price, percent = F.rint("l_extendedprice").cast("bigint"), F.rint(F.col("l_discount") * 100).cast("bigint")
    return rows.select("l_orderkey", "l_linenumber", S.discounted(price, percent).alias("discounted"))


@_query("SELECT * FROM part WHERE p_partkey = 77")
def item_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.row_by_key(_table(spark, sf_dir, "part"), "p_partkey", 77)


@_query("SELECT l_partkey AS id, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 77 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = 77)")
def views_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber")
    return S.views_of(views, _table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id"), 77)


@_query("SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 42 AND c_nationkey = 7")
def user_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exists(_table(spark, sf_dir, "customer"), c_custkey=42, c_nationkey=7)


@_query("SELECT 41::BIGINT AS i, '{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}' AS json FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 1 OFFSET 41)")
def item_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.item_by_index(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 41)


@_query("""WITH p AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)
SELECT i, '{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}' AS json FROM p WHERE i IN (SELECT l_orderkey FROM lineitem)""")
def items_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items at all positions that a table asks for."""
    index = S.position_index(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return index.fetch(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i")))


@_query("""WITH a AS (SELECT user_id % 50 AS userid, event_id % 3 AS id, CASE WHEN event_id % 5 < 2 THEN 1 ELSE -1 END AS change, ts, event_id FROM events),
s AS (SELECT *, sum(change) OVER (PARTITION BY userid, id ORDER BY ts, event_id) AS s FROM a)
SELECT userid, id, (sum(change) - least(0, min(s)))::BIGINT AS quantity FROM s GROUP BY ALL HAVING sum(change) - least(0, min(s)) > 0""")
def folded_carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carts after all events as actions in the order of time."""
    actions = _table(spark, sf_dir, "events").selectExpr("user_id % 50 AS userid", "event_id % 3 AS id", "CASE WHEN event_id % 5 < 2 THEN 1 ELSE -1 END AS change", "ts", "event_id")
    return S.folded_carts(actions, "ts", "event_id")


@_query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'getviews' WHEN 1 THEN 'getallitems' ELSE 'Invalid action' END AS action,
CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR ELSE '' END AS id, CASE event_id % 3 WHEN 1 THEN user_id::VARCHAR ELSE '' END AS i FROM events""")
def json_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = """CASE event_id % 3 WHEN 0 THEN format_string('{"action":"getviews","id":%d}', event_id) WHEN 1 THEN format_string('{"action":"getallitems","i":%d}', user_id) ELSE '{"action":"drop"}' END"""
    return _table(spark, sf_dir, "events").select("event_id", *S.request_fields(F.expr(request))).select("event_id", "action", "id", "i")


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS text, o_orderdate::DATE AS date FROM orders")
def date_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = S.date_text(F.col("o_orderdate"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), S.text_date(text).alias("date"))


@_query("SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_custkey::INT AS item, floor(o_totalprice)::INT AS totalprice, 'Pending' AS \"orderStatus\" FROM orders")
def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts with dense ids in their order."""
    carts = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "array(cast(o_custkey AS int)) AS items", "cast(floor(o_totalprice) AS int) AS totalprice")
    return S.receipts(carts, "o_orderkey").select("id", F.get("items", F.lit(0)).alias("item"), "totalprice", "orderStatus")


@_query("SELECT c_custkey, (c_custkey % 5)::INT + 1 AS more, greatest(0, (c_custkey % 5)::INT - 1) AS less FROM customer")
def cart_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cart with c_custkey % 5 pieces of item 7, with one more and one less."""
    cart = F.when(F.col("c_custkey") % 5 > 0, F.create_map(F.lit(7), (F.col("c_custkey") % 5).cast("int"), F.lit(8), F.lit(1))).otherwise(F.create_map(F.lit(8), F.lit(1)))
    seven = lambda m: F.coalesce(F.try_element_at(m, F.lit(7)), F.lit(0))
    return _table(spark, sf_dir, "customer").select("c_custkey", seven(S.cart_added(cart, F.lit(7))).alias("more"), seven(S.cart_decreased(cart, F.lit(7))).alias("less"))


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10")
def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "customer").createOrReplaceTempView("geobucket_customer")
    return database.query(spark, "SELECT c_custkey, c_name, c_acctbal FROM geobucket_customer WHERE c_mktsegment = ? AND c_nationkey < ?", "BUILDING", 10)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
