"""Damaged binary geometries are null, and nested collections have the members of all levels."""

import random
import struct

from geobucket.functions import geometry as G
from pyspark.sql import functions as F


def wkb(code, body, end="<"):
    return bytes([end == "<"]) + struct.pack(f"{end}I", code) + body


def many(items, end="<"):
    return struct.pack(f"{end}I", len(items)) + b"".join(items)


P = [struct.pack("<2d", x, y) for x, y in ((0, 0), (4, 0), (4, 4), (0, 0))]
GOOD = {
    "point": wkb(1, P[1]), "big": wkb(1, struct.pack(">2d", 4, 0), ">"), "line": wkb(2, many(P[:2])), "polygon": wkb(3, many([many(P)])), "points": wkb(4, many([wkb(1, p) for p in P[:2]])), "lines": wkb(5, many([wkb(2, many(P[:2]))] * 2)),
    "polygons": wkb(6, many([wkb(3, many([many(P)]))])), "z": wkb(1001, struct.pack("<3d", 4, 0, 9)), "srid": wkb(0x20000001, struct.pack("<I", 4326) + P[1]), "both": wkb(7, many([wkb(1, P[1]), wkb(7, many([wkb(2, many(P[:2]))]))])),
}


def parsed(spark, values):
    df = spark.createDataFrame([(i, bytearray(v) if v is not None else None) for i, v in enumerate(values)], "id int, g binary")
    return {r.id: r.g for r in G.with_geometry(df, "g", "wkb", ["center"]).collect()}


def test_kinds(spark):
    got = parsed(spark, GOOD.values())
    assert [got[i].type if got[i] else None for i in range(len(GOOD))] == [1, 1, 2, 3, 4, 5, 6, 1, 1, 0]
    assert all((got[i].center.x, got[i].center.y) == (4, 0) for i in (0, 1, 7, 8)) and (got[9].center.x, got[9].center.y) == (2, 0)


def test_damage_is_null(spark):
    deep = wkb(7, many([wkb(1, P[0])]))
    for _ in range(3000):
        deep = wkb(7, many([deep]))
    bad = [b"", b"\1", b"\1\1\0\0\0", GOOD["point"][:-1], wkb(4, many([wkb(7, many([]))])), wkb(6, many([wkb(1, P[0])])), wkb(99, P[0]), b"\7" + GOOD["point"][1:], wkb(2, struct.pack("<I", 2**32 - 1)), deep, None]
    assert set(parsed(spark, bad).values()) == {None}


def test_random_bytes_never_fail(spark):
    r, values = random.Random(5), []
    for _ in range(3000):
        raw = bytearray(r.choice(list(GOOD.values())))
        for _ in range(r.randrange(1, 5)):
            raw[r.randrange(len(raw))] = r.randrange(256)
        values.append(bytes(raw[: r.randrange(len(raw) + 1)] if r.random() < 0.3 else raw))
    assert len(parsed(spark, values)) == 3000


def test_nested_collections(spark):
    point = lambda x, y: f'{{"type":"Point","coordinates":[{x},{y}]}}'
    line = '{"type":"LineString","coordinates":[[0,0],[8,0]]}'
    box = '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}'
    of = lambda *g: f'{{"type":"GeometryCollection","geometries":[{",".join(g)}]}}'
    cases = {
        of(point(1, 2), of(point(3, 4))): (2, 3), of(of(of(of(line), point(9, 9)))): (4, 0), of(of(of(point(5, 5)), line), of(box)): (1, 1), of(of(), point(6, 6)): (6, 6), of(point(1, 1), '{"type":"Point"}'): None, of(of("null")): None,
        '{"type":"GeometryCollection"}': None, point(1, 1).replace("Point", "GeometryCollection"): None,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, t string")
    got = {r.id: r.g for r in rows.select("id", G.geometry_struct(F.col("t"), "geojson", ["center"]).alias("g")).collect()}
    assert [got[i] and (got[i].center.x, got[i].center.y) for i in range(len(cases))] == list(cases.values())
    assert all(g.type == 0 and not g.part for g in got.values() if g)
    wkt = {"GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (POINT (3 4)))": (2, 3), "GeometryCollection(GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(LINESTRING (0 0, 8 0)), POINT (9 9)), MULTIPOINT ((1 1), (2 2)))": (4, 0), "GEOMETRYCOLLECTION (GEOMETRYCOLLECTION (POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0)), POINT (5 5)), POINT (7 7))": (1, 1)}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(wkt)], "id int, t string")
    got = {r.id: r.g for r in rows.select("id", G.geometry_struct(F.col("t"), "wkt", ["center"]).alias("g")).collect()}
    assert [got[i] and (got[i].center.x, got[i].center.y) for i in range(len(wkt))] == list(wkt.values())


def test_text_of_every_kind(spark):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in GOOD.items()], "k string, g binary")
    got = {r.k: r.g for r in G.with_geojson(df, "g", "wkb").collect()}
    ring = "[[0.0,0.0],[4.0,0.0],[4.0,4.0],[0.0,0.0]]"
    assert got["point"] == got["big"] == got["z"] == got["srid"] == '{"type":"Point","coordinates":[4.0,0.0]}'
    assert got["polygon"] == f'{{"type":"Polygon","coordinates":[{ring}]}}' and got["polygons"] == f'{{"type":"MultiPolygon","coordinates":[[{ring}]]}}'
    assert got["both"] == '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[4.0,0.0]},{"type":"LineString","coordinates":[[0.0,0.0],[4.0,0.0]]}]}'
    odd = ["POINT EMPTY", "GEOMETRYCOLLECTION (POINT (1 1))", "POINT (1", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", G.geojson_text(F.col("t"), "wkt").alias("g"))
    assert [r.g for r in sorted(rows.collect())] == ['{"type":"Point","coordinates":[]}', '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1.0,1.0]}]}', None, None]
    again = spark.createDataFrame([(k, t) for k, t in got.items()], "k string, t string")
    assert {r.k: r.t for r in again.select("k", G.geojson_text(F.col("t"), "geojson").alias("t")).collect()} == got
