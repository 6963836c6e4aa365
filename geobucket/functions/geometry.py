"""Geometries as one nested struct, parsed and measured with native expressions.

A parsed geometry is an array of members (type, shape); all but collections
have one. A shape nests polygons, parts and points: array of array of array of
[x, y]. Every type fits: a point is [[[p]]], a line [[line]], a polygon
[rings]. Measures therefore see the grouping of rings that the flat `part`
list of the result no longer has.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geohash import geohash_numeric, geohash_text

#: Type codes; any other type is 0.
TYPES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
FEATURES = ("bbox", "center", "area", "startpoint", "endpoint", "geohash")
FORMATS = ("wkb", "wkt", "geojson")
_POINT = "array<double>"
_SHAPE = f"array<array<array<{_POINT}>>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; expressions would repeat it wherever they use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(text: Column, depth: int) -> Column:
    kind = _POINT
    for _ in range(depth):
        kind = f"array<{kind}>"
    return F.from_json(text, kind)


def _shape(kind: Column, coordinates: Column) -> Column:
    """The shape of coordinates given as JSON text; null if they don't fit the type."""
    one = lambda x: F.array(F.array(x))
    return (
        F.when(kind == 1, one(F.array(_numbers(coordinates, 0))))
        .when(kind == 2, one(_numbers(coordinates, 1)))
        .when(kind == 3, F.array(_numbers(coordinates, 2)))
        .when(kind == 4, F.transform(_numbers(coordinates, 1), lambda p: F.array(F.array(p))))
        .when(kind == 5, F.transform(_numbers(coordinates, 2), lambda p: F.array(p)))
        .when(kind == 6, _numbers(coordinates, 3))
    )


def _code(name: Column) -> Column:
    out = F.lit(0)
    for k, v in TYPES.items():
        out = F.when(F.lower(name) == k.lower(), v).otherwise(out)
    return out


def _valid(kind: Column, shape: Column) -> Column:
    """Points have two finite ordinates, lines two points, rings are closed and have three points or more."""
    point = lambda p: (F.size(p) >= 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v))
    line = lambda q: (F.size(q) == 0) | (F.size(q) >= 2)
    ring = lambda q: (F.size(q) == 0) | ((F.size(q) >= 3) & (F.get(q, F.lit(0)) == F.element_at(q, -1)))
    part = lambda q: F.forall(q, point) & F.when(kind.isin(3, 6), ring(q)).when(kind.isin(2, 5), line(q)).otherwise(True)
    return shape.isNotNull() & F.forall(shape, lambda g: F.forall(g, part))


def _rounded(shape: Column, precision: str) -> Column:
    if precision == "double":
        return F.transform(shape, lambda g: F.transform(g, lambda q: F.transform(q, lambda p: F.slice(p, 1, 2))))
    return F.transform(shape, lambda g: F.transform(g, lambda q: F.transform(q, lambda p: F.transform(F.slice(p, 1, 2), lambda v: v.cast("float").cast("double")))))


def _member(name: Column, coordinates: Column, precision: str) -> Column:
    return _let(F.struct(_code(name).alias("k"), coordinates.alias("c")), lambda m: _typed(m["k"], _shape(m["k"], m["c"]), precision))


def _typed(kind: Column, shape: Column, precision: str) -> Column:
    """A member of a type and a shape, null if they don't make a geometry."""
    return _let(shape, lambda x: F.when((kind > 0) & _valid(kind, x), F.struct(kind.alias("type"), _rounded(x, precision).alias("shape"))))


def _whole(members: Column) -> Column:
    """Members, or null if one of them could not be parsed."""
    return _let(members, lambda x: F.when(F.forall(x, lambda m: m.isNotNull()), x))


def _collection(members: Column) -> Column:
    """The members of a collection, after one of type 0 without a shape, so that one of a single member is no plain geometry."""
    return F.concat(F.array(F.struct(F.lit(0).alias("type"), F.array().cast(_SHAPE).alias("shape"))), members)


_TYPED = "type string, coordinates string, geometries array<string>"


def _members_of(texts: Column) -> Column:
    """Geometries as JSON text, each collection replaced by its members, whatever the depth: a step opens one level, and there are no more levels than opening braces."""
    collection = lambda g: g["type"] == "GeometryCollection"

    def opened(now: Column, _: Column) -> Column:
        nested = lambda t: t.contains("GeometryCollection")
        one = lambda t: F.when(nested(t), _let(F.from_json(t, _TYPED), lambda g: F.when(collection(g), F.coalesce(g["geometries"], F.array(F.lit("null")))).otherwise(F.array(t)))).otherwise(F.array(t))
        return F.when(F.exists(now, nested), F.flatten(F.transform(now, one))).otherwise(now)

    levels = F.aggregate(texts, F.lit(0), lambda n, t: n + F.regexp_count(t, F.lit('"GeometryCollection"')).cast("int"))
    return F.when(levels == 0, texts).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), texts, opened))


def parse_geojson(text: Column, precision: str = "double") -> Column:
    """Members of a GeoJSON geometry, those of nested collections among them; null if it is malformed."""
    parsed = lambda t: _let(F.from_json(t, "type string, coordinates string"), lambda m: _member(m["type"], m["coordinates"], precision))
    members = lambda g: F.when(g["type"] == "GeometryCollection", _collection(F.transform(_members_of(g["geometries"]), parsed))).otherwise(F.array(_member(g["type"], g["coordinates"], precision)))
    return _whole(_let(F.from_json(text, _TYPED), members))


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_WKT = r"^\s*([A-Za-z]+)\s*(?:[ZMzm]{1,2}\b)?\s*(.*?)\s*$"


def _wkt_member(text: Column, precision: str) -> Column:
    parts = F.struct(_code(F.regexp_extract(text, _WKT, 1)).alias("k"), F.regexp_extract(text, _WKT, 2).alias("body"))
    return _let(parts, lambda m: _let(_wkt_lists(m["k"], m["body"]), lambda c: _typed(m["k"], F.when((m["k"] == 1) & (c == "[]"), F.array().cast(_SHAPE)).otherwise(_shape(m["k"], c)), precision)))


def _wkt_lists(kind: Column, body: Column) -> Column:
    """The body of a WKT geometry as JSON lists."""
    pairs = F.regexp_replace(body, rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*", "[$1,$2]")
    pairs = F.regexp_replace(F.regexp_replace(pairs, r"([\[,][-+]?)\.", r"$10."), r"\+|(?<=\d)\.(?=[,\]eE])", "")
    lists = F.translate(pairs, "()", "[]")

    def wrapped(x: Column) -> Column:
        # a point is wrapped once too often, as is each point of a multipoint in its longer form
        return F.when(kind == 1, F.regexp_replace(x, r"^\[(.*)\]$", "$1")).when(kind == 4, F.regexp_replace(x, r"\[(\[[^\[\]]*\])\]", "$1")).otherwise(x)

    one = lambda x: F.when((kind == 4) & ~F.startswith(x, F.lit("[[")), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)
    return F.when(F.upper(body) == "EMPTY", F.lit("[]")).otherwise(_let(_let(lists, wrapped), one))


def parse_wkt(text: Column, precision: str = "double") -> Column:
    """Members of a WKT geometry, those of nested collections among them; null if it is malformed."""
    nested = r"\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"
    # a collection without one inside gives its members to the one around it, as often as there are any
    simple = rf"[A-Za-z]+\s*(?:{nested}|(?i:EMPTY))"
    innermost = rf"(?i)(?<=[(,])\s*GEOMETRYCOLLECTION\s*\(\s*((?:(?!GEOMETRYCOLLECTION){simple}\s*,\s*)*(?!GEOMETRYCOLLECTION){simple})\s*\)"
    inner_ones = F.regexp_count(text, F.lit(r"(?i)GEOMETRYCOLLECTION")) - 1
    text = F.when(inner_ones <= 0, text).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(inner_ones, F.lit(1))), text, lambda t, _: F.regexp_replace(t, innermost, "$1")))
    body = F.regexp_extract(text, r"(?i)^\s*GEOMETRYCOLLECTION\s*\((.*)\)\s*$", 1)
    inner = F.transform(F.regexp_extract_all(body, F.lit(rf"([A-Za-z]+\s*{nested})"), 1), lambda m: _wkt_member(m, precision))
    return _whole(F.when(text.rlike(r"(?i)^\s*GEOMETRYCOLLECTION"), _collection(inner)).otherwise(F.array(_wkt_member(text, precision))))


#: Codes of the members of multi types.
MEMBERS = {4: 1, 5: 2, 6: 3}
_NAMES = {v: k for k, v in TYPES.items()}
#: Collections within collections beyond which a value counts as damaged.
DEEPEST = 64


class _Damaged(ValueError):
    pass


def _wkb_text(raw: bytes, at: int = 0, wanted: int | None = None, depth: int = 0) -> tuple[str, int]:
    """GeoJSON text of one WKB geometry, and where it ends. Ordinates beyond x and y are skipped."""
    if raw[at] > 1 or depth > DEEPEST:
        raise _Damaged
    end = "<" if raw[at] == 1 else ">"
    (code,) = struct.unpack_from(f"{end}I", raw, at + 1)
    at += 5
    size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    if code & 0x20000000:  # a reference system follows
        at += 4
    code &= 0x1FFFFFFF
    size, code = (3 if code // 1000 in (1, 2) else 4 if code // 1000 == 3 else size), code % 1000
    if code not in _NAMES and code != 7 or wanted not in (None, code):
        raise _Damaged

    def number(least: int) -> int:
        """A count of parts of `least` bytes or more, which must fit in what is left."""
        nonlocal at
        (n,) = struct.unpack_from(f"{end}I", raw, at)
        at += 4
        if n * least > len(raw) - at:
            raise _Damaged
        return n

    def point() -> str:
        nonlocal at
        x, y = struct.unpack_from(f"{end}2d", raw, at)
        at += 8 * size
        return f"[{x!r},{y!r}]"

    def line() -> str:
        return "[" + ",".join([point() for _ in range(number(8 * size))]) + "]"

    if code == 1:
        coordinates = point()
    elif code == 2:
        coordinates = line()
    elif code == 3:
        coordinates = "[" + ",".join([line() for _ in range(number(4))]) + "]"
    else:
        inner = []
        for _ in range(number(5)):
            text, at = _wkb_text(raw, at, MEMBERS.get(code), depth + 1)
            inner.append(text)
        if code == 7:
            return f'{{"type":"GeometryCollection","geometries":[{",".join(inner)}]}}', at
        coordinates = "[" + ",".join(x[x.index('"coordinates":') + 14 : -1] for x in inner) + "]"
    return f'{{"type":"{_NAMES[code]}","coordinates":{coordinates}}}', at


def _plain_points(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which values are points of 21 bytes without a reference system, and (x, y) of these, without a loop over values."""
    size = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False)
    which = np.flatnonzero(size == 21)
    if not len(which):
        return which, np.zeros((0, 2))
    grid = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(which)], raw.take(pa.array(which))), b"")[0].as_py(), np.uint8).reshape(-1, 21)
    little, big = ((grid[:, :5] == head).all(1) for head in ([1, 1, 0, 0, 0], [0, 0, 0, 0, 1]))
    xy = np.where(little[:, None], np.ascontiguousarray(grid[:, 5:]).view("<f8"), np.ascontiguousarray(grid[:, 5:]).view(">f8").astype("<f8"))
    return which[little | big], xy[little | big]


@F.arrow_udf(T.StringType())
def wkb_to_geojson(raw: pa.Array) -> pa.Array:
    """GeoJSON text of WKB; null where it is damaged. Spark has no native reader of binary geometries."""

    def text(x: bytes | None) -> str | None:
        try:
            return None if x is None else _wkb_text(x)[0]
        except (struct.error, IndexError, ValueError, RecursionError):
            return None

    which, xy = _plain_points(raw)
    out = np.empty(len(raw), object)
    out[which] = [f'{{"type":"Point","coordinates":[{x!r},{y!r}]}}' for x, y in xy.tolist()]
    rest = np.ones(len(raw), bool)
    rest[which] = False
    rest = np.flatnonzero(rest)
    out[rest] = [text(x) for x in raw.take(pa.array(rest)).to_pylist()]
    return pa.array(out, pa.string())


def parse(value: Column, fmt: str, precision: str = "double") -> Column:
    """Members of text in a format; binary geometries are made text by wkb_to_geojson first."""
    if fmt not in FORMATS[1:]:
        raise ValueError(f"unknown text format {fmt!r}; known are {', '.join(FORMATS[1:])}")
    return parse_wkt(value, precision) if fmt == "wkt" else parse_geojson(value, precision)


def as_geojson(members: Column) -> Column:
    """Members as GeoJSON text; collections have their members, those of nested ones too, at one level. An empty point has no coordinates."""
    first = lambda x: F.get(x, F.lit(0))
    texts = (
        lambda s: F.to_json(first(first(first(s)))),
        lambda s: F.to_json(first(first(s))),
        lambda s: F.to_json(first(s)),
        lambda s: F.to_json(F.transform(s, lambda g: first(first(g)))),
        lambda s: F.to_json(F.transform(s, first)),
        lambda s: F.to_json(s),
    )

    def one(m: Column) -> Column:
        coordinates = F.lit(None).cast("string")
        for kind, text in enumerate(texts, 1):
            coordinates = F.when(m["type"] == kind, text(m["shape"])).otherwise(coordinates)
        name = F.element_at(F.array(*map(F.lit, TYPES)), m["type"])
        return F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), F.coalesce(coordinates, F.lit("[]")), F.lit("}"))

    inner = lambda x: F.array_join(F.transform(F.filter(x, lambda m: m["type"] > 0), one), ",")
    return _let(members, lambda x: F.when(F.size(x) == 1, F.when(first(x)["type"] > 0, one(first(x))).otherwise(F.lit(_NONE))).otherwise(F.concat(F.lit(_NONE[:-2]), inner(x), F.lit("]}"))))


_NONE = '{"type":"GeometryCollection","geometries":[]}'


def geojson_text(value: Column, fmt: str, precision: str = "double") -> Column:
    """GeoJSON text of a geometry given as text in a format; null where it can't be parsed."""
    return as_geojson(parse(value, fmt, precision))


def with_geojson(df: DataFrame, name: str, fmt: str, precision: str = "double") -> DataFrame:
    """df with the geometry column, in any format, as GeoJSON text; null where it can't be parsed."""
    if fmt == "wkb":
        df, fmt = df.withColumn(name, wkb_to_geojson(F.col(name))), "geojson"
    return df.withColumn(name, geojson_text(F.col(name), fmt, precision))


def _parts(members: Column) -> Column:
    """The flat part list of the result; empty for collections."""
    xy = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    shape = F.when(F.size(members) == 1, F.get(members, F.lit(0))["shape"]).otherwise(F.array().cast(_SHAPE))
    return F.transform(F.flatten(shape), lambda q: F.struct(F.transform(q, xy).alias("coordinate")))


def _points(members: Column) -> Column:
    return F.flatten(F.flatten(F.flatten(F.transform(members, lambda m: m["shape"]))))


def _steps(part: Column) -> Column:
    """(x1, y1, x2, y2) of the segments of a part."""
    at = lambda i, k: F.get(F.get(part, i), F.lit(k))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    each = lambda i: F.struct(at(i - 1, 0).alias("x1"), at(i - 1, 1).alias("y1"), at(i, 0).alias("x2"), at(i, 1).alias("y2"))
    return F.when(F.size(part) >= 2, F.transform(F.sequence(F.lit(1), F.size(part) - 1), each)).otherwise(none)


def _zero(*names: str) -> Column:
    return F.struct(*[F.lit(0.0).alias(n) for n in names])


def _ring(part: Column) -> Column:
    """Twice the signed area of a ring, and its first moments, about its first point."""
    bx, by = F.get(F.get(part, F.lit(0)), F.lit(0)), F.get(F.get(part, F.lit(0)), F.lit(1))

    def add(s: Column, e: Column) -> Column:
        return _let(cross(e), lambda c: F.struct((s["a"] + c).alias("a"), (s["x"] + c * (bx + e["x1"] + e["x2"])).alias("x"), (s["y"] + c * (by + e["y1"] + e["y2"])).alias("y")))

    def cross(e: Column) -> Column:
        return (e["x1"] - bx) * (e["y2"] - by) - (e["x2"] - bx) * (e["y1"] - by)

    return F.aggregate(_steps(part), _zero("a", "x", "y"), add)


def _surface(members: Column) -> Column:
    """Sums over polygons: twice the area (shells less holes) and its moments."""
    polygons = F.flatten(F.transform(F.filter(members, lambda m: m["type"].isin(3, 6)), lambda m: m["shape"]))
    signed = lambda r, shell: F.when(shell, F.signum(r["a"])).otherwise(-F.signum(r["a"]))
    rings = F.flatten(F.transform(polygons, lambda g: F.transform(g, lambda q, i: F.struct(_ring(q).alias("r"), (i == 0).alias("shell")))))
    weight = lambda e: signed(e["r"], e["shell"])
    add = lambda s, e: F.struct(*[(s[k] + weight(e) * e["r"][k]).alias(k) for k in ("a", "x", "y")])
    return F.aggregate(rings, _zero("a", "x", "y"), add)


def area(members: Column) -> Column:
    """Area without holes; 0 for points and lines."""
    return _surface(members)["a"] / 2


def center(members: Column, precision: str = "double") -> Column:
    """Centroid by the highest dimension: area, else length of all lines and rings, else points; null if empty."""
    surface = _surface(members)
    lines = F.flatten(F.flatten(F.transform(F.filter(members, lambda m: ~m["type"].isin(1, 4)), lambda m: m["shape"])))
    # sums are bound one after the other, each only where the higher dimension is empty

    def walk(s: Column, e: Column) -> Column:
        length = F.sqrt((e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"]))
        return _let(length, lambda n: F.struct((s["n"] + n).alias("n"), (s["x"] + n * (e["x1"] + e["x2"]) / 2).alias("x"), (s["y"] + n * (e["y1"] + e["y2"]) / 2).alias("y")))

    length = F.aggregate(F.flatten(F.transform(lines, _steps)), _zero("n", "x", "y"), walk)
    dots = F.concat(_points(F.filter(members, lambda m: m["type"].isin(1, 4))), F.transform(F.filter(lines, lambda q: F.size(q) > 0), lambda q: F.get(q, F.lit(0))))
    mean = F.aggregate(dots, _zero("n", "x", "y"), lambda s, p: F.struct((s["n"] + 1).alias("n"), (s["x"] + F.get(p, F.lit(0))).alias("x"), (s["y"] + F.get(p, F.lit(1))).alias("y")))
    rounded = (lambda v: v) if precision == "double" else (lambda v: v.cast("float").cast("double"))
    both = lambda x, y: F.struct(rounded(x).alias("x"), rounded(y).alias("y"))
    over = lambda s, n: both(s["x"] / n, s["y"] / n)
    dotted = _let(mean, lambda m: F.when(m["n"] > 0, over(m, m["n"])))
    lined = _let(length, lambda n: F.when(n["n"] > 0, over(n, n["n"])).otherwise(dotted))
    full = _let(surface, lambda a: F.when(a["a"] != 0, over(a, 3 * a["a"])).otherwise(lined))
    return F.when(F.forall(members, lambda m: m["type"].isin(1, 4)), dotted).otherwise(full)


def geometry_struct(value: Column, fmt: str, features: Iterable[str] = (), precision: str = "double") -> Column:
    """The geometry struct of text: type, part, then the enabled features in fixed order.

    Null where the value can't be parsed, and, with center or geohash, where
    the geometry is empty or its centroid out of range.
    """
    features = frozenset(features)
    if unknown := features - set(FEATURES):
        raise ValueError(f"unknown features: {sorted(unknown)}")
    return _let(parse(value, fmt, precision), lambda m: F.when(m.isNotNull(), _struct(m, features, precision)))


def with_geometry(df: DataFrame, name: str, fmt: str, features: Iterable[str] = (), precision: str = "double") -> DataFrame:
    """df with the column as a geometry struct; of a binary column, text is made first."""
    if fmt == "wkb":
        df, fmt = df.withColumn(name, wkb_to_geojson(F.col(name))), "geojson"
    return df.withColumn(name, geometry_struct(F.col(name), fmt, features, precision))


def _struct(members: Column, features: frozenset[str], precision: str) -> Column:
    kind = F.when(F.size(members) == 1, F.get(members, F.lit(0))["type"]).otherwise(0).cast("int").alias("type")
    centered, ends = features & {"center", "geohash"}, features & {"bbox", "startpoint", "endpoint"}
    none = F.lit(None)

    def built(x: Column) -> Column:
        """The struct from (points, middle)."""
        points, middle = x["points"], x["middle"]
        along = lambda k, f: f(F.transform(points, lambda p: F.get(p, F.lit(k))))
        xy = lambda q: _let(q, lambda p: F.when(p.isNotNull(), F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
        wanted = {
            "bbox": lambda: F.struct(along(0, F.array_min).alias("minx"), along(1, F.array_min).alias("miny"), along(0, F.array_max).alias("maxx"), along(1, F.array_max).alias("maxy")),
            "center": lambda: middle,
            "area": lambda: area(members),
            "startpoint": lambda: xy(F.get(points, F.lit(0))),
            "endpoint": lambda: xy(F.try_element_at(points, F.lit(-1))),
            "geohash": lambda: _let(geohash_numeric(middle["x"], middle["y"], bind=True), lambda c: geohash_text(c)),
        }
        out = F.struct(kind, _parts(members).alias("part"), *[wanted[f]().alias(f) for f in FEATURES if f in features])
        if not centered:
            return out
        ok = middle.isNotNull()
        if "geohash" in features:
            ok &= middle["x"].between(-180, 180) & middle["y"].between(-90, 90)
        return F.when(ok, out)

    point = "array<array<double>>"
    bound = F.struct((_points(members) if ends else none.cast(point)).alias("points"), (center(members, precision) if centered else none.cast("struct<x:double,y:double>")).alias("middle"))
    return _let(bound, built)
