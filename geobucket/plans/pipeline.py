"""Spatial loads: raw files to a bronze table, and to a silver table laid out in key buckets."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geohash import geohash_to_long
from ..functions.geometry import with_geometry
from ..operators import bucketing as B
from ..sources.formats import geometry_column, read_by_extension
from . import tables, versions
from .scratch import dropped, stored
from .tables import TableSpec

BUCKET, KEY = "bucket_min", "geohash_numeric"
#: How often a load starts again after another one's commit.
TRIES = 5
_INPUT = {"wkb": T.BinaryType, "wkt": T.StringType, "geojson": T.StringType}


def refined(raw: DataFrame, fmt: str = "geojson", features: Iterable[str] = ("geohash",), precision: str = "double") -> DataFrame:
    """raw with its geometry as a struct and its number; rows whose geometry can't be parsed go.

    The type of the column must suit the format, else ValueError. A geometry is
    parsed once: it leaves a generator, past which neither the filter nor the
    number's expression is moved.
    """
    name = geometry_column(raw)
    if not isinstance(raw.schema[name].dataType, _INPUT[fmt]):
        raise ValueError(f"column {name} is {raw.schema[name].dataType.simpleString()}, which {fmt} can't read")
    if "geohash" not in (features := frozenset(features)):
        raise ValueError("the geohash feature is needed for the key")
    made, parsed = with_geometry(raw, name, fmt, features, precision), F.explode(F.array_compact(F.array(name))).alias(name)
    rows = made.select(*[parsed if c == name else F.col(f"`{c}`") for c in made.columns])
    return rows.withColumn(KEY, geohash_to_long(F.col(name)["geohash"]))


def _load_id(load: str | None) -> str:
    """The id of a load, or a new one; letters, digits, `_` and `-` only, as it names partitions."""
    load = load or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_-]+", load):
        raise ValueError(f"not an id of a load: {load!r}")
    return load


def _to_bronze(raw: DataFrame, bronze: TableSpec, load: str) -> int:
    """Writes raw rows to the load's partition of the bronze table, in place of an earlier try; returns their number, counted by the write itself."""
    spark, seen, view = raw.sparkSession, Observation(), f"bronze_{uuid.uuid4().hex}"
    tables.create_table(spark, bronze, raw.withColumn(versions.LOAD, F.lit(load)).schema, partitioned_by=[versions.LOAD])
    raw.observe(seen, F.count(F.lit(1)).alias("n")).createOrReplaceTempView(view)
    try:
        names = ", ".join(f"`{c}`" for c in spark.table(bronze.name).columns if c != versions.LOAD)
        spark.sql(f"INSERT OVERWRITE TABLE {bronze.name} PARTITION ({versions.LOAD} = '{load}') SELECT {names} FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    return seen.get["n"]


def _counts(laid: DataFrame) -> DataFrame:
    return laid.groupBy(F.col(BUCKET).cast("long").alias(BUCKET)).agg(F.count("*").alias(versions.RECORDS))


def initial_load(spark: SparkSession, path: str, bronze: TableSpec, silver: TableSpec, fmt: str = "geojson", features: Iterable[str] = ("geohash",), target: int = B.TARGET, rel_error: float = B.REL_ERROR, properties: list[str] | None = None, load: str | None = None) -> int:
    """Loads a file into new tables; returns how many rows had no valid geometry.

    A geometry column that the format can't read is an error before anything is
    written. Silver becomes visible in one step. A load that broke off may be
    run again under its id (one that is done then does nothing); a silver table
    of other loads is an error.
    """
    load, raw = _load_id(load), read_by_extension(spark, path, properties=properties)
    good = refined(raw, fmt, features)
    base = versions.current(spark, silver)
    if base and not versions.holds(spark, silver, base, load):
        raise ValueError(f"{silver.name} has rows already")
    n = _to_bronze(raw, bronze, load)
    rows = stored(good, "refined")
    if not base:
        laid = stored(B.equi_depth_bucket(rows, KEY, BUCKET, target, rel_error), "laid")
        versions.publish(laid, _counts(laid), silver, 0, load, order=[KEY])
        dropped(spark, laid.scratch)
    else:
        versions.shown(spark, silver, base)
    lost = n - rows.count()
    dropped(spark, rows.scratch)
    return lost


def bucket_labels(spark: SparkSession, silver: TableSpec) -> DataFrame:
    """The labels of the table's buckets, from its newest version alone."""
    return versions.parts(spark, silver, versions.current(spark, silver)).select(BUCKET)


def merged(good: DataFrame, silver: TableSpec, load: str, target: int = B.TARGET, most: int = B.MOST, rel_error: float = B.REL_ERROR) -> None:
    """Adds refined rows to the silver table: each goes to the nearest lower bucket, then oversize buckets are split.

    Only the buckets that get rows are written again, and only their runs read. A bucket whose
    label is not among the new ones (its keys lie below it) goes. All becomes
    visible in one step; after another load's commit it starts again from
    there, and a load that is in the table already adds nothing. The first
    load lays the rows out in buckets of `target`.
    """
    spark = good.sparkSession
    good = stored(good, "refined")
    for _ in range(TRIES):
        base = versions.current(spark, silver)
        if versions.holds(spark, silver, base, load):
            versions.shown(spark, silver, base)
            break
        if base:
            labels = versions.parts(spark, silver, base).select(BUCKET)
            added = stored(B.assign_to_existing(good, KEY, labels, BUCKET), "added")
            touched = stored(added.filter(F.col(BUCKET).isNotNull()).select(BUCKET).distinct(), "touched")
            old = versions.live(spark, silver, base, touched)
            joined = stored(old.unionByName(added), "joined")
            laid, scratch = stored(B.split_oversize(joined, KEY, BUCKET, most), "laid"), [added.scratch, touched.scratch, joined.scratch]
        else:
            laid, touched, scratch = stored(B.equi_depth_bucket(good, KEY, BUCKET, target, rel_error), "laid"), None, []
        try:
            versions.publish(laid, _counts(laid), silver, base, load, touched, [KEY])
        except versions.Conflict:
            continue
        finally:
            dropped(spark, laid.scratch, *scratch)
        break
    else:
        raise versions.Conflict(silver.name)
    dropped(spark, good.scratch)


def incremental_load(spark: SparkSession, path: str, bronze: TableSpec, silver: TableSpec, fmt: str = "geojson", features: Iterable[str] = ("geohash",), most: int = B.MOST, properties: list[str] | None = None, load: str | None = None) -> DataFrame:
    """Adds a file; returns the new bucket counts.

    A load that broke off may be run again under its id, whatever step it had
    come to: each row is in either table once.
    """
    load, raw = _load_id(load), read_by_extension(spark, path, properties=properties)
    good = refined(raw, fmt, features)
    if not versions.current(spark, silver):
        raise ValueError("no buckets")
    _to_bronze(raw, bronze, load)
    merged(good, silver, load, most=most)
    return versions.parts(spark, silver, versions.current(spark, silver)).select(BUCKET, F.col(versions.RECORDS).alias("record_count"))


def in_key_range(spark: SparkSession, silver: TableSpec, least: int, most: int) -> DataFrame:
    """Rows of a table with keys in a range, from the buckets that may hold some.

    They are found from the newest version's list; the lowest bucket is open
    below. Two labels and two runs reach the driver.
    """
    number = versions.current(spark, silver)
    own, key, bucket = versions.parts(spark, silver, number), F.col(KEY).between(least, most), F.col(BUCKET)
    lowest, first = own.agg(F.min(BUCKET), F.max(F.when(bucket <= least, bucket))).first()
    if lowest is None:
        return versions.live(spark, silver, number, within=key)
    held = (bucket >= (lowest if first is None else first)) & ((bucket <= most) | (bucket == lowest))
    runs = own.filter(held).agg(F.min(versions.RUN), F.max(versions.RUN)).first()
    return versions.live(spark, silver, number, within=F.col(versions.RUN).between(*runs) & held & key)
