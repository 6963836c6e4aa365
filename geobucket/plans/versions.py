"""Versions of a table laid out in buckets: a load becomes visible at once, or not at all.

A load writes its rows to partitions of its own of the data table (load, run):
a run is some thousands of neighbouring buckets, named by the least of them, so
the number of files follows bytes and not buckets. A version is a small Parquet
table that says, for each bucket, which load and run hold its rows; readers
join it, so partitions that it does not name are never read and rows of
replaced buckets beside live ones are not seen. A version is written aside and then
renamed to its number, and a rename onto an existing number is an error, so of
two loads that start from one version the second must start again. A version
also lists the loads in it: a load that is run again after a crash finds
itself there and does nothing, or else replaces what it had written.

The table's own name is a view of the newest version. File systems without an
atomic rename need a lock around commit().
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import dropped, stored
from .tables import TableSpec, create_table

LOAD, RUN, BUCKET, RECORDS = "load", "bucket_min_from", "bucket_min", "records"
#: Rows of a run of buckets, about.
ROWS = 1 << 18


class Conflict(RuntimeError):
    """Another load has committed since the version that this one started from."""


def data_table(spec: TableSpec) -> TableSpec:
    return TableSpec(spec.database, f"{spec.table}_data")


def _folder(spark: SparkSession, spec: TableSpec) -> str:
    return f"{spark.catalog.getDatabase(spec.database).locationUri.rstrip('/')}/{spec.table}_versions"


def _path(spark: SparkSession, spec: TableSpec, number: int) -> str:
    return f"{_folder(spark, spec)}/{number:012d}"


def current(spark: SparkSession, spec: TableSpec) -> int:
    """The number of the newest version; 0 if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark, spec))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def parts(spark: SparkSession, spec: TableSpec, number: int) -> DataFrame:
    """(bucket_min, load, bucket_min_from, records) of a version; a bucket has one row."""
    schema = f"{BUCKET} long, {LOAD} string, {RUN} long, {RECORDS} long"
    if not number:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{_path(spark, spec, number)}/parts")


def holds(spark: SparkSession, spec: TableSpec, number: int, load: str) -> bool:
    """Is the load in the version?"""
    return bool(number) and not spark.read.schema(f"{LOAD} string").parquet(f"{_path(spark, spec, number)}/loads").filter(F.col(LOAD) == load).isEmpty()


def live(spark: SparkSession, spec: TableSpec, number: int, only: DataFrame | None = None, within: Column | None = None) -> DataFrame:
    """The rows of a version, without load and run; of the buckets `only`, and where `within` holds for a row of the data table."""
    own, data = parts(spark, spec, number), spark.table(data_table(spec).name)
    if only is not None:
        own = own.join(only.select(BUCKET), BUCKET, "left_semi")
    if within is not None:
        data = data.filter(within)
    return data.join(own.select(LOAD, RUN, BUCKET), [LOAD, RUN, BUCKET], "left_semi").drop(LOAD, RUN)


def in_runs(counts: DataFrame, rows: int | None = None) -> DataFrame:
    """(bucket_min, records, bucket_min_from) from (bucket_min, records): neighbouring buckets in runs of about `rows` rows. One sum reaches the driver. `scratch` is its path."""
    kept = stored(counts, "counts")
    n = max(1, math.ceil((kept.agg(F.sum(RECORDS)).first()[0] or 0) / (rows or ROWS)))
    dealt = stored(kept.repartitionByRange(n, BUCKET).withColumn("__run", F.spark_partition_id()), "runs")
    dropped(counts.sparkSession, kept.scratch)
    out = dealt.join(F.broadcast(dealt.groupBy("__run").agg(F.min(BUCKET).alias(RUN))), "__run").drop("__run")
    out.scratch = dealt.scratch
    return out


def write_load(rows: DataFrame, spec: TableSpec, load: str) -> None:
    """Writes rows, which have their run, to the partitions of a load; what an earlier try of it had written goes. Nothing becomes visible."""
    spark, data = rows.sparkSession, data_table(spec)
    own = [c for c in rows.columns if c not in (LOAD, RUN, BUCKET)]
    schema = rows.select(*own, F.col(BUCKET).cast("long").alias(BUCKET), F.lit(load).alias(LOAD), RUN).schema
    create_table(spark, data, schema, partitioned_by=[LOAD, RUN])
    view = f"load_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        names = ", ".join(f"`{f.name}`" for f in spark.table(data.name).schema if f.name not in (LOAD, RUN))
        spark.sql(f"INSERT OVERWRITE TABLE {data.name} PARTITION ({LOAD} = '{load}', {RUN}) SELECT {names}, {RUN} FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


def commit(spark: SparkSession, spec: TableSpec, base: int, own: DataFrame, load: str) -> int:
    """Makes `own` (bucket_min, load, bucket_min_from, records) the version after base; Conflict if there is one already."""
    aside = f"{_folder(spark, spec)}/.aside-{uuid.uuid4().hex}"
    own.select(BUCKET, LOAD, RUN, RECORDS).repartitionByRange(BUCKET).sortWithinPartitions(BUCKET).write.parquet(f"{aside}/parts")
    loads = spark.createDataFrame([(load,)], f"{LOAD} string")
    if base:
        loads = spark.read.schema(f"{LOAD} string").parquet(f"{_path(spark, spec, base)}/loads").unionByName(loads)
    loads.coalesce(1).write.parquet(f"{aside}/loads")
    renamed(spark, aside, _path(spark, spec, base + 1))
    return base + 1


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder in one step; Conflict if the target exists."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    a, b = hadoop.Path(source), hadoop.Path(target)
    try:
        hadoop.FileContext.getFileContext(b.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, plain)
    except Exception as e:
        if isinstance(e, PySparkException) or "FileAlreadyExists" not in str(e):
            raise
        fs = a.getFileSystem(jvm.org.apache.hadoop.conf.Configuration(spark.sparkContext._jsc.hadoopConfiguration()))
        fs.delete(a, True)
        raise Conflict(target) from None


def publish(rows: DataFrame, counts: DataFrame, spec: TableSpec, base: int, load: str, replaced: DataFrame | None = None, order: Sequence[str] = ()) -> None:
    """Adds a load on top of a version: its rows, whose buckets have `counts` (bucket_min, records), in place of the buckets `replaced`.

    Rows of a run lie together, ordered by bucket and `order` for row-group
    pruning; a run too large for one task is spread over several.
    """
    spark, own = rows.sparkSession, in_runs(counts)
    try:
        placed = rows.drop(RUN).join(own.select(BUCKET, RUN), BUCKET)
        write_load(placed.hint("rebalance", RUN).sortWithinPartitions(RUN, BUCKET, *order), spec, load)
        added = own.withColumn(LOAD, F.lit(load))
        if base:
            kept = parts(spark, spec, base)
            added = added.unionByName(kept if replaced is None else kept.join(replaced.select(BUCKET), BUCKET, "left_anti"))
        number = commit(spark, spec, base, added, load)
    finally:
        dropped(spark, own.scratch)
    shown(spark, spec, number)


def shown(spark: SparkSession, spec: TableSpec, number: int) -> None:
    """Lets the table's name show a version."""
    data = data_table(spec).name
    names = ", ".join(f"d.`{c}`" for c in spark.table(data).columns if c not in (LOAD, RUN))
    path = f"{_path(spark, spec, number)}/parts"
    spark.sql(f"CREATE OR REPLACE VIEW {spec.name} AS SELECT {names} FROM {data} d LEFT SEMI JOIN parquet.`{path}` v ON d.{LOAD} = v.{LOAD} AND d.{RUN} = v.{RUN} AND d.{BUCKET} = v.{BUCKET}")


def vacuum(spark: SparkSession, spec: TableSpec, order: Sequence[str] = ()) -> int:
    """Deletes the data that the newest version does not name, of replaced buckets and of broken loads; returns how many partitions.

    Live buckets of partitions that also hold dead ones are first written again
    as a load of their own, a version like any other. No load may run
    meanwhile, and readers of older versions lose their data. The names of
    these partitions reach the driver, as the catalog has it.
    """
    data, number = data_table(spec).name, current(spark, spec)
    own = parts(spark, spec, number)
    there = spark.table(data).select(LOAD, RUN, BUCKET).distinct()
    mixed = there.join(own, [LOAD, RUN, BUCKET], "left_anti").select(LOAD, RUN).distinct()
    moved = stored(own.join(mixed, [LOAD, RUN], "left_semi").select(BUCKET, RECORDS), "moved")
    if not moved.isEmpty():
        rows = stored(live(spark, spec, number, moved), "kept")
        publish(rows, moved, spec, number, f"vacuum-{uuid.uuid4().hex}", moved, order)
        dropped(spark, rows.scratch)
    dropped(spark, moved.scratch)
    names = spark.sql(f"SHOW PARTITIONS {data}").select(F.regexp_extract("partition", rf"{LOAD}=([^/]*)", 1).alias(LOAD), F.regexp_extract("partition", rf"{RUN}=(-?\d+)$", 1).cast("long").alias(RUN))
    dead = names.join(parts(spark, spec, current(spark, spec)), [LOAD, RUN], "left_anti").collect()
    for at in range(0, len(dead), 100):
        specs = ", ".join(f"PARTITION ({LOAD} = '{r[LOAD]}', {RUN} = {r[RUN]})" for r in dead[at : at + 100])
        spark.sql(f"ALTER TABLE {data} DROP IF EXISTS {specs}")
    return len(dead)
