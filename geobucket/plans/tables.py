"""Table definitions and writes."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OVERWRITES = threading.Lock()


@dataclass(frozen=True)
class TableSpec:
    database: str
    table: str

    @property
    def name(self) -> str:
        return f"{self.database}.{self.table}"


def column_ddl(schema: T.StructType) -> str:
    """Column names and types; nullability, defaults and comments are not emitted."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def create_sql(spec: TableSpec, schema: T.StructType, provider: str = "parquet", partitioned_by: Sequence[str] = ()) -> list[str]:
    """Statements that create the database and the table where they are absent."""
    parts = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    return [f"CREATE DATABASE IF NOT EXISTS {spec.database}", f"CREATE TABLE IF NOT EXISTS {spec.name} ({column_ddl(schema)}) USING {provider}{parts}"]


def create_table(spark: SparkSession, spec: TableSpec, schema: T.StructType, provider: str = "parquet", partitioned_by: Sequence[str] = ()) -> None:
    for statement in create_sql(spec, schema, provider, partitioned_by):
        spark.sql(statement)


def append(df: DataFrame, spec: TableSpec) -> None:
    """Appends by name; the table's column order is taken."""
    df.select(*df.sparkSession.table(spec.name).columns).write.insertInto(spec.name)


def overwrite_partitions(df: DataFrame, spec: TableSpec) -> None:
    """Replaces the partitions that df has rows of; an empty df replaces none.

    insertInto takes the mode from the session alone, so one call at a time sets it.
    """
    spark = df.sparkSession
    key = "spark.sql.sources.partitionOverwriteMode"
    with _OVERWRITES:
        before = spark.conf.get(key)
        spark.conf.set(key, "dynamic")
        try:
            df.select(*spark.table(spec.name).columns).write.insertInto(spec.name, overwrite=True)
        finally:
            spark.conf.set(key, before)
