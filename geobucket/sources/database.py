"""Parameterised SQL over views, and external databases by JDBC."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

PARAMETERS = (str, int, datetime.datetime, datetime.date)


def _checked(args: Sequence[object]) -> None:
    for a in args:
        if isinstance(a, bool) or not isinstance(a, PARAMETERS):
            raise ValueError(f"unsupported parameter type: {type(a).__name__}")


def query(spark: SparkSession, sql: str, *args: object) -> DataFrame:
    """sql with positional parameters (`?`): strings, integers, timestamps and dates; others are a ValueError."""
    _checked(args)
    return spark.sql(sql, args=list(args))


def literal(value: object) -> str:
    """A parameter as an SQL literal."""
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value:%Y-%m-%d}'"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def bound(sql: str, *args: object, shown: Callable[[object], str] = literal) -> str:
    """sql with its `?` outside quotes replaced by literals, for a database that Spark sends text to; `shown` is the database's way to write them."""
    _checked(args)
    pieces = re.split(r"""('(?:[^']|'')*'|"[^"]*")""", sql)
    if sum(p.count("?") for p in pieces[::2]) != len(args):
        raise ValueError(f"{len(args)} parameters for {sql!r}")
    left = iter(args)
    return "".join(p if k % 2 else re.sub(r"\?", lambda _: shown(next(left)), p) for k, p in enumerate(pieces))


def read_jdbc(spark: SparkSession, url: str, sql: str, options: Mapping[str, str], *args: object, by: str | None = None, parts: int | None = None) -> DataFrame:
    """A query that an external database runs; user, password and driver come with the options.

    With `by`, a numeric, date or timestamp column of the result, `parts` tasks
    (the default parallelism) read a range of it each, over connections of
    their own; its least and largest value are asked first. Rows where it is
    null are read too. Without it one task reads all rows.
    """
    sql = bound(sql, *args)
    source = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more).load()
    if by is None:
        return source(query=sql)
    low, high = source(query=f"SELECT min({by}) AS low, max({by}) AS high FROM ({sql}) edges").first()
    if low is None:
        return source(query=sql)
    return source(dbtable=f"({sql}) rows_of_query", partitionColumn=by, lowerBound=str(low), upperBound=str(high), numPartitions=parts or spark.sparkContext.defaultParallelism)


def append_jdbc(df: DataFrame, url: str, table: str, options: Mapping[str, str]) -> None:
    """Appends rows, each partition over a connection and in a transaction of its own: a task that is tried again after its commit adds its rows twice, so the table needs a key where that matters."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
