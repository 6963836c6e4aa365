"""Dense row numbers in a total order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.names import free_names
from ..plans.scratch import stored


def numbered(df: DataFrame, order: list[str], name: str = "row_no", first: int = 1) -> DataFrame:
    """df with numbers first, first + 1, ... in the given order.

    Rows are dealt by range and numbered in place; each partition starts after
    the sizes of those before it. Only one count a partition reaches the driver.
    `total` of the result is the number of rows.
    """
    part, at, start, mark = free_names(df, "part", "at", "start", "mark")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id())
    kept = stored(ranged.withColumns({part: F.shiftrightunsigned(mark, 33), at: F.col(mark).bitwiseAND((1 << 33) - 1)}).drop(mark), "numbered")
    sizes = sorted((r[0], r[1]) for r in kept.groupBy(part).count().collect())
    starts, total = [(0, first)] if not sizes else [], first
    for p, n in sizes:
        starts.append((p, total))
        total += n
    parts = df.sparkSession.createDataFrame(starts, f"{part} long, {start} long")
    out = kept.join(F.broadcast(parts), part).withColumn(name, F.col(start) + F.col(at)).drop(*[c for c in (part, at, start) if c != name])
    out.total = total - first
    return out
