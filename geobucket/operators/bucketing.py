"""Equi-depth buckets: static splits, assignment to existing buckets, and splitting of oversize ones."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.names import free_names
from ..plans.scratch import dropped, stored

#: Rows a bucket at the first load, rows beyond which a bucket is split, quantile error.
TARGET, MOST, REL_ERROR = 64, 128, 0.001
#: Keys of a cell; medians are found in the cells of a label first, then within one cell.
CELL = 1 << 15
#: Different keys of a label up to which its halvings are made in one task.
GROUP = 200_000


def bucket_count(rows: int, target: int = TARGET) -> int:
    return (rows + target - 1) // target


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """df stored in ranges of the key, with the number `__part` of its range."""
    return stored(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")


def _carry(df: DataFrame, rows: list[tuple], kind: str) -> DataFrame:
    """df with the column `__carry` of its range; rows are (range, carry)."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"__part int, __carry {kind}")), "__part")


def _so_far() -> WindowSpec:
    return W.partitionBy("__part").orderBy("__key").rowsBetween(W.unboundedPreceding, 0)


def _ranks(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(__part, __key, __cnt, __to): the different keys dealt by range, their rows and the rank of the last of them; and the number of keys. One sum a range reaches the driver."""
    # Filters come after the write: pushed below it they would compute the key once more for each test.
    dealt = _dealt(df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__cnt")), "__key")
    dealt = dealt.filter(F.col("__key").isNotNull() & ~F.isnan(F.col("__key").cast("double")))
    starts, total = [], 0
    for part, n in sorted(tuple(r) for r in dealt.groupBy("__part").agg(F.sum("__cnt")).collect()):
        starts.append((part, total))
        total += n
    return _carry(dealt, starts, "long").select("__part", "__key", "__cnt", (F.col("__carry") + F.sum("__cnt").over(_so_far())).alias("__to")), total


def _rank(split_no: Column, b: int, n: int) -> Column:
    """The rank of the key that is split split_no of b buckets of n keys."""
    return F.greatest(F.lit(1), F.ceil(split_no * F.lit(1.0) / F.lit(float(b)) * F.lit(float(n))))


def equi_depth_splits(df: DataFrame, key: str, target: int = TARGET, rel_error: float = REL_ERROR) -> DataFrame:
    """(split_no, split): quantiles 0, 1/b, ..., 1 of the key for b = ceil(rows / target) buckets; none for an empty table.

    Split i is the key at rank ceil(i / b * n) of the n keys that are not null,
    the first at rank 1. With a rel_error above 0 its rank may be off by
    rel_error * n: one aggregate then takes quantiles on a grid of 2 /
    rel_error, by mergeable summaries, and each split the nearest of them.
    """
    if rel_error < 0:
        raise ValueError("rel_error must not be negative")
    if rel_error > 0:
        return _approximate_splits(df, key, target, rel_error)
    b, (ranks, n) = bucket_count(df.count(), target), _ranks(df, key)
    if not b or not n:
        return df.sparkSession.createDataFrame([], "split_no long, split double")
    after = F.col("__to") - F.col("__cnt")
    low = F.greatest(F.lit(0), F.floor(after * (b / n)) - 1).cast("long")
    high = F.least(F.lit(b), F.ceil(F.col("__to") * (b / n)) + 1).cast("long")
    near = ranks.select("__key", "__to", after.alias("__after"), F.explode(F.sequence(low, high)).alias("split_no"))
    rank = _rank(F.col("split_no"), b, n)
    return near.filter((rank > F.col("__after")) & (rank <= F.col("__to"))).select("split_no", F.col("__key").cast("double").alias("split"))


def _grid(df: DataFrame, key: str, rel_error: float) -> tuple[int, list]:
    """Rows, and quantiles 0, 1/m, ..., 1 of the key that is neither null nor NaN, within half of rel_error, for m = ceil(2 / rel_error); the grid's size is bounded by rel_error."""
    m = max(1, math.ceil(2 / rel_error))
    own = F.when(~F.isnan(F.col(key).cast("double")), F.col(key))
    rows, found = df.agg(F.count("*"), F.percentile_approx(own, [j / m for j in range(m + 1)], m)).first()
    return rows, list(found or [])


def _approximate_splits(df: DataFrame, key: str, target: int, rel_error: float) -> DataFrame:
    rows, grid = _grid(df, key, rel_error)
    b, m = bucket_count(rows, target), len(grid) - 1
    if not b or not grid:
        return df.sparkSession.createDataFrame([], "split_no long, split double")
    place = F.rint(F.col("id") * F.lit(m / b)).cast("int")
    return df.sparkSession.range(b + 1).select(F.col("id").alias("split_no"), F.get(F.lit([float(x) for x in grid]), place).alias("split"))


def within_rank(df: DataFrame, key: str, splits: DataFrame, rel_error: float) -> DataFrame:
    """(split_no, within): is a split's rank among the keys off by at most rel_error times their number?"""
    ranks, n = _ranks(df, key)
    b = splits.agg(F.max("split_no")).first()[0] or 1
    wanted = F.col("split_no") * F.lit(n / b)
    ok = (F.col("__to") >= wanted - rel_error * n) & (F.col("__to") - F.col("__cnt") <= wanted + rel_error * n)
    return splits.join(ranks.withColumn("split", F.col("__key").cast("double")), "split", "left").select("split_no", F.coalesce(ok, F.lit(False)).alias("within"))


def _at_or_below(df: DataFrame, key: str, bounds: DataFrame, name: str, last_if_none: bool = False) -> DataFrame:
    """df with the greatest bound at or below its key; below all bounds the least one, or the last. Null for null.

    Different keys and bounds are dealt by range together, each range starts
    with the last bound of those before it, and the bounds found are joined
    back. The least and the last bound of a range reach the driver.
    """
    kind = df.schema[key].dataType
    keys = df.select(F.col(key).alias("__key"), F.lit(None).cast("long").alias("__bound"))
    marks = bounds.select(F.col(bounds.columns[0]).cast("long").alias("__bound")).filter("__bound is not null").select(F.col("__bound").cast(kind).alias("__key"), "__bound")
    dealt = _dealt(keys.unionByName(marks).groupBy("__key").agg(F.max("__bound").alias("__bound")), "__key").filter("__key is not null")
    return _carried(df, key, dealt, name, last_if_none)


def _carried(df: DataFrame, key: str, dealt: DataFrame, name: str, last_if_none: bool = False) -> DataFrame:
    """df with the last bound at or before its key, from different keys (__part, __key, __bound or null) dealt by range."""
    ends = sorted(tuple(r) for r in dealt.groupBy("__part").agg(F.min("__bound"), F.max("__bound")).collect())
    known = [(a, z) for _, a, z in ends if a is not None]
    if not known:
        raise ValueError("no buckets")
    starts, last = [], known[-1][1] if last_if_none else known[0][0]
    for part, _, z in ends:
        starts.append((part, last))
        last = last if z is None else z
    found = F.coalesce(F.last("__bound", ignorenulls=True).over(_so_far()), "__carry")
    own, bound = free_names(df, "key", "bound")
    found = _carry(dealt, starts, "long").select(F.col("__key").alias(own), found.alias(bound))
    joined = df.join(found, df[key] == found[own], "left").withColumn(name, F.col(bound))
    return joined.drop(own, bound)


def equi_depth_bucket(df: DataFrame, key: str, name: str = "bucket_min", target: int = TARGET, rel_error: float = REL_ERROR) -> DataFrame:
    """df with the split at or below each key, of all but the last; an empty table gets a null column.

    Exact splits (rel_error 0) are found where keys are ranked: a key is one if
    the rank of some split is among its own, so keys are dealt by range once.
    """
    if rel_error > 0:
        splits = stored(equi_depth_splits(df, key, target, rel_error), "splits")
        last = splits.agg(F.max("split_no")).first()[0]
        if last is None:
            return df.withColumn(name, F.lit(None).cast("long"))
        return _at_or_below(df, key, splits.filter(F.col("split_no") < last).select(F.floor("split")), name, last_if_none=True)
    b, (ranks, n) = bucket_count(df.count(), target), _ranks(df, key)
    if not b or not n:
        return df.withColumn(name, F.lit(None).cast("long"))
    near, split = F.floor(F.col("__to") * (b / n)).cast("long"), F.lit(False)
    for step in (-1, 0, 1):  # the last split whose rank is not above the key's last
        i = F.least(F.greatest(near + step, F.lit(0)), F.lit(b - 1))
        split = split | _rank(i, b, n).between(F.col("__to") - F.col("__cnt") + 1, F.col("__to"))
    return _carried(df, key, stored(ranks.select("__part", "__key", F.when(split, F.floor("__key")).cast("long").alias("__bound")), "bounds"), name, last_if_none=True)


def bucket_counts(df: DataFrame, label: str = "bucket_min") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("record_count"))


def assign_to_existing(df: DataFrame, key: str, buckets: DataFrame, label: str = "bucket_min") -> DataFrame:
    """df with the nearest lower label of a table of bucket metadata."""
    return _at_or_below(df, key, buckets.select(label), label)


def oversize(counts: DataFrame, most: int = MOST) -> DataFrame:
    return counts.filter(F.col("record_count") > most)


def medians(histogram: DataFrame, label: str, key: str) -> DataFrame:
    """(label, n, least, median) from (label, key, cnt); the median is the least key that half the rows do not exceed.

    Running sums go over the cells of a label, then over the keys of one cell,
    so no window holds all keys of a label.
    """
    cells = histogram.groupBy(label, F.floor(F.col(key) / CELL).alias("__cell")).agg(F.sum("cnt").alias("__c"))
    up_to = F.sum("__c").over(W.partitionBy(label).orderBy("__cell").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("__c").over(W.partitionBy(label))
    half = F.ceil(F.col("__n") / 2)
    cells = cells.withColumns({"__to": up_to, "__n": total}).filter((F.col("__to") >= half) & (F.col("__to") - F.col("__c") < half))
    inside = histogram.withColumn("__cell", F.floor(F.col(key) / CELL)).join(cells, [label, "__cell"])
    running = F.col("__to") - F.col("__c") + F.sum("cnt").over(W.partitionBy(label).orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    found = inside.withColumn("__run", running).filter(F.col("__run") >= half).groupBy(label).agg(F.min(key).alias("median"))
    sizes = histogram.groupBy(label).agg(F.sum("cnt").alias("n"), F.min(key).alias("least"))
    return sizes.join(found, label)


def approximate_medians(df: DataFrame, label: str, key: str, rel_error: float = REL_ERROR) -> DataFrame:
    """(label, n, least, median) of rows in one aggregate; the median's rank may be off by rel_error times the rows of the label."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.min(key).alias("least"), F.percentile_approx(key, 0.5, max(1, math.ceil(2 / rel_error))).alias("median"))


def split_points(histogram: DataFrame, label: str, key: str, most: int = MOST) -> DataFrame:
    """(label, split, least) of the oversize labels that can be split: at the median, or at the next key if the median is the least key."""
    big = medians(histogram, label, key).filter(F.col("n") > most)
    after = histogram.join(big.select(label, "median"), label).filter(F.col(key) > F.col("median")).groupBy(label).agg(F.min(key).alias("next"))
    split = F.when(F.col("median") > F.col("least"), F.col("median")).otherwise(F.col("next"))
    return big.join(after, label, "left").select(label, split.alias("split"), "least").filter("split is not null")


def relabelled(rows: DataFrame, points: DataFrame, label: str, key: str) -> DataFrame:
    """rows with keys at or above their label's split moved to the label `split`.

    Rows that were clamped into the first bucket may lie below its label; if
    the split does too, the lower half takes its least key as label.
    """
    upper, clamped = F.col(key) >= F.col("split"), F.col("split") <= F.col(label)
    new = F.when(upper, F.col("split")).when(clamped, F.col("least")).otherwise(F.col(label))
    return rows.join(points, label, "left").withColumn(label, new.cast("long")).drop("split", "least")


def split_tree(keys: np.ndarray, counts: np.ndarray, label: int, most: int = MOST) -> np.ndarray:
    """The labels of the sorted different keys of one label once all its halvings are made."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    out, open_ = np.empty(len(keys), np.int64), [(0, len(keys), label)]
    while open_:
        a, z, own = open_.pop()
        n = int(ends[z] - ends[a])
        if n <= most or z - a == 1:
            out[a:z] = own
            continue
        median = int(np.searchsorted(ends, ends[a] + (n + 1) // 2)) - 1
        cut = max(median, a + 1)  # the next key if the median is the least one
        # rows clamped into the first bucket lie below its label, which their least key replaces
        open_ += [(a, cut, int(keys[a]) if keys[cut] <= own else own), (cut, z, int(keys[cut]))]
    return out


def split_labels(df: DataFrame, key: str, label: str = "bucket_min", most: int = MOST, rounds: int | None = None, group: int = GROUP) -> DataFrame:
    """(old_label, key, label, cnt): oversize buckets are halved at their median until none can be split, or `rounds` times.

    Rows of equal key stay together, so all work is on the histogram of keys.
    A label of at most `group` different keys is halved to the end in one task;
    one of more is halved first by rounds of joins, all such labels together.
    A bucket of a single key can't be split and stays. Rows with a null key or
    label are left out.
    """
    spark, rows = df.sparkSession, df.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    hist = rows.groupBy(F.col(label).alias("old_label"), key).agg(F.count("*").alias("cnt"))
    now, done, settled = stored(hist.withColumn(label, F.col("old_label")), "histogram"), 0, []
    while rounds is None or done < rounds:
        if rounds is None:
            sizes = stored(now.groupBy(label).agg(F.sum("cnt").alias("n"), F.count("*").alias("keys")).filter((F.col("n") > most) & (F.col("keys") > 1)), "sizes")
            large = sizes.filter(F.col("keys") > group).select(label)
            if large.isEmpty():
                small = now.join(sizes.select(label), label, "left_semi")
                settled.append(now.join(sizes.select(label), label, "left_anti").select("old_label", key, label, "cnt"))
                now = _finished(small.select("old_label", key, label, "cnt"), key, label, most)
                break
            chosen = now.join(large, label, "left_semi")
        else:
            chosen = now
        points = stored(split_points(chosen.groupBy(label, key).agg(F.sum("cnt").alias("cnt")), label, key, most), "splits")
        if points.isEmpty():
            break
        rest = now.join(points, label, "left_anti").select("old_label", key, label, "cnt")
        moved = relabelled(now.join(points, label, "left_semi"), points, label, key).select("old_label", key, label, "cnt")
        moved = stored(moved.unionByName(rest), "histogram")
        dropped(spark, now.scratch, points.scratch)
        now, done = moved, done + 1
    return functools.reduce(DataFrame.unionByName, settled, now)


def _finished(histogram: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """(old_label, key, label, cnt) with each label halved to the end by one task."""
    def halved(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by(key)
        keys, at = np.unique(batch[key].to_numpy(), return_inverse=True)
        own = split_tree(keys, np.bincount(at, batch["cnt"].to_numpy(), len(keys)).astype(np.int64), batch[label][0].as_py(), most)
        return batch.set_column(batch.schema.get_field_index(label), label, pa.array(own[at], batch.schema.field(label).type))

    return histogram.select("old_label", key, label, "cnt").groupBy(label).applyInArrow(halved, histogram.schema)


def split_oversize(df: DataFrame, key: str, label: str = "bucket_min", most: int = MOST) -> DataFrame:
    """df with new labels; its rows are joined to the histogram once. Rows with a null key or label keep it."""
    old, own, new = free_names(df, "old", "key", "new")
    moves = split_labels(df, key, label, most).select(F.col("old_label").alias(old), F.col(key).alias(own), F.col(label).alias(new))
    joined = df.join(moves, (df[label] == moves[old]) & (df[key] == moves[own]), "left")
    return joined.withColumn(label, F.coalesce(F.col(new), df[label])).drop(old, own, new)


def unsplittable(df: DataFrame, key: str, label: str = "bucket_min", most: int = MOST) -> DataFrame:
    """(label, record_count) of the oversize buckets of a single key."""
    counts = df.groupBy(label).agg(F.count("*").alias("record_count"), F.min(key).alias("__a"), F.max(key).alias("__b"))
    return oversize(counts, most).filter("__a = __b").drop("__a", "__b")
