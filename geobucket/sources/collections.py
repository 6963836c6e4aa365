"""Feature collections of any size: one document is cut by many tasks.

A file is read as records that end at `}`, which Spark splits by blocks of
bytes; a record belongs to the block in which it begins. What a block does to
the state of a reader does not depend on what comes before it but for whether
it begins inside a string, so each block of a larger file is first summed up,
for both cases, in a few numbers: does it end in the other case, how far does
the nesting go down, where does it end, and which arrays named "features" does
it leave open. The sums are chained, one row a block at the driver, and then
all blocks are cut at once from known states. Features that reach over the end
of a block are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUOTE, ESCAPE = ord('"'), ord("\\")
_LEVEL = np.zeros(256, np.int64)
_LEVEL[[ord("{"), ord("[")]] = 1
_LEVEL[[ord("}"), ord("]")]] = -1
_MARK = _LEVEL != 0
_MARK[ord(",")] = True
_KEY = re.compile(rb'(?<!\\)"features"\s*:\s*\[')
WHOLE, HEAD, TAIL = 0, 1, 2


def _quotes(c: np.ndarray) -> np.ndarray:
    """Places of the quotes that are not escaped."""
    at = np.flatnonzero(c == QUOTE)
    if not len(at) or not (c[np.maximum(at, 1) - 1] == ESCAPE).any():
        return at
    last = np.maximum.accumulate(np.where(c == ESCAPE, -1, np.arange(len(c))))  # the last place that is no escape
    run = at - 1 - np.where(at > 0, last[at - 1], -1)
    return at[run % 2 == 0]


def _marks(c: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas outside strings, the nesting after each, from 0, and whether the end is inside a string."""
    quotes, at = _quotes(c), np.flatnonzero(_MARK[c])
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    return at, np.cumsum(_LEVEL[c[at]]), (len(quotes) + inside) % 2


class _Sum:
    """What a block does, if it begins outside (0) or inside (1) a string."""

    def __init__(self, inside: int):
        self.inside, self.level, self.least, self.open = inside, 0, 0, []

    def feed(self, raw: bytes) -> None:
        at, levels, inside = _marks(np.frombuffer(raw, np.uint8), self.inside)
        levels = levels + self.level
        if len(levels):
            low = int(levels.min())
            self.open = [x for x in self.open if low > x]
            self.least = min(self.least, low)
            for m in _KEY.finditer(raw):
                k = int(np.searchsorted(at, m.end() - 1))
                if k < len(at) and at[k] == m.end() - 1 and levels[k:].min() >= levels[k]:
                    self.open.append(int(levels[k]) - 1)
            self.level = int(levels[-1])
        self.inside = inside


class _Cutter:
    """Cuts the elements of an array `features` at the top of a document, from a state within it."""

    def __init__(self, inside: int, level: int, on: bool):
        self.inside, self.level, self.on, self.begun, self.text = inside, level, on, not on, []

    def feed(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        c = np.frombuffer(raw, np.uint8)
        at, levels, self.inside = _marks(c, self.inside)
        levels = levels + self.level
        what, start = c[at], 0
        cuts = np.flatnonzero(((what == ord(",")) & (levels == 2)) | ((what == ord("[")) & (levels == 2)) | ((what == ord("]")) & (levels == 1)))
        keys = {m.end() - 1 for m in _KEY.finditer(raw)} if (what[cuts] == ord("[")).any() else set()
        for i, x in zip(at[cuts].tolist(), what[cuts].tolist()):
            if x == ord("["):
                self.on, start = i in keys, i + 1
            elif self.on:
                yield WHOLE if self.begun else HEAD, b"".join([*self.text, raw[start:i]])
                self.on, start = x == ord(","), i + 1
            self.begun, self.text = True, []
        if self.on:
            self.text.append(raw[start:])
        if len(levels):
            self.level = int(levels[-1])

    def end(self) -> Iterator[tuple[int, bytes]]:
        """What is left: the begin of an element, or a block's whole text in the midst of one."""
        if self.on:
            yield TAIL if self.begun else HEAD, b"".join(self.text)


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("parted"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str, int], bytes]]:
    """The text of each batch by (path, file, block); the rows of a block come one after the other."""
    for b in batches:
        path, block = b.column("path").dictionary_encode(), b.column("block").to_numpy()
        new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (np.diff(path.indices.to_numpy()) != 0)]) if b.num_rows else []
        for x, y in zip(new, [*new[1:], b.num_rows]):
            text = "}".join([*b.column("value").slice(x, y - x).to_pylist(), ""])
            yield (b.column("path")[int(x)].as_py(), b.column("file")[int(x)].as_py(), int(block[x])), text.encode()


_SUMS = "path string, block long, ends int, level0 long, least0 long, open0 array<long>, level1 long, least1 long, open1 array<long>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, now, sums = [x.split()[0] for x in _SUMS.split(", ")], None, ()

    def row() -> pa.RecordBatch:
        values = [now[0], now[2], sums[0].inside, *[v for s in sums for v in (s.level, s.least, s.open)]]
        kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64(), pa.int64(), pa.list_(pa.int64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for key, raw in _by_block(batches):
        if key != now:
            if now:
                yield row()
            now, sums = key, (_Sum(0), _Sum(1))
        for s in sums:
            s.feed(raw)
    if now:
        yield row()


def block_states(records: DataFrame) -> dict[tuple[str, int], tuple[int, int, bool]]:
    """(path, block) to the state at its begin: inside a string, nesting, in the array of features. Files of one block are left out."""
    out, last = {}, None
    for r in sorted(records.filter("parted").mapInArrow(_summed, _SUMS).collect(), key=lambda r: (r.path, r.block)):
        if r.path != last:
            last, inside, level, on = r.path, 0, 0, False
        out[r.path, r.block] = inside, level, on
        went, least, left = (r.level1, r.least1, r.open1) if inside else (r.level0, r.least0, r.open0)
        # the array of the features is opened from level 1
        if 1 - level >= least:
            on = 1 - level in left
        inside, level = r.ends if not inside else 1 - r.ends, level + went
    return out


def features_in(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, feature) of FeatureCollections: the features as JSON text, of well-formed documents of any size.

    A feature must fit in a row, a document need not. Elements that are no
    objects come as their JSON text, null as null. A document without an array
    `features` has none; of a malformed one, what can be cut is returned.
    """
    records = _records(spark, path)
    states = spark.sparkContext.broadcast(block_states(records))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, rows, size = None, None, [], 0

        def batch() -> pa.RecordBatch:
            own = list(zip(*rows)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(own[0], pa.string()), pa.array(own[1], pa.string()), pa.array(own[2], pa.int64()), pa.array(own[3], pa.int32()), pa.array([x.decode("utf-8", "replace") for x in own[4]], pa.string())], ["path", "file", "block", "kind", "text"])

        for key, raw in _by_block(batches):
            if key != now:
                rows += [(*now, *x) for x in cutter.end()] if now else []
                now, cutter = key, _Cutter(*states.value.get((key[0], key[2]), (0, 0, False)))
            for x in cutter.feed(raw):
                rows.append((*key, *x))
                size += len(x[1])
                if size > 1 << 20:
                    yield batch()
                    rows, size = [], 0
        rows += [(*now, *x) for x in cutter.end()] if now else []
        yield batch()

    cuts = records.drop("parted").mapInArrow(cut, "path string, file string, block long, kind int, text string")
    whole = cuts.filter(F.col("kind") == WHOLE).select("path", "file", "text")
    if states.value:
        # a block has two pieces at most: the end of an element begun before, and the begin of one
        order = W.partitionBy("path").orderBy("block", "kind")
        begun = F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True)
        owner = F.when(F.col("kind") == TAIL, F.col("block")).otherwise(begun.over(order.rowsBetween(W.unboundedPreceding, -1)))
        pieces = cuts.filter(F.col("kind") != WHOLE).withColumn("owner", owner)
        joined = pieces.groupBy("path", "file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x"))
        whole = whole.unionByName(joined.select("path", "file", F.array_join("x.text", "").alias("text")))
    shown = whole.filter(F.col("text").rlike(r"\S"))
    return shown.select("path", "file", F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), F.lit(0)).alias("feature"))
