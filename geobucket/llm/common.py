"""Helpers shared by the corpus operators: scratch tables, Arrow slicing, hashed words and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import dropped, scratch_path, stored

__all__ = ["dropped", "scratch_path", "stored"]

#: Bytes of text handled at once inside a task, whatever the size of the Arrow batch.
SLICE_BYTES = 4 << 20
#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> str:
    """The mounted path of a shared folder; workers open and map files there."""
    path = uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:")
    if not path.startswith("/"):
        raise ValueError(f"workers map files, so spark.checkpoint.dir must be a mounted folder: {uri}")
    return path


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `limit` bytes of the column; a longer row is a part of its own."""
    for b in batches:
        n = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt anew if fewer of its partitions hold rows than there are cores: a file of one row group is one task's, whatever its size."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    full = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).count()
    return docs.repartition(cores) if full < cores else docs


def normal_words(text: Column) -> Column:
    """Lower-case words joined by single spaces; null gives the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))


class WordHashes(dict):
    """Word to 64-bit hash; forgets all once it holds `most` words, so its memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def worded(column: pa.Array, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts whose words are parted by single spaces, one after the other, and their number per text."""
    if len(column) < 16:
        texts = [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]
        return hashes.of([w for t in texts for w in t]), np.fromiter(map(len, texts), np.int64, len(texts))
    lists = pc.split_pattern(pc.fill_null(column, ""), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().cast(pa.binary()).dictionary_encode()
    number, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[number]
    if b"" in known:  # next to a space, or of an empty text
        keep = number != known.index(b"")
        ends = np.r_[0, np.cumsum(keep)]
        cuts = np.r_[0, np.cumsum(counts)]
        counts, h = ends[cuts[1:]] - ends[cuts[:-1]], h[keep]
    return h, counts


def shingled(h: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of k words, in order; a text of 1 to k - 1 words has one shorter run."""
    ends = np.cumsum(counts)
    n = len(h) - k + 1
    if n > 0:
        acc = h[:n].copy()
        for j in range(1, k):
            acc = acc * PRIME + h[j : n + j]
        text = np.repeat(np.arange(len(counts)), counts)[:n]
        fits = np.arange(n) + k <= ends[text]
        text, acc = text[fits], acc[fits]
    else:
        text, acc = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(short := np.flatnonzero((counts > 0) & (counts < k))):
        more = np.zeros(len(short), np.uint64)
        for x, i in enumerate(short):
            v = counts[i : i + 1].astype(np.uint64)
            for at in range(ends[i] - counts[i], ends[i]):
                v = v * PRIME + h[at : at + 1]
            more[x] = v[0]
        text, acc = np.concatenate([text, short]), np.concatenate([acc, more])
        order = np.argsort(text, kind="stable")
        text, acc = text[order], acc[order]
    return text, mixed(acc)
