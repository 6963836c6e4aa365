"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0 to N - 1 in a total order. A Feistel network permutes the
smallest even-bit domain that holds N; a result outside 0..N-1 is permuted
again (cycle walking), which gives a permutation of 0..N-1 itself. The
permuted number p goes to shard p mod S, slot p div S: shard sizes differ by
one at most, slots have no gaps, and the place of any row can be computed, and
inverted, from its number alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered as numbered_rows
from .common import mixed

ROUNDS = 8


class Feistel:
    """A permutation of 0..n-1 for a seed."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        state = np.uint64(seed & (2**64 - 1)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = mixed(state)

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mixed(left + k) & mask), left
            else:
                left, right = right, left ^ (mixed(right + k) & mask)
        return (left << h) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), self.keys, back)
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = self._once(out[far], self.keys, back)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def backward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def sharded(rows: DataFrame, order: list[str], shards: int = 40, seed: int = 2024) -> DataFrame:
    """rows with `shard` and `slot`, law `rows`.

    Ties in the order are equal rows, so which of them gets which place makes
    no difference. Nulls come first. An empty table gives no rows. rows must
    be narrow: only what the order and the result need is shuffled.
    """
    numbered = numbered_rows(rows, order, "__row", 0)
    n = numbered.total

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, seed).forward(x.to_numpy()))

    moved = numbered.withColumn("__to", permuted("__row"))
    return moved.withColumns({"shard": (F.col("__to") % shards).cast("int"), "slot": F.floor(F.col("__to") / shards).cast("long")}).drop("__row", "__to")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 2024) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text (null: 0) plus 16; the crc32 of a null
    text is that of the empty text. Rows with a null doc_id come first in the
    order; rows that repeat an id are ordered by size and crc32.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharded(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
