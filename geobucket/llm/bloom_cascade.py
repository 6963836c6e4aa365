"""URL filters by a cascade of Bloom filters over the corpus's own keys.

Level 1 encodes the listed keys. Tried on every other key of the universe it
lets some pass; level 2 encodes those, level 3 the listed keys that level 2
lets pass, and so on until none is left. A key of the universe is judged by
the first level it fails, without error, so no join is needed. The listed keys
are a table; the universe is the keys of the rows to judge and the list
together, so building the cascade takes one grouping and no join. Each level is
built by Spark as bitmap buckets; only the finished bits, whose number is known
from the count of keys, reach the driver and the tasks. Above `most_bytes` the
keys are dealt to shards by their hash, with a cascade each.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, mixed, stored

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_BYTES, FIRST_RATE, NEXT_RATE = 64 << 20, 0.02, 0.5
BUCKET = 32768
#: Shards of keys beyond which filters are smaller than can be meant.
MOST_SHARDS = 1024


def _places(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """(key, hash) bit numbers; levels hash independently."""
    salt = mixed(np.array([level + 1], np.uint64))[0]
    x, y = mixed(a.astype(np.int64).view(np.uint64) + salt), mixed(b.astype(np.int64).view(np.uint64) ^ salt) | np.uint64(1)
    return ((x[:, None] + np.arange(hashes, dtype=np.uint64) * y[:, None]) % np.uint64(bits)).astype(np.int64)


class Cascade:
    """Levels of (bits, number of bits, number of hashes)."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def passes(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        words, bits, hashes = self.levels[level]
        at = _places(a, b, level, bits, hashes)
        return ((words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        listed, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for level in range(len(self.levels)):
            ok = self.passes(a[open_], b[open_], level)
            open_ = open_[ok]
            listed[open_] = level % 2 == 0  # holds unless a later level is failed
        return listed

    @property
    def bytes(self) -> int:
        return sum(len(w) for w, _, _ in self.levels)


def hashed(key: Column) -> list[Column]:
    """Two independent 64-bit hashes of a key."""
    return [F.xxhash64(key, F.lit(1)).alias("__a"), F.xxhash64(F.lit(2), key).alias("__b")]


def _level(keys: DataFrame, n: int, level: int, rate: float) -> tuple[np.ndarray, int, int]:
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))

    @F.pandas_udf("array<long>")
    def places(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(_places(a.to_numpy(), b.to_numpy(), level, bits, hashes) + 1), dtype=object)

    at = keys.select(F.explode(places("__a", "__b")).alias("at"))
    got = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    words = np.zeros(math.ceil(bits / BUCKET) * BUCKET // 8, np.uint8)
    for bucket, x in got.collect():  # at most bits / 8 bytes
        words[(bucket - 1) * BUCKET // 8 : bucket * BUCKET // 8] = np.frombuffer(x, np.uint8)
    return words, bits, hashes


def cascade(universe: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade | None:
    """The cascade for universe (key, listed), or None if it could exceed most_bytes. Keys may repeat."""
    keys = stored(universe.filter("key is not null").groupBy("key").agg(F.max("listed").alias("listed")).select(F.col("listed"), *hashed(F.col("key"))), "keys")
    out, (n, total) = Cascade(), keys.agg(F.count_if("listed"), F.count("*")).first()
    paths = [keys.scratch]
    bound = lambda n, rate: max(64, n * round(math.log2(1 / rate)) / math.log(2)) / 8 + BUCKET / 8
    own, other, left = keys.filter("listed"), keys.filter("not listed"), n
    try:
        while left:
            rate = NEXT_RATE if out.levels else FIRST_RATE
            if out.bytes + bound(left, rate) > most_bytes:
                return None
            out.levels.append(_level(own, left, len(out.levels), rate))
            sent, level = keys.sparkSession.sparkContext.broadcast(out), len(out.levels) - 1

            @F.pandas_udf("boolean")
            def passing(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series(sent.value.passes(a.to_numpy(), b.to_numpy(), level))

            own, other = stored(other.filter(passing("__a", "__b")), "passed"), own
            paths.append(own.scratch)
            left = own.count()
    finally:
        dropped(keys.sparkSession, *paths)
    return out


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), key), F.lit(shards))


def cascades(universe: DataFrame, most_bytes: int = MOST_BYTES) -> list[Cascade]:
    """One cascade, or one for each of 2, 4, ... shards of the keys' hashes, so that each stays within most_bytes."""
    shards = 1
    while shards <= MOST_SHARDS:
        out: list[Cascade] = []
        for k in range(shards):
            found = cascade(universe if shards == 1 else universe.filter(_shard(F.col("key"), shards) == k), most_bytes)
            if found is None:
                break
            out.append(found)
        else:
            return out
        shards *= 2
    raise ValueError(f"a filter of {most_bytes} bytes is too small")


def _contains(sent: Broadcast) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("boolean")
    def contains(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(sent.value.contains(a.to_numpy(), b.to_numpy()))

    return contains


def with_listed(rows: DataFrame, key: str, listed: DataFrame, name: str = "listed", most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows with a boolean: is the key in the first column of `listed`? Null keys are not.

    The list may hold keys that no row has, nulls and repeated keys. Beyond
    most_bytes of filters there is a cascade for each shard of keys, and the
    rows are read once a shard, of which one cascade at a time is sent.
    """
    keys = listed.select(F.col(listed.columns[0]).cast("string").alias("key"))
    universe = rows.select(F.col(key).alias("key"), F.lit(False).alias("listed")).unionByName(keys.select("key", F.lit(True).alias("listed")))
    found, parts = cascades(universe, most_bytes), []
    for k, own in enumerate(found):
        contains = _contains(rows.sparkSession.sparkContext.broadcast(own))
        a, b = hashed(F.col(key))
        mine = rows if len(found) == 1 else rows.filter(F.coalesce(_shard(F.col(key), len(found)), F.lit(0)) == k)
        parts.append(mine.withColumn(name, F.col(key).isNotNull() & contains(a, b)))
    return functools.reduce(DataFrame.unionByName, parts)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)).otherwise("")
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; `listed` is a table of hosts.

    Without a fitting rule, a page is blocked if its host is listed. Null and
    odd urls have an empty host and path, which no rule fits; repeated rows are
    judged alike; other columns are ignored, whatever their names. Empty pages
    give no rows, an empty list blocks nothing.
    """
    host, path = url_parts(pages["url"])
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = with_listed(rows, "host", listed, "listed", most_bytes)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
