"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Words become 64-bit hashes. Three passes over the documents:

1. unigrams of the training documents, dealt by ranges of the hash;
2. bigrams, dealt by the first word; each shard writes its bigram and context
   counts as sorted hash arrays to the shared folder and sends how many
   different words it saw before each word, from which a second shuffle makes
   the unigram arrays (counts and continuation counts);
3. scoring: every worker maps the arrays and looks up the different words and
   bigrams of a slice of texts by binary search.

A slice sends each different bigram once, packed in binary rows, so a frequent
bigram costs one entry a slice. A first word with more than a fair share of
the tokens is split over as many shards as its count calls for. Only totals,
file names and the few split words reach the driver; their number follows the
number of shards, which follows the bytes of text.

P(c|b) = max(n(bc) - D(n(bc)), 0) / n(b) + (D1 N1(b) + D2 N2(b) + D3 N3+(b)) / n(b) * P(c)
P(c)   = max(m(c) - E(m(c)), 0) / M + (E1 M1 + E2 M2 + E3 M3+) / M / (V + 1)

where m(c) is the number of different words before c, M their sum, and D and E
are the discounts estimated from counts of counts. The share 1 / (V + 1) of the
last line that no training token takes is that of unknown words.
"""

from __future__ import annotations

import functools
import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PRIME, WordHashes, local_path, mixed, scratch_path, sliced

END, BEGIN = np.uint64(xxhash.xxh64_intdigest(b"")), np.uint64(xxhash.xxh64_intdigest(b" "))
SHARD_BYTES, SCORE_BYTES, FLUSH = 16 << 20, 8 << 20, 4_000_000
BLOBS = "shard int, kind string, keys binary, b binary, c binary, n binary, meta string"
_NAMES = ("shard", "kind", "keys", "b", "c", "n", "meta")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def tokens(b: pa.RecordBatch, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's followed by its end, and their number per text. A-Z count as a-z."""
    words: list[bytes] = []
    counts = np.ones(b.num_rows, np.int64)
    for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
        own = (t or b"").lower().split()
        counts[i] += len(own)
        words += own
    h = hashes.of(words)
    ends = np.cumsum(counts)
    out = np.full(ends[-1] if len(ends) else 0, END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = h
    return out, counts


def _before(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each, BEGIN at the start of a text."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[np.cumsum(counts) - counts] = BEGIN
    return out


def pair_keys(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mixed(mixed(b + PRIME) * PRIME + c)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), *[pa.binary()] * 4, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(_NAMES, types)], list(_NAMES))


def _flushed(batches: Iterator[pa.RecordBatch], most: int = FLUSH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, counts per text) of about `most` tokens at a time."""
    hashes, held, n = WordHashes(), [], 0
    for b in sliced(batches, "text"):
        held.append(tokens(b, hashes))
        n += len(held[-1][0])
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The runs of sorted shard numbers."""
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), slice(cuts[s], cuts[s + 1])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, the place of one of each, and sums."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], order[first], np.add.reduceat(n, first) if len(first) else n


def _write(folder: str, name: str, *arrays: np.ndarray) -> str:
    """Arrays of one length as one file, one after the other; the path has the length."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}-{len(arrays[0])}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        for a in arrays:
            f.write(a.tobytes())
    os.replace(f"{path}.part", path)
    return path


#: Files that a worker keeps mapped, one map each; a process may usually have 65,530.
MAPS = 30_000


@functools.lru_cache(MAPS)
def _mapped(path: str, kinds: str) -> tuple[np.ndarray, ...]:
    """The arrays of a file, mapped as one; kinds are their numpy types."""
    n, types = int(path.rpartition("-")[2]), [np.dtype(k) for k in kinds.split()]
    if not n:
        return tuple(np.zeros(0, t) for t in types)
    raw, cuts = np.memmap(path, np.uint8, "r"), np.cumsum([0, *[n * t.itemsize for t in types]])
    return tuple(raw[x:y].view(t) for x, y, t in zip(cuts, cuts[1:], types))


def _found(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sought in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; absolute ones where a count of counts is 0."""
    if 0 in n:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))


@dataclass
class Model:
    """Totals and file names of a trained model; small enough to send to every task."""

    shards: int
    total: int = 0
    words: int = 0
    unigrams: list[str | None] = field(default_factory=list)
    bigrams: list[tuple[str, str, str] | None] = field(default_factory=list)
    split: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    split_stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))
    d: tuple[float, float, float] = (0.5, 0.75, 0.9)
    e: tuple[float, float, float] = (0.5, 0.75, 0.9)
    continuations: int = 0
    rest: float = 1.0

    def pair_shards(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The shard of the first word; a split word's bigrams go to several shards by their second word."""
        shard = shard_of(b, self.shards)
        at, there = _found(self.split[0], b)
        if there.any():
            ways = self.split[1][at[there]].astype(np.uint64)
            shard[there] = (shard[there] + (mixed(c[there] + PRIME) % ways).astype(np.int64)) % self.shards
        return shard

    def unigram(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and probabilities of sorted words."""
        count, before = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for s, run in _by_shard(shard_of(words, self.shards), self.shards):
            if self.unigrams[s]:
                keys, n, m = _mapped(self.unigrams[s], "u8 i8 i8")
                if len(keys):  # a shard may hold no word but BEGIN
                    at, there = _found(keys, words[run])
                    count[run], before[run] = np.where(there, n[at], 0), np.where(there, m[at], 0)
        cut = np.r_[0.0, self.e][np.minimum(before, 3)]
        return count, np.maximum(before - cut, 0) / max(1, self.continuations) + self.rest / (self.words + 1)

    def contexts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted first words, their count and the weight of the lower order."""
        stats = np.zeros((len(words), 4), np.int64)
        for s, run in _by_shard(shard_of(words, self.shards), self.shards):
            if self.bigrams[s]:
                keys, *four = _mapped(self.bigrams[s][2], "u8 i8 i8 i8 i8")
                at, there = _found(keys, words[run])
                stats[run] = np.stack([np.where(there, x[at], 0) for x in four], axis=1) if len(keys) else 0
        at, there = _found(self.split[0], words)
        stats[there] = self.split_stats[at[there]]
        return stats[:, 0], np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(self.d) / np.maximum(1, stats[:, 0]), 1.0)

    def bigram(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Discounted counts of pairs."""
        shard, key, out = self.pair_shards(b, c), pair_keys(b, c), np.zeros(len(b))
        order = np.lexsort((key, shard))
        for s, run in _by_shard(shard[order], self.shards):
            if self.bigrams[s]:
                at_ = order[run]
                once = _mapped(self.bigrams[s][0], "u8")[0]
                keys, n = _mapped(self.bigrams[s][1], "u8 i8")
                own = np.where(_found(once, key[at_])[1], 1, 0)
                at, there = _found(keys, key[at_])
                if len(keys):
                    own = np.where(there, n[at], own)
                out[at_] = own - np.r_[0.0, self.d][np.minimum(own, 3)]
        return out

    def log10(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its training count and log10 probability."""
        words, w = np.unique(h, return_inverse=True)
        count, lower = self.unigram(words)
        before = _before(h, counts)
        first, f = np.unique(before, return_inverse=True)
        total, weight = self.contexts(first)
        pair, p = np.unique(f * len(words) + w, return_inverse=True)
        cut = self.bigram(first[pair // len(words)], words[pair % len(words)])
        x = pair // len(words)
        prob = np.where(total[x] > 0, cut / np.maximum(1, total[x]), 0) + weight[x] * lower[pair % len(words)]
        return count[w], np.log10(prob)[p]


def train(docs: DataFrame) -> Model:
    """The model of all texts of docs (text; null is empty). Nothing is sampled or pruned."""
    spark = docs.sparkSession
    folder = local_path(scratch_path(spark, "kneser-ney"))
    texts = docs.select(docs["text"].alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(max(8, math.ceil(size / SHARD_BYTES)))
    shards = model.shards

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, counts in _flushed(batches):
            keys, n = np.unique(np.r_[h, np.full(len(counts), BEGIN)], return_counts=True)
            yield _batch([{"shard": s, "kind": "words", "keys": keys[r].tobytes(), "n": n[r].astype("u4").tobytes()} for s, r in _by_shard(shard_of(keys, shards), shards)])

    most = max(1, size // (32 * shards))  # occurrences, beyond which a first word is split

    def word_shard(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, "u8") for x in table["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, "u4") for x in table["n"].to_pylist()]).astype(np.int64)
        keys, _, n = _summed(keys, n)
        ways = {str(k): int(-(-v // most)) for k, v in zip(keys[n > most], n[n > most])}
        own = keys != BEGIN
        keys, n = keys[own], n[own]
        meta = {"path": _write(folder, "words", keys, n.astype("i8")), "words": len(keys), "total": int(n.sum()), "split": ways}
        return pa.Table.from_batches([_batch([{"shard": table["shard"][0].as_py(), "kind": "meta", "meta": json.dumps(meta)}])])

    counted = texts.mapInArrow(count_words, BLOBS).groupBy("shard").applyInArrow(word_shard, BLOBS)
    counted = {r["shard"]: json.loads(r["meta"]) for r in counted.select("shard", "meta").collect()}
    model.total, model.words = sum(x["total"] for x in counted.values()), sum(x["words"] for x in counted.values())
    ways = sorted((int(k), min(v, shards)) for x in counted.values() for k, v in x["split"].items())
    model.split = np.array([k for k, _ in ways], np.uint64), np.array([v for _, v in ways], np.int64)
    word_paths = {s: x["path"] for s, x in counted.items()}

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, counts in _flushed(batches):
            b = _before(h, counts)
            _, at, n = _summed(pair_keys(b, h), np.ones(len(h), np.int64))
            b, c = b[at], h[at]
            shard = model.pair_shards(b, c)
            order = np.argsort(shard.astype(np.uint16) if shards < 65536 else shard, kind="stable")
            b, c, n, shard = b[order], c[order], n[order], shard[order]
            for s, r in _by_shard(shard, shards):
                words, i = np.unique(np.r_[b[r], c[r]], return_inverse=True)
                small = "u2" if len(words) < 65536 else "u4"
                x, y = i[: len(i) // 2].astype(small), i[len(i) // 2 :].astype(small)
                by = np.argsort(x, kind="stable")  # runs of one first word pack well
                yield _batch([{"shard": s, "kind": small, "keys": words.tobytes(), "b": x[by].tobytes(), "c": y[by].tobytes(), "n": n[r][by].astype("u4").tobytes()}])

    def pair_shard(table: pa.Table) -> pa.Table:
        bs, cs, ns = [], [], []
        for row in table.to_pylist():
            words = np.frombuffer(row["keys"], "u8")
            bs.append(words[np.frombuffer(row["b"], row["kind"])])
            cs.append(words[np.frombuffer(row["c"], row["kind"])])
            ns.append(np.frombuffer(row["n"], "u4"))
        b, c = np.concatenate(bs), np.concatenate(cs)
        keys, at, n = _summed(pair_keys(b, c), np.concatenate(ns).astype(np.int64))
        b, c, once = b[at], c[at], n == 1
        first, i = np.unique(b, return_inverse=True)
        stats = np.stack([np.bincount(i, w, len(first)).astype(np.int64) for w in (n, once, n == 2, n > 2)], axis=1)
        there = _found(model.split[0], first)[1]
        whole = first[~there], *stats[~there].astype("i8").T
        paths = [_write(folder, "once", keys[once]), _write(folder, "pairs", keys[~once], n[~once].astype("i8")), _write(folder, "contexts", *whole)]
        meta = {"bigrams": paths, "of_counts": _of_counts(n), "split": [[str(k), *map(int, v)] for k, v in zip(first[there], stats[there])]}
        after, m = np.unique(c, return_counts=True)
        rows = [{"shard": table["shard"][0].as_py(), "kind": "meta", "meta": json.dumps(meta)}]
        rows += [{"shard": s, "kind": "after", "keys": after[r].tobytes(), "n": m[r].astype("u4").tobytes()} for s, r in _by_shard(shard_of(after, shards), shards)]
        return pa.Table.from_batches([_batch(rows)])

    def unigram_shard(table: pa.Table) -> pa.Table:
        rows, s = table.to_pylist(), table["shard"][0].as_py()
        out = [r for r in rows if r["kind"] == "meta"]
        if s in word_paths:
            keys, n = _mapped(word_paths[s], "u8 i8")
            m = np.zeros(len(keys), np.int64)
            for r in rows:
                if r["kind"] == "after":
                    m[np.searchsorted(keys, np.frombuffer(r["keys"], "u8"))] += np.frombuffer(r["n"], "u4")
            meta = {"unigrams": _write(folder, "unigrams", keys, n, m.astype("i8")), "of_counts": _of_counts(m), "many": int((m > 2).sum()), "sum": int(m.sum())}
            out.append({"shard": s, "kind": "meta", "meta": json.dumps(meta)})
        return pa.Table.from_batches([_batch(out)])

    made = texts.mapInArrow(count_pairs, BLOBS).groupBy("shard").applyInArrow(pair_shard, BLOBS).groupBy("shard").applyInArrow(unigram_shard, BLOBS)
    model.unigrams, model.bigrams = [None] * shards, [None] * shards
    n, m, many, split = np.zeros(4, np.int64), np.zeros(4, np.int64), 0, {}
    for s, meta in [(r["shard"], json.loads(r["meta"])) for r in made.select("shard", "meta").collect()]:
        if "bigrams" in meta:
            model.bigrams[s] = tuple(meta["bigrams"])
            n += meta["of_counts"]
            for k, *v in meta["split"]:
                split[int(k)] = np.array(v, np.int64) + split.get(int(k), 0)
        else:
            model.unigrams[s] = meta["unigrams"]
            m += meta["of_counts"]
            many += meta["many"]
            model.continuations += meta["sum"]
    model.split_stats = np.array([split.get(int(k), np.zeros(4, np.int64)) for k in model.split[0]], np.int64).reshape(-1, 4)
    model.d, model.e = discounts(n.tolist()), discounts(m.tolist())
    if model.continuations:
        model.rest = (model.e[0] * int(m[0]) + model.e[1] * int(m[1]) + model.e[2] * many) / model.continuations
    for path in word_paths.values():
        os.remove(path)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 1 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    The model learns from the documents that are not held out. A null or empty
    text has one token, its end. Without training documents every probability
    is 1. Repeated rows count as often as they occur.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    model = train(rows.filter(~F.col("held_out")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = sent.value, WordHashes()
        for b in sliced(batches, "text", SCORE_BYTES):
            h, counts = tokens(b, hashes)
            known, log = m.log10(h, counts)
            text = np.repeat(np.arange(b.num_rows), counts)
            per = lambda x: np.bincount(text, x, b.num_rows)
            base = np.log10((known + 0.5) / (m.total + 0.5 * (m.words + 1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(counts), pa.array(per(known > 0).astype(np.int64)), pa.array(np.full(b.num_rows, m.total, np.int64)), pa.array(per(base)), pa.array(per(log))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
