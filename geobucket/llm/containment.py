"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so their Jaccard similarity says
little. Items are therefore partitioned by size: class c holds the items with
2^(c-1) < shingles <= 2^c. For a class, a document is cut into windows of
2 * 2^c shingles that start every 2^c, so an item that occurs lies in some
window of comparable size. Items and windows get a one-permutation MinHash of
8 * 2^c registers (a register is the least hash that falls into it), banded at
one row a band: a window that agrees with an item in a register makes the
document a candidate. A candidate is kept if at least `least` of the item's
distinct five-word shingles occur in the whole document, counted exactly.

Items of one to four words are one shingle of their own length; documents are
searched for shingles of that length too, so they are found inside documents
of any length.

A register of a contained item is hidden only if one of the window's other
shingles falls into it with a lesser hash, chance 1/8 at most, so an item with
m shingles present is missed with a chance below 8^-m.

Documents are read once for each block of items and never shuffled. A block
holds at most `block_bytes` of item text, which bounds what is broadcast; more
items make more blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mixed, normal_words, shingled, sliced, worded

SHINGLE, LEAST, BLOCK_BYTES, REGISTERS = 5, 0.8, 16 << 20, 8
#: Bytes of text searched at once; the arrays of a search take some 25 times as much.
SLICE = 1 << 20


def _registers(h: np.ndarray, size: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(group, least hash) of every register in use, for hashes dealt by group."""
    g = mixed(h + np.uint64(size))
    group = np.zeros(len(h), np.int64) if group is None else group
    slot = (g & np.uint64(REGISTERS * size - 1)).astype(np.int64)
    order = np.lexsort((g, slot, group))
    group, slot, g = group[order], slot[order], g[order]
    first = np.ones(len(g), bool)
    first[1:] = (group[1:] != group[:-1]) | (slot[1:] != slot[:-1])
    return group[first], g[first]


class ItemIndex:
    """Register values and exact shingles of a block of items, by the length of their shingles."""

    def __init__(self, texts: list[str | None], least: float = LEAST):
        h, counts = worded(pa.array(texts, pa.string()), WordHashes())
        self.least, self.exact, self.lengths = least, [np.zeros(0, np.uint64)] * len(texts), {}
        ends = np.cumsum(counts)
        for k in np.unique(np.minimum(counts[counts > 0], SHINGLE)).tolist():
            which = np.flatnonzero(np.minimum(counts, SHINGLE) == k)
            text, sh = shingled(np.concatenate([h[ends[i] - counts[i] : ends[i]] for i in which]), counts[which], k)
            cuts, by_class = np.searchsorted(text, np.arange(len(which) + 1)), {}
            for i, a, b in zip(which.tolist(), cuts, cuts[1:]):
                self.exact[i] = own = np.unique(sh[a:b])
                size = 1 << max(0, math.ceil(math.log2(len(own))))
                by_class.setdefault(size, []).extend((int(v), i) for v in _registers(own, size)[1])
            self.lengths[k] = {s: tuple(np.array(x, t) for x, t in zip(zip(*sorted(v)), (np.uint64, np.int64))) for s, v in by_class.items()}

    def found(self, texts: pa.Array, hashes: WordHashes) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all items contained in texts of words parted by single spaces."""
        h, counts = worded(texts, hashes)
        return [x for k, classes in self.lengths.items() for x in self.search(*shingled(h, counts, k), classes)]

    def search(self, text: np.ndarray, sh: np.ndarray, classes: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
        """The same for shingles of one length and the items that have such; text is sorted."""
        starts = np.searchsorted(text, text)
        at = np.arange(len(text)) - starts
        found: set[tuple[int, int]] = set()
        for size, (values, items) in classes.items():
            g = mixed(sh + np.uint64(size))
            place = np.minimum(np.searchsorted(values, g), len(values) - 1)
            hit = np.flatnonzero(values[place] == g)
            if not len(hit):
                continue
            # only windows with a value that some item has can agree in a register
            for back in (0, 1):
                window = at // size - back
                own = np.unique(np.stack([text[hit], window[hit]]), axis=1)
                own = own[:, own[1] >= 0]
                lo = np.searchsorted(text, own[0]) + own[1] * size
                hi = np.minimum(lo + 2 * size, np.searchsorted(text, own[0], "right"))
                length = hi - lo
                group = np.repeat(np.arange(len(lo)), length)
                pos = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(lo, length)
                which, least = _registers(sh[pos], size, group)
                a, b = np.searchsorted(values, least), np.searchsorted(values, least, "right")
                for w, x, y in zip(which[b > a], a[b > a], b[b > a]):
                    found.update((int(own[0][w]), int(i)) for i in items[x:y])
        out, last, distinct = [], -1, None
        for t, i in sorted(found):
            if t != last:
                last, distinct = t, np.unique(sh[np.searchsorted(text, t) : np.searchsorted(text, t, "right")])
            shared = len(np.intersect1d(distinct, self.exact[i], assume_unique=True))
            if shared >= self.least * len(self.exact[i]):
                out.append((t, i, shared))
        return out


def _blocks(items: DataFrame, least: float, block_bytes: int) -> Iterator[tuple[ItemIndex, list]]:
    items = items.select(items["item_id"].alias("item_id"), normal_words(items["text"]).alias("text")).filter("text != ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / block_bytes)
    for k in range(blocks):
        got = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        if got.num_rows:
            yield ItemIndex(got["text"].to_pylist(), least), got["item_id"].to_pylist()


def contained_items(docs: DataFrame, items: DataFrame, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment for each document row and item found in it.

    Words are runs without ASCII white space, lower-cased. Null or empty texts
    and items have no shingle and never match; an item of under five words is
    one shingle, found where its words follow each other. Repeated rows and
    items match each; without documents or items there are no rows; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, item_shingles long, shared long, containment double"
    parts = spark.createDataFrame([], schema)
    text = docs.select(docs["doc_id"].alias("doc_id"), normal_words(docs["text"]).alias("text"))
    for index, ids in _blocks(items, least, block_bytes):
        sent = spark.sparkContext.broadcast((index, ids))

        def found(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (index, ids), hashes = sent.value, WordHashes()
            for b in sliced(batches, "text", SLICE):
                rows = index.found(b.column("text"), hashes)
                if rows:
                    t, i, n = zip(*rows)
                    size = [len(index.exact[x]) for x in i]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(t)), pa.array([ids[x] for x in i]), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x / y for x, y in zip(n, size)])], ["doc_id", "item_id", "item_shingles", "shared", "containment"])

        parts = parts.unionByName(text.mapInArrow(found, schema))
    return parts


def _free_of_items(sent: Broadcast, words: Column) -> Column:
    """Whether texts of words parted by single spaces contain none of the items."""

    @F.arrow_udf("boolean")
    def free(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for b in sliced((pa.RecordBatch.from_arrays([t], ["words"]) for t in texts), "words", SLICE):
            keep = np.ones(b.num_rows, bool)
            keep[[t for t, _, _ in sent.value.found(b.column("words"), hashes)]] = False
            yield pa.array(keep)

    return free(words)


def without_items(docs: DataFrame, items: DataFrame, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no item is contained, with all their columns, whatever the names of these.

    Null and empty texts stay; repeated rows stay or go together; without items
    all rows stay; an empty table gives no rows. Workers get the words and
    return a verdict: rows stay in Spark, so a batch holds its texts once.
    """
    for index, _ in _blocks(items, least, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.filter(_free_of_items(sent, normal_words(docs["text"])))
    return docs
