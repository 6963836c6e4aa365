"""Alignment of two tokenizers: which tokens of one end where tokens of the other end.

Both vocabularies are lossless here, so tokens are intervals of the bytes of a
text. A text is cut at single spaces and before line ends, where a token of
either kind always starts, and the different chunks of a slice are aligned
once, many to a DuckDB query: the tokens are two interval tables; a range join
with equal ends gives the links, a window sum over their ends numbers the
groups, and an ASOF join gives each token the next such end and so its group.
A bounded memory of a worker keeps the alignments of frequent chunks.

A linked pair has one token whose bytes end the other's, so the pairs that can
occur are known from the vocabularies alone, a few hundred thousand. Links are
numbers of that list. Each task adds its counts up in it, Spark merges the
partial counts, and the merged ones, bounded by the list, are broadcast.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored
from .token_orc import Encoder, encoder_of, ragged

MARK = "▁"
#: Bytes of text handled at once, chunks of a library call, tokens of one kind in a DuckDB query, chunks a worker remembers and their longest, and DuckDB's memory.
SLICE, CALL, TOKENS, MEMORY, BRIEF, LIMIT = 1 << 18, 512, 1 << 17, 200_000, 64, "256MB"
#: A single space between characters other than white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")

_LINKS = "CREATE OR REPLACE TEMP TABLE link AS SELECT a.e, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.s < b.e AND b.s < a.e AND a.e = b.e"
_CUTS = "CREATE OR REPLACE TEMP TABLE cut AS SELECT e, sum(1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) - 1 AS g FROM (SELECT DISTINCT e FROM link)"
_GROUPS = "SELECT cut.g::BIGINT AS g FROM {0} ASOF JOIN cut ON {0}.e <= cut.e ORDER BY {0}.e"


class Vocabulary:
    """The bytes of each id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.size = tokens, np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start, self.raw = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def gives(self, ids: np.ndarray, text: bytes) -> bool:
        """Are the joined bytes of the ids those of the text?"""
        own = self.size[ids]
        return int(own.sum()) == len(text) and np.array_equal(self.raw[ragged(self.start[ids], own)], np.frombuffer(text, np.uint8))


class ByteTokens:
    """The byte-level tokenizer; strings of special tokens are plain text."""

    def __init__(self, file: str):
        self.encoder: Encoder = encoder_of(file, True)
        byte = {chr(c): b for b, c in enumerate(self.encoder.alphabet.tolist()) if b}
        byte[chr(256)] = 0  # the first byte that has no printed form
        own = self.encoder.library.get_vocab(with_added_tokens=False)
        tokens = [b""] * (max(own.values()) + 1)
        for piece, i in own.items():
            tokens[i] = bytes(byte[c] for c in piece)
        self.vocabulary = Vocabulary(tokens)

    def of(self, parts: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after the other, and the number of each."""
        ids, start, length = self.encoder.of(parts, often)
        return ids[ragged(start, length)].astype(np.int64), length

    def wide(self, chunks: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.encoder.library.encode_batch_fast(chunks, add_special_tokens=False)]


class PieceTokens:
    """The piece tokenizer, which puts a space before a text."""

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        self.library = p = SentencePieceProcessor(model_file=file)
        n = p.get_piece_size()
        pieces = [p.id_to_piece(i) for i in range(n)]
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in pieces):
            raise ValueError("a piece reaches over the start of a word or a line")
        self.vocabulary = Vocabulary([b"" if p.is_control(i) or p.is_unknown(i) else bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)])

    def of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, the number of each, and whether their bytes are those of the chunk; no ids where not.

        Chunks begin with a space or a line end. They are encoded many to a
        text, after a letter, and parted again by bytes.
        """
        all_ids, counts, good = [np.zeros(0, np.int64)], np.zeros(len(chunks), np.int64), np.ones(len(chunks), bool)
        spans = [(at, min(at + CALL, len(chunks))) for at in range(0, len(chunks), CALL)]
        for (at, to), ids in zip(spans, self.library.encode(["a" + "".join(chunks[at:to]) for at, to in spans], num_threads=1)):
            done = self._parted(np.array(ids, np.int64), chunks[at:to])
            if done is None:
                alone = [self._parted(np.array(self.library.encode("a" + c), np.int64), [c]) for c in chunks[at:to]]
                good[at:to] = [x is not None for x in alone]
                done = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in alone if x]]), np.array([x[1][0] if x else 0 for x in alone], np.int64)
            all_ids.append(done[0])
            counts[at:to] = done[1]
        return np.concatenate(all_ids), counts, good

    def _parted(self, ids: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        raw = [c.encode() for c in chunks]
        if not self.vocabulary.gives(ids, b" a" + b"".join(raw)):
            return None
        ends, cuts = np.cumsum(self.vocabulary.size[ids]), 2 + np.cumsum([0, *map(len, raw)])
        at = np.searchsorted(ends, cuts)
        if not np.array_equal(ends[at], cuts):
            return None
        return ids[at[0] + 1 :], np.diff(at)


class Pairs:
    """All pairs of tokens of which one ends with the other, as sorted numbers a << 32 | b."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        def by_bytes(v: Vocabulary) -> dict[bytes, list[int]]:
            out: dict[bytes, list[int]] = {}
            for i, t in enumerate(v.tokens):
                if t:
                    out.setdefault(t, []).append(i)
            return out

        x, y = by_bytes(a), by_bytes(b)
        own = {(i, j) for t, ids in x.items() for k in range(len(t)) for j in y.get(t[k:], ()) for i in ids}
        own |= {(i, j) for t, ids in y.items() for k in range(1, len(t)) for i in x.get(t[k:], ()) for j in ids}
        self.keys = np.sort(np.fromiter((i << 32 | j for i, j in own), np.int64, len(own)))

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a << 32 | b).astype(np.int32)


@dataclass
class Chunks:
    """Alignments of chunks: numbers of tokens, the links one after the other and their number, the groups as text, and whether both vocabularies give the chunk."""

    n_a: np.ndarray
    n_b: np.ndarray
    links: np.ndarray
    n_links: np.ndarray
    groups: pa.Array
    good: np.ndarray

    @classmethod
    def none(cls) -> Chunks:
        return cls(*[np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64)], pa.array([], pa.string()), np.zeros(0, bool))

    def take(self, at: np.ndarray) -> Chunks:
        start, n = np.cumsum(self.n_links) - self.n_links, self.n_links[at]
        return Chunks(self.n_a[at], self.n_b[at], self.links[ragged(start[at], n)], n, self.groups.take(pa.array(at)), self.good[at])

    def with_more(self, *more: Chunks) -> Chunks:
        joined = lambda k: np.concatenate([getattr(x, k) for x in (self, *more)])
        return Chunks(joined("n_a"), joined("n_b"), joined("links"), joined("n_links"), pa.concat_arrays([x.groups for x in (self, *more)]), joined("good"))


def _joined(values: pa.Array, counts: np.ndarray, mark: str) -> pa.Array:
    """Strings joined in runs of the given lengths."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values), mark)


class Aligner:
    """Both tokenizers of a worker, and its memory of aligned chunks."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = ByteTokens(a_file), PieceTokens(b_file)
        self.pairs = Pairs(self.a.vocabulary, self.b.vocabulary)
        self.known, self.memory = pa.array([], pa.string()), Chunks.none()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": LIMIT, "temp_directory": ""})

    def _block(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of two token sequences of the same bytes: the group of each token, and end and ids of each link."""
        for name, ids, size in (("a", a, a_size), ("b", b, b_size)):
            ends = np.cumsum(size)
            self.db.register(name, pa.table({"id": ids, "s": ends - size, "e": ends}))
        self.db.execute(_LINKS)
        self.db.execute(_CUTS)
        link = self.db.sql("SELECT e::BIGINT AS e, a_id, b_id FROM link ORDER BY e").to_arrow_table()
        groups = [self.db.sql(_GROUPS.format(x)).to_arrow_table()["g"].to_numpy() for x in "ab"]
        return *groups, *[link[c].to_numpy() for c in ("e", "a_id", "b_id")]

    def _cuts(self, n_a: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Blocks (from a, to a, from b, to b) of about TOKENS tokens that end where chunks do, or, in a long chunk, where tokens of both kinds do."""
        ends, out, at_a, at_b = np.cumsum(n_a), [], 0, 0
        while at_a < len(a_ends):
            fit = ends[np.searchsorted(ends, at_a + TOKENS, "right") - 1] if len(ends) and ends[0] <= at_a + TOKENS else 0
            if fit <= at_a:
                near = a_ends[at_a + TOKENS - 1 :]
                place = np.minimum(np.searchsorted(b_ends, near), len(b_ends) - 1)
                fit = at_a + TOKENS + int(np.argmax(b_ends[place] == near)) if len(near) else len(a_ends)
            to_b = int(np.searchsorted(b_ends, a_ends[fit - 1])) + 1
            out.append((at_a, int(fit), at_b, to_b))
            at_a, at_b = int(fit), to_b
        return out

    def aligned(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> Chunks:
        """Alignments of chunks whose tokens are given one after the other; both kinds give the same bytes."""
        a_size, b_size = self.a.vocabulary.size[a], self.b.vocabulary.size[b]
        a_ends, b_ends = np.cumsum(a_size), np.cumsum(b_size)
        groups, links, ends = [pa.array([], pa.string())], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for x, to_x, y, to_y in self._cuts(n_a, a_ends, b_ends):
            g_a, g_b, e, i, j = self._block(a[x:to_x], b[y:to_y], a_size[x:to_x], b_size[y:to_y])
            shown = [_joined(pc.cast(pa.array(ids), pa.string()), np.bincount(g), ",") for ids, g in ((a[x:to_x], g_a), (b[y:to_y], g_b))]
            groups.append(pc.binary_join_element_wise(*shown, "|"))
            links.append(self.pairs.number(i, j))
            ends.append(e + (a_ends[x - 1] if x else 0))
        # all tokens have bytes, so a chunk has as many groups as links
        done = np.searchsorted(np.concatenate(ends), np.r_[0, a_ends][np.cumsum(n_a)], "right")
        n = np.diff(np.r_[0, done])
        return Chunks(n_a, n_b, np.concatenate(links), n, _joined(pa.concat_arrays(groups), n, ";"), np.ones(len(n_a), bool))

    def _new(self, a: np.ndarray, n_a: np.ndarray, chunks: list[str]) -> Chunks:
        """Alignments of chunks with the given byte tokens."""
        b, n_b, good = self.b.of(chunks)
        start = np.cumsum(n_a) - n_a
        if not good.all():
            a, n_a = a[ragged(start[good], n_a[good])], np.where(good, n_a, 0)
        own = self.aligned(a, n_a, b, n_b)
        own.good = good
        return own

    def parts(self, parts: pa.Array, often: np.ndarray) -> Chunks:
        """Alignments of different parts of texts; those that occur often are kept."""
        place = pc.index_in(parts, self.known).to_numpy(zero_copy_only=False) if len(self.known) else np.full(len(parts), np.nan)
        new = np.flatnonzero(np.isnan(place))
        fresh = parts.take(pa.array(new))
        a, n_a = self.a.of(fresh, often[new])
        line = pc.starts_with(fresh, "\n")
        own = self._new(a, n_a, pc.if_else(line, fresh, pc.binary_join_element_wise(" ", fresh, "")).to_pylist())
        at = np.zeros(len(parts), np.int64)
        at[np.isnan(place)] = len(self.known) + np.arange(len(new))
        at[~np.isnan(place)] = place[~np.isnan(place)].astype(np.int64)
        both = self.memory.with_more(own)
        brief = pc.binary_length(fresh).to_numpy(zero_copy_only=False) <= BRIEF
        keep = np.flatnonzero(often[new] & brief)[: MEMORY - len(self.known)]
        if len(keep):
            self.known, self.memory = pa.concat_arrays([self.known, fresh.take(pa.array(keep))]), self.memory.with_more(own.take(keep))
        return both.take(at)

    def wide(self, chunks: list[str]) -> Chunks:
        """Alignments of chunks with any white space."""
        ids = self.a.wide(chunks)
        return self._new(np.concatenate([np.zeros(0, np.int64), *ids]), np.fromiter(map(len, ids), np.int64, len(ids)), chunks)


@functools.lru_cache(1)
def aligner_of(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def chunked(texts: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
    """The different parts of texts, further chunks, the numbers of the chunks of all texts (further ones after the parts), and how many each text has.

    A part follows a space or begins with a line end. A text with other white
    space around a cut is cut only at single spaces between other characters.
    """
    empty = pc.equal(pc.fill_null(texts, ""), "").to_numpy(zero_copy_only=False)
    texts = texts.take(pa.array(np.arange(len(texts)), mask=empty))  # empty ones as null
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    parts, numbers = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    bare = pc.binary_length(pc.utf8_trim_whitespace(parts)).to_numpy(zero_copy_only=False)
    line = pc.starts_with(parts, "\n").to_numpy(zero_copy_only=False)
    odd = (bare == 0) | (bare + line != pc.binary_length(parts).to_numpy(zero_copy_only=False))
    text = np.repeat(np.arange(len(texts)), counts)
    whole = np.unique(text[odd[numbers]])
    if not len(whole):
        return parts, [], numbers, counts
    keep = ~np.isin(text, whole)
    used, numbers = np.unique(numbers[keep], return_inverse=True)
    number: dict[str, int] = {}
    more = [[len(used) + number.setdefault(" " + c, len(number)) for c in _CUT.split(t)] for t in texts.take(pa.array(whole)).to_pylist()]
    sizes = counts.copy()
    sizes[whole] = [len(x) for x in more]
    out = np.zeros(int(sizes.sum()), np.int64)
    other = np.ones(len(texts), bool)
    other[whole] = False
    first = np.cumsum(sizes) - sizes
    out[ragged(first[other], sizes[other])] = numbers
    out[ragged(first[whole], sizes[whole])] = np.concatenate([np.array(x, np.int64) for x in more])
    return parts.take(pa.array(used)), list(number), out, sizes


ALIGNED = "doc_id long, n_a long, n_b long, groups string, links array<int>, counts array<struct<link:int,times:long>>"


def aligned_documents(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, groups, links, counts: a row for each document, and one for each task.

    groups has the ids of each group as `a1,a2|b1;a3|b2,b3`, links the numbers
    of its linked pairs in the list of Pairs. A task's last row has nulls but
    for counts, how often it saw each pair. Null and empty texts, and those
    that one of the vocabularies does not give back, have no tokens. Repeated
    rows give equal rows; other columns are ignored, whatever their names; an
    empty table gives no documents.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = aligner_of(a_file, b_file), pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("groups", pa.string()), ("links", pa.list_(pa.int32())), ("counts", pa.list_(pa.struct([("link", pa.int32()), ("times", pa.int64())])))])
        seen = np.zeros(len(own.pairs.keys), np.int64)
        for b in sliced(batches, "text", SLICE):
            parts, wide, numbers, counts = chunked(b.column("text"))
            chunks = own.parts(parts, np.bincount(numbers, minlength=len(parts))[: len(parts)] > 1)
            chunks = chunks.with_more(own.wide(wide)) if wide else chunks
            text = np.repeat(np.arange(b.num_rows), counts)
            bad = np.zeros(b.num_rows, bool)
            bad[text[~chunks.good[numbers]]] = True
            if bad.any():
                numbers, counts = numbers[~bad[text]], np.where(bad, 0, counts)
                text = text[~bad[text]]
            total = lambda x: np.bincount(text, x[numbers], b.num_rows).astype(np.int64)
            start, n = np.cumsum(chunks.n_links) - chunks.n_links, chunks.n_links[numbers]
            links, ends = chunks.links[ragged(start[numbers], n)], np.cumsum(total(chunks.n_links))
            seen += np.bincount(links, minlength=len(seen))
            n_a, n_b, cuts = total(chunks.n_a), total(chunks.n_b), np.r_[0, np.cumsum(counts)]
            for at in range(0, b.num_rows, 128):  # the groups are long texts
                to = min(at + 128, b.num_rows)
                shown = _joined(chunks.groups.take(pa.array(numbers[cuts[at] : cuts[to]])), counts[at:to], ";")
                lo = ends[at - 1] if at else 0
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends[at:to] - lo], pa.int32()), pa.array(links[lo : ends[to - 1]]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, to - at), pa.array(n_a[at:to]), pa.array(n_b[at:to]), shown, lists, pa.nulls(to - at, schema.field("counts").type)], schema=schema)
        which = np.flatnonzero(seen)
        if len(which):
            flat = pa.StructArray.from_arrays([pa.array(which, pa.int32()), pa.array(seen[which])], ["link", "times"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(c).type) for c in schema.names[:-1]] + [pa.ListArray.from_arrays(pa.array([0, len(which)], pa.int32()), flat)], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(align, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, times): how many links hold a pair, merged from the tasks' rows."""
    return aligned.filter("counts IS NOT NULL").select(F.explode("counts").alias("x")).groupBy("x.link").agg(F.sum("x.times").alias("times"))


def alignment_table(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    n_best counts the links whose pair is the most frequent one of its b token
    in all documents, ties included; count_sum adds up the counts of the pairs
    of all links. Without tokens all are 0 and the digest is empty. Edge cases
    are those of aligned_documents.
    """
    digest = F.when(F.col("groups") != "", F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows = stored(aligned_documents(docs, a_file, b_file).withColumn("groups", digest), "aligned")
    # bounded by the list of possible pairs, whatever the number of documents
    merged = pair_counts(rows).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((merged["link"].to_numpy(), merged["times"].to_numpy()))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, (link, times) = aligner_of(a_file, b_file).pairs.keys, sent.value
        count = np.zeros(len(keys), np.int64)
        count[link] = times
        b_id = keys & 0xFFFFFFFF
        most = np.zeros(int(b_id.max(initial=0)) + 1, np.int64)
        np.maximum.at(most, b_id, count)
        best = (count == most[b_id]).astype(np.int64)
        for b in batches:
            lists = b.column("links")
            ends = lists.offsets.to_numpy()
            own = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            sums = [np.diff(np.r_[0, np.cumsum(x[own])][ends - ends[0]]) for x in (best, count)]
            n = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_a"), b.column("n_b"), n, n, *map(pa.array, sums), b.column("groups")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    own = rows.filter("counts IS NULL").select("doc_id", "n_a", "n_b", "links", "groups")
    return own.mapInArrow(scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
