"""SentencePiece encoding and decoding by suffix-array matching.

The different chunks of a slice of texts (words with their leading space mark)
are concatenated, and their suffixes sorted to the depth of the longest piece.
Binary search finds the range of suffixes that start with each piece, four
characters at a time; the occurrences become edges (position, length, piece), which are sorted by
position. The model is a byte-pair one, so edges are relaxed in merge order:
in each round every chunk contracts its leftmost pair of neighbouring symbols
whose join is the edge of the best score, until no pair is an edge. The ids
equal those of the library. Characters without a piece become byte pieces. A
bounded memory keeps the ids of chunks that occur twice or more in a slice, so
later slices match the others only.

Memory is bounded by SLICE, whatever the length of a text or of a word: chunks
are matched in groups of SLICE characters, and a chunk longer than BLOCK is
encoded in blocks that overlap. Two blocks are joined at a token that both
have: symbols are those of the whole chunk if every two neighbours are those
of their own join, and on either side of that token all neighbours come from
one block.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .token_orc import ragged, split_parts

MARK, SLICE, LONG_CHUNK, NEVER = "▁", 1 << 20, 128, np.int64(2**62)
#: Bytes of texts encoded at once; with 1 MB a worker took 60 MB more.
TEXTS = 1 << 18
#: Most chunks that a worker remembers, and their most bytes.
MEMORY, BRIEF = 100_000, 64
#: Characters of a long chunk that are encoded at once, and how far the next block reaches back.
BLOCK, OVERLAP = 1 << 15, 1 << 9


class Pieces:
    """Pieces of a model as packed keys, four characters of 16 bits to a word; and the memory of chunks, with their ids."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.raw = [b""] * n
        own = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.raw[i] = piece.replace(MARK, " ").encode()
                own.append((piece, sp.get_score(i), i))
        own.sort()  # sought in order
        self.raw_bytes = pa.array(self.raw, pa.large_binary())
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in own):
            raise ValueError("a piece reaches over the start of a word or a line")
        self.ids = np.array([i for _, _, i in own], np.int32)
        self.lengths = np.array([len(p) for p, _, _ in own], np.int64)
        _, rank = np.unique([-s for _, s, _ in own], return_inverse=True)
        self.rank = rank.astype(np.int64)
        self.depth = int(self.lengths.max())
        if self.depth >= 64 or n >= 1 << 20:
            raise ValueError("a piece has 64 characters or more, or there are 2**20 pieces or more")
        self.words = (self.depth + 3) // 4
        chars = np.array(sorted({ord(c) for p, _, _ in own for c in p}))
        if len(chars) > 65000:
            raise ValueError("the pieces have too many different characters")
        # 0 stands between chunks; a character of no piece gets the last code
        self.code = np.full(0x110000, len(chars) + 1, np.uint16)
        self.code[chars] = np.arange(1, len(chars) + 1)
        grid = np.zeros((len(own), self.words * 4), np.uint64)
        for x, (p, _, _) in enumerate(own):
            grid[x, : len(p)] = self.code[[ord(c) for c in p]]
        self.low = self._packed(grid)
        grid[np.arange(self.words * 4)[None, :] >= self.lengths[:, None]] = 0xFFFF
        self.high = self._packed(grid)
        self.memory, self.memory_ids, self.memory_sizes = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    @staticmethod
    def _packed(grid: np.ndarray) -> list[np.ndarray]:
        return [(grid[:, j] << np.uint64(48)) | (grid[:, j + 1] << np.uint64(32)) | (grid[:, j + 2] << np.uint64(16)) | grid[:, j + 3] for j in range(0, grid.shape[1], 4)]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces in a text of codes: sorted keys position * 64 + length, and piece numbers."""
        n, codes = len(codes), codes.astype(np.uint64)
        padded = np.concatenate([codes, np.zeros(self.words * 4, np.uint64)])
        four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
        keys = [four[4 * j : 4 * j + n] for j in range(self.words)]
        suffixes = _sorted_suffixes(four[:n], self.words * 4)
        keys = [k[suffixes] for k in keys]
        first, count = self._found(keys)
        piece = np.repeat(np.arange(len(first)), count)
        edge = suffixes[ragged(first, count)] * 64 + self.lengths[piece]
        both = np.sort(edge << 20 | piece)  # positions below 2**37, pieces below 2**20: one sort of whole numbers
        return both >> 20, both & 0xFFFFF


    def _found(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of the sorted suffixes that start with each piece, narrowed by four characters at a time."""
        first, after = np.searchsorted(keys[0], self.low[0]), np.searchsorted(keys[0], self.high[0], "right")
        for j in range(1, self.words):
            open_ = np.flatnonzero((self.lengths > 4 * j) & (first < after))
            low, high = _bisect(keys[j], self.low[j][open_], first[open_], after[open_], False), _bisect(keys[j], self.high[j][open_], first[open_], after[open_], True)
            first[open_], after[open_] = low, high
        return first, after - first


def _sorted_suffixes(four: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` characters or more, by prefix doubling from four."""
    order, known, key, n = np.argsort(four), 4, four, len(four)
    while known < depth:
        new = key[order]
        rank = np.zeros(n + known, np.int64)  # 0 beyond the end
        rank[order] = 1 + np.cumsum(np.r_[False, new[1:] != new[:-1]])
        key = rank[:n] * (n + 2) + rank[known : known + n]
        order, known = np.argsort(key), 2 * known
    return order


def _bisect(keys: np.ndarray, sought: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """For all sought keys at once, the place from lo to hi, between which keys are sorted, before (after: after) those equal to each."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        right = keys[mid] <= sought[open_] if after else keys[mid] < sought[open_]
        lo[open_] = np.where(right, mid + 1, lo[open_])
        hi[open_] = np.where(right, hi[open_], mid)
    return lo


@functools.lru_cache(2)
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


def _contract(start: np.ndarray, chunk: np.ndarray, lookup) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (start, length) of chunks whose characters start at `start`; both sorted."""
    length = np.ones(len(start), np.int64)
    rank = np.full(len(start), NEVER)

    def joined(at: np.ndarray) -> np.ndarray:
        """Ranks of symbols `at` joined with the next ones."""
        at = at[(at >= 0) & (at + 1 < len(start))]
        at = at[chunk[at] == chunk[at + 1]]
        rank[at] = lookup(start[at], length[at] + length[at + 1])
        return at

    joined(np.arange(len(start)))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(start):
        heads = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        sizes = np.diff(np.r_[heads, len(start)])
        least = np.repeat(np.minimum.reduceat(rank, heads), sizes)
        ready = least == NEVER
        if ready.any():
            done.append((start[ready], length[ready]))
            start, length, chunk, rank, least = (x[~ready] for x in (start, length, chunk, rank, least))
            if not len(start):
                break
        best = np.flatnonzero(rank == least)
        left = best[np.r_[True, chunk[best[1:]] != chunk[best[:-1]]]]
        length[left] += length[left + 1]
        keep = np.ones(len(start), bool)
        keep[left + 1] = False
        rank[left] = NEVER
        start, length, chunk, rank = start[keep], length[keep], chunk[keep], rank[keep]
        left = left - np.arange(len(left))  # one symbol less for each pair before
        joined(left)
        joined(left - 1)
    if not done:
        return start, length
    start, length = (np.concatenate(x) for x in zip(*done))
    size = np.zeros(start.max() + 1, np.int64)
    size[start] = length
    start = np.flatnonzero(size)
    return start, size[start]


def _contract_long(begin: int, end: int, ranks: dict[int, int]) -> list[tuple[int, int]]:
    """The same for one long chunk, with a heap of pairs."""
    size = {i: 1 for i in range(begin, end)}
    before = {i: i - 1 for i in range(begin, end)}
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = i + size[i]
        if i >= begin and j < end:
            n = size[i] + size[j]
            if n < 64 and (r := ranks.get(i * 64 + n)) is not None:
                heapq.heappush(heap, (r, i, n))

    for i in range(begin, end - 1):
        push(i)
    while heap:
        _, i, n = heapq.heappop(heap)
        if i not in size or (j := i + size[i]) >= end or size[i] + size[j] != n:
            continue
        size[i] = n
        del size[j]
        if i + n < end:
            before[i + n] = i
        push(i)
        if before[i] >= begin:
            push(before[i])
    return sorted(size.items())


def _symbols(text: str, lengths: np.ndarray, p: Pieces) -> tuple[np.ndarray, ...]:
    """Of chunks of the given lengths, joined by a character each: symbols (start in its chunk, length), their number of ids, the ids, and the symbols of each chunk."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = p.code[points]
    begins = np.cumsum(lengths + 1) - lengths - 1
    codes[begins[1:] - 1] = 0
    key, piece = p.edges(codes)
    edge_rank = p.rank[piece]
    # edges of a position lie together, by length: the first one's place, and a bit for each length
    own = key >> 6
    number = np.bincount(own, minlength=len(codes))
    first, lasting = np.cumsum(number) - number, np.zeros(len(codes), np.uint64)
    if len(key):
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        lasting[own[heads]] = np.bitwise_or.reduceat(np.uint64(1) << (key & 63).astype(np.uint64), heads)

    def find(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bit, bits = np.uint64(1) << np.minimum(length, 63).astype(np.uint64), lasting[start]
        return first[start] + np.bitwise_count(bits & (bit - np.uint64(1))), ((bits & bit) != 0) & (length < 64)

    def lookup(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        at, ok = find(start, length)
        found = np.full(len(start), NEVER)
        found[ok] = edge_rank[at[ok]]
        return found

    long = lengths > LONG_CHUNK
    short = np.flatnonzero(~long)
    start, length = _contract(ragged(begins[short], lengths[short]), np.repeat(short, lengths[short]), lookup)
    if long.any():
        more = []
        for i in np.flatnonzero(long):
            a, b = np.searchsorted(key, begins[i] * 64), np.searchsorted(key, (begins[i] + lengths[i]) * 64)
            more += _contract_long(int(begins[i]), int(begins[i] + lengths[i]), dict(zip(key[a:b].tolist(), edge_rank[a:b].tolist())))
        more_start, more_length = np.array(more, np.int64).reshape(-1, 2).T
        start, length = np.concatenate([start, more_start]), np.concatenate([length, more_length])
        order = np.argsort(start)
        start, length = start[order], length[order]
    at, ok = find(start, length)
    counts = np.ones(len(start), np.int64)
    cp = points[start[~ok]].astype(np.int64)
    counts[~ok] = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.cumsum(counts)
    ids = np.zeros(ends[-1] if len(ends) else 0, np.int32)
    ids[ends[ok] - 1] = p.ids[piece[at[ok]]]
    if len(cp):
        raw = np.frombuffer("".join(map(chr, cp.tolist())).encode(), np.uint8)
        ids[ragged(ends[~ok] - counts[~ok], counts[~ok])] = p.byte_id[raw]
    chunk = np.searchsorted(begins, start, "right") - 1
    return start - begins[chunk], length, counts, ids, np.bincount(chunk, minlength=len(lengths))


def _in_blocks(chunk: str, p: Pieces, block: int = BLOCK) -> np.ndarray:
    """Ids of one chunk of any length, from overlapping blocks; they grow where two have no symbol in common."""

    def part(at: int) -> tuple[np.ndarray, ...]:
        return _symbols(own := chunk[at : at + block], np.array([len(own)]), p)

    out, at = [], 0
    start, length, counts, ids, _ = part(0)
    while at + block < len(chunk):
        begin = int(start[min(np.searchsorted(start, block - OVERLAP), len(start) - 1)])
        new_start, new_length, new_counts, new_ids, _ = part(at + begin)
        same = np.flatnonzero(np.isin((start - begin) * block + length, new_start * block + new_length) & (start >= begin))
        if not begin or not len(same):
            return _in_blocks(chunk, p, 2 * block)
        i = same[0]
        j = np.searchsorted(new_start, start[i] - begin)
        out.append(ids[: counts[:i].sum()])
        ids = new_ids[new_counts[:j].sum() :]
        start, length, counts, at = new_start[j:], new_length[j:], new_counts[j:], at + begin
    return np.concatenate([*out, ids])


def encode_chunks(chunks: pa.Array, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks, one after the other, and the number of ids of each."""
    lengths = pc.utf8_length(chunks).to_numpy().astype(np.int64)
    # cuts: before and after each long chunk, and where a group would grow beyond SLICE
    long = np.flatnonzero(lengths > BLOCK)
    group = np.cumsum(lengths) // SLICE
    cuts = np.unique(np.concatenate([[0, len(chunks)], long, long + 1, 1 + np.flatnonzero(np.diff(group))]))
    all_ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(chunks), np.int64)
    for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if lengths[at] > BLOCK:
            ids = _in_blocks(chunks[at].as_py(), p)
            sizes[at] = len(ids)
        else:
            own = chunks.slice(at, to - at)
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(own)], own), "\x00")[0].as_py()
            _, _, counts, ids, symbols = _symbols(text, lengths[at:to], p)
            sizes[at:to] = np.bincount(np.repeat(np.arange(to - at), symbols), counts, to - at)
        all_ids.append(ids)
    return np.concatenate(all_ids), sizes


def encode_known(chunks: pa.Array, often: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of different chunks, as (ids, start of each chunk, number of each); those of chunks that occur often are taken from, and kept in, the memory."""
    known = pc.fill_null(pc.index_in(chunks, p.memory), -1).to_numpy().astype(np.int64)
    new = np.flatnonzero(known < 0)
    more, sizes = encode_chunks(chunks.take(pa.array(new)), p)
    known[new] = len(p.memory) + np.arange(len(new))
    ids, sizes = np.concatenate([p.memory_ids, more]), np.concatenate([p.memory_sizes, sizes])
    starts = np.cumsum(sizes) - sizes
    brief = pc.binary_length(chunks).to_numpy() <= BRIEF
    keep = new[(often & brief)[new]][: MEMORY - len(p.memory)]
    if len(keep):
        p.memory = pa.concat_arrays([p.memory, chunks.take(pa.array(keep))])
        p.memory_ids = np.concatenate([p.memory_ids, ids[ragged(starts[known[keep]], sizes[known[keep]])]])
        p.memory_sizes = np.concatenate([p.memory_sizes, sizes[known[keep]]])
    return ids, starts[known], sizes[known]


_RUN = re.compile("  +")


def encode_texts(texts: pa.Array, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the number of ids of each text; none for null and empty texts."""
    # the mark itself counts as a space; all but the first of a run of spaces go with the word after it
    texts = pc.replace_substring(texts, MARK, " ")
    texts = pc.if_else(pc.equal(pc.fill_null(texts, ""), ""), None, pc.binary_join_element_wise(" ", texts, ""))
    runs = pc.fill_null(pc.match_substring(texts, "  "), False)
    if pc.any(runs).as_py():
        texts = pa.array([_RUN.sub(lambda m: " " + MARK * (len(m[0]) - 1), t) if r else t for t, r in zip(texts.to_pylist(), runs.to_pylist())], pa.string())
    words, numbers, counts = split_parts(texts)
    if not len(numbers):
        return np.zeros(0, np.int32), counts
    own = np.ones(len(numbers), bool)
    own[(np.cumsum(counts) - counts)[counts > 0]] = False  # the line end that split_parts() puts first
    numbers, counts = numbers[own], np.maximum(0, counts - 1)
    chunks = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(MARK, words, ""))
    ids, starts, lengths = encode_known(chunks, np.bincount(numbers, minlength=len(chunks)) > 1, p)
    own = lengths[numbers]
    return ids[ragged(starts[numbers], own)], np.bincount(np.repeat(np.arange(len(texts)), counts), own, len(texts)).astype(np.int64)


def decode_ids(ids: list[int], p: Pieces) -> str:
    """The text of ids; the space before the first word goes."""
    return b"".join(map(p.raw.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _decoded(ids: np.ndarray, p: Pieces, most: int = 1 << 16) -> str:
    """The same for an array, a part at a time."""
    return b"".join(b"".join(map(p.raw.__getitem__, ids[at : at + most].tolist())) for at in range(0, len(ids), most)).removeprefix(b" ").decode("utf-8", "replace")


def round_trips(texts: pa.Array, ids: np.ndarray, counts: np.ndarray, p: Pieces) -> np.ndarray:
    """Whether the ids of each text decode to it: by the bytes of all at once, and one by one where those differ."""
    ends, same = np.cumsum(counts), np.zeros(len(texts), bool)
    if len(ids):
        raw = p.raw_bytes.take(pa.array(ids))
        _, places, content = raw.buffers()
        cuts = np.frombuffer(places, np.int64)[np.concatenate([[0], ends])]
        back = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(cuts), content])
        spaced = pc.binary_join_element_wise(" ", pc.replace_substring(pc.fill_null(texts, ""), MARK, " "), "")
        same = pc.equal(back, spaced.cast(pa.large_binary())).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~same):
        same[i] = _decoded(ids[ends[i] - counts[i] : ends[i]], p) == (texts[i].as_py() or "").replace(MARK, " ")
    return same


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip for every row.

    Null and empty texts have no ids and count as round trips. round_trip says
    that decoding gives the text, in which the space mark itself, if it
    occurs, comes back as a space. Repeated rows give equal rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model_file)
        for b in sliced(batches, "text", TEXTS):
            ids, counts = encode_texts(b.column("text"), p)
            ends = np.cumsum(counts)
            back = round_trips(b.column("text"), ids, counts, p)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), lists, pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of encoded rows (doc_id, ids); null ids give null texts."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model_file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else decode_ids(x, p) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")
