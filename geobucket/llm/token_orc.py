"""Token ids in ORC: run-length coded integers, row indexes and Bloom filters on document ids.

Texts are dealt by ranges of (doc_id, hash of the text) and sorted, so file
order, stripe order and row order follow the ids, and a repeated or null id may
spread over files; statistics of stripes and row groups then prune reads of id
ranges, and the Bloom filters those of single ids. Stripes are read in
parallel. Each row keeps `at`, the number of ids before it in its file.

White space never joins the token before it in this vocabulary's pattern, so a
text may be cut before any single space or line end between other characters.
A run of marks (ASCII punctuation but the apostrophe) after plain letters, at
the end of such a part, is a match of the pattern of its own. The library
encodes each different word and run of a slice once, many words to a call, and
a bounded memory keeps the ids of frequent ones.
Texts with other white space around a cut are encoded whole.
"""

from __future__ import annotations

import functools
import math
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, sliced

END_ID, CALL, SLICE, MEMORY = 2, 10_000, 4 << 20, 450_000
#: Most bytes of text a file; smaller tables make SPREAD files a core, down to 1 MB a file.
FILE_BYTES, LEAST_BYTES, SPREAD = 64 << 20, 1 << 20, 4
ORC = {"orc.compress": "ZSTD", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
#: A plain word, after a line end where it follows one, and the marks that may follow it.
PLAIN, MARKS = "^\n?[A-Za-zÀ-ÖØ-öø-ÿ]+$", string.punctuation.replace("'", "")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def split_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different parts of texts, the numbers of the parts of all texts, and how many each text has.

    Texts are parted at single spaces and before line ends; a part that begins
    with a line end follows no space, and neither does the first one, before
    which a line end is put. Null and empty texts have no part.
    """
    texts = pc.if_else(pc.equal(pc.fill_null(texts, ""), ""), None, pc.binary_join_element_wise("\n", texts, ""))
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    counts = np.maximum(0, pc.fill_null(pc.list_value_length(lists), 1).to_numpy(zero_copy_only=False).astype(np.int64) - 1)
    flat = lists.flatten()  # each list begins with the empty part before its first line end
    keep = np.ones(len(flat), bool)
    full = counts[counts > 0]
    keep[np.cumsum(full + 1) - full - 1] = False
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counts


def _gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of ids one after the other, and their new starts."""
    return ids[ragged(start, length)], np.cumsum(length) - length, length


class Encoder:
    """Ids of parts by the library, as (ids, start of each part, length of each part)."""

    def __init__(self, file: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = plain_specials  # else their strings are tokens wherever they occur
        self.added = [] if plain_specials else [t.content for t in self.library.get_added_tokens_decoder().values()]
        line = self._of("\n")
        if len(line) != 1:
            raise ValueError("a line end is not one token")
        self.line = int(line[0])
        # plain words are given to the library's model already parted, in its alphabet of bytes
        self.spaces = pre_tokenizers.CharDelimiterSplit(" ")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = np.zeros(256, np.uint16)
        self.alphabet[shown] = shown
        self.alphabet[[b for b in range(256) if b not in set(shown)]] = 256 + np.arange(256 - len(shown))
        self.alphabet[0] = ord(" ")  # the parting character; it is in no plain word
        self.memory, self.ids, self.start, self.length = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _of(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _cut(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the runs after each line end."""
        cuts = np.flatnonzero(ids == self.line)
        if len(cuts) != n:
            raise ValueError("a part holds a line end")
        return cuts, np.r_[cuts[1:], len(ids)] - cuts

    def general(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text with a part in each line; a line end before a character other than white space is a token of its own."""
        all_ids, starts, lengths, before = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for at in range(0, len(pieces), CALL):
            own = pieces.slice(at, CALL).to_pylist()
            bare = np.fromiter((x[0] == "\n" for x in own), np.int64, len(own))
            ids = self._encoded("".join([x if x[0] == "\n" else "\n " + x for x in own]))
            start, length = self._cut(ids, len(own))
            all_ids.append(ids)
            starts.append(before + start + 1 - bare)
            lengths.append(length - 1 + bare)
            before += len(ids)
        return np.concatenate(all_ids), np.concatenate(starts), np.concatenate(lengths)

    def plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for plain words, which follow a space or begin with a line end."""
        all_ids, starts, lengths, before = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for at in range(0, len(words), CALL):
            own = words.slice(at, CALL)
            after_line = pc.starts_with(own, "\n")
            own = pc.if_else(after_line, pc.utf8_ltrim(own, "\n"), pc.binary_join_element_wise(" ", own, ""))
            raw = pc.binary_join(pa.ListArray.from_arrays([0, len(own)], own), "\0\n\0")[0].as_py()
            text = self.alphabet[np.frombuffer(f"\n\0{raw}".encode(), np.uint8)].tobytes().decode("utf-16-le")
            own_pattern, self.library.pre_tokenizer = self.library.pre_tokenizer, self.spaces
            ids, spaced = self._encoded(text), ~after_line.to_numpy(zero_copy_only=False)
            self.library.pre_tokenizer = own_pattern
            start, length = self._cut(ids, len(own))
            all_ids.append(ids)
            starts.append(before + start + spaced)
            lengths.append(length - spaced)
            before += len(ids)
        return np.concatenate(all_ids), np.concatenate(starts), np.concatenate(lengths)

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def cores(self, pieces: pa.Array, often: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different parts; those of parts that occur often are taken from, and kept in, the memory."""
        known = pc.index_in(pieces, self.memory).to_numpy(zero_copy_only=False) if len(self.memory) else np.full(len(pieces), np.nan)
        new = np.isnan(known)
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        old = known[~new].astype(np.int64)
        all_ids, start[~new], length[~new] = [self.ids], self.start[old], self.length[old]
        before = len(self.ids)
        for which, encode in ((np.flatnonzero(new & plain), self.plain), (np.flatnonzero(new & ~plain), self.general)):
            ids, s, n = encode(pieces.take(pa.array(which)))
            all_ids.append(ids)
            start[which], length[which] = before + s, n
            before += len(ids)
        ids = np.concatenate(all_ids)
        brief = pc.binary_length(pieces).to_numpy(zero_copy_only=False) <= 64
        keep = np.flatnonzero(new & often & brief)[: MEMORY - len(self.memory)]
        if len(keep):
            more, s, n = _gathered(ids, start[keep], length[keep])
            self.start, self.length = np.r_[self.start, len(self.ids) + s], np.r_[self.length, n]
            self.memory, self.ids = pa.concat_arrays([self.memory, pieces.take(pa.array(keep))]), np.r_[self.ids, more]
        return ids, start, length

    def runs(self, pieces: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the marks, `size` of them, at the end of each part."""
        coded = pa.array([x[-n:] for x, n in zip(pieces, size.tolist())], pa.string()).dictionary_encode()
        ids = [self._of(x) for x in coded.dictionary.to_pylist()]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        number = coded.indices.to_numpy()
        return np.concatenate([np.zeros(0, np.int32), *ids]), (np.cumsum(length) - length)[number], length[number]

    def of(self, pieces: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different parts without white space but the line end that may begin one."""
        core = pc.utf8_rtrim(pieces, MARKS)
        cut = pc.binary_length(pieces).to_numpy(zero_copy_only=False) - pc.binary_length(core).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(core, PLAIN).to_numpy(zero_copy_only=False)
        coded = pc.if_else(pa.array(plain), core, pieces).dictionary_encode()
        number, cores = coded.indices.to_numpy(), coded.dictionary
        word = np.zeros(len(cores), bool)
        word[number[plain]] = True
        ids, start, length = self.cores(cores, np.bincount(number, 1 + often, len(cores)) > 1, word)
        start, length, marked = start[number], length[number], np.flatnonzero(plain & (cut > 0))
        marks, mark_start, mark_length = self.runs(pieces.take(pa.array(marked)).to_pylist(), cut[marked])
        total = length.copy()
        total[marked] += mark_length
        first = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), np.int32)
        out[ragged(first, length)] = ids[ragged(start, length)]
        out[ragged(first[marked] + length[marked], mark_length)] = marks[ragged(mark_start, mark_length)]
        return out, first, total


def encode_slice(texts: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the number of ids of each text.

    A text with other white space around a single space or line end is encoded
    whole, as is one that holds the string of an added token.
    """
    pieces, numbers, counts = split_parts(texts)
    bare = pc.binary_length(pc.utf8_trim_whitespace(pieces)).to_numpy(zero_copy_only=False)
    line = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
    odd = (bare == 0) | (bare + line != pc.binary_length(pieces).to_numpy(zero_copy_only=False))
    text = np.repeat(np.arange(len(texts)), counts)
    whole = np.unique(text[odd[numbers]]) if len(numbers) else np.zeros(0, np.int64)
    for special in encoder.added:
        whole = np.union1d(whole, np.flatnonzero(pc.fill_null(pc.match_substring(texts, special), False).to_numpy(zero_copy_only=False)))
    often = np.bincount(numbers, minlength=len(pieces))[~odd] > 1
    ids, starts, lengths = encoder.of(pieces.filter(pa.array(~odd)), often)
    place = np.cumsum(~odd) - 1
    if len(whole):
        keep = ~np.isin(text, whole)
        text, numbers = text[keep], numbers[keep]
    use = place[numbers]
    first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
    start, length = starts[use] + first, lengths[use] - first  # without the line end put there
    if len(whole):
        more = [np.array(e.ids, np.int32) for e in encoder.library.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        n = np.array([len(x) for x in more], np.int64)
        text, start, length = np.r_[text, whole], np.r_[start, len(ids) + np.cumsum(n) - n], np.r_[length, n]
        ids = np.concatenate([ids, *more])
        order = np.argsort(text, kind="stable")
        text, start, length = text[order], start[order], length[order]
    return ids[ragged(start, length)], np.bincount(text, length, len(texts)).astype(np.int64)


@functools.lru_cache(2)
def encoder_of(file: str, plain_specials: bool = False) -> Encoder:
    """The encoder of this worker, with its memory of parts."""
    return Encoder(file, plain_specials)


def encoded(rows: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """rows (doc_id, text) as (doc_id, n_tokens, ids, at), with the end id after each document; their order is kept.

    `at` counts the ids before a row in its partition.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = encoder_of(tokenizer_file), 0
        for b in sliced(batches, "text", SLICE):
            ids, counts = encode_slice(b.column("text"), encoder)
            ends = np.cumsum(counts + 1)
            out = np.full(ends[-1], end_id, np.int32)
            out[ragged(ends - counts - 1, counts)] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts + 1), lists, pa.array(before + ends - counts - 1)], ["doc_id", "n_tokens", "ids", "at"])
            before += int(ends[-1])

    return rows.mapInArrow(encode, TOKENS)


TOKENS = "doc_id long, n_tokens long, ids array<int>, at long"


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Writes (doc_id, n_tokens, ids, at) in ascending doc_id order, a file for each range.

    Rows that repeat an id are ordered by a hash of their text, then by the
    text; rows equal in both are dealt by their place in the input, so a much
    repeated one spreads over files. Null ids come first. The number of files
    follows the bytes of text.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, math.ceil(size / file_bytes), min(SPREAD * docs.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES))
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(files, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text")
    encoded(dealt.select("doc_id", "text"), tokenizer_file, end_id).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, at. Filters on doc_id and n_tokens prune stripes and row groups."""
    return spark.read.schema(TOKENS).orc(path)


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a written folder.

    Files hold ascending ranges, in the order of their part numbers, so a
    document starts after all ids of the earlier files and of the earlier rows
    of its own. One count a file reaches the driver.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ends = b.column("ids"), b.column("ids").offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
            own = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(own, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    file = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long").alias("file")
    rows = read_tokens(spark, path)
    before, starts = 0, []
    for f, n in sorted(tuple(r) for r in rows.select(file, "n_tokens").groupBy("file").agg(F.sum("n_tokens")).collect()):
        starts.append((f, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "file long, before long"))
    rows = rows.select("doc_id", "n_tokens", "ids", "at", file).join(starts, "file")
    return rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_documents(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """Writes the tokens of all documents and describes them as read back.

    Null texts are empty: one end id. An empty table gives no rows; repeated
    rows have places of their own; other columns are ignored, whatever their
    names.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "orc")
    write_tokens(docs, path, tokenizer_file, end_id)
    return token_table(spark, path)
