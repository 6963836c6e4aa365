"""Language identification by a linear-chain conditional random field over words.

A word is a run without ASCII white space that has a letter; its features come
from its letters, lower-cased: n-grams of 1 to 5 characters of the word with a
mark at both ends (those at a mark are its affixes), hashed into a fixed table
of weights, and a lexicon, the log odds of the word between labels by the
number of labelled documents that hold it, hashed into a fixed table too. The
transitions between the labels of neighbouring words are learned with the
weights.

The lexicon counts all labelled documents; tasks add up dense tables and Spark
merges them. The field is fitted on a bounded sample: about `sample_docs`
documents a label, of each a run of `sample_words` words from anywhere in it.
Labels are of whole documents, so runs of several documents are joined to
sequences, which hold the switches that transitions are learned from.

Texts are labelled whole. Scores of a word are found once for the different
words of a slice. The chains of all texts run side by side in blocks of words:
each block's product of steps is found first, states are carried over the
blocks of a text, then all blocks run forward and backward at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRIME, SPACES, mixed, sliced
from .token_orc import ragged

#: Bits of the tables of weights and of the lexicon, longest n-gram, and labels beyond which a table of all transitions is no model.
WEIGHT_BITS, LEXICON_BITS, LONGEST, MOST_LABELS = 18, 16, 5, 64
#: The sample of the fit: expected documents a label, words of each, runs in a sequence.
SAMPLE_DOCS, SAMPLE_WORDS, RUNS = 300, 40, 3
STEPS, RATE, SHRINK = 40, 0.15, 1e-5
SLICE, BLOCK, MEMORY, BRIEF = 8 << 20, 64, 300_000, 48
#: Least odds of a label of a word against its best one, so that products of a few steps stay far from zero.
FLOOR = 1e-6
NO_LABEL = "und"


def letters(part: str) -> str:
    """The letters of a part, lower-cased."""
    return (part if part.isalpha() else "".join(filter(str.isalpha, part))).lower()


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different parts of texts between ASCII white space (the empty one may be among them), the parts of all texts, and their number per text."""
    for c in SPACES[1:]:
        texts = pc.replace_substring(texts, c, " ")
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def buckets(words: list[str]) -> np.ndarray:
    """The places of words in the lexicon."""
    return np.fromiter((xxhash.xxh64_intdigest(w) & ((1 << LEXICON_BITS) - 1) for w in words), np.int64, len(words))


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the hashed n-grams of words that are not empty, in the order of words, and where each word's end."""
    c = np.frombuffer(("\2" + "\2".join(words) + "\2").encode("utf-32-le"), np.uint32).astype(np.uint64)
    marks = np.flatnonzero(c == 2)
    word = np.cumsum(c == 2) - 1
    limit = np.r_[marks[1:], len(c)][word]  # a window may end on the next mark
    h = np.zeros(len(c), np.uint64)
    for n in range(1, LONGEST + 1):
        h = h[: len(c) - n + 1] * PRIME + c[n - 1 :]
        at = np.arange(len(h))
        ok = (at + n - 1 <= limit[: len(h)]) & (word[: len(h)] < len(words))
        ok &= (c[: len(h)] != 2) if n == 1 else True
        yield (mixed(h[ok] + np.uint64(n)) & np.uint64((1 << WEIGHT_BITS) - 1)).astype(np.int64), np.searchsorted(word[: len(h)][ok], np.arange(len(words)), "right")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0, np.float64)])[np.r_[0, ends]]
    return np.diff(total, axis=0)


@dataclass
class Model:
    """Labels, weights of n-grams and of the lexicon's log odds, the log odds of all buckets, and scores of first labels and of transitions."""

    labels: list[str]
    weights: np.ndarray
    mix: np.ndarray
    lexicon: np.ndarray
    first: np.ndarray
    steps: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """The score of each label for each word."""
        if not words:
            return np.zeros((0, len(self.labels)))
        out = self.lexicon[buckets(words)] @ self.mix
        for index, ends in features(words):
            out += _sums(self.weights[index], ends)
        return out


def log_odds(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of counts (bucket, label) of documents, the log of each label's share against the mean of the logs; 0 where nothing is known."""
    x = np.log((counts + 0.5) / (docs + 1.0))
    return np.where(counts.sum(1, keepdims=True) > 0, x - x.mean(1, keepdims=True), 0.0)


def marginals(scores: np.ndarray, counts: np.ndarray, first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Posterior of each label for each word of chains that lie one after the other."""
    k = len(first)
    x = np.exp(np.maximum(scores - scores.max(1, keepdims=True), np.log(FLOOR))) if len(scores) else np.zeros((0, k))
    m = np.exp(steps - steps.max())
    s = np.tile(np.exp(first - first.max()), (k, 1))
    blocks = -(-counts // BLOCK)
    n = int(blocks.sum())
    if not n:
        return x
    chain, begin = np.repeat(np.arange(len(counts)), blocks), np.cumsum(blocks) - blocks
    number = np.arange(n) - begin[chain]
    size = np.minimum(BLOCK, counts[chain] - number * BLOCK)
    where = (np.repeat(np.arange(n), size), np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size))
    grid = np.ones((BLOCK, n, k))
    grid[where[1], where[0]] = x
    live = [np.flatnonzero(size > t) for t in range(BLOCK)]
    head = number == 0

    def scaled(v: np.ndarray, axes: tuple[int, ...] = (1,)) -> np.ndarray:
        return v / v.max(axis=axes, keepdims=True)

    product = np.where(head[:, None, None], s, m) * grid[0][:, None, :]
    for t in range(1, BLOCK):
        at = live[t]
        if not len(at):
            break
        step = (product[at].reshape(-1, k) @ m).reshape(-1, k, k) * grid[t][at][:, None, :]
        product[at] = scaled(step, (1, 2)) if t % 4 == 0 else step
    product = scaled(product, (1, 2))
    before, after = np.zeros((n, k)), np.ones((n, k))
    before[begin[blocks > 0]] = np.eye(k)[0]  # any state: the rows of the first step are equal
    for b in range(1, int(blocks.max())):
        at = begin[blocks > b] + b
        before[at] = scaled(np.einsum("nk,nkl->nl", before[at - 1], product[at - 1]))
    for b in range(int(blocks.max()) - 2, -1, -1):
        at = begin[blocks > b + 1] + b
        after[at] = scaled(np.einsum("nkl,nl->nk", product[at + 1], after[at + 1]))
    forward = np.empty((BLOCK, n, k))
    now = np.where(head[:, None], s[0], before @ m) * grid[0]
    forward[0] = now = scaled(now)
    for t in range(1, BLOCK):
        forward[t] = now = scaled((now @ m) * grid[t])  # beyond a block's end it is not used
    out, now = np.empty((BLOCK, n, k)), after.copy()
    for t in range(BLOCK - 1, -1, -1):
        if t < BLOCK - 1:
            at = live[t + 1]
            now[at] = scaled((grid[t + 1][at] * now[at]) @ m.T)
        out[t] = forward[t] * now
    own = out[where[1], where[0]]
    return own / own.sum(1, keepdims=True)


def _expected(x: np.ndarray, mask: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (t, n, label) and expected transitions of padded sequences of scores (t, n, label)."""
    e, m = np.exp(x - x.max(2, keepdims=True)), np.exp(steps - steps.max())
    a, b, total = np.empty_like(e), np.ones_like(e), np.zeros_like(m)
    a[0] = np.exp(first - first.max()) * e[0]
    for t in range(1, len(x)):
        a[t] = np.where(mask[t][:, None], (a[t - 1] @ m) * e[t], a[t - 1])
        a[t] /= a[t].sum(1, keepdims=True)
    for t in range(len(x) - 2, -1, -1):
        b[t] = np.where(mask[t + 1][:, None], (e[t + 1] * b[t + 1]) @ m.T, b[t + 1])
        b[t] /= b[t].sum(1, keepdims=True)
        own = a[t][:, :, None] * m * (e[t + 1] * b[t + 1])[:, None, :]
        total += (own / own.sum((1, 2), keepdims=True))[mask[t + 1]].sum(0)
    p = a * b
    return p / p.sum(2, keepdims=True), total


def fitted(labels: list[str], runs: list[tuple[int, list[str]]], counts: np.ndarray, docs: np.ndarray, seed: int = 13) -> Model:
    """The field that explains runs of words (label, words), by gradient steps of adapted size on all sequences.

    counts (bucket, label) and docs (label) make the lexicon; in the fit, a
    run's own document is taken out of it.
    """
    k, rng = len(labels), np.random.default_rng(seed)
    order = rng.permutation(len(runs))
    sequences = [[runs[i] for i in order[at : at + RUNS]] for at in range(0, len(runs), RUNS)]
    words, number, token_word, token_label, place = [], {}, [], [], []
    for n, sequence in enumerate(sequences):
        t = 0
        for label, own in sequence:
            for w in own:
                if (w, label) not in number:
                    number[w, label] = len(words)
                    words.append(w)
                token_word.append(number[w, label])
                token_label.append(label)
                place.append((t, n))
                t += 1
    token_word, token_label = np.array(token_word), np.array(token_label)
    at = tuple(np.array(place).reshape(-1, 2).T)
    own_counts = counts[buckets(words)].astype(np.float64)
    own_counts[np.arange(len(words)), [label for _, label in number]] -= 1
    odds = log_odds(np.maximum(own_counts, 0), docs)
    grams = list(features(words))
    lengths = [np.diff(np.r_[0, ends]) for _, ends in grams]
    mask = np.zeros((max(at[0]) + 1, len(sequences)), bool)
    mask[at] = True
    gold = np.zeros((k, k))
    np.add.at(gold, (token_label[:-1], token_label[1:]), (at[1][:-1] == at[1][1:]).astype(float))
    starts = np.bincount(token_label[at[0] == 0], minlength=k)
    w = {"weights": np.zeros((1 << WEIGHT_BITS, k)), "mix": np.eye(k) * 0.5, "first": np.zeros(k), "steps": np.zeros((k, k))}
    mean, square = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        score = odds @ w["mix"]
        for index, ends in grams:
            score += _sums(w["weights"][index], ends)
        x = np.zeros((*mask.shape, k))
        x[at] = score[token_word]
        p, moves = _expected(x, mask, w["first"], w["steps"])
        miss = p[at]
        miss[np.arange(len(miss)), token_label] -= 1
        error = np.stack([np.bincount(token_word, miss[:, j], len(words)) for j in range(k)], 1)
        grad = {"weights": np.zeros_like(w["weights"]), "mix": odds.T @ error, "first": p[0].sum(0) - starts, "steps": moves - gold}
        for (index, _), n in zip(grams, lengths):
            for j in range(k):
                grad["weights"][:, j] += np.bincount(index, np.repeat(error[:, j], n), 1 << WEIGHT_BITS)
        for n, g in grad.items():
            g = g / len(token_word) + SHRINK * w[n]
            mean[n] = 0.9 * mean[n] + 0.1 * g
            square[n] = 0.99 * square[n] + 0.01 * g * g
            w[n] = w[n] - RATE * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-8)
    return Model(labels, w["weights"].astype(np.float32), w["mix"], log_odds(counts, docs).astype(np.float32), w["first"], w["steps"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))


def lexicon_counts(rows: DataFrame, labels: list[str]) -> np.ndarray:
    """(bucket, label): how many labelled rows (lang, text) hold a word of the bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = np.zeros((len(labels), 1 << LEXICON_BITS), np.int64), pa.array(labels)
        for b in sliced(batches, "text", SLICE):
            parts, numbers, counts = parted(b.column("text"))
            words = [letters(x) for x in parts.to_pylist()]
            place = np.where(np.array([not w for w in words], bool), -1, buckets(words))[numbers]
            text = np.repeat(np.arange(b.num_rows), counts)[place >= 0]
            pair = np.unique(text << LEXICON_BITS | place[place >= 0])
            label = pc.index_in(b.column("lang"), known).to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(seen, (label[pair >> LEXICON_BITS], pair & ((1 << LEXICON_BITS) - 1)), 1)
        label, bucket = np.nonzero(seen)
        for at in range(0, len(label), 1 << 16):
            own = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[own], pa.int32()), pa.array(label[own], pa.int32()), pa.array(seen[label[own], bucket[own]])], ["bucket", "label", "n"])

    # bounded by the table, whatever the input
    got = rows.mapInArrow(counted, "bucket int, label int, n long").groupBy("bucket", "label").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << LEXICON_BITS, len(labels)), np.int64)
    out[got["bucket"].to_numpy(), got["label"].to_numpy()] = got["n"].to_numpy()
    return out


def sampled_runs(rows: DataFrame, labels: dict[str, int], sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> list[tuple[int, list[str]]]:
    """About sample_docs runs (label, words) of each label, in a fixed order; labels has the number of rows of each."""
    names, share = list(labels), F.lit(0.0)
    for name, n in labels.items():
        share = F.when(F.col("lang") == name, min(1.0, sample_docs / n)).otherwise(share)
    h = F.xxhash64("doc_id", "text")
    rows = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist()):
                words = [w for w in map(letters, text.split()) if w]
                at = h % max(1, len(words) - sample_words + 1)
                out.append(words[at : at + sample_words])
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array(out, pa.list_(pa.string()))], ["h", "lang", "words"])

    got = rows.mapInArrow(runs, "h long, lang string, words array<string>").toPandas().sort_values(["h", "lang"])
    return [(names.index(r.lang), list(r.words)) for r in got.itertuples() if len(r.words)]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model | None:
    """The model of labelled rows (doc_id, text, lang); rows without text or label are left out, and without any row there is none.

    More than MOST_LABELS labels are a ValueError.
    """
    rows = _rows(docs).filter("lang IS NOT NULL AND text IS NOT NULL")
    # one more than can be used reaches the driver
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels = {r["lang"]: r["n"] for r in found}
    runs = sampled_runs(rows, labels, sample_docs, sample_words) if labels else []
    if not runs:
        return None
    return fitted(list(labels), runs, lexicon_counts(rows, list(labels)), np.array(list(labels.values()), np.float64))


class Labeller:
    """A model in a worker, with the scores of frequent parts."""

    def __init__(self, model: Model):
        self.model, self.known = model, pa.array([], pa.string())
        self.has, self.score = np.zeros(0, bool), np.zeros((0, len(model.labels)))

    def parts(self, parts: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether parts have a letter, and their scores."""
        place = pc.index_in(parts, self.known).to_numpy(zero_copy_only=False) if len(self.known) else np.full(len(parts), np.nan)
        new = np.flatnonzero(np.isnan(place))
        words = [letters(x) for x in parts.take(pa.array(new)).to_pylist()]
        own = np.array([bool(w) for w in words], bool)
        score = np.zeros((len(new), len(self.model.labels)))
        score[own] = self.model.scores([w for w in words if w])
        at = np.where(np.isnan(place), 0, place).astype(np.int64)
        at[new] = len(self.known) + np.arange(len(new))
        has, both = np.r_[self.has, own][at], np.concatenate([self.score, score])[at]
        brief = pc.binary_length(parts).to_numpy(zero_copy_only=False)[new] <= BRIEF
        keep = np.flatnonzero(often[new] & brief)[: MEMORY - len(self.known)]
        self.known, self.has, self.score = pa.concat_arrays([self.known, parts.take(pa.array(new[keep]))]), np.r_[self.has, own[keep]], np.concatenate([self.score, score[keep]])
        return has, both

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of the words of all texts, and the number of words of each."""
        parts, numbers, counts = parted(texts)
        has, score = self.parts(parts, np.bincount(numbers, minlength=len(parts)) > 1)
        text = np.repeat(np.arange(len(texts)), counts)[has[numbers]]
        counts = np.bincount(text, minlength=len(texts))
        return marginals(score[numbers[has[numbers]]], counts, self.model.first, self.model.steps), counts


_LABELLERS: dict[str, Labeller] = {}


def _labeller(key: str, model: Model) -> Labeller:
    """The labeller of this worker; one model at a time."""
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(model)
    return _LABELLERS[key]


def labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words, runs for every row (doc_id, text).

    score is the mean posterior of the label over all words, lang_pred the
    label of the greatest one (ties: the first in order). runs has the most
    likely label of each word as (lang, words), neighbours of one label in
    one. Null texts, and those without a letter, get `und`, score 0 and no
    run, as do all without a model. Repeated rows give equal rows; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    import uuid

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    if model is None:
        none = "CAST(array() AS array<struct<lang:string,words:int>>) AS runs"
        return rows.selectExpr("doc_id", f"'{NO_LABEL}' AS lang_pred", "0.0D AS score", "0L AS n_words", none)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _labeller(key, sent.value)
        names = pa.array([*own.model.labels, NO_LABEL])
        for b in sliced(batches, "text", SLICE):
            p, counts = own.texts(b.column("text"))
            ends = np.cumsum(counts)
            mean = _sums(p, ends) / np.maximum(counts, 1)[:, None]
            best = np.where(counts > 0, mean.argmax(1), len(names) - 1)
            score = np.where(counts > 0, np.clip(mean.max(1), 0, 1), 0.0)
            top, text = p.argmax(1), np.repeat(np.arange(len(counts)), counts)
            cut = np.flatnonzero(np.r_[True, (top[1:] != top[:-1]) | (text[1:] != text[:-1])]) if len(top) else np.zeros(0, np.int64)
            flat = pa.StructArray.from_arrays([names.take(pa.array(top[cut])), pa.array(np.diff(np.r_[cut, len(top)]), pa.int32())], ["lang", "words"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text[cut], minlength=len(counts)))], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), names.take(pa.array(best)), pa.array(score), pa.array(counts.astype(np.int64)), lists], ["doc_id", "lang_pred", "score", "n_words", "runs"])

    return rows.mapInArrow(label, "doc_id long, lang_pred string, score double, n_words long, runs array<struct<lang:string,words:int>>")


def language_documents(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, runs for every row of documents (doc_id, text, lang).

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out: the model is
    fitted on the others, those of a null doc_id among them. Predictions see
    the text alone. Edge cases are those of `fit` and `labelled`.
    """
    held = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs.filter(~held), sample_docs, sample_words)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return labelled(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "n_words", "runs")
