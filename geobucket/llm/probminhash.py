"""Near-duplicate classes by ProbMinHash.

A document is its five-word shingles weighted by 1 + ln(occurrences). Two
documents are linked if their probability Jaccard similarity,
sum over common shingles i of 1 / sum over all j of max(a_j / a_i, b_j / b_i),
is 0.8 or more; for equal weights this is the Jaccard similarity of the sets.

* Sketch. Every shingle sends out arrivals of a Poisson process with its weight
  as rate, each to a random one of 64 registers; a register keeps the shingle
  of its earliest arrival. Two registers agree with the probability Jaccard
  similarity as chance. A shingle whose next arrival is later than the latest
  register's time stops (early termination), so the work is near the number of
  shingles plus 64 ln 64.
* Banding. 16 bands of 4 registers: a pair at 0.8 shares a band with a chance
  above 0.9997. Exact copies (equal word sequences) are one node from the start.
* Verification. The members of a band's bucket are first compared with its
  pivot, the member whose other buckets are fullest (the original among its
  copies), not with each other. A node outside the largest class of one of its
  buckets is then compared with all nodes of other classes that it could still
  be similar to. These are found by a prefix: shingles are put in a global
  order, rare ones first, and if two similar nodes share no shingle before a
  position, what follows must be weight enough for 0.8. Near copies that differ
  from the pivot by too much meet only where they share their rare shingles,
  so a group's pairs are not all tried. Each comparison is exact.
* Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.names import free_names
from .common import PRIME, WordHashes, dropped, mixed, normal_words, shingled, sliced, stored, worded

SHINGLE, REGISTERS, BANDS, LEAST = 5, 64, 16, 0.8
#: Nodes whose list is sent to every task, under 64 MB; longer lists are joined by a shuffle.
SENT_NODES = 500_000
#: Bytes of text sketched at once; a worker holds some 25 times as much.
SLICE = 1 << 20
#: Counters of the order of shingles: 2 bytes each, whatever the number of shingles.
CELLS = 1 << 22


def weighted(text: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their weights, sorted by text."""
    _, first, n = np.unique(mixed(sh + text.astype(np.uint64) * PRIME), return_index=True, return_counts=True)
    order = np.argsort(first)
    first, n = first[order], n[order]
    return text[first], sh[first], 1 + np.log(n)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketch(text: np.ndarray, sh: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers shingles, the earliest arrival of each register; 0 for texts without shingles."""
    soonest, kept = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    latest = np.full(n, np.inf)
    state, time = sh.copy(), np.zeros(len(sh))
    while len(sh):
        state = mixed(state + PRIME)
        time = time - np.log(_uniform(state)) / weight
        on = time < latest[text]
        text, sh, weight, state, time = text[on], sh[on], weight[on], state[on], time[on]
        at = text * registers + (mixed(state ^ PRIME) % np.uint64(registers)).astype(np.int64)
        won = np.flatnonzero(time < soonest[at])
        won = won[np.argsort(-time[won], kind="stable")]  # the earliest is written last
        soonest[at[won]], kept[at[won]] = time[won], sh[won]
        latest = soonest.reshape(n, registers).max(axis=1)
    return kept.reshape(n, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two sorted weighted sets; n log n in the common shingles.

    For a common i with ratio r_i = b_i / a_i the inner sum is
    (sum of a_j where r_j <= r_i) / a_i + (sum of b_j where r_j > r_i) / b_i,
    with r_j = 0 for shingles of a alone and infinite for those of b alone.
    """
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0
    wa, wb = a[1][x], b[1][y]
    order = np.argsort(wb / wa, kind="stable")
    wa, wb = wa[order], wb[order]
    r = wb / wa
    last = np.searchsorted(r, r, "right")
    below = (a[1].sum() - wa.sum()) + np.r_[0, np.cumsum(wa)][last]
    above = (b[1].sum() - wb.sum()) + (wb.sum() - np.r_[0, np.cumsum(wb)][last])
    return float((1 / (below / wa + above / wb)).sum())


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the word sequence; null without words), bands."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = WordHashes(), REGISTERS // BANDS
        for b in sliced(batches, "words", SLICE):
            kept = sketch(*weighted(*shingled(*worded(b.column("words"), hashes), SHINGLE)), b.num_rows)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (b.num_rows, BANDS)).copy()
            for j in range(rows):
                key = mixed(key * PRIME + kept[:, j::rows])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), lists], ["doc_id", "node", "bands"])

    rows = docs.select(docs["doc_id"].alias("doc_id"), normal_words(docs["text"]).alias("words"))
    rows = rows.select("doc_id", F.when(F.col("words") != "", F.unhex(F.md5("words"))).alias("node"), "words")
    return rows.mapInArrow(bands, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, words) are similar. b's text travels to a, so a hot a can be split."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        hashes, seen, out = WordHashes(), {}, []

        def own(t: str) -> tuple[np.ndarray, np.ndarray]:
            if t not in seen:
                if len(seen) > 64:
                    seen.clear()
                _, sh, weight = weighted(*shingled(*worded(pa.array([t]), hashes), SHINGLE))
                order = np.argsort(sh)
                seen[t] = sh[order], weight[order]
            return seen[t]

        return pd.Series([similarity(own(s), own(t)) >= least for s, t in zip(x, y)], dtype=bool)

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    with_a = with_b.join(texts.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    return with_a.filter(similar("x", "y")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node of each connected component of edges (a, b), for nodes with an edge.

    In each round every label takes its least neighbouring label, and edges
    are drawn anew between labels, so both shrink; nodes are digests, whose
    random order keeps the rounds few. Only minima are gathered by key.
    """
    spark = edges.sparkSession
    edges = stored(edges.filter("a != b").distinct(), "edges")
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("class", F.col("node")), "labels")
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("old")).agg(F.min("b").alias("b"))
        near = stored(near.select("old", F.least("old", "b").alias("new")), "near")
        step = lambda df, c: df.join(near.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        new_labels = stored(step(labels, "class").select("node", "class"), "labels")
        new_edges = stored(step(step(edges, "a"), "b").filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        dropped(spark, near.scratch, labels.scratch, edges.scratch)
        labels, edges = new_labels, new_edges
    dropped(spark, edges.scratch)
    return labels


def speaking_texts(docs: DataFrame, sketches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, words) of the given nodes, each from its document of the least doc_id.

    Texts are shuffled only if the list of nodes is too long to send to every task.
    """
    texts = docs.select(docs["doc_id"].alias("doc_id"), normal_words(docs["text"]).alias("words")).withColumn("own", F.unhex(F.md5("words")))
    wanted = stored(sketches.groupBy("node").agg(F.min("doc_id").alias("speaker")).join(nodes.select("node"), "node"), "wanted")
    few = wanted.count() <= SENT_NODES
    found = texts.join(F.broadcast(wanted) if few else wanted, (F.col("own") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("speaker")))
    found = stored(found.select("node", "words").dropDuplicates(["node"]), "texts")
    dropped(docs.sparkSession, wanted.scratch)
    return found


def _cell_counts(nodes: DataFrame) -> np.ndarray:
    """Occurrences of shingles by cell of their hash, CELLS numbers; a cell with 1 has a shingle of one node."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches, "words", SLICE):
            _, sh, _ = weighted(*shingled(*worded(b.column("words"), hashes), SHINGLE))
            cell, n = np.unique(sh % np.uint64(CELLS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int32))], ["cell", "n"])

    got = nodes.select("words").mapInArrow(counts, "cell int, n int").groupBy("cell").agg(F.least(F.sum("n"), F.lit(65535)).cast("int").alias("n")).filter("n > 1").toArrow()
    out = np.ones(CELLS, np.uint16)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def prefix_rows(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """The prefixes of nodes (node, words, class, open): a row for each shingle that two similar nodes may have as the first common one.

    Any total order of shingles is right; one by counts makes prefixes rare. Of
    two similar nodes let i be the first common shingle. The common ones weigh
    no more than what either has from i on (`rest`), and that must be `least`
    of the node's size. `more` is what these weigh above 1 each.
    """
    sent = nodes.sparkSession.sparkContext.broadcast(_cell_counts(nodes))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches, "words", SLICE):
            text, sh, weight = weighted(*shingled(*worded(b.column("words"), hashes), SHINGLE))
            n = sent.value[(sh % np.uint64(CELLS)).astype(np.int64)]
            order = np.lexsort((sh, n, text))
            text, sh, weight, n = text[order], sh[order], weight[order], n[order]
            size = np.bincount(text, weight, b.num_rows)
            rest = np.cumsum(size)[text] - (np.cumsum(weight) - weight)
            above = weight - 1
            more = np.cumsum(np.bincount(text, above, b.num_rows))[text] - (np.cumsum(above) - above)
            keep = (n > 1) & (rest >= least * size[text] - 1e-6)
            text = text[keep]
            own = b.drop_columns(["words"]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sh[keep].view(np.int64)), pa.array(rest[keep]), pa.array(size[text]), pa.array(more[keep])], [*own.schema.names, "sh", "rest", "size", "more"])

    return nodes.select("node", "class", "open", "words").mapInArrow(prefixes, "node binary, class binary, open boolean, sh long, rest double, size double, more double")


def prefix_pairs(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """All pairs (a, b) of nodes with prefixes `rows` that may be similar, of different classes and with a open.

    With C the common shingles, A and B the sizes, and weights of 1 or more,
    the similarity is at most sum over C of max(a_i, b_i), over
    A + B - max(sum over C of a_i, sum over C of b_i). A sum over C is at most
    the node's own rest, and the other's rest with the own weights above 1.
    """
    a = rows.filter("open").select("sh", *[F.col(c).alias(f"a_{c}") for c in ("node", "class", "rest", "size", "more")])
    one, other = F.col("a_rest") + F.col("more"), F.col("rest") + F.col("a_more")
    common = F.greatest(F.least("a_rest", other), F.least("rest", one))
    enough = F.least(one, other) >= least * (F.col("a_size") + F.col("size") - common) - 1e-6
    once = ~F.col("open") | (F.col("a_node") < F.col("node"))
    pairs = a.join(rows, (a["sh"] == rows["sh"]) & (F.col("a_class") != F.col("class")) & once & enough)
    return pairs.select(F.col("a_node").alias("a"), F.col("node").alias("b")).distinct()


def linked(docs: DataFrame, sketches: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, class) for the nodes that have a link to another node."""
    spark = docs.sparkSession
    # one row of each node speaks for it
    nodes = sketches.filter("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    banded = stored(nodes.select("node", F.explode("bands").alias("bucket")), "banded")
    full = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(banded.join(full, "bucket"), "members")
    fullness = members.groupBy("node").agg(F.sum("size").alias("fullness"))
    texts = speaking_texts(docs, sketches, fullness)
    new = stored(members.join(fullness, "node").select("bucket", "node", "fullness"), "members")
    dropped(spark, banded.scratch, members.scratch)
    members = new
    # the first pivot of each bucket is its member of fullest buckets
    pivots = stored(members.groupBy("bucket").agg(F.max(F.struct("fullness", "node")).alias("p")).select("bucket", F.col("p.node").alias("a")), "pivots")
    pairs = pivots.join(members, "bucket").filter("a != node").select("a", F.col("node").alias("b")).distinct()
    links = stored(verified(pairs, texts, least), "links")
    classes = components(links)
    now = stored(members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "now")
    by_class = now.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    main = by_class.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).filter("classes > 1")
    met = now.join(main.select("bucket", F.col("main.class").alias("main")), "bucket")
    met = stored(met.groupBy("node").agg(F.first("class").alias("class"), F.bool_or(F.col("class") != F.col("main")).alias("open")), "met")
    met_texts = met.join(texts, "node")
    prefixes = stored(prefix_rows(met_texts, least), "prefixes")
    more = stored(verified(prefix_pairs(prefixes, least), texts, least), "links")
    if not more.isEmpty():
        old, classes = classes, components(links.unionByName(more))
        dropped(spark, old.scratch)
    dropped(spark, *[x.scratch for x in (texts, now, members, pivots, links, met, prefixes, more)])
    return classes


def duplicate_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id, node, class for every row of docs; class_id is the least doc_id of the class.

    Words are lower-cased runs without ASCII white space. Rows with equal word
    sequences share a class. A text without words, or null, has no shingle and
    is a class of its own with its doc_id, shared only by rows of equal doc_id.
    A text of under five words has one short shingle. Extra columns are ignored.
    """
    sketches = stored(sketched(docs), "sketches")
    classes = linked(docs, sketches, least)
    own = sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id")).filter("node is not null")
    own = own.join(classes, "node", "left").select("node", "doc_id", F.coalesce("class", "node").alias("class"))
    least_id = own.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    named = own.join(least_id, "class").select("node", "class", "class_id")
    return sketches.select("doc_id", "node").join(named, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "node", "class")


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of docs for each class, the one of the least doc_id, with all columns; rows without words all stay.

    A row with a null doc_id stays only if no row of its class has an id; an
    empty table gives no rows; columns of any names are kept. The rows that go
    are listed, and texts are shuffled only if the list is too long to send to
    every task; rows that repeat both doc_id and text are gathered by themselves.
    """
    found = stored(duplicate_classes(docs, least), "classes")
    pairs = stored(found.filter("node is not null").groupBy("class", "class_id", "doc_id", "node").agg(F.count("*").alias("n")), "pairs")
    # of rows that share the least doc_id of a class, different texts included, one stays
    first = pairs.filter("doc_id <=> class_id").groupBy("class").agg(F.min("node").alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first"))
    marked = pairs.join(first, "class").filter(~stays | (F.col("n") > 1)).select("doc_id", "node", stays.alias("stays"))
    name, an_id, own = free_names(docs, "node", "id", "own")
    marked = stored(marked.select(F.col("doc_id").alias(an_id), F.col("node").alias(own), "stays"), "marked")
    dropped(docs.sparkSession, found.scratch, pairs.scratch)
    few = marked.count() <= SENT_NODES
    rows = docs.withColumn(name, F.when((w := normal_words(docs["text"])) != "", F.unhex(F.md5(w))))

    def joined(keys: DataFrame, how: str) -> DataFrame:
        on = rows["doc_id"].eqNullSafe(keys[an_id]) & (rows[name] == keys[own])
        return rows.join(F.broadcast(keys) if few else keys, on, how)

    out = joined(marked.drop("stays"), "left_anti")
    repeated = marked.filter("stays").drop("stays")
    if not repeated.isEmpty():
        out = out.unionByName(joined(repeated, "left_semi").dropDuplicates(["doc_id", name]))
    return out.drop(name)
