"""Merkle manifest of a dataset: a tree a source, and a tree over the sources' roots.

A node is the lower-case hex SHA-256 of the concatenated hex digests of the
FAN consecutive nodes below it; the last run of a level may be shorter. The
leaves of a group are cut into blocks of FAN ** LEVELS, so that a block is a
whole subtree: one row with an ordered array of digests, which `sequence`,
`transform`, `slice` and `aggregate` collapse level by level inside built-in
expressions. The roots of the blocks are the leaves of the next pass, until
one node of each group is left; a pass shrinks the table by the block's size,
so the passes number log(leaves) to the base of that size, and no array is
longer than a block whatever the size of a group.

On the way back, each node's path (the digests left and right of it in its
run, a pair a level) is handed down from pass to pass, and joined to the leaf
blocks. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import dropped, stored
from .quality import let

#: Children of a node, and the levels that a block collapses.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
_BITS = FAN.bit_length() - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: `-` for null, else the count of UTF-8 bytes, a colon and the value."""
    shown = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(*[shown(c.cast("string")) for c in fields])


def _runs(nodes: Column) -> Column:
    """Nodes in runs of FAN."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / FAN).cast("int") - 1), lambda r: F.slice(nodes, r * FAN + 1, FAN))


def _collapsed(nodes: Column, levels: Column) -> Column:
    """struct(runs, nodes): the runs of the levels below the last one, lowest first, and the nodes of that."""
    none = F.struct(F.array().cast("array<array<array<string>>>").alias("runs"), nodes.alias("nodes"))

    def step(s: Column, _: Column) -> Column:
        return let(_runs(s["nodes"]), lambda x: F.struct(F.concat(s["runs"], F.array(x)).alias("runs"), F.transform(x, lambda run: digest(F.array_join(run, ""))).alias("nodes")))

    return F.aggregate(F.slice(F.lit(list(range(LEVELS))), F.lit(1), levels), none, step)


def _path(runs: Column, at: Column) -> Column:
    """The pairs of siblings of leaf `at` of a block, lowest level first."""
    shifted = lambda x, by: F.call_function("shiftright", x, by)

    def pair(level: Column, k: Column) -> Column:
        def of(i: Column) -> Column:
            return let(F.get(level, F.shiftright(i, _BITS)), lambda run: F.struct(F.array_join(F.slice(run, F.lit(1), i.bitwiseAND(FAN - 1)), "").alias("left"), F.array_join(F.slice(run, i.bitwiseAND(FAN - 1) + 2, F.lit(FAN)), "").alias("right")))

        return let(shifted(at, k * _BITS), of)

    return F.transform(runs, pair)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level from the leaf, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


@dataclass
class Forest:
    """Trees of all groups: `roots` (g, h), and the blocks of each pass."""

    roots: DataFrame
    passes: list[DataFrame]


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, n, block, items, runs, tip) of nodes (g, n, at, h, item): n nodes in a group, dense places from 0."""
    rows = nodes.groupBy("g", "n", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "h", "item"))).alias("own"))
    levels = F.lit(0)
    for k in range(LEVELS):  # a group of one node has no level left
        levels = levels + (F.col("n") > FAN**k).cast("int")
    done = let(F.transform("own", lambda x: x["h"]), lambda nodes_: _collapsed(nodes_, levels))
    return rows.select("g", "n", "block", F.transform("own", lambda x: x["item"]).alias("items"), done.alias("s")).select("g", "n", "block", "items", F.col("s.runs").alias("runs"), F.get("s.nodes", F.lit(0)).alias("tip"))


def grown(nodes: DataFrame) -> Forest:
    """The forest of nodes (g, n, at, h, item); the item stays with its leaf in the first pass."""
    passes = [stored(_blocks(nodes), "merkle-blocks")]
    while True:
        up = passes[-1].select("g", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("at"), F.col("tip").alias("h"), F.lit(None).cast("string").alias("item"))
        if (up.agg(F.max("n")).first()[0] or 1) == 1:
            return Forest(up.select("g", "h"), passes)
        passes.append(stored(_blocks(up), "merkle-blocks"))


def with_paths(forest: Forest, tops: DataFrame) -> DataFrame:
    """The leaf blocks, each with the columns of `tops` (g, above, ...) of its group and, as `above`, the path of its root up to the end of that of tops."""
    paths = tops.withColumn("at", F.lit(0).cast("long"))
    extra = [c for c in tops.columns if c not in ("g", "above")]
    for blocks in forest.passes[:0:-1]:
        near = blocks.join(paths, (blocks["g"] == paths["g"]) & (blocks["block"] == paths["at"])).drop(paths["g"], paths["at"])
        each = F.transform("items", lambda _, i: F.struct((F.col("block") * BLOCK + i).alias("at"), F.concat(_path(F.col("runs"), i), F.col("above")).alias("above")))
        paths = stored(near.select("g", *extra, F.explode(each).alias("x")).select("g", *extra, "x.at", "x.above"), "merkle-paths")
    first = forest.passes[0]
    return first.join(paths, (first["g"] == paths["g"]) & (first["block"] == paths["at"])).drop(paths["g"], paths["at"])


def manifest(docs: DataFrame) -> tuple[DataFrame, Forest, DataFrame]:
    """The leaf blocks with their paths to the root, the forest of sources, and (source, g, n, subroot, root).

    A block holds items (doc_id, leaf, tampered); tampered is the leaf of the
    row with a lower-cased text where it is looked for, else null.
    """
    spark = docs.sparkSession
    own = {c: docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")}
    leaf = lambda text: leaf_digest(own["doc_id"], own["source"], own["lang"], own["n_chars"], text)
    marked = F.crc32(own["doc_id"].cast("string").cast("binary")) % 5 == 0
    rows = docs.select(own["doc_id"].cast("long").alias("doc_id"), own["source"].cast("string").alias("source"), leaf(own["text"]).alias("h"), F.when(marked, leaf(F.translate(own["text"], _UPPER, _LOWER))).alias("tampered"))
    leaves = stored(rows, "merkle-leaves")
    placed = numbered(leaves, ["source", "doc_id", "h"], "row", 0)
    counts = placed.groupBy("source").agg(F.min("row").alias("start"), F.count("*").alias("n"))
    groups = stored(numbered(counts, ["source"], "g", 0), "merkle-sources")
    joined = placed.join(groups.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
    forest = grown(joined.select("g", "n", (F.col("row") - F.col("start")).alias("at"), "h", F.struct("doc_id", "tampered").alias("item")))
    n = groups.count()
    subroots = stored(forest.roots.select(F.lit(0).cast("long").alias("g"), F.lit(n).cast("long").alias("n"), F.col("g").alias("at"), "h", F.struct(F.col("g").alias("group"), F.col("h").alias("subroot")).alias("item")), "merkle-subroots")
    top = grown(subroots)
    whole = with_paths(top, top.roots.select("g", F.array().cast(_PATH).alias("above"), F.col("h").alias("root")))
    each = F.transform("items", lambda x, i: F.struct(x["group"].alias("g"), F.concat(_path(F.col("runs"), i), F.col("above")).alias("above"), x["subroot"].alias("subroot")))
    tops = stored(whole.select("root", F.explode(each).alias("x")).select("x.*", "root"), "merkle-tops")
    dropped(spark, leaves.scratch)
    return with_paths(forest, tops), forest, groups.join(tops.drop("above"), "g").select("source", "g", "n", "subroot", "root")


def merkle_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    Nulls in any column are digested as `-`; the null source is a group of its
    own and comes first. Rows of a source ascend by doc_id (null first), rows
    equal in it by their digest; equal rows have equal digests but places of
    their own. Other columns are ignored, whatever their names. An empty table
    gives no rows.
    """
    blocks, _, _ = manifest(docs)

    def shown(x: Column, i: Column) -> Column:
        # a group of one leaf has no runs: the leaf is the tip of its block
        leaf = F.coalesce(F.get(F.get(F.get("runs", F.lit(0)), F.shiftright(i, _BITS)), i.bitwiseAND(FAN - 1)), F.col("tip"))

        def of(s: Column) -> Column:
            return F.struct(x["doc_id"].alias("doc_id"), s["leaf"].alias("leaf"), proof_digest(s["path"]).alias("proof_sha256"), folded(F.coalesce(x["tampered"], s["leaf"]), s["path"]).alias("folded_root"))

        return let(F.struct(leaf.alias("leaf"), F.concat(_path(F.col("runs"), i), F.col("above")).alias("path")), of)

    rows = blocks.select("subroot", "root", F.explode(F.transform("items", shown)).alias("x"))
    return rows.select("x.doc_id", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))
