"""Edge pairs of a directed graph, and their coverage by a node trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.scratch import stored
from .numbering import numbered

#: Edges of a node into or out of it that go to one cell, and positions of a trace in one window.
SIDE, BLOCK = 1000, 100_000


def edge_pairs(edges: DataFrame, side: int = SIDE) -> DataFrame:
    """(pos1, pos2, edge1_id, edge2_id, n1, n2, n3) for edges (pos, edge_id, src, dst) of which one ends where the other starts.

    A self-loop pairs with itself; repeated edges give repeated pairs; an edge
    with a null end pairs with none. The pairs of a node are a grid of the
    edges into it by those out of it, which is cut into cells of about
    side * side pairs: an edge goes to all cells of its row or column, and
    cells, not nodes, are joined, so a hub is dealt to many tasks. Only nodes
    with over `side` edges into or out of them are cut.
    """
    first = edges.select(F.col("pos").alias("pos1"), F.col("edge_id").alias("edge1_id"), F.col("src").alias("n1"), F.col("dst").alias("n2"))
    second = edges.select(F.col("pos").alias("pos2"), F.col("edge_id").alias("edge2_id"), F.col("src").alias("n2"), F.col("dst").alias("n3"))
    into, out = (e.filter("n2 IS NOT NULL").groupBy("n2").agg(F.count("*").alias(c)) for e, c in ((first, "into"), (second, "out")))
    # a node has as many edges as make it large, so there are at most 2 * edges / side of them
    grid = into.join(out, "n2").filter((F.col("into") > side) | (F.col("out") > side))
    grid = stored(grid.select("n2", F.ceil(F.col("into") / side).cast("int").alias("rows"), F.ceil(F.col("out") / side).cast("int").alias("columns")), "grid")

    def dealt(e: DataFrame, own: str, other: str, pos: str) -> DataFrame:
        """Edges with a number on their own side, once for each number on the other."""
        one = F.coalesce(F.pmod(F.xxhash64(pos), F.col(own)), F.lit(0)).cast("int").alias(own[0])
        return e.join(grid, "n2", "left").select(*e.columns, one, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other[0]))

    return dealt(first, "rows", "columns", "pos1").join(dealt(second, "columns", "rows", "pos2"), ["n2", "r", "c"]).select("pos1", "pos2", "edge1_id", "edge2_id", "n1", "n2", "n3")


def numbered_pairs(edges: DataFrame) -> DataFrame:
    """Edge pairs with pair_no from 1, in the order of the first and then of the second edge."""
    return numbered(edge_pairs(edges), ["pos1", "pos2"], "pair_no").select("pair_no", "edge1_id", "edge2_id", "n1", "n2", "n3")


def rendered_pairs(edges: DataFrame) -> DataFrame:
    """(pair_no, line) in the printed form of edge pairs."""
    line = F.format_string("Paired Edge %d: Node %s → Node %s , Node %s → Node %s", "pair_no", "n1", "n2", "n2", "n3")
    return numbered_pairs(edges).select("pair_no", line.alias("line"))


def trace_windows(trace: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Different (n1, ..., nk) at consecutive positions of a trace (pos, node) with dense positions, for k of 1 or more.

    Positions are cut into blocks, and a block also gets the first k - 1 rows
    of the next: one shuffle for any k, and no window holds more than a block.
    """
    if k < 1:
        raise ValueError("a window has one node or more")
    own = F.floor(F.col("pos") / block)
    # a row near the begin of a block belongs to the one before, too; beyond a block that goes on
    reach = F.floor((F.col("pos") - (k - 1)) / block)
    rows = trace.filter("pos IS NOT NULL").select("pos", "node", F.explode(F.sequence(reach, own)).alias("block"))
    order = W.partitionBy("block").orderBy("pos")
    ahead = [F.lead("pos", k - 1).over(order).alias("last"), *[F.lead("node", j).over(order).alias(f"n{j + 1}") for j in range(k)]]
    found = rows.select("pos", "block", *ahead).filter((F.floor(F.col("pos") / block) == F.col("block")) & (F.col("last") == F.col("pos") + k - 1))
    return found.select(*[f"n{j + 1}" for j in range(k)]).distinct()


def trace_triples(trace: DataFrame) -> DataFrame:
    """Different (n1, n2, n3) at consecutive positions of a trace (pos, node) with dense positions."""
    return trace_windows(trace, 3).filter("n1 IS NOT NULL AND n2 IS NOT NULL AND n3 IS NOT NULL")


def covered_pairs(pairs: DataFrame, trace: DataFrame) -> DataFrame:
    """Pairs whose nodes occur in the trace, one right after the other."""
    return pairs.join(trace_triples(trace), ["n1", "n2", "n3"], "left_semi")


def uncovered_pairs(pairs: DataFrame, trace: DataFrame) -> DataFrame:
    return pairs.join(trace_triples(trace), ["n1", "n2", "n3"], "left_anti")


def coverage(pairs: DataFrame, trace: DataFrame) -> DataFrame:
    """One row: pairs, covered, all_covered. No pairs count as all covered."""
    marked = pairs.join(trace_triples(trace).withColumn("hit", F.lit(True)), ["n1", "n2", "n3"], "left")
    return marked.agg(F.count("*").alias("pairs"), F.count("hit").alias("covered"), F.coalesce(F.bool_and(F.col("hit").isNotNull()), F.lit(True)).alias("all_covered"))
