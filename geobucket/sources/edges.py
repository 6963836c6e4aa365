"""Readers of edge lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import stored

EDGE = r"Edge \d+: Node (\d+) → Node (\d+)"


def edge_tokens(line: Column) -> list[Column]:
    """edge_id, src and dst of a line of three tokens, each after one leading character. A malformed token is an error."""
    token = F.split(line, " ")
    return [F.substring(F.get(token, F.lit(k)), 2, 2**31 - 1).cast("int").alias(n) for k, n in enumerate(("edge_id", "src", "dst"))]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, pos) of the lines of files, in the order of the files' paths and of the lines: pos is 1, 2, ... whatever the splits.

    Lines come in the order of their block of bytes; the blocks' numbers of
    lines, one row a block at the driver, say where each begins.
    """
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    lines = stored(spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("place")), "lines")
    starts, total = [], 1
    for r in sorted(lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect(), key=lambda r: (r.path, r.block)):
        starts.append((r.path, r.block, total - r.first))
        total += r.n
    shift = F.broadcast(spark.createDataFrame(starts, "path string, block long, shift long"))
    return lines.join(shift, ["path", "block"]).select("value", F.col("path").alias("file"), (F.col("place") + F.col("shift")).alias("pos"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(pos, edge_id, src, dst) of a file or a folder of lines; pos is the line's place, from 1, blank lines counted."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    return lines.select("pos", *edge_tokens(F.col("value")))


def parsed_edges(text: Column) -> Column:
    """Edges of printed text: array of (src, dst); what doesn't match is ignored."""
    pair = lambda s, d: F.struct(s.cast("int").alias("src"), d.cast("int").alias("dst"))
    return F.zip_with(F.regexp_extract_all(text, F.lit(EDGE), 1), F.regexp_extract_all(text, F.lit(EDGE), 2), pair)
