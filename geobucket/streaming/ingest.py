"""Continuous loads, an extension: each micro-batch of features is merged into the table's buckets."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import merged, refined
from ..plans.tables import TableSpec
from ..sources.formats import FEATURE


def stream_features(spark: SparkSession, folder: str) -> DataFrame:
    """New files of feature lines as (geometry, properties)."""
    return spark.readStream.text(folder).select(F.from_json("value", FEATURE).alias("f")).select("f.geometry", "f.properties")


def load_id(checkpoint: str, batch: int) -> str:
    """The id of the load that a micro-batch is."""
    return f"{hashlib.md5(checkpoint.encode()).hexdigest()}-{batch}"


def ingest(features: DataFrame, silver: TableSpec, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into the silver table, as an incremental load does.

    The id of a load is made of the checkpoint's folder and the batch's
    number, so a batch that is tried again adds its rows once.
    """

    def write(batch: DataFrame, number: int) -> None:
        merged(refined(batch), silver, load_id(checkpoint, number))

    return features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
