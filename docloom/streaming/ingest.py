"""Incremental ingest as a stream of files: the checkpoint is the record of what has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks, pages
from ..params import Params


def ingest_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, p: Params = Params(), *, schema: str = "doc_id STRING, text STRING") -> StreamingQuery:
    """Documents of new JSON files as search chunks in a table of batches, until no file is left.

    A batch writes to a folder of its own number, so a batch that is run again replaces itself.
    """
    docs = spark.readStream.schema(schema).json(folder)

    def write(batch: DataFrame, number: int) -> None:
        made = pages.without_references(pages.to_pages(batch, pages.packed("text", p)), p)
        chunks.search_chunks(made, p).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The chunks of each document's last batch."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("doc_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["doc_id", "version"]).drop("batch", "version")


def fresh_name(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}"
