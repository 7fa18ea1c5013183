"""A stored keyword index: packed postings by bucket of the term, put in and taken out document by document.

A folder holds ``parts`` (packed rows of ``operators.postings``; files stand by bucket, so a search reads the buckets of
its terms only), ``gone`` (places of chunks in parts that were replaced or taken out), each in versions, and ``current``,
which names the version that readers see and its parts.  A change writes the new documents' part and what is gone, and
leaves the old parts as they are; it names them when all is written, so a lost writer leaves the index as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import postings, search
from .files import exists, read_text, write_text

_GONE = "segment string, at short, dl long"


def _current(spark: SparkSession, folder: str) -> dict:
    path = f"{folder}/current"
    now = json.loads(read_text(spark, path)) if exists(spark, path) else {"version": 0, "parts": []}
    if "parts" not in now:
        raise ValueError(f"{folder} holds an index of an older form: write it anew into an empty folder")
    return now


def version(spark: SparkSession, folder: str) -> int:
    """The version that readers see, 0 for none."""
    return int(_current(spark, folder)["version"])


def _parts(spark: SparkSession, folder: str, parts: list[int]) -> DataFrame:
    return spark.read.parquet(*[f"{folder}/parts/v{k}" for k in parts])


def _gone(spark: SparkSession, folder: str, now: dict) -> DataFrame:
    """segment, at, dl of chunks that count no more."""
    return spark.read.schema(_GONE).parquet(f"{folder}/gone/v{now['version']}") if len(now["parts"]) > 1 else spark.createDataFrame([], _GONE)


def _write_part(chunks: DataFrame, folder: str, k: int) -> None:
    split = chunks.select("chunk_id", "doc_id", X.terms("text").alias("t"))
    postings.packed(split, str(k)).sortWithinPartitions("bucket", "segment").write.mode("overwrite").parquet(f"{folder}/parts/v{k}")


def _name(spark: SparkSession, folder: str, k: int, parts: list[int]) -> None:
    write_text(spark, f"{folder}/current", json.dumps({"version": k, "parts": parts}))


def write_index(chunks: DataFrame, folder: str) -> None:
    """The index of ``chunks`` (chunk_id, doc_id, text), in place of what is there."""
    spark = chunks.sparkSession
    k = version(spark, folder) + 1
    _write_part(chunks, folder, k)
    _name(spark, folder, k, [k])


def upsert_index(chunks: DataFrame, folder: str, gone: DataFrame | None = None) -> None:
    """Documents of ``chunks``, and those of ``gone`` (doc_id), lose all that is stored of them; then ``chunks`` are put in."""
    spark = chunks.sparkSession
    now = _current(spark, folder)
    k = now["version"] + 1
    if k == 1:
        return write_index(chunks, folder)
    _write_part(chunks, folder, k)
    held = lambda parts: _parts(spark, folder, parts).where(F.col("bucket") == postings.CHUNKS)
    out = held([k]).select(F.explode("doc_id").alias("doc_id"))
    out = out if gone is None else out.unionByName(gone.select("doc_id"))
    old = held(now["parts"]).select("segment", F.posexplode(F.arrays_zip("doc_id", "dl")).alias("at", "x")).select("segment", F.col("at").cast("short").alias("at"), "x.dl", "x.doc_id")
    lost = old.join(out.distinct(), "doc_id", "left_semi").select("segment", "at", "dl")
    lost.unionByName(_gone(spark, folder, now)).distinct().write.mode("overwrite").parquet(f"{folder}/gone/v{k}")
    _name(spark, folder, k, [*now["parts"], k])


def read_index(spark: SparkSession, folder: str, queries: DataFrame | None = None, *, text: str = "text") -> search.KeywordIndex:
    """The stored index; with ``queries``, that of their terms, whose buckets only are read (at most BUCKETS numbers come to the driver)."""
    now = _current(spark, folder)
    parts, gone = _parts(spark, folder, now["parts"]), _gone(spark, folder, now)
    held = parts.where(F.col("bucket") == postings.CHUNKS).select(F.size("dl").cast("long").alias("n"), F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x).alias("dl"))
    sums = held.unionByName(gone.select(F.lit(-1).cast("long").alias("n"), (-F.col("dl")).alias("dl")))
    totals = sums.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.try_divide(F.sum("dl"), F.sum("n")).alias("avgdl"))
    if queries is not None:
        asked = queries.select(F.explode(X.terms(text)).alias("term")).distinct()
        some = [r[0] for r in asked.select(postings.bucket(F.col("term"))).distinct().collect()]
        parts = postings.asked_only(parts.where(F.col("bucket").isin(postings.CHUNKS, *some)).drop("doc_id"), asked)
    else:
        parts = parts.drop("doc_id")
    lost = gone.groupBy("segment").agg(F.collect_list("at").alias("at")).withColumn("bucket", F.lit(postings.GONE))
    rows = parts.unionByName(lost, allowMissingColumns=True)
    flat = postings.flat(postings.listed(rows, F.col("segment")))
    return search.KeywordIndex(flat, totals, flat.groupBy("term").agg(F.count(F.lit(1)).alias("df")), rows)
