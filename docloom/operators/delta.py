"""Incremental work: what is new or changed, upserts, manifests, identifiers of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(now: DataFrame, known: DataFrame, key: str, version: str = "sha1") -> DataFrame:
    """Rows of ``now`` with status new, changed or unchanged against ``known`` (key, version)."""
    old = known.select(F.col(key), F.col(version).alias("__old"), F.lit(True).alias("__known"))
    status = F.when(F.col("__known").isNull(), "new").when(F.col(version).eqNullSafe(F.col("__old")), "unchanged").otherwise("changed")
    return now.join(old, key, "left").withColumn("status", status).drop("__old", "__known")


def pending(now: DataFrame, known: DataFrame, key: str, version: str = "sha1", *, force: bool = False, skip_changed: bool = False) -> DataFrame:
    """Rows that are to be processed."""
    if force:
        return now
    return changes(now, known, key, version).where(F.col("status").isin(["new"] if skip_changed else ["new", "changed"])).drop("status")


def versions(docs: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """The manifest's version of each document, else its own."""
    known = manifest.select(key, F.col("sha1").alias("__listed"))
    return docs.join(known, key, "left").withColumn("sha1", F.coalesce(F.nullif("__listed", F.lit("")), "sha1")).drop("__listed")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` without the rows whose keys ``new`` has, and ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the documents in ``new`` give way to its rows, so nothing stale stays of a document that became shorter."""
    return upsert(old, new, "doc_id")


def file_ids(files: DataFrame) -> DataFrame:
    """doc_id of each path: the stem; of equal stems, the second in the order of paths gets _2, and so on."""
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]*$", "")
    k = F.row_number().over(Window.partitionBy("stem").orderBy("source_path"))
    return files.withColumn("stem", stem).withColumn("k", k).withColumn("doc_id", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("k").cast("string")))).drop("stem", "k")


def stale(latest: DataFrame, stamp: float | None) -> DataFrame:
    """One row: whether anything is later than the stamp (column ``at``, seconds)."""
    return latest.agg(F.max("at").alias("latest")).select("latest", (F.lit(stamp is None) | (F.col("latest") > F.lit(stamp or 0.0))).alias("needs_rebuild"))
