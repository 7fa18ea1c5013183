"""Identifiers: content hashes, name-based UUIDs, chunk ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS name space of RFC 4122.
DNS = "6ba7b8109dad11d180b400c04fd430c8"
CHUNK_ID = r"^(.+)_p(\d+)_c\d+$"
LAZY_CHUNK_ID = r"^(.+?)_p(\d+)_c(\d+)$"


def uuid5(name: Column, namespace: str = DNS) -> Column:
    """Name-based UUID of version 5."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(doc_id: Column, text_hash: Column) -> Column:
    return uuid5(F.concat_ws("_", doc_id, text_hash))


def dense_chunk_id(doc_id: Column, parent_id: Column, text_hash: Column) -> Column:
    return F.concat_ws(":", doc_id, parent_id, text_hash)


def bm25_chunk_id(doc_id: Column, page: Column, ordinal: Column) -> Column:
    return F.concat(doc_id, F.lit("_p"), page.cast("string"), F.lit("_c"), ordinal.cast("string"))


def parse_chunk_id(chunk_id: Column, lazy: bool = False) -> Column:
    """struct(doc_id, page); nulls if the id has another form."""
    pattern = LAZY_CHUNK_ID if lazy else CHUNK_ID
    part = lambda k: F.nullif(F.regexp_extract(chunk_id, pattern, k), F.lit(""))
    return F.struct(part(1).alias("doc_id"), part(2).cast("int").alias("page"))


def first_filled(*columns: Column, default: str = "unknown") -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(default))


def coerced(value: Column, kind: str, default) -> Column:
    """A value cast to int, double or boolean, the default where it cannot be."""
    if kind == "boolean":
        t = F.lower(F.trim(value.cast("string")))
        return F.when(t.isNull() | (t == ""), F.lit(default)).otherwise(t.isin("1", "true", "yes", "on", "y"))
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast(kind), F.lit(default))
