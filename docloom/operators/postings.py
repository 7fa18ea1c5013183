"""Packed postings: chunks in segments, a row for each segment and bucket of terms.

Columns: segment, bucket, and lists.  The row of bucket ``CHUNKS`` has the segment's chunks (chunk_id, doc_id, dl); other
rows have the bucket's terms (term), the number of chunks of each (n) and, term by term, the chunks' places in the
segment (at) and the term's counts there (tf).  A row of bucket ``GONE`` has the places of chunks that count no more.
"""

from __future__ import annotations

import ctypes
import functools
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Packed rows that are filtered at once.
LOT = 256
#: Buckets of terms, chunks of a segment at most, and the buckets of rows that hold no terms.
BUCKETS, SEGMENT, CHUNKS, GONE = 64, 1024, -1, -2


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def returning(run):
    """``run`` of a task, at whose end the Python worker, which outlives it, gives freed memory back."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return whole


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins; keys are sorted and not negative."""
    return np.flatnonzero(np.diff(keys, prepend=-1))


def packed(split: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """Packed rows of chunks (chunk_id, doc_id, t: terms); ``name`` begins the names of their segments.

    A segment is made of chunks that stand together, so nothing is shuffled.
    """
    size = size or SEGMENT
    kinds = {c: split.schema[c].dataType for c in ("chunk_id", "doc_id")} | {"dl": T.LongType(), "term": T.StringType(), "n": T.IntegerType(), "at": T.ShortType(), "tf": T.IntegerType()}
    schema = T.StructType([T.StructField("segment", T.StringType()), T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.ArrayType(kind)) for c, kind in kinds.items())])

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in (b.slice(k, 4 * size) for b in batches for k in range(0, b.num_rows, 4 * size)):
            dl = np.asarray(pc.list_value_length(batch.column("t")).fill_null(0)).astype(np.int64)
            coded = batch.column("t").flatten().dictionary_encode()
            # words stand by bucket, so sorted postings of a segment do, too
            of = np.array([crc32(w) % BUCKETS for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int64)
            order = np.argsort(of, kind="stable")
            words, of, width = coded.dictionary.take(pa.array(order)), of[order], max(1, len(order))
            chunk, word = np.repeat(np.arange(batch.num_rows), dl), np.argsort(order)[np.asarray(coded.indices)]
            key, tf = np.unique((chunk // size * width + word) * size + chunk % size, return_counts=True)
            piece, at = np.divmod(key, size)
            term = _starts(piece)
            segment, word = np.divmod(piece[term], width)
            row = _starts(segment * BUCKETS + of[word])
            names = pa.array([f"{name}-{task}-{made + k}" for k in range(-(-batch.num_rows // size))])
            made += len(names)
            lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
            ends = [*range(0, batch.num_rows, size), batch.num_rows]
            held = {"segment": names, "bucket": pa.array([CHUNKS] * len(names), pa.int32()), "chunk_id": lists(ends, batch.column("chunk_id")), "doc_id": lists(ends, batch.column("doc_id")), "dl": lists(ends, pa.array(dl))}
            ends, posts = [*row, len(term)], [*term[row], len(key)]
            terms = {"segment": names.take(pa.array(segment[row])), "bucket": pa.array(of[word[row]], pa.int32()), "term": lists(ends, words.take(pa.array(word))), "n": lists(ends, pa.array(np.diff(term, append=len(key)), pa.int32())), "at": lists(posts, pa.array(at, pa.int16())), "tf": lists(posts, pa.array(tf, pa.int32()))}
            kind = {c: x.type for c, x in (held | terms).items()}
            for some in (held, terms):
                yield pa.RecordBatch.from_arrays([some[c] if c in some else pa.nulls(len(some["segment"]), kind[c]) for c in schema.names], names=schema.names)

    return split.select("chunk_id", "doc_id", "t").mapInArrow(returning(run), schema)


def segments(rows: pa.StructArray):
    """Of each segment in packed rows: ids and lengths of its chunks, its terms, and as arrays the number of the term, the chunk's place and the count of each posting that is not gone."""
    name, bucket_ = np.asarray(rows.field("segment").dictionary_encode().indices), np.asarray(rows.field("bucket"))
    order = np.lexsort((bucket_, name))
    part = lambda column, some: rows.field(column).take(pa.array(some)).flatten()
    for some in np.split(order, _starts(name[order])[1:]):
        held, gone, rest = (some[x] for x in (bucket_[some] == CHUNKS, bucket_[some] == GONE, bucket_[some] >= 0))
        ids, terms, at, tf = part("chunk_id", held), part("term", rest), np.asarray(part("at", rest)), np.asarray(part("tf", rest))
        live = np.ones(len(ids), dtype=bool)
        live[np.asarray(part("at", gone))] = False
        code, kept = np.repeat(np.arange(len(terms)), np.asarray(part("n", rest))), live[at]
        yield ids, np.asarray(part("dl", held)), terms, code[kept], at[kept], tf[kept]


def asked_only(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Packed rows without terms that are not in ``terms`` (term, distinct), so nothing else is shuffled; buckets' terms go to all tasks."""
    lists = terms.groupBy(bucket(F.col("term")).alias("bucket")).agg(F.collect_list("term").alias("asked"))
    names = rows.columns

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, LOT):
                some = batch.slice(start, LOT)
                column = dict(zip(names, some.columns))
                owner = lambda c: np.repeat(np.arange(some.num_rows), np.asarray(pc.list_value_length(some.column(c)).fill_null(0)))
                terms_, n, row = column["term"].flatten(), np.asarray(column["n"].flatten()), owner("term")
                # a term is in one bucket, so it may be looked for among those of all rows
                held = np.asarray(pc.is_in(terms_, some.column("asked").flatten().unique()))
                post = np.repeat(held, n)
                has = column["term"].is_valid()

                def cut(c, keep, of):
                    ends = np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=some.num_rows))])
                    return pc.if_else(has, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column[c].flatten().filter(pa.array(keep))), pa.scalar(None, column[c].type))

                column |= {"term": cut("term", held, row), "n": cut("n", held, row), "at": cut("at", post, owner("at")), "tf": cut("tf", post, owner("tf"))}
                yield pa.RecordBatch.from_arrays(list(column.values()), names=names)

    return rows.join(F.broadcast(lists), "bucket", "left").select(*names, "asked").mapInArrow(returning(run), rows.schema)


def listed(rows: DataFrame, key: Column) -> DataFrame:
    """Packed rows as one list, ``rows``, for each key: __b."""
    return rows.groupBy(key.alias("__b")).agg(F.collect_list(F.struct("segment", "bucket", "chunk_id", "dl", "term", "n", "at", "tf")).alias("rows"))


def _each(lists: DataFrame, make, schema: T.StructType) -> DataFrame:
    names = schema.names

    def run(batches):
        for batch in batches:
            for rows in batch.column("rows"):
                for segment in segments(rows.values):
                    yield pa.RecordBatch.from_arrays(make(*segment), names=names)

    return lists.select("rows").mapInArrow(returning(run), schema)


def flat(lists: DataFrame) -> DataFrame:
    """term, chunk_id, tf, dl of all postings in ``listed`` rows that are not gone."""
    kind = lists.schema["rows"].dataType.elementType["chunk_id"].dataType.elementType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("chunk_id", kind), T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())])
    return _each(lists, lambda ids, dl, terms, code, at, tf: [terms.take(pa.array(code)), ids.take(pa.array(at)), pa.array(tf.astype(np.int64)), pa.array(dl[at])], schema)


def document_counts(lists: DataFrame) -> DataFrame:
    """term, df over ``listed`` rows without what is gone."""

    def make(ids, dl, terms, code, at, tf):
        n = np.bincount(code, minlength=len(terms))
        some = np.flatnonzero(n)
        return [terms.take(pa.array(some)), pa.array(n[some].astype(np.int64))]

    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    return _each(lists, make, schema).groupBy("term").agg(F.sum("n").alias("df"))
