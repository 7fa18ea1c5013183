"""Windows of words, parents and children, chunks for search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as X
from ..params import Params


def windows(words: Column, size: int, overlap: int) -> Column:
    """Arrays of ``size`` words, each ``overlap`` words into the one before; the last ends with the words."""
    step = size - overlap
    n = F.size(words)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step).cast("int"))
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(words, k * step + 1, size))


def word_windows(rows: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), p: Params = Params()) -> DataFrame:
    """keep, window (from 1), chunk, n_words; the words of a text are split once."""
    split = rows.select(*keep, X.words(text).alias("__words"))
    count = F.size("__words")
    step = p.child_words - p.child_overlap
    n = F.when(count == 0, 0).when(count <= p.child_words, 1).otherwise(1 + F.ceil((count - p.child_words) / step).cast("int"))
    out = split.where(count > 0).withColumn("__k", F.explode(F.sequence(F.lit(0), n - 1)))
    part = F.slice("__words", F.col("__k") * step + 1, F.lit(p.child_words))
    return out.select(*keep, (F.col("__k") + 1).alias("window"), F.array_join(part, " ").alias("chunk"), F.size(part).alias("n_words"))


def parents(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, parent (from 1), text, page_start, page_end: pages' words in pieces of a parent's size; a full parent keeps that many words.

    What a page adds beyond is dropped if ``lossy_parents``, else it opens the next parent.  One document's pages
    are folded in a task; documents are spread.
    """
    size = p.parent_words
    w = X.words("text")
    rows = pages.select("doc_id", "page", w.alias("w")).where(F.size("w") > 0)
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "w"))).alias("pages"))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x["w"]) - 1) / size).cast("int")), lambda k: F.struct(x["page"].alias("page"), F.slice(x["w"], k * size + 1, size).alias("w")))
    pieces = F.flatten(F.transform("pages", cut))
    none = F.array().cast("array<string>")
    made = "array<struct<w:array<string>,a:int,b:int>>"
    start = F.struct(none.alias("w"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.array().cast(made).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        every = F.concat(acc["w"], x["w"])
        a, b = F.least(acc["a"], x["page"]), F.greatest(acc["b"], x["page"])
        over = F.slice(every, size + 1, size) if not p.lossy_parents else none
        rest = F.size(over) > 0
        full = F.struct(
            over.alias("w"),
            F.when(rest, x["page"]).alias("a"),
            F.when(rest, x["page"]).alias("b"),
            F.array_append(acc["out"], F.struct(F.slice(every, 1, size).alias("w"), a.alias("a"), b.alias("b"))).alias("out"),
        )
        return F.when(F.size(every) >= size, full).otherwise(F.struct(every.alias("w"), a.alias("a"), b.alias("b"), acc["out"].alias("out")))

    last = lambda acc: F.when(F.size(acc["w"]) > 0, F.array_append(acc["out"], F.struct(acc["w"].alias("w"), acc["a"].alias("a"), acc["b"].alias("b")))).otherwise(acc["out"])
    folded = docs.select("doc_id", F.posexplode(F.aggregate(pieces, start, step, last)).alias("k", "x"))
    return folded.select("doc_id", (F.col("k") + 1).alias("parent"), F.array_join("x.w", " ").alias("text"), F.col("x.a").alias("page_start"), F.col("x.b").alias("page_end"))


def children(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, parent_id, child (from 1), chunk_text, page_start, page_end, len_words, text_hash."""
    rows = word_windows(parents(pages, p), keep=("doc_id", "parent", "page_start", "page_end"), p=p)
    return rows.select(
        "doc_id", F.concat(F.lit("P"), F.col("parent").cast("string")).alias("parent_id"), "parent", F.col("window").alias("child"), F.col("chunk").alias("chunk_text"), "page_start", "page_end", F.col("n_words").alias("len_words"), X.text_hash("chunk").alias("text_hash")
    )


def first_of_each_hash(chunks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Chunks whose text has not come before (by document, parent, child) and that are not stored for their document.

    A stored chunk does not stand in the way of an equal one of another document.
    """
    if existing is not None:
        chunks = chunks.join(existing.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_anti")
    order = F.struct("doc_id", "parent", "child")
    # the least place of each hash is summed before rows move; only then are rows joined
    first = chunks.groupBy("text_hash").agg(F.min(order).alias("__first"))
    return chunks.join(first, "text_hash").where(order == F.col("__first")).drop("__first")


def points(chunks: DataFrame) -> DataFrame:
    """Rows of a vector table, but for the vector."""
    return chunks.select(
        ids.point_id(F.col("doc_id"), F.col("text_hash")).alias("point_id"),
        ids.dense_chunk_id(F.col("doc_id"), F.col("parent_id"), F.col("text_hash")).alias("chunk_id"),
        "doc_id",
        "parent_id",
        "page_start",
        "page_end",
        "len_words",
        "text_hash",
        F.substring("chunk_text", 1, 800).alias("chunk_text"),
    )


def search_chunks(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """chunk_id, doc_id, page, child_idx, text: windows of pages without citation lines, numbered before noise goes."""
    clean = pages.select("doc_id", "page", X.drop_loose_citations("text").alias("text"))
    rows = word_windows(clean, keep=("doc_id", "page"), p=p).where(~X.is_noise("chunk", p=p))
    return rows.select(ids.bm25_chunk_id(F.col("doc_id"), F.col("page"), F.col("window")).alias("chunk_id"), "doc_id", "page", F.col("window").alias("child_idx"), F.col("chunk").alias("text"))


__all__ = ["Window", "children", "first_of_each_hash", "parents", "points", "search_chunks", "windows", "word_windows"]
