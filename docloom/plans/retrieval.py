"""Whole plans: reindexing, hybrid retrieval, prompts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunks, context, delta, pages, search
from ..params import Params
from ..sources import files
from ..sources import index as store


@dataclass(frozen=True)
class Index:
    keyword: search.KeywordIndex
    chunks: DataFrame
    points: DataFrame | None = None


def ingest(docs: DataFrame, p: Params = Params(), *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pages of raw texts without their bibliographies."""
    return pages.without_references(pages.to_pages(docs, pages.packed(text, p), id=id), p)


def build(page_rows: DataFrame, p: Params = Params(), *, points: DataFrame | None = None) -> Index:
    rows = chunks.search_chunks(page_rows, p)
    return Index(search.keyword_index(rows, p), rows, points)


def reindex(docs: DataFrame, state: DataFrame, stored: DataFrame, p: Params = Params(), *, full: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks of all documents, new state, counts by status): new and changed documents are worked through, the others' chunks stay."""
    now = docs.withColumn("sha1", F.sha1(F.col("text").cast("binary")))
    work = delta.pending(now, state, "doc_id", force=full)
    made = chunks.search_chunks(ingest(work, p), p)
    # all chunks of a document that was worked through give way, even if nothing of it is left
    kept = stored.join(work.select("doc_id").distinct(), "doc_id", "left_anti")
    counts = delta.changes(now, state, "doc_id").groupBy("status").agg(F.count(F.lit(1)).alias("docs"))
    return kept.unionByName(made), delta.upsert(state.select("doc_id", "sha1"), now.select("doc_id", "sha1"), "doc_id"), counts


def reindex_stored(docs: DataFrame, folder: str, p: Params = Params(), *, full: bool = False, job: str = "reindex") -> DataFrame:
    """``reindex`` on a stored index and state in ``folder``; counts by status.  States of the job are logged; a failed one is logged and fails."""
    spark = docs.sparkSession
    log = lambda state, detail="": files.log_job(spark, f"{folder}/jobs", job, state, detail)
    log(files.RUNNING)
    try:
        now = docs.withColumn("sha1", F.sha1(F.col("text").cast("binary")))
        state = files.read_state(spark, f"{folder}/state")
        work = delta.pending(now, state, "doc_id", force=full)
        counts = spark.createDataFrame(delta.changes(now, state, "doc_id").groupBy("status").agg(F.count(F.lit(1)).alias("docs")).collect(), "status string, docs long")
        store.upsert_index(chunks.search_chunks(ingest(work, p), p), f"{folder}/keyword", gone=work)
        new = delta.upsert(state.select("doc_id", "sha1"), now.select("doc_id", "sha1"), "doc_id")
        # the state is read while it is made, so it is written beside the old one first
        files.write_state(new, f"{folder}/state.new")
        files.write_state(files.read_state(spark, f"{folder}/state.new"), f"{folder}/state")
    except Exception as error:
        log(files.FAILED, str(error)[:200])
        raise
    log(files.DONE)
    return counts


def _with_page_text(rows: DataFrame, page_rows: DataFrame, p: Params) -> DataFrame:
    """``rows`` without text get that of their pages; their spans are looked up once each."""
    span = F.struct("doc_id", "page_start", "page_end")
    blank = X.strip("text") == ""
    asked = rows.where(blank).select(span.alias("span_id"), "doc_id", "page_start", "page_end").distinct()
    found = pages.page_range_text(asked, page_rows, p.snippet_chars).withColumnRenamed("text", "__t")
    return rows.withColumn("span_id", span).join(found, "span_id", "left").withColumn("text", F.when(blank, F.coalesce("__t", F.lit(""))).otherwise(F.col("text"))).drop("span_id", "__t")


def hybrid(index: Index, queries: DataFrame, p: Params = Params(), *, page_rows: DataFrame | None = None) -> DataFrame:
    """query_id, place, doc_id, page_start, page_end, text, chunk_id, fused.

    queries: query_id, text, and vector if the index has points (chunk_id, doc_id, page_start, page_end, chunk_text, vector).
    Candidates without text take that of their pages in ``page_rows`` (doc_id, page, text), if it is given.
    """
    depth = max(8 * p.k, p.depth)
    words = search.keyword_top(index.keyword, queries, depth, p)
    by_word = words.join(index.chunks, "chunk_id").select("query_id", "chunk_id", "doc_id", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "text")
    runs, tables = [words], [by_word]
    if index.points is not None:
        dense = search.dense_top(index.points, queries, depth)
        by_vector = dense.join(index.points, "chunk_id").select("query_id", "chunk_id", "doc_id", "page_start", "page_end", F.col("chunk_text").alias("text"))
        runs, tables = [dense, words], [by_vector, by_word]
    pool = search.candidates(*tables)
    rows = search.fuse(runs, p, depth=p.rrf_depth).join(pool, ["query_id", "chunk_id"])
    if page_rows is not None:
        rows = _with_page_text(rows, page_rows, p)
    items = search.capped(rows.withColumn("text", F.substring("text", 1, p.snippet_chars)), p.per_doc, p.k)
    if p.rerank and index.points is not None:
        vectors = index.points.select("chunk_id", F.col("vector").alias("__v"))
        asked = queries.select("query_id", F.col("vector").alias("__q"))
        items = search.reranked(items.join(vectors, "chunk_id", "left").join(asked, "query_id"), F.coalesce(V.cosine(F.col("__v"), F.col("__q")), F.lit(0.0)), p.rerank_top).drop("place", "__v", "__q").withColumnRenamed("place_after", "place")
    return items.select("query_id", "place", "doc_id", "page_start", "page_end", "text", "chunk_id", "fused")


def chat(turns: DataFrame, index: Index, p: Params = Params(), *, seed: str = "клинические рекомендации", embed=None) -> DataFrame:
    """conv_id, system, user: prompts of conversations (conv_id, turn, role, text) with what retrieval finds for them."""
    cases = context.case_from_history(turns).withColumn("x", X.case_and_plan("raw_case"))
    cases = cases.select(F.col("conv_id").cast("string").alias("query_id"), "conv_id", X.compact_text("x.case_text", 2000).alias("case_text"), F.col("x.plan").alias("plan"))
    queries = cases.select("query_id", context.resolved_query(X.compact_text("case_text", 800), F.col("case_text"), seed).alias("text"))
    found = context.contexts(hybrid(index, embed(queries) if embed else queries, p), p)
    rows = cases.join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(""))).withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))
    return context.prompts(rows).select("conv_id", "case_text", "plan", "context", "citations", "system", "user")
