"""Pages: packing of texts, removal of bibliographies, page statistics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..params import Params


#: White space and the end of a sentence or paragraph, as the patterns of functions.text have it.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_END = re.compile(rf"(\n\n|[.!?]{_SPACE}+)")
_EDGE = re.compile(rf"^{_SPACE}+|{_SPACE}+$")


def packed(text: Column | str, p: Params = Params()) -> Column:
    """Texts of pages: sentences and paragraphs are added to a page until the next would exceed its size.

    A greedy fold, which built-in functions could only do by copying the pages so far at each sentence.
    """
    limit = p.page_chars

    def fold(text: str) -> list[str]:
        pages, page, size = [], [], 0
        for part in _END.split(text):
            if page and size + len(part) > limit:
                pages.append(_EDGE.sub("", "".join(page)))
                page, size = [], 0
            page.append(part)
            size += len(part)
        return [*pages, _EDGE.sub("", "".join(page))]

    @F.pandas_udf("array<string>")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    return folded(X.clean_text(text, p.homoglyphs))


def line_packed(text: Column | str, p: Params = Params()) -> Column:
    """Texts of pages of whole lines, each closed once it has reached its size."""
    limit = p.line_page_chars

    def fold(text: str) -> list[str]:
        pages, page, size = [], [], 0
        for line in text.split("\n"):
            page.append(line)
            size += len(line) + 1
            if size >= limit:
                pages.append("\n".join(page))
                page, size = [], 0
        return [*pages, "\n".join(page)] if page else pages

    @F.pandas_udf("array<string>")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    return folded(X._c(text))


def to_pages(docs: DataFrame, pages: Column, *, id: str = "doc_id") -> DataFrame:
    """doc_id, page (from 1), text."""
    return docs.select(F.col(id).alias("doc_id"), F.posexplode(pages).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


def flagged(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Pages with ordinal i (from 0), number n, is_refs and the characters before."""
    by_doc = Window.partitionBy("doc_id").orderBy("page")
    whole = Window.partitionBy("doc_id")
    return (
        pages.withColumn("is_refs", X.references_page("text", p)["is_refs"])
        .withColumn("i", F.row_number().over(by_doc) - 1)
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("before", F.coalesce(F.sum(F.length(X._c("text"))).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )


def tail_cut(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """``pages`` (doc_id, i, n, is_refs, before) with cut: where the first late run of reference pages starts that is long enough and has enough text before it, or -1."""
    by_doc = Window.partitionBy("doc_id").orderBy("i")
    late = F.col("is_refs") & (F.col("i") >= F.floor(F.col("n") * p.refs_tail))
    run = Window.partitionBy("doc_id", "island").orderBy("i")
    rows = (
        pages.withColumn("island", F.sum(F.when(F.col("is_refs"), 0).otherwise(1)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("late", late)
        .withColumn("k", F.sum(F.when(F.col("late"), 1).otherwise(0)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("first", F.min(F.when(F.col("late"), F.col("i"))).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    )
    good = F.col("late") & (F.col("k") >= p.refs_run) & (F.col("before") >= p.refs_min_chars)
    cut = F.coalesce(F.min_by(F.when(good, F.col("first")), F.when(good, F.col("i"))).over(Window.partitionBy("doc_id")), F.lit(-1))
    return rows.withColumn("cut", cut).drop("island", "late", "k", "first")


def without_references(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, page, text: no tail of references, no early page of references, no citation lines."""
    rows = tail_cut(flagged(pages, p), p)
    kept = rows.where(((F.col("cut") < 0) | (F.col("i") < F.col("cut"))) & ~((F.col("i") < p.refs_early_pages) & F.col("is_refs")))
    once = X.drop_citations("text")
    return kept.select("doc_id", "page", F.when(F.col("is_refs"), X.drop_citations(once)).otherwise(once).alias("text"))


def page_stats(pages: DataFrame) -> DataFrame:
    """Pages and empty pages of each document."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(X.strip("text") == "").alias("empty_pages"))


def with_text(pages: DataFrame) -> DataFrame:
    """Pages of documents that have any text."""
    some = pages.groupBy("doc_id").agg(F.max(F.length(X.strip("text"))).alias("n")).where("n > 0").select("doc_id")
    return pages.join(some, "doc_id", "left_semi")


def ocr_choice(page_text: Column, ocr_text: Column, mode: str = "auto", min_chars: int = 60) -> Column:
    """Text of a scanned page: the recognised one if the mode asks for it (auto: the layer is short) and it is longer."""
    if mode == "never":
        return X._c(page_text)
    longer = F.when(F.length(X._c(ocr_text)) > F.length(X._c(page_text)), ocr_text).otherwise(X._c(page_text))
    return longer if mode == "always" else F.when(F.length(X._c(page_text)) < min_chars, longer).otherwise(X._c(page_text))


def needs_ocr(pages: DataFrame, first: int = 5, least: int = 50) -> DataFrame:
    """Documents whose first pages have hardly any text."""
    return pages.groupBy("doc_id").agg((F.coalesce(F.sum(F.when(F.col("page") <= first, F.length(X.strip("text")))), F.lit(0)) < least).alias("needs_ocr"))


def joined_text(pages: DataFrame, marked: bool = True) -> DataFrame:
    """One text for each document, pages under marks."""
    block = F.concat(F.lit("##### [PAGE "), F.col("page").cast("string"), F.lit("]\n"), X._c("text")) if marked else X._c("text")
    rows = F.sort_array(F.collect_list(F.struct("page", block.alias("block"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n").alias("text"))


def page_range_text(spans: DataFrame, pages: DataFrame, limit: int = 4000) -> DataFrame:
    """Text of pages page_start to page_end of each span (span_id, doc_id, page_start, page_end): an equal join on the document, then the range."""
    hit = spans.join(pages.select("doc_id", "page", "text").where("text <> ''"), "doc_id").where("page BETWEEN page_start AND page_end")
    rows = F.sort_array(F.collect_list(F.struct("page", "text")))
    return hit.groupBy("span_id").agg(F.substring(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n"), 1, limit).alias("text"))
