"""Context blocks, citations, chat histories, prompts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..params import Params

# fixed values: what a user reads
PAGE_WORD = "стр."
NO_ANSWER = "Нет ответа в базе по предоставленному контексту."
NO_CONTEXT = "(контекст не найден)"
SYSTEM = (
    "Ты — ассистент поиска по медицинской базе. Отвечай ТОЛЬКО по тексту из КОНТЕКСТА ниже. "
    "Никаких предположений и «общих знаний». Если в КОНТЕКСТЕ нет однозначного ответа, "
    "верни дословно: «Нет ответа в базе по предоставленному контексту.» "
    "Отвечай кратко, на русском, без Markdown и без код-блоков.\n\n"
    "=== КОНТЕКСТ (RAG) ===\n{context}\n=== КОНЕЦ КОНТЕКСТА ===\n\n"
    "Справочные ссылки (их можно перечислить в конце ответа как Источники):\n{citations}"
)
USER = (
    "ВОПРОС/ЗАПРОС:\n{case_text}{plan}\n\nЗАДАЧА:\n"
    "- Найди в КОНТЕКСТЕ выше точный и короткий ответ (термин, число, краткая фраза).\n"
    "- Если однозначного ответа в КОНТЕКСТЕ нет — напиши: «Нет ответа в базе по предоставленному контексту.»\n"
    "- В конце добавь строку вида: Источники: DOC_ID стр.A-B; DOC_ID стр.C-D\n"
    "- Краткость важнее. Без Markdown и без код-блоков."
)


def citation(doc_id: Column, start: Column, end: Column) -> Column:
    first = F.coalesce(start, F.lit(1))
    return F.concat(F.coalesce(doc_id, F.lit("unknown")), F.lit(f" {PAGE_WORD}"), first.cast("string"), F.lit("-"), F.coalesce(end, first).cast("string"))


def block(place: Column, doc_id: Column, start: Column, end: Column, text: Column, limit: int) -> Column:
    first = F.coalesce(start, F.lit(1))
    return F.concat(
        F.lit("### ["), place.cast("string"), F.lit("] DOC "), F.coalesce(doc_id, F.lit("unknown")), F.lit(" P"), first.cast("string"), F.lit("-"), F.coalesce(end, first).cast("string"), F.lit("\n"), F.substring(X._c(text), 1, limit), F.lit("\n\n")
    )


def context_blocks(items: DataFrame, p: Params = Params()) -> DataFrame:
    """Items (query_id, place, doc_id, page_start, page_end, text) with block and admitted: blocks count in order until the first that would exceed the budget."""
    rows = items.withColumn("block", block(F.col("place"), F.col("doc_id"), F.col("page_start"), F.col("page_end"), F.col("text"), p.context_text_chars))
    total = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("admitted", total <= p.context_chars)


def contexts(items: DataFrame, p: Params = Params()) -> DataFrame:
    """query_id, context (admitted blocks), citations (of the first items, admitted or not)."""
    rows = context_blocks(items, p).withColumn("cite", citation(F.col("doc_id"), F.col("page_start"), F.col("page_end")))
    ordered = lambda value, when: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("place", F.col(value).alias("v"))))), lambda x: x["v"])
    return rows.groupBy("query_id").agg(F.array_join(ordered("block", F.col("admitted")), "").alias("context"), ordered("cite", F.col("place") <= p.citations).alias("citations"))


def file_context(items: DataFrame, most: int = 12, limit: int = 1600) -> DataFrame:
    """query_id, context: the first chunks, each cut and marked, a fixed phrase if there are none."""
    made = F.concat(F.lit("### ["), F.col("place").cast("string"), F.lit("] DOC "), F.col("doc_id"), F.lit(" P"), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit("\n"), X.head(X.strip("text"), limit, " …"))
    rows = items.withColumn("b", F.when(F.col("place") <= most, F.struct("place", made.alias("v"))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda x: x["v"]), "\n\n")
    return rows.groupBy("query_id").agg(F.when(text == "", NO_CONTEXT).otherwise(text).alias("context"))


def case_from_history(turns: DataFrame, last: int = 6, target: int = 2000) -> DataFrame:
    """conv_id, case_text: the last user turns that say something, in order, compacted."""
    users = turns.where(F.col("role") == "user").withColumn("__n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).where(F.col("__n") <= last)
    said = F.length(F.regexp_replace(X._c("text"), r"(?U)\W+", "")) > 0
    rows = F.sort_array(F.collect_list(F.when(said, F.struct("turn", "text"))))
    joined = users.groupBy("conv_id").agg(X.strip(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n")).alias("raw_case"))
    return joined.select("conv_id", "raw_case", X.compact_text("raw_case", target).alias("case_text"))


def resolved_query(query: Column, case_text: Column, seed: str = "", target: int = 220) -> Column:
    """The query, or the compacted case if it is blank or says nothing, or a fixed one."""
    case = X.compact_text(case_text, target)
    return F.when((X.strip(query) != "") & ~X.looks_meaningless(query), X.strip(query)).when(case != "", case).otherwise(F.lit(seed))


def prompts(rows: DataFrame, base: str = "") -> DataFrame:
    """system and user prompts of rows (case_text, plan, context, citations)."""
    cites = F.concat(F.array_join(F.transform("citations", lambda c: F.concat(F.lit("- "), c)), "\n"), F.when(F.size("citations") > 0, "\n").otherwise(""))
    plan = F.when(X._c("plan") != "", F.concat(F.lit("\n\n[План врача]\n"), F.col("plan"))).otherwise("")
    system = X.fill((base.strip() + "\n\n" if base.strip() else "") + SYSTEM, context=F.col("context"), citations=cites)
    return rows.withColumn("system", X.strip(system) if base.strip() else system).withColumn("user", X.fill(USER, case_text=F.col("case_text"), plan=plan))


def report(result: Column) -> Column:
    """A scored result (schemas.SCORED) as lines."""
    cites = lambda x: F.array_join(F.transform(F.coalesce(x["citations"], F.array()), lambda c: F.concat(c["doc_id"], F.lit(":"), F.array_join(F.transform(c["pages"], lambda n: n.cast("string")), ","))), "; ")
    line = lambda i, left, sep, right, x: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(") "), X._c(left), F.lit(sep), X._c(right), F.lit(" [src: "), cites(x), F.lit("]"))
    errors, recs = result["critical_errors"], result["recommendations"]
    subs = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), result["subscores"][n].cast("string")) for n in ("diagnosis", "med_choice", "dose", "interactions", "contraindications", "monitoring")])
    return F.concat_ws(
        "\n",
        F.concat(F.lit("SCORE: "), F.coalesce(result["score"].cast("string"), F.lit("None"))),
        F.concat(F.lit("SUBSCORES: "), subs),
        F.when(F.size(errors) > 0, "CRITICAL ERRORS:").otherwise("CRITICAL ERRORS: none"),
        F.transform(errors, lambda x, i: line(i, x["type"], ": ", x["explain"], x)),
        F.lit("RECOMMENDATIONS:"),
        F.transform(recs, lambda x, i: line(i, x["what_to_change"], " — ", x["rationale"], x)),
        F.concat(F.lit("DISCLAIMER: "), X._c(result["disclaimer"])),
    )


def preview(items: DataFrame, *, with_text: bool = True, limit: int = 1500) -> DataFrame:
    """Items for a preview: document, pages, page range as text, and the text's beginning if it is asked for."""
    text = F.substring(X._c("text"), 1, limit) if with_text else F.lit(None).cast("string")
    return items.select("query_id", "place", "doc_id", "page_start", "page_end", F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string")).alias("page_range"), text.alias("text"))


def sources(items: DataFrame, most: int = 10) -> DataFrame:
    """Document and pages of the first items."""
    return items.where(F.col("place") <= most).select("query_id", "place", F.coalesce("doc_id", F.lit("unknown")).alias("doc_id"), F.coalesce("page_start", F.lit(1)).alias("page_start"), F.coalesce("page_end", "page_start", F.lit(1)).alias("page_end"))
