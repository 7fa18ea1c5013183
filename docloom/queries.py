"""Queries of the engine's own operators on the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ids, results
from .functions import text as X
from .functions import vectors as V
from .operators import chunks, context, delta, pages, search
from .params import Params
from .plans import retrieval
from .sources import files
from .sources import index as store
from .sources.files import tempfolder

P = Params()
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def turns_as_pages(spark, sf_dir):
    """Conversations stand in for documents of pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")


# pieces of SQL that several oracles share
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
LINES = r"list_filter(list_transform(string_split_regex(regexp_replace({0}, '\.\s+', '.' || chr(10), 'g'), '\n+'), lambda x: " + STRIP.format("x") + "), lambda x: x <> '')"
CITE = r"(length({0}) >= 20 AND regexp_matches({0}, '(?i)(^\s*\d{{1,3}}[\).\]]\s+)|(\b(et\s*al\.?)\b)|(\bdoi[:\s/]|10\.\d{{3,9}}/\S+)|(\bEpub\b|\bPublished\b|\bRetrieved\b)|(\b\d{{4}}\b\s*;\s*\d{{1,4}}\s*(\(\d{{1,4}}\))?\s*:\s*\d{{1,5}}([-–]\d{{1,5}})?)'))"
HASHED = r"trim(regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '[^0-9a-zа-яё %/.,;:()\-\n]+', ' ', 'g'))"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
CHUNKS = (
    """
w AS (SELECT doc_id, """
    + WORDS.format("text")
    + """ AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 180 THEN 1 ELSE 1 + CAST(ceil((len(w) - 180) / 150.0) AS BIGINT) END)) AS k FROM w),
c AS (SELECT doc_id, k + 1 AS window_no, array_to_string(w[k * 150 + 1 : k * 150 + 180], ' ') AS chunk, len(w[k * 150 + 1 : k * 150 + 180]) AS n_words FROM k)"""
)


CLEAN = STRIP.format(r"translate(regexp_replace(replace(replace(replace(replace(replace(text, chr(13), ''), '-' || chr(10), ''), chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10)), '[ \t]+', ' ', 'g'), 'AaBEeKkMHOoPpCcTXxYy', 'АаВЕеКкМНОоРрСсТХхУу')")
NORMAL = (
    STRIP.format(r"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(translate(text, chr(13) || chr(9), chr(10) || ' '), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: " + STRIP.format(r"regexp_replace(x, '\s+', ' ', 'g')") + r"), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")
)


@query("SELECT doc_id, " + CLEAN + " AS clean FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text("text").alias("clean"))


@query("SELECT doc_id, " + NORMAL + " AS clean FROM documents")
def normalize_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_text("text").alias("clean"))


@query("SELECT doc_id, sha1(" + HASHED.format("text") + ") AS text_hash FROM documents")
def normalize_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.text_hash("text").alias("text_hash"))


@query("WITH h AS (SELECT doc_id, sha1(" + HASHED.format("text") + ") AS text_hash FROM documents) SELECT text_hash, min(doc_id) AS doc_id FROM h GROUP BY text_hash")
def dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.text_hash("text").alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))


CITATION, MARK = "Smith J et al, Plain work 2019; 12(3): 45-67", "doi:10.1000/xyz, a page of the shelf"
CITED = f"(SELECT doc_id, text || repeat(chr(10) || '{CITATION}', CAST(doc_id % 7 AS INTEGER)) || repeat(chr(10) || '{MARK}', CASE WHEN doc_id % 5 = 0 THEN 60 ELSE 0 END) AS text FROM documents) documents"


def cited(spark, sf_dir):
    """Documents with planted lines of a bibliography: none to six in each, and 60 more in every fifth."""
    lines = lambda line, n: F.repeat(F.lit(f"\n{line}"), n.cast("int"))
    more = F.when(F.col("doc_id") % 5 == 0, 60).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", lines(CITATION, F.col("doc_id") % 7), lines(MARK, more)).alias("text"))


@query("WITH l AS (SELECT doc_id, unnest(" + LINES.format("text") + ") AS line FROM " + CITED + ") SELECT doc_id, line, count(*) AS n FROM l WHERE " + CITE.format("line") + " GROUP BY doc_id, line")
def citation_lines(spark, sf_dir):
    rows = cited(spark, sf_dir).select("doc_id", F.explode(X.split_lines("text")).alias("line"))
    return rows.where(X.is_citation(F.col("line"))).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT doc_id, " + LINES.format("text") + " AS l FROM " + CITED + "), n AS (SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: " + CITE.format("x") + ")) AS hits FROM l) SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CASE WHEN n_lines >= 5 THEN round(hits / n_lines, 6) ELSE 0 END AS ratio, n_lines >= 5 AND hits / n_lines >= 0.55 AS is_refs FROM n")
def refs_page_class(spark, sf_dir):
    rows = cited(spark, sf_dir).select("doc_id", X.references_page("text").alias("x"))
    return rows.select("doc_id", "x.n_lines", F.round("x.ratio", 6).alias("ratio"), "x.is_refs")


@query("SELECT doc_id, " + STRIP.format("array_to_string(list_filter(" + LINES.format("text") + ", lambda x: NOT " + CITE.format("x") + "), chr(10))") + " AS clean FROM " + CITED)
def drop_citations(spark, sf_dir):
    return cited(spark, sf_dir).select("doc_id", X.drop_citations("text").alias("clean"))


LOOSE = r"(?i)(^\s*\d{1,3}[\).\]]\s+|et\s*al\.?|doi[:\s/]|10\.\d{3,9}/\S+|\b\d{4}\b\s*;\s*\d+)"


@query(
    r"SELECT doc_id, " + STRIP.format(r"array_to_string(list_filter(string_split_regex(regexp_replace(text, '\.\s+', '.' || chr(10), 'g'), '\n+'), lambda x: x <> '' AND NOT regexp_matches(x, '" + LOOSE + r"')), chr(10))") + " AS clean FROM " + CITED
)
def bm25_citation_drop(spark, sf_dir):
    return cited(spark, sf_dir).select("doc_id", X.drop_loose_citations("text").alias("clean"))


NOISE = (
    "(length(t) < 110 OR length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(length(t), 1) > 0.3 OR length(regexp_replace(t, '[^.,;:·•▪\\-|_/\\\\\\[\\]()]', '', 'g')) / greatest(length(t), 1) > 0.28"
    " OR len(list_filter(" + LINES.format("t") + ", lambda x: length(x) < 35)) / greatest(len(" + LINES.format("t") + "), 1) > 0.7)"
)


@query("WITH d AS (SELECT doc_id, " + STRIP.format("text") + " AS t FROM documents) SELECT doc_id, " + NOISE + " AS is_noise FROM d")
def noise_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.is_noise("text").alias("is_noise"))


@query(
    "WITH t AS (SELECT item_id, lower(" + STRIP.format("text") + r") AS t FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations)) SELECT item_id, CASE WHEN length(t) < 3 THEN true WHEN regexp_full_match(t, '[a-z]\d{1,2}(\.\d+)?') THEN false WHEN NOT regexp_matches(t, '[a-zа-яё0-9]') THEN true ELSE regexp_full_match(t, '[a-zа-яё\s]+') AND len(list_distinct(string_split(t, ''))) < 5 AND length(t) < 20 END AS meaningless FROM t"
)
def meaningless_query(spark, sf_dir):
    """Benchmark items and the whole texts of conversations."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text").union(turns)
    return rows.select("item_id", X.looks_meaningless("text").alias("meaningless"))


@query(
    "WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, " + CLEAN + r" AS t FROM documents), p AS (SELECT doc_id, list_transform(string_split(regexp_replace(t, '(\n\n|[.!?]\s+)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: {'done': CAST([] AS VARCHAR[]), 'page': x}) AS parts FROM c),"
    " f AS (SELECT doc_id, list_reduce(parts, lambda a, x: CASE WHEN length(a.page) + length(x.page) > 1800 THEN {'done': list_append(a.done, a.page), 'page': x.page} ELSE {'done': a.done, 'page': a.page || x.page} END) AS f FROM p),"
    " g AS (SELECT doc_id, list_append(f.done, f.page) AS pages FROM f) SELECT doc_id, CAST(k AS INTEGER) AS page, " + STRIP.format("pages[k]") + " AS text FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS k FROM g)"
)
def page_packing(spark, sf_dir):
    return pages.to_pages(docs(spark, sf_dir), pages.packed("text", P))


@query(
    "WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, " + NORMAL + " AS t FROM documents), p AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: {'done': CAST([] AS VARCHAR[]), 'page': x, 'n': length(x) + 1}) AS parts FROM c),"
    " f AS (SELECT doc_id, list_reduce(parts, lambda a, x: CASE WHEN a.n >= 2000 THEN {'done': list_append(a.done, a.page), 'page': x.page, 'n': x.n} ELSE {'done': a.done, 'page': a.page || chr(10) || x.page, 'n': a.n + x.n} END) AS f FROM p),"
    " g AS (SELECT doc_id, list_append(f.done, f.page) AS pages FROM f) SELECT doc_id, CAST(k AS INTEGER) AS page, pages[k] AS text FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS k FROM g)"
)
def line_packing(spark, sf_dir):
    return pages.to_pages(docs(spark, sf_dir), pages.line_packed(X.normalize_text("text"), P))


VOLUMES = f"(SELECT CAST(doc_id // 20 AS VARCHAR) AS doc_id, CAST(doc_id % 20 + 1 AS INTEGER) AS page, CASE WHEN (doc_id // 20) % 3 = 0 AND doc_id % 20 >= 14 OR doc_id % 11 = 0 THEN repeat('{CITATION}' || chr(10), 8) ELSE text END AS text FROM documents)"


def volumes(spark, sf_dir):
    """Documents as the pages of volumes of twenty; the last six of every third volume, and every eleventh page, are made a bibliography."""
    volume, page = F.expr("doc_id div 20"), F.col("doc_id") % 20
    listed = ((volume % 3 == 0) & (page >= 14)) | (F.col("doc_id") % 11 == 0)
    rows = table(spark, sf_dir, "documents")
    return rows.select(volume.cast("string").alias("doc_id"), (page + 1).cast("int").alias("page"), F.when(listed, F.repeat(F.lit(f"{CITATION}\n"), F.lit(8))).otherwise(F.col("text")).alias("text"))


@query(
    "WITH l AS (SELECT *, " + LINES.format("text") + " AS l FROM " + VOLUMES + "), f AS (SELECT doc_id, page, text, len(l) >= 5 AND len(list_filter(l, lambda x: " + CITE.format("x") + """)) / greatest(len(l), 1) >= 0.55 AS is_refs FROM l),
i AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
s AS (SELECT *, sum(CASE WHEN is_refs THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island, is_refs AND i >= floor(n * 0.6) AS late FROM i),
k AS (SELECT *, sum(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island ORDER BY i) AS k, min(CASE WHEN late THEN i END) OVER (PARTITION BY doc_id, island ORDER BY i) AS first FROM s)
SELECT doc_id, CAST(coalesce(arg_min(first, i) FILTER (WHERE late AND k >= 2 AND before >= 5000), -1) AS INTEGER) AS cut FROM k GROUP BY doc_id"""
)
def tail_cut(spark, sf_dir):
    rows = pages.flagged(volumes(spark, sf_dir), P)
    return pages.tail_cut(rows, P).select("doc_id", F.col("cut").cast("int").alias("cut")).distinct()


@query()
def pages_without_references(spark, sf_dir):
    return retrieval.ingest(docs(spark, sf_dir), P)


@query()
def parent_child(spark, sf_dir):
    return chunks.children(turns_as_pages(spark, sf_dir), P).select("doc_id", "parent_id", "child", "page_start", "page_end", "len_words", "text_hash")


@query("WITH" + CHUNKS + " SELECT doc_id, CAST(window_no AS INTEGER) AS window_no, chunk, CAST(n_words AS INTEGER) AS n_words FROM c")
def word_windows(spark, sf_dir):
    rows = chunks.word_windows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("window").cast("int").alias("window_no"), "chunk", "n_words")


@query(
    """
WITH h AS (SELECT doc_id, sha1("""
    + HASHED.format("text")
    + """) AS text_hash FROM documents),
s AS (SELECT doc_id, text_hash, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '_' || text_hash)) AS s FROM h)
SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS point_id FROM s"""
)
def point_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.text_hash("text").alias("text_hash"))
    return rows.select("doc_id", ids.point_id(F.col("doc_id").cast("string"), F.col("text_hash")).alias("point_id"))


@query(
    """
WITH now AS (SELECT doc_id, sha1(text) AS sha1 FROM documents),
known AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha1(text) END AS sha1 FROM documents WHERE doc_id % 3 <> 0)
SELECT now.doc_id, CASE WHEN known.doc_id IS NULL THEN 'new' WHEN known.sha1 = now.sha1 THEN 'unchanged' ELSE 'changed' END AS status FROM now LEFT JOIN known ON now.doc_id = known.doc_id"""
)
def delta_status(spark, sf_dir):
    now = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    known = now.where("doc_id % 3 <> 0").withColumn("sha1", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("sha1")))
    return delta.changes(now, known, "doc_id").select("doc_id", "status")


@query("SELECT doc_id, n_chars + CASE WHEN doc_id % 4 = 0 THEN 1000000 ELSE 0 END AS n_chars FROM documents")
def upsert_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    new = rows.where("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1000000)
    return delta.upsert(rows, new, "doc_id")


@query(
    "WITH" + CHUNKS + ", h AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, window_no AS k, sha1(" + HASHED.format("chunk") + ") AS text_hash FROM c), a AS (SELECT * FROM h WHERE NOT (doc_id LIKE '%7')), f AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id, k) AS r FROM a) SELECT doc_id, CAST(k AS INTEGER) AS child, text_hash FROM f WHERE r = 1"
)
def existing_anti(spark, sf_dir):
    rows = chunks.word_windows(docs(spark, sf_dir)).select("doc_id", F.lit("P1").alias("parent_id"), F.lit(1).alias("parent"), F.col("window").alias("child"), X.text_hash("chunk").alias("text_hash"))
    stored = rows.where(F.col("doc_id").endswith("7")).select("doc_id", "text_hash")
    return chunks.first_of_each_hash(rows, stored).select("doc_id", F.col("child").cast("int").alias("child"), "text_hash")


SEARCH = (
    CHUNKS
    + """,
i AS (SELECT doc_id || '_p1_c' || window_no AS chunk_id, doc_id, chunk, """
    + TERMS.format("chunk")
    + """ AS t FROM c),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM i) GROUP BY chunk_id, term),
dl AS (SELECT chunk_id, len(t) AS dl FROM i),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest("""
    + TERMS.format("text")
    + """) AS term FROM benchmark),
s AS (SELECT query_id, tf.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl)))), 6) AS score
      FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = tf.term JOIN dl ON dl.chunk_id = tf.chunk_id CROSS JOIN tot GROUP BY query_id, tf.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""
)


def windows_of_documents(spark, sf_dir):
    rows = chunks.word_windows(docs(spark, sf_dir))
    return rows.select(ids.bm25_chunk_id(F.col("doc_id"), F.lit(1), F.col("window")).alias("chunk_id"), "doc_id", F.lit(1).alias("page"), F.col("chunk").alias("text"))


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("WITH" + SEARCH + " SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN tot")
def bm25_stats(spark, sf_dir):
    return search.keyword_index(windows_of_documents(spark, sf_dir), P).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("WITH" + SEARCH + " SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    index = search.keyword_index(windows_of_documents(spark, sf_dir), P)
    return search.keyword_top(index, items(spark, sf_dir), 10)


@query("WITH" + SEARCH + " SELECT query_id, CAST(rank AS INTEGER) AS place, '### [' || rank || '] DOC ' || r.chunk_id || ' P1-1' || chr(10) || left(chunk, 800) || chr(10) || chr(10) AS block, sum(length('### [' || rank || '] DOC ' || r.chunk_id || ' P1-1' || chr(10) || left(chunk, 800) || chr(10) || chr(10))) OVER (PARTITION BY query_id ORDER BY rank) <= 4000 AS admitted FROM r JOIN i ON r.chunk_id = i.chunk_id WHERE rank <= 8")
def context_budget(spark, sf_dir):
    rows = windows_of_documents(spark, sf_dir)
    top = search.keyword_top(search.keyword_index(rows, P), items(spark, sf_dir), 8).join(rows.select("chunk_id", "text"), "chunk_id")
    made = top.select("query_id", F.col("rank").alias("place"), F.col("chunk_id").alias("doc_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "text")
    return context.context_blocks(made, P).select("query_id", "place", "block", "admitted")


@query("WITH" + SEARCH + " SELECT query_id, string_agg(chunk_id || ' стр.1-1', '; ' ORDER BY rank) AS citations FROM r WHERE rank <= 5 GROUP BY query_id")
def citations(spark, sf_dir):
    rows = windows_of_documents(spark, sf_dir)
    top = search.keyword_top(search.keyword_index(rows, P), items(spark, sf_dir), 8).join(rows.select("chunk_id", "text"), "chunk_id")
    made = top.select("query_id", F.col("rank").alias("place"), F.col("chunk_id").alias("doc_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "text")
    return context.contexts(made, P).select("query_id", F.array_join("citations", "; ").alias("citations"))


COS = "round(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])), 6)"
VECTORS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings)"
DENSE = VECTORS + ", s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label, " + COS + " AS score FROM e q JOIN e ON q.vec_id % 50 = {0}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.col("embedding").alias("vector"))


def vector_run(spark, sf_dir, shift: int, n: int):
    rows = vectors(spark, sf_dir)
    asked = rows.where(F.col("chunk_id") % 50 == shift).select(F.col("chunk_id").alias("query_id"), "vector")
    return search.dense_top(rows, asked, n)


@query("WITH " + DENSE.format(0) + " SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 80")
def dense_topk(spark, sf_dir):
    return vector_run(spark, sf_dir, 0, 80).select("query_id", "chunk_id", "score", "rank")


RUNS = (
    "WITH " + DENSE.format("0 OR q.vec_id % 50 = 1") + ", u AS (SELECT query_id // 50 * 50 AS query_id, chunk_id, rank, query_id % 50 AS run FROM r WHERE rank <= {0}), f AS (SELECT query_id, chunk_id, round(sum(1 / (60.0 + rank)), 9) AS fused, min(run * 100000 + rank) AS o FROM u GROUP BY query_id, chunk_id), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, o, chunk_id) AS position FROM f)"
)


def two_runs(spark, sf_dir):
    other = vector_run(spark, sf_dir, 1, 80).withColumn("query_id", F.col("query_id") - 1)
    return [vector_run(spark, sf_dir, 0, 80), other]


@query(RUNS.format(60) + " SELECT query_id, chunk_id, fused, CAST(position AS INTEGER) AS position FROM p")
def rrf_fuse(spark, sf_dir):
    return search.fuse(two_runs(spark, sf_dir), P, depth=60).select("query_id", "chunk_id", "fused", "position")


@query(
    RUNS.format(80)
    + ", d AS (SELECT u.query_id, label, round(sum(1 / (60.0 + rank)), 9) AS fused FROM u JOIN embeddings ON vec_id = chunk_id GROUP BY u.query_id, label) SELECT query_id, label, fused FROM d"
)
def rrf_doc_level(spark, sf_dir):
    labels = vectors(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("label"))
    runs = [r.join(labels, "chunk_id").select("query_id", F.col("label").alias("chunk_id"), "rank") for r in two_runs(spark, sf_dir)]
    return search.fuse(runs, P).select("query_id", F.col("chunk_id").alias("label"), "fused")


@query(
    RUNS.format(60)
    + ", c AS (SELECT p.*, label, row_number() OVER (PARTITION BY query_id, label ORDER BY position) AS n FROM p JOIN embeddings ON vec_id = chunk_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM c WHERE n <= 2) SELECT query_id, chunk_id, label, CAST(place AS INTEGER) AS place FROM k WHERE place <= 8"
)
def per_doc_cap(spark, sf_dir):
    rows = search.fuse(two_runs(spark, sf_dir), P, depth=60).join(vectors(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("label"), F.lit("x").alias("text")), "chunk_id")
    return search.capped(rows, 2, 8, doc="label").select("query_id", "chunk_id", "label", "place")


@query("WITH " + DENSE.format(0) + ", h AS (SELECT query_id, chunk_id, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS place FROM r WHERE rank <= 20) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN place <= 10 THEN 0 ELSE 1 END, CASE WHEN place <= 10 THEN score ELSE 0 END DESC, place) AS INTEGER) AS place_after FROM h")
def rerank(spark, sf_dir):
    rows = vector_run(spark, sf_dir, 0, 20).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return search.reranked(rows, F.col("score"), 10).select("query_id", "chunk_id", "place_after")


@query(
    "WITH" + SEARCH + ", " + VECTORS + """,
v AS (SELECT b.item_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS cos FROM benchmark b JOIN e q ON q.vec_id = b.item_id, e p),
ds AS (SELECT query_id, chunk_id, round(cos, 6) AS score FROM v JOIN i ON v.vec_id = CAST(i.doc_id AS BIGINT) % (SELECT count(*) FROM embeddings)),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds),
u AS (SELECT query_id, chunk_id, rank, 0 AS run FROM dr WHERE rank <= 60 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM r WHERE rank <= 60 AND query_id IN (SELECT query_id FROM v)),
fu AS (SELECT query_id, chunk_id, round(sum(1 / (60.0 + rank)), 9) AS fused, min(run * 100000 + rank) AS o FROM u GROUP BY query_id, chunk_id),
po AS (SELECT fu.*, i.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, o, fu.chunk_id) AS position FROM fu JOIN i ON i.chunk_id = fu.chunk_id),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY position) AS nth FROM po),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM one WHERE nth = 1)
SELECT pl.query_id, CAST(row_number() OVER (PARTITION BY pl.query_id ORDER BY cos DESC, place) AS INTEGER) AS place, CAST(doc_id AS VARCHAR) AS doc_id, 1 AS page_start, 1 AS page_end, chunk_id
FROM pl JOIN v ON v.query_id = pl.query_id AND v.vec_id = CAST(doc_id AS BIGINT) % (SELECT count(*) FROM embeddings) WHERE place <= 8"""
)
def hybrid_full(spark, sf_dir):
    """Keyword and vector runs over documents; vectors stand in by number."""
    rows = windows_of_documents(spark, sf_dir)
    vec = table(spark, sf_dir, "embeddings")
    n = vec.count()
    dense = rows.withColumn("vec_id", F.pmod(F.col("doc_id").cast("long"), F.lit(n))).join(vec, "vec_id").select("chunk_id", "doc_id", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("text").alias("chunk_text"), F.col("embedding").alias("vector"))
    asked = items(spark, sf_dir).withColumn("vec_id", F.col("query_id")).join(vec.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")
    index = retrieval.Index(search.keyword_index(rows, P), rows, dense)
    return retrieval.hybrid(index, asked, P).select("query_id", "place", "doc_id", "page_start", "page_end", "chunk_id")


@query("WITH s AS (SELECT DISTINCT conv_id, 1 AS a, 3 AS b FROM conversations) SELECT s.conv_id AS span_id, left(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), 4000) AS text FROM s JOIN conversations c ON s.conv_id = c.conv_id AND turn BETWEEN a AND b WHERE text <> '' GROUP BY s.conv_id")
def page_range_text(spark, sf_dir):
    rows = turns_as_pages(spark, sf_dir)
    spans = rows.select("doc_id").distinct().select(F.col("doc_id").cast("long").alias("span_id"), "doc_id", F.lit(1).alias("page_start"), F.lit(3).alias("page_end"))
    return pages.page_range_text(spans, rows)


@query(r"WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') SELECT conv_id, " + STRIP.format(r"coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE regexp_matches(text, '[\p{L}\p{N}_]')), '')") + " AS raw_case FROM u WHERE r <= 6 GROUP BY conv_id")
def chat_case(spark, sf_dir):
    return context.case_from_history(table(spark, sf_dir, "conversations")).select("conv_id", "raw_case")


@query()
def compact_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.compact_text("text", 220).alias("compact"))


@query()
def case_plan_split(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.case_and_plan("text").alias("x")).select("conv_id", "turn", "x.case_text", "x.plan")


@query()
def chat_prompts(spark, sf_dir):
    rows = windows_of_documents(spark, sf_dir)
    index = retrieval.Index(search.keyword_index(rows, P), rows)
    return retrieval.chat(table(spark, sf_dir, "conversations"), index, P).select("conv_id", "case_text", "plan", "user")


@query("WITH s AS (SELECT doc_id || '_p' || (doc_id % 9) || '_c1' AS chunk_id FROM documents) SELECT chunk_id, regexp_extract(chunk_id, '^(.+)_p(\\d+)_c\\d+$', 1) AS doc_id, CAST(regexp_extract(chunk_id, '^(.+)_p(\\d+)_c\\d+$', 2) AS INTEGER) AS page FROM s".replace("\\\\", "\\"))
def id_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(ids.bm25_chunk_id(F.col("doc_id").cast("string"), F.col("doc_id") % 9, F.lit(1)).alias("chunk_id"))
    return rows.select("chunk_id", ids.parse_chunk_id(F.col("chunk_id")).alias("x")).select("chunk_id", "x.doc_id", "x.page")


@query()
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_text(files.html_text("html")).alias("text"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE trim(text) = '') AS BIGINT) AS empty_pages FROM conversations GROUP BY conv_id")
def empty_page_stats(spark, sf_dir):
    return pages.page_stats(turns_as_pages(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("conv_id"), "pages", "empty_pages")


@query("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE (CASE WHEN strpos(reverse(left(text, 2000)), ' ') = 0 OR 2000 - strpos(reverse(left(text, 2000)), ' ') < 200 THEN left(text, 2000) ELSE left(text, 2000 - strpos(reverse(left(text, 2000)), ' ')) END) || ' …' END AS trimmed FROM documents")
def safe_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.safe_trim("text").alias("trimmed"))


@query("SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 800) || chr(10) || '…' ELSE text END AS head FROM documents")
def head_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.head("text", 800, "\n…").alias("head"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.page') AS INTEGER), -1) AS page, json_valid(props) AS ok FROM events")
def json_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return rows.select("event_id", ids.coerced(F.get_json_object("props", "$.page"), "int", -1).alias("page"), F.col("v").isNotNull().alias("ok"))


@query()
def json_loose(spark, sf_dir):
    """Answers made of events: JSON in prose, in fences, with lists of mixed types."""
    answer = F.concat(F.lit("Ответ: ```json\n{\"critical_errors\": [\"e"), F.col("event_id").cast("string"), F.lit("\", {\"type\": \"t\", \"explain\": \"x\"}], \"recommendations\": [{\"what_to_change\": \"a\", \"rationale\": \"b\"}, \"a\", \"a\"], \"meta\": "), F.col("props"), F.lit("}\n```"))
    rows = table(spark, sf_dir, "events").select("event_id", results.from_text(answer).alias("r"))
    return rows.select("event_id", F.size("r.critical_errors").alias("n_errors"), F.array_join("r.recommendations", ";").alias("recommendations"), F.size("r.meta").alias("n_meta"), "r.free_text")


@query("SELECT max(epoch(ts)) > 0 AS needs_rebuild, CAST(floor(epoch(max(ts))) AS BIGINT) AS latest FROM events")
def mtime_gate(spark, sf_dir):
    seconds = F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS DOUBLE)")
    rows = table(spark, sf_dir, "events").select(seconds.alias("at"))
    return delta.stale(rows, 0.0).select("needs_rebuild", F.col("latest").cast("long").alias("latest"))


@query("WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '/' || source || '.txt') AS k FROM documents) SELECT doc_id AS file_no, CASE WHEN k = 1 THEN source ELSE source || '_' || k END AS doc_id FROM s")
def collision_suffix(spark, sf_dir):
    path = F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("/"), F.col("source"), F.lit(".txt"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_no"), path.alias("source_path"))
    return delta.file_ids(rows).select("file_no", "doc_id")


@query("SELECT vec_id, round(list_sum(v), 6) AS total, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length FROM (" + "WITH " + VECTORS + " SELECT * FROM e)")
def l2_unit(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(V.norm(F.col("v")), 6).alias("length"))


@query("SELECT count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents")
def totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def unchanged_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query()
def reindex_plan(spark, sf_dir):
    """Every third document is known, one in five of these in an older version."""
    rows = docs(spark, sf_dir)
    state = rows.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id").cast("long") % 5 == 0, "old").otherwise(F.sha1(F.col("text").cast("binary"))).alias("sha1"))
    stored = chunks.search_chunks(rows.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("page"), "text"), P)
    return retrieval.reindex(rows, state, stored, P)[0].groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


STORED = SEARCH.replace("FROM documents)", "FROM stored)", 1)


@query(
    "WITH stored AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'again ' || text ELSE text END AS text FROM documents WHERE doc_id % 5 <> 1),"
    + STORED
    + " SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"
)
def stored_index(spark, sf_dir):
    """A stored index of all documents, of which every fourth is put in again in a new version and every fifth is taken out, then searched."""
    folder = tempfolder(spark, "keyword-index")
    rows = docs(spark, sf_dir)
    number = F.col("doc_id").cast("long")
    made = lambda some: chunks.word_windows(some).select(ids.bm25_chunk_id(F.col("doc_id"), F.lit(1), F.col("window")).alias("chunk_id"), "doc_id", F.col("chunk").alias("text"))
    store.write_index(made(rows), folder)
    new = rows.where((number % 4 == 0) & (number % 5 != 1)).withColumn("text", F.concat(F.lit("again "), "text"))
    store.upsert_index(made(new), folder, gone=rows.where(number % 5 == 1))
    asked = items(spark, sf_dir)
    return search.keyword_top(store.read_index(spark, folder, asked), asked, 10)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items answered from the documents: top chunks, one for each document, with citations."""
    rows = windows_of_documents(spark, sf_dir)
    index = retrieval.Index(search.keyword_index(rows, P), rows)
    found = retrieval.hybrid(index, items(spark, sf_dir), P)
    return found.select("query_id", "place", "doc_id", "chunk_id", context.citation(F.col("doc_id"), F.col("page_start"), F.col("page_end")).alias("citation"))
