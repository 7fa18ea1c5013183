"""One query for each operator: (spark, sf_dir) -> DataFrame over the whole intended table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chosen_path import near_duplicates
from .hamming import nearest_codes, sign_code
from .html_content import main_text
from .lines import dedup_lines
from .mixing import mix
from .passages import repeated_passages
from .pii import personal_data
from .quality import judged
from .sentencepiece_codec import encode_decode
from .warc import archive, read_archive

#: Path of the tokenizer's model on every executor; a parameter of the operators.
MODEL = "piece_bpe_32k.model"


def model_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


def other_vocabularies() -> dict[str, str]:
    """Vocabularies of op 2 beside MODEL: names in its bands and paths.

    ``byte_bpe_50k`` has bands, too (name ``byte``), but a third vocabulary takes op 2 beyond its CPU budget.
    """
    import public_tokenizers

    return {"multi": str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(documents(spark, sf_dir)).taken
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "slot")


OP1 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][sid % 3 + 1] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS every FROM s),
r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY source_size / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER (ORDER BY source_size / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM w),
f AS (SELECT *, cap * rest_w <= (every - caps) * w AS filled FROM r),
t AS (
  SELECT source, source_size,
         CASE WHEN filled THEN cap ELSE (every - coalesce(sum(CASE WHEN filled THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT filled THEN w END) OVER () END AS target
  FROM f),
o AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS lo
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT t.source, source_size, CAST(floor(target + 0.5) AS BIGINT) AS quota, s.sid, (source_size + 1023) // 1024 AS blocks
  FROM t JOIN s USING (source_size) WHERE t.source IS NOT DISTINCT FROM s.source AND floor(target + 0.5) > 0),
n AS (SELECT *, quota // source_size AS rounds, quota % source_size AS rest, (quota // source_size) * blocks + (quota % source_size + 1023) // 1024 AS slots FROM q),
i AS (SELECT *, CAST(sum(slots) OVER (ORDER BY sid) AS BIGINT) AS upto, CAST(sum(slots) OVER () AS BIGINT) AS every FROM n),
g AS (
  SELECT x.slot, least(CAST(floor((((x.slot & 2147483647) * 2654435769) & 4294967295) * (CAST(m.every AS DOUBLE) / CAST(4294967296 AS DOUBLE))) AS BIGINT), m.every - 1) AS p
  FROM (SELECT max(every) AS every FROM i) m, LATERAL (SELECT unnest(range(m.every)) AS slot) x),
k AS (SELECT i.sid, g.slot, row_number() OVER (PARTITION BY i.sid ORDER BY g.slot) - 1 AS rank FROM g JOIN i ON g.p >= i.upto - i.slots AND g.p < i.upto),
z AS (
  SELECT sid, slot, rank FROM k
  UNION ALL
  SELECT i.sid, i.every + i.upto - i.slots + y.rank, y.rank
  FROM (SELECT i.*, (SELECT count(*) FROM k WHERE k.sid = i.sid) AS got FROM i) i, LATERAL (SELECT unnest(range(i.got, i.slots)) AS rank) y),
b AS (
  SELECT i.source, z.slot, (z.rank % i.blocks) * 1024 AS b0,
         (z.rank % i.blocks) * 1024 + least(1024, CASE WHEN z.rank // i.blocks < i.rounds THEN i.source_size ELSE i.rest END - (z.rank % i.blocks) * 1024) AS b1
  FROM z JOIN i ON z.sid = i.sid WHERE z.rank < i.slots),
f1 AS (SELECT o.source AS src, o.lo AS at, min(b.slot) AS slot FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source AND b.b0 < o.lo + o.size AND o.lo < b.b1 AND o.size > 0 GROUP BY o.source, o.lo)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE CAST((quota // source_size) * size + greatest(0, least(lo + size, quota % source_size) - lo) AS BIGINT) END AS taken,
       CAST(f1.slot AS BIGINT) AS slot
FROM o LEFT JOIN f1 ON o.source IS NOT DISTINCT FROM f1.src AND o.lo = f1.at AND o.size > 0
"""


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), model_file(), others=other_vocabularies())


def op3_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_lines(documents(spark, sf_dir))
    return clean.select("doc_id", "text", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


OP3 = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
n AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
j AS (SELECT doc_id, k, norm, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j FROM n WHERE norm <> ''),
w AS (SELECT a.doc_id, a.j, a.k AS k1, b.k AS k2, a.norm || chr(10) || b.norm AS run FROM j a JOIN j b ON a.doc_id = b.doc_id AND b.j = a.j + 1),
f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY run ORDER BY doc_id, j) AS doc1, first_value(j) OVER (PARTITION BY run ORDER BY doc_id, j) AS j1 FROM w),
c AS (SELECT doc_id, k1, k2 FROM f WHERE doc1 <> doc_id OR j1 + 2 <= j),
g AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, k1 AS k FROM c UNION ALL SELECT doc_id, k2 FROM c)),
m AS (SELECT l.doc_id, l.k, l.line, g.k IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.k = g.k),
a AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS clean, CAST(count(*) AS BIGINT) AS n_lines,
         CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE gone), '') AS removed
  FROM m GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE a.clean END AS text, n_lines, n_removed, removed FROM a JOIN documents d ON a.doc_id = d.doc_id
"""


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    asked = codes.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return nearest_codes(codes, asked, k=10).withColumnRenamed("id", "vec_id")


OP4 = """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS bits FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, b.bits), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance
  FROM s q JOIN s b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op5_html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(pages(spark, sf_dir)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(documents(spark, sf_dir), model_file())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op8_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    digest = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("formats", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in ("email", "ip", "card", "phone")], F.sha2(digest("formats").cast("binary"), 256).alias("base_sha256"), digest("spans").alias("spans"), added("secret"), F.size("spans").cast("long").alias("n_spans"))


def op9_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(documents(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_chars", "n_removed", spans.alias("spans"))


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = archive(pages(spark, sf_dir))
    return read_archive(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_tokeniser_fertility": op2_tokeniser_fertility,
    "op3_line_winnowing": op3_line_winnowing,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_html_regions": op5_html_regions,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_chosen_path_join": op7_chosen_path_join,
    "op8_candidate_boosting": op8_candidate_boosting,
    "op9_paragraph_bands": op9_paragraph_bands,
    "op10_warc_normaliser": op10_warc_normaliser,
}
ORACLE_SQL = {"op1_source_mix": OP1, "op3_line_winnowing": OP3, "op4_multi_index_hashing": OP4}
