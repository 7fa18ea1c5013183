"""The corpus pipeline: quality rules, line deduplication, near duplicates, mixing, SentencePiece encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the docs of the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.chosen_path import one_of_each
from docloom.llm.common import temporary
from docloom.llm.lines import dedup_lines
from docloom.llm.mixing import mixed_documents
from docloom.llm.quality import judged
from docloom.llm.queries import model_file, other_vocabularies
from docloom.llm.sentencepiece_codec import encode_decode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rules or lie outside the bands of a vocabulary.

    Null and empty texts have no words and go; a null language is judged by script; repeated rows are judged alike;
    other nulls play no part; an empty table stays empty.
    """
    kept = judged(docs.select(*COLUMNS), model_file(), keep=COLUMNS, others=other_vocabularies())
    return kept.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; n_chars follows the text.

    No row goes.  A null text stays null with its n_chars; the first by id (null last) keeps its lines; of repeated
    rows one does; an empty table stays empty.
    """
    clean = dedup_lines(docs.select(*COLUMNS)).select(*COLUMNS)
    return clean.selectExpr("doc_id", "text", "lang", "source", "CASE WHEN text IS NULL THEN n_chars ELSE CAST(length(text) AS BIGINT) END AS n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the least id (null last).

    Texts without words (null, empty, blank) are near nothing and stay; repeated rows are one class; an empty table
    stays empty.
    """
    return one_of_each(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them in whole or in part, in the order of its slots.

    A null source is one of its own; texts without words are never taken; repeated rows are documents of their own;
    rows that tie are ordered by a hash; an empty table stays empty.
    """
    return mixed_documents(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids (little-endian 32-bit integers), their number and the text decoded from them.

    Null and empty texts have the begin and end ids only and decode to ''; each row is by itself, repeated rows are
    encoded alike; an empty table stays empty.
    """
    return encode_decode(docs.select(*COLUMNS), model_file(), keep=COLUMNS)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, one after the other through tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = temporary(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the tokeniser nor the chosen paths; tests hold the stages against brute force.
ORACLE_SQL = None
