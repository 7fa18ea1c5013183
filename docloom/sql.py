"""The engine's functions for spark.sql: python sessions register them, SQL calls them by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import unicode as U
from .sources import files

#: SQL functions whose bodies are SQL themselves, so the optimizer sees through them.
BODIES = {
    "doc_words(t STRING) RETURNS ARRAY<STRING>": r"filter(split(coalesce(t, ''), '(?U)\\s+'), w -> w <> '')",
    "doc_terms(t STRING) RETURNS ARRAY<STRING>": r"filter(split(lower(coalesce(t, '')), '[^\\p{L}\\p{N}_]+'), w -> w <> '')",
    "doc_text_hash(t STRING) RETURNS STRING": r"sha1(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(t, '')), '(?U)\\s+', ' '), '[^0-9a-zа-яё %/.,;:()\\-\n]+', ' '), '(?U)^\\s+|\\s+$', ''))",
    "rrf_term(place INT) RETURNS DOUBLE": "1 / (60 + place)",
    "doc_citation(d STRING, a INT, b INT) RETURNS STRING": "concat(coalesce(d, 'unknown'), ' стр.', coalesce(a, 1), '-', coalesce(b, a, 1))",
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions as temporary ones; their names."""
    names = []
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.partition("(")[0])
    for name, f in (("nfkc", U.nfkc), ("html_text", files.html_text), ("docx_text", files.docx_text)):
        spark.udf.register(name, f)
        names.append(name)
    return names
