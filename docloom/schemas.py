"""Schemas of the tables that the engine reads and writes."""

from pyspark.sql import types as T

_f = T.StructField
PAGE = T.StructType([_f("doc_id", T.StringType()), _f("page", T.IntegerType()), _f("text", T.StringType()), _f("source_path", T.StringType())])
MANIFEST_DOC = T.StructType(
    [_f(n, T.StringType()) for n in ("doc_id", "source_path", "lang", "sha1", "ocr_mode", "ocr_backend", "ocr_lang")]
    + [_f("ocr", T.BooleanType())]
    + [_f(n, T.IntegerType()) for n in ("pages", "dpi", "min_chars", "empty_pages")]
)
MANIFEST = T.StructType([_f("docs", T.ArrayType(MANIFEST_DOC))])
STATE = T.MapType(T.StringType(), T.StringType())
HIT_META = T.StructType([_f("doc_id", T.StringType()), _f("page", T.IntegerType()), _f("child_idx", T.IntegerType())])
CONTEXT_ITEM = T.StructType([_f("doc_id", T.StringType()), _f("page_start", T.IntegerType()), _f("page_end", T.IntegerType()), _f("text", T.StringType())])
ERROR = T.StructType([_f("type", T.StringType()), _f("explain", T.StringType())])
RESULT = T.StructType(
    [
        _f("critical_errors", T.ArrayType(ERROR)),
        _f("recommendations", T.ArrayType(T.StringType())),
        _f("citations", T.ArrayType(T.StringType())),
        _f("disclaimer", T.StringType()),
        _f("meta", T.MapType(T.StringType(), T.StringType())),
        _f("free_text", T.StringType()),
    ]
)
_CITE = T.ArrayType(T.StructType([_f("doc_id", T.StringType()), _f("pages", T.ArrayType(T.IntegerType()))]))
_SUB = ("diagnosis", "med_choice", "dose", "interactions", "contraindications", "monitoring")
SCORED = T.StructType(
    [
        _f("score", T.IntegerType()),
        _f("subscores", T.StructType([_f(n, T.IntegerType()) for n in _SUB])),
        _f("critical_errors", T.ArrayType(T.StructType([_f("type", T.StringType()), _f("explain", T.StringType()), _f("citations", _CITE)]))),
        _f("recommendations", T.ArrayType(T.StructType([_f("what_to_change", T.StringType()), _f("rationale", T.StringType()), _f("citations", _CITE)]))),
        _f("citations", T.ArrayType(T.StructType([_f("doc_id", T.StringType()), _f("pages", T.ArrayType(T.IntegerType())), _f("quote", T.StringType())]))),
        _f("disclaimer", T.StringType()),
    ]
)
_PLAIN = ("diagnosis", "therapy", "dosage", "interactions", "evidence")
PLAIN_SCORED = T.StructType(
    [
        _f("score", T.IntegerType()),
        _f("subscores", T.StructType([_f(n, T.IntegerType()) for n in _PLAIN])),
        _f("critical_errors", T.ArrayType(T.StructType([_f(n, T.StringType()) for n in ("severity", "message", "why")]))),
        _f("recommendations", T.ArrayType(T.StringType())),
        _f("citations", T.ArrayType(T.StructType([_f(n, T.StringType()) for n in ("source", "section", "page")]))),
    ]
)
