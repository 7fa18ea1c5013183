"""SentencePiece encoding and decoding of whole texts with a merge-type model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced, texts, tidy
from .pieces import table

CODEC = T.StructType(
    [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids", T.BinaryType(), False),
        T.StructField("decoded", T.StringType(), False),
    ]
)


def encode_decode(docs: DataFrame, model_file: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bounds: bool = True, decode: bool = True) -> DataFrame:
    """The columns ``keep``, then ``n_tokens``, ``ids`` (little-endian 32-bit integers, one after the other) and ``decoded`` for each row.

    Ids equal those of the sentencepiece library (no sampling); ``bounds`` adds its begin and end ids.
    ``decoded`` is what the library's decode(ids) returns ('' if not ``decode``).  A null or empty text has
    the begin and end ids only and decodes to ''.  Each row is by itself: repeated rows give equal results,
    no row is dropped, and other columns play no part.  ``model_file`` must be at that path on every executor.
    """
    fields = [docs.schema[c] for c in keep]

    @tidy(table)
    def run(batches):
        pieces = table(model_file)
        begin, end = (np.array([i], "<u4").tobytes() if bounds else b"" for i in (pieces.bos, pieces.eos))
        for batch in sliced(batches, 128):
            ids = [begin + x + end for x in pieces.encode_all(texts(batch, text))]
            decoded = [pieces.decode(np.frombuffer(x, "<u4")) for x in ids] if decode else [""] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                names=[*keep, *CODEC.names],
            )

    columns = list(dict.fromkeys([*keep, text]))
    return docs.select(*columns).mapInArrow(run, T.StructType(fields + CODEC.fields))
