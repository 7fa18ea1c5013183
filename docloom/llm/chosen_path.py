"""N-gram Jaccard join by chosen paths.

A set picks, by hash functions that all sets share, each of its tokens with probability 1 / (branch * size): a
similar pair picks a common token with a probability that depends on its similarity only.  A set descends into
the bucket of each token that it picks; buckets that stay crowded are split again by tokens that are picked by
the path so far.  Small buckets are compared outright.  Independent runs are repeated until a pair at the least
similarity is missed with probability 1 - recall at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHINGLE, SIMILAR, sliced, staged, texts, tidy
from .similar import FEATURES, Rows, U, digest, mixed, packed, resolve, shingles, signature, stream

#: Sets pick 1 / BRANCH tokens each on average.
BRANCH = 0.8


#: Levels of buckets.
DEPTH = 3


def repeats(similar: float, recall: float, depth: int = DEPTH) -> int:
    """Runs needed: a pair shares at least ``similar`` of the larger set, so a level is survived as a branching process of that mean over BRANCH."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-similar / BRANCH * p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def picks(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Keys of the tokens picked in each run."""
    limit = 1 / (BRANCH * len(s))
    out = []
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            h = mixed(s[at : at + 4096, None] ^ seeds)
            if limit < 1:
                row, run = np.nonzero(h <= U(int(limit * (2**64 - 1))))
            else:
                row, run = np.nonzero(np.ones(h.shape, bool))
            out.append(mixed(h[row, run] + seeds[run]))
    return np.concatenate(out).view(np.int64)


def deeper(s: np.ndarray, key: int, level: int) -> np.ndarray:
    """Keys one level below a bucket."""
    seed = mixed(np.array([key], np.int64).view(U) + U(level))
    return picks(s, seed)


def features(docs: DataFrame, id: str, text: str, runs: int, shingle: int = SHINGLE) -> DataFrame:
    seeds = stream(7, runs)

    @tidy()
    def run(batches):
        rows = Rows()
        for batch in sliced(batches):
            columns: list[list] = [[] for _ in range(6)]
            for value in texts(batch, text):
                s = shingles(value.encode("utf-8", "surrogatepass").split(), shingle)
                row = (rows.take(), digest(s), len(s), signature(s), packed(s), picks(s, seeds)) if len(s) else (rows.take(), None, 0, None, None, [])
                for c, v in zip(columns, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(id)] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], names=["id", *FEATURES.names])

    schema = T.StructType([T.StructField("id", docs.schema[id].dataType)] + FEATURES.fields)
    return staged(docs.select(*dict.fromkeys([id, text])).mapInArrow(run, schema), "near-features")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", similar: float = SIMILAR, recall: float = 0.9999, shingle: int = SHINGLE, bucket: int = 1024, group: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: id, class_id, n_links, copy (0 for one row of each class, that with its id).

    Two rows are linked if the Jaccard similarity of their five-word shingles is ``similar`` or more; classes are
    connected components, named by their least id; n_links counts a row's linked rows, copies included.  Texts of
    fewer than five words are one shingle; texts without words (null, empty, blank) are linked with nothing and
    have their own id as class.  Repeated rows are copies.  A null id counts as a row; a class without another id
    has a null class_id.
    """
    rows = features(docs, id, text, repeats(similar, recall), shingle)
    classes = staged(resolve(rows, similar=similar, split=deeper, depth=DEPTH, bucket=bucket, group=group), "near-classes")
    named = rows.select("id", "uid", "rid").join(classes.select("rid", "copies", "links", "root").hint("merge"), "rid", "left")
    named = staged(named.select("id", "uid", F.coalesce("root", "uid").alias("root"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")), "near-rows")
    # written before it meets the rows, so that Spark can split the join where a class has very many rows
    first = staged(named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("uid"))).alias("first")), "near-firsts")
    return named.join(first.hint("merge"), "root").select("id", F.col("first.id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"), F.when(F.col("first.uid") == F.col("uid"), 0).otherwise(1).alias("copy"))


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one of each class does: that with the least id; of repeated rows with this id, one."""
    from pyspark.sql import Window

    from .common import name_of

    found = near_duplicates(docs, id=id, text=text, **options).where("copy = 0").groupBy(name_of("id").alias("__i")).agg(F.count(F.lit(1)).alias("__n"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), name_of(id).alias("__i"))
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__i").orderBy(F.xxhash64(F.col(f"__row.{text}")))))
    return rows.join(found, "__i").where("__k <= __n").select("__row.*")
