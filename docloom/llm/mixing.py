"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points run through the sources' cumulative weights and deal out slots; a source's slots are ranked
in the order of the schedule, and rank r takes the source's block r (round and round again).  Blocks are equal
runs of words of the source's documents in shuffled order.  A document's ``slot`` is the first that takes words of
it: read by slot, every stretch of the mix has the sources in their shares.

Limit: what there is of a source (its sizes, target, slots) is one row, and windows run over these rows in one task.

DataFrame functions only.  Nothing is gathered but two scalars; ranks and offsets come from two levels of
counts, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import name_of, staged, text_of, word_count

#: 2^32 over the golden ratio, odd: i * GOLDEN mod 2^32 is the i-th point.
GOLDEN = 2654435769
#: Slots ranked within one chunk.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Mix:
    """targets: a row for each source (sid, source, size, target, quota).  schedule: a row for each slot (slot, sid,
    epoch, block, tokens).  taken: a row for each document (id, source, size, source_size, target, taken, slot).
    slots: numbers below which all slots lie."""

    targets: DataFrame
    schedule: DataFrame
    taken: DataFrame
    slots: int


def source_targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """Targets for the sources of ``sizes`` (source, size): sid, source, source_size, target, quota.

    Sources by code point, null last, have the weights in turn and share all sizes; a target stops at ``most``
    times its source's size and the excess is shared again by weight.  That ends with the sources of least
    size to weight at their limits: sorted by this ratio, they are a prefix.  One row for each source; the
    windows over all of them read that table only.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ratio = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("sid").asc())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", (F.row_number().over(by_source) - 1).cast("long"))
        .withColumn("w", weight.cast("double"))
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("all_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("caps", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("rest_w") <= (F.col("all_size") - F.col("caps")) * F.col("w"))
        .withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("free_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise((F.col("all_size") - F.col("full_cap")) * F.col("w") / F.col("free_w")))
        .withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    )
    return s.select("sid", "source", "source_size", "target", "quota")


def div(a: str, b: str) -> Column:
    return F.expr(f"CAST(({a}) div ({b}) AS BIGINT)")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """The slots: slot, sid, epoch, block, tokens (words that the slot takes from the start of its block)."""
    b = str(block)
    t = (
        targets.where("quota > 0")
        .withColumn("blocks", div(f"source_size + {b} - 1", b))
        .withColumn("rounds", div("quota", "source_size"))
        .withColumn("rest", F.expr("quota - (quota div source_size) * source_size"))
        .withColumn("slots", F.col("rounds") * F.col("blocks") + div(f"rest + {b} - 1", b))
        .withColumn("upto", F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("upto") - F.col("slots"))
    )
    total, sources = t.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    cells = max(1024, 1 << math.ceil(math.log2(4 * sources + 1)))
    width = max(1, -(-total // cells))
    # interval of each source, cut at the cells of a grid, so that points find it by an equal cell
    grid = t.withColumn("cell", F.explode(F.sequence(div("start", str(width)), div("upto - 1", str(width))))).select("cell", "sid", "start", "upto")
    points = (
        t.sparkSession.range(total)
        .withColumn("u", F.expr(f"((id & {(1 << 31) - 1}) * {GOLDEN}) & {(1 << 32) - 1}"))
        .withColumn("p", F.least(F.floor(F.col("u") * (total / (1 << 32))).cast("long"), F.lit(total - 1)))
        .withColumn("cell", div("p", str(width)))
    )
    dealt = points.join(grid, "cell").where("p >= start AND p < upto").select(F.col("id").alias("slot"), "sid", div("id", str(CHUNK)).alias("chunk"))
    counts = dealt.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))).join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("k") - 1).alias("rank"))
    # the points give each source its slots but for a few: it takes what lacks at the end
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    late = (
        t.join(got, "sid", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .where("got < slots")
        .select((F.lit(total) + F.col("start")).alias("slot"), "sid", F.explode(F.expr("sequence(got, slots - 1)")).alias("rank"))
        .select((F.col("slot") + F.col("rank")).alias("slot"), "sid", "rank")
    )
    s = ranked.unionByName(late).join(t.select("sid", "slots", "blocks", "rounds", "rest", "source_size"), "sid").where("rank < slots")
    s = s.withColumn("epoch", div("rank", "blocks")).withColumn("block", F.expr("rank - (rank div blocks) * blocks"))
    left = F.when(F.col("epoch") < F.col("rounds"), F.col("source_size")).otherwise(F.col("rest")) - F.col("block") * block
    return s.select("slot", "sid", "epoch", "block", F.least(F.lit(block).cast("long"), left).alias("tokens"))


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1), most: int = 3, block: int = 1024, seed: str = "mix") -> Mix:
    """Mix all rows of ``docs``; sizes are words, a null text has none and is never taken.

    Sources get exactly the words of their targets (rounded).  A null source is a source of its own, a null id
    is shuffled as any other.  Repeated rows are separate documents.  Rows tie only if they agree in id, source
    and size, and then it makes no difference which is which, so reruns agree.  An empty table gives no rows.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit("null"))).cast("binary"))
    sizes = staged(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), key.alias("h")), "mix-sizes")
    targets = staged(source_targets(sizes, weights, most), "mix-targets")
    slots = staged(schedule(targets, block), "mix-slots")
    # shuffled order of each source: buckets of leading digits, then the whole key
    buckets = 1 << max(1, math.ceil(math.log2(sizes.count() + 1) / 2))
    s = (
        sizes.withColumn("bucket", F.expr(f"shiftright(cast(conv(substring(h, 1, 7), 16, 10) AS BIGINT) * {buckets}, 28)"))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of", "quota")
    )
    sums = s.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    starts = sums.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "id", "size")
    placed = (
        s.withColumn("row", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["sid", "bucket"])
        .withColumn("lo", F.col("start") + F.col("upto") - F.col("size"))
        .drop("h", "upto", "start")
    )
    spans = F.when(F.col("size") > 0, F.sequence(div("lo", str(block)), div("lo + size - 1", str(block))))
    pieces = placed.withColumn("block", F.explode_outer(spans))
    got = F.least(F.col("lo") + F.col("size"), F.col("block") * block + F.col("tokens")) - F.greatest(F.col("lo"), F.col("block") * block)
    taken = (
        pieces.join(slots.select("sid", "block", "tokens", "slot"), ["sid", "block"], "left")
        .groupBy("sid", "bucket", "row", "id", "source", "size", "source_size", "target")
        .agg(F.sum(F.when(F.col("tokens").isNull(), 0).otherwise(F.greatest(got, F.lit(0)))).cast("long").alias("taken"), F.min(F.when(got > 0, F.col("slot"))).alias("slot"))
        .drop("sid", "bucket", "row")
    )
    return Mix(targets, slots, taken, 1 + (slots.agg(F.max("slot")).first()[0] or 0))


def mixed_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, each as often as it takes it in whole or in part: ceil(taken / size) times, one after the other.

    Partitions are equal stretches of the schedule, and rows in them are sorted by slot.  Rows with equal id, source
    and size are matched in the order of hashes of their texts.  An empty table gives no rows; rows without words
    are never taken.
    """
    m = mix(docs, id=id, text=text, source=source, **options)
    spark = docs.sparkSession
    key = lambda i, s, n: [i.alias("__i"), s.alias("__s"), n.alias("__n")]
    taken = m.taken.where("taken > 0").select(*key(name_of("id"), name_of("source"), F.col("size")), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("__copies"), F.col("slot").alias("__slot"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *key(name_of(id), name_of(source), word_count(text)), F.xxhash64(text_of(text)).alias("__h")).where("__n > 0")
    # one dealing by id, source and size for both, and both are numbered in it: texts move once to meet what is taken of them
    both = rows.unionByName(taken, allowMissingColumns=True).withColumn("__of", F.col("__row").isNull())
    turn = Window.partitionBy("__i", "__s", "__n", "__of").orderBy(F.col("__copies").desc(), "__slot", "__h")
    meet = Window.partitionBy("__i", "__s", "__n", "__t")
    both = both.repartition("__i", "__s", "__n").withColumn("__t", F.row_number().over(turn))
    both = both.withColumns({"__many": F.max("__copies").over(meet), "__at": F.max("__slot").over(meet)}).where("NOT __of AND __many > 0")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.expr(f"cast(__at * {parts} div {m.slots} as int)")
    out = both.select("__row", "__at", F.explode(F.expr("sequence(1, __many)")).alias("__copy"), "__i").withColumn("__part", place)
    return out.repartitionById(parts, F.col("__part")).sortWithinPartitions("__at", "__i", "__copy").select("__row.*")
