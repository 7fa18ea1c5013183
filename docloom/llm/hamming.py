"""Exact nearest binary codes by multi-index hashing with growing segment radii.

A code is cut into segments.  Once every segment has been searched to radius r, all codes within
segments * (r + 1) - 1 bits have been met: a code farther off differs in more than r bits of each segment.  With
the first n segments searched to radius r + 1 besides, the bound grows by n.  So a query whose kth verified
distance is d needs only the first d - segments * (r + 1) + 1 segments of the next radius, and is done once the
bound covers d.  Radii grow, query by query; queries that are done take no further part.  No other search stands
beside the index.

A probe meets a code in the first segment, of those of least distance, that is searched: which one this is can be
told from the two codes, so what has been met before is never met again and nothing has to be made distinct.

Equal codes are one entry with its k least ids (ties go to the least id, so no other can be in a result): a code
that a third of all rows have is one entry of the index.  A segment value that many codes share is dealt out in
parts; a directory of the values that exist sends each probe to the parts of its value, or nowhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BITS = 64
#: Codes of one segment value that one part of the index holds.
PART = 4096


def sign_code(vector: str) -> Column:
    """64 bits as a long: bit i is set if component i is positive; missing components count as not positive. Null for a null vector."""
    bit = F.transform(vector, lambda x, i: F.when((x > 0) & (i < BITS), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.col(vector).isNotNull(), F.aggregate(F.filter(bit, lambda b: b.isNotNull()), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def segment_widths(codes: int, bits: int | None = None) -> list[int]:
    """Widths of the segments: about log2 of the number of codes, less 2 as a probe costs more than a comparison; 8 to 22 bits."""
    about = bits or min(22, max(8, math.ceil(math.log2(max(codes, 2))) - 2))
    parts = math.ceil(BITS / about)
    return [BITS // parts + (k < BITS % parts) for k in range(parts)]


def _masks(widths: list[int]) -> list[int]:
    starts = [sum(widths[:k]) for k in range(len(widths))]
    return [((1 << w) - 1) << s for w, s in zip(widths, starts)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def segments(code: Column, widths: list[int]) -> Column:
    """(place, width, value) of each segment."""
    starts = [sum(widths[:k]) for k in range(len(widths))]
    return F.array(*[F.struct(F.lit(p).alias("place"), F.lit(w).alias("width"), F.shiftrightunsigned(code, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("value")) for p, (w, s) in enumerate(zip(widths, starts))])


def probes(asked: DataFrame, widths: list[int], radius: int) -> DataFrame:
    """(q, need, place, value): the first ``need`` segments of each query with exactly ``radius`` bits flipped, each bit above the one flipped before."""
    out = asked.select("q", "need", F.explode(segments(F.col("q"), widths)).alias("x")).where("x.place < need").select("q", "need", "x.place", "x.width", "x.value", F.lit(-1).alias("top"))
    for left in range(radius - 1, -1, -1):
        out = (
            out.where(F.col("top") + 1 <= F.col("width") - 1 - left)
            .withColumn("bit", F.explode(F.expr(f"sequence(top + 1, width - 1 - {left})")))
            .select("q", "need", "place", "width", F.expr("value ^ shiftleft(1L, bit)").alias("value"), F.col("bit").alias("top"))
        )
    return out.select("q", "need", "place", "value")


def first_met(widths: list[int], radius: int) -> Column:
    """Whether (q, need, place) is where a probe first meets ``code``: no segment is nearer, and none before it is as near."""
    apart = F.col("q").bitwiseXOR(F.col("code"))
    distance = [F.bit_count(apart.bitwiseAND(_long(m))) for m in _masks(widths)]
    out = F.lit(True)
    for p, d in enumerate(distance):
        out = out & F.when(F.col("place") > p, d > radius).otherwise(d >= radius)
    return out


def nearest_codes(base: DataFrame, queries: DataFrame, *, k: int = 10, bits: int | None = None, rounds: list | None = None) -> DataFrame:
    """For each row of ``queries`` (query_id, code) its k nearest rows of ``base`` (id, code) but for that with its own id: query_id, rank, id, distance.

    Nearest by Hamming distance of 64-bit codes, then least id.  Rows with a null code or id take no part.
    Repeated ids count once for each code.  Fewer than k rows give as many as there are.  Queries with equal
    codes are searched once.  Other columns play no part.  ``rounds``, where given, gets (radius, queries still
    open after it) of each round.
    """
    rows = base.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    # a query may meet itself, so one id more than k stands for a code
    first = Window.partitionBy("code").orderBy("id")
    entries = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = staged(entries.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    total = entries.count()
    widths = segment_widths(total, bits)
    asked = staged(queries.where("query_id IS NOT NULL AND code IS NOT NULL").select("query_id", "code").distinct(), "code-queries")
    placed = entries.select("code", F.get("ids", F.lit(0)).alias("lead"), F.size("ids").alias("m"), F.explode(segments(F.col("code"), widths)).alias("x")).select("code", "lead", "m", "x.place", "x.value")
    directory = staged(placed.groupBy("place", "value").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "code-directory")
    dealt = placed.join(directory.hint("merge"), ["place", "value"]).withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    index = staged(dealt.select("place", "value", "part", "code", "lead", "m"), "code-index")
    open_ = staged(asked.select(F.col("code").alias("q")).distinct().withColumn("need", F.lit(len(widths))), "code-open")
    best = Window.partitionBy("q").orderBy("d", "lead")
    upto = F.sum("m").over(best.rowsBetween(Window.unboundedPreceding, 0))
    ended: list[DataFrame] = []
    known, radius = None, 1
    while total and open_.take(1):
        # the index meets the probes, which are many: neither side is ever sent to all tasks
        met = None
        for r in (0, 1) if radius == 1 else (radius,):
            ways = probes(open_, widths, r).join(directory.hint("merge"), ["place", "value"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
            some = ways.join(index.hint("merge"), ["place", "value", "part"]).where(first_met(widths, r)).select("q", "code", "lead", "m", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("d"))
            met = some if met is None else met.unionByName(some)
        if known is not None:
            met = met.unionByName(known.join(open_.hint("merge"), "q", "left_semi"))
        known = staged(met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "codes-met")
        # the kth (with the query itself, k + 1st) verified id must lie within what is covered, or every code there is be met
        kth = known.withColumn("upto", upto).groupBy("q").agg(F.min(F.when(F.col("upto") >= k + 1, F.col("d"))).alias("kth"), F.count(F.lit(1)).alias("n"))
        bound = len(widths) * radius - 1 + F.col("need")
        done = F.coalesce(F.col("kth") <= bound, F.lit(False)) | F.coalesce(F.col("n") == total, F.lit(False)) | F.lit(radius >= max(widths))
        checked = staged(open_.join(kth.hint("merge"), "q", "left").select("q", "kth", done.alias("done")), "code-checked")
        need = F.least(F.lit(len(widths)), F.coalesce(F.col("kth"), F.lit(BITS)) - len(widths) * (radius + 1) + 1)
        open_ = staged(checked.where("NOT done").select("q", need.alias("need")), "code-open")
        ended.append(known.join(checked.where("done").hint("merge"), "q", "left_semi"))
        if rounds is not None:
            rounds.append((radius, open_.count()))
        radius += 1
    if not ended:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(0).alias("distance")).limit(0)
    found = ended[0]
    for x in ended[1:]:
        found = found.unionByName(x)
    listed = found.select("q", "code", "d").join(entries.hint("merge"), "code").select("q", "d", F.explode("ids").alias("id"))
    answers = asked.join(listed.hint("merge"), asked.code == listed.q).where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id", "q").orderBy("d", "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("d").cast("int").alias("distance"))
