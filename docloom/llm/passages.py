"""Removal of repeated passages: paragraphs by MinHash bands, passages inside long paragraphs by equal pieces.

Paragraphs are lines.  They collide in a band of MinHash values; of those that do, features are read, they are
verified by exact Jaccard similarity of their five-word shingles, and form classes by connected components; of each
class the first paragraph stays.  A passage inside a longer line is no paragraph, so lines of more than ``long``
words are also cut where the words themselves say so (at local minima of a hash of two words, within RADIUS
words either side): equal passages are cut alike wherever they stand.  The words that decide a cut are a piece;
equal pieces are seeds, and each is extended both ways for as long as it equals the first place of its piece: as
a whole up to the ends of the next cuts' pieces where a hash says so, else word by word.  Up to there is far
enough: where both are cut alike, the next piece is a seed, too.  Repeats that touch are one span; a span goes if
it is long enough.

Words, hashes, minima and cuts are worked out for a whole batch of texts at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILAR, staged, text_of
from .similar import Rows, U, met, mixed, mixed_low, packed, resolve, sieve, signature, stream
from .words import Words, slices

#: Words either side that decide whether a line is cut at a word.
RADIUS = 5
#: MinHash values of a band.
BAND = 2


LINE, PIECE = 1, 2


def bands(similar: float, recall: float) -> int:
    """Bands needed for a pair at the least similarity to collide with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**BAND))


def band_keys(s: np.ndarray, start: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A row of keys for each of the sets s[start:next start]."""
    keys = np.zeros((len(places) // BAND, len(start)), U)
    if len(start):
        with np.errstate(over="ignore"):
            for k, place in enumerate(places):
                least = np.minimum.reduceat(mixed_low(s * place), start)
                keys[k // BAND] = mixed(keys[k // BAND] * U(0x9E3779B97F4A7C15) + least)
            keys = mixed(keys + np.arange(len(keys), dtype=U)[:, None])
    return np.ascontiguousarray(keys.T).view(np.int64)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - before, size)


def pieces(w: Words, long: int):
    """Of each piece of the long lines: its line, the words from and up to which it goes, and those up to which it is extended."""
    n = len(w) - 1
    if n < 2 * RADIUS + 1:
        return (np.empty(0, np.int64),) * 5
    two = w.runs(2)
    least = np.ones(n, bool)
    for d in range(1, RADIUS + 1):
        least[d:] &= two[d:] < two[:-d]
        least[:-d] &= two[:-d] <= two[d:]
    line = w.line()
    c = np.flatnonzero(least)
    own = line[c]
    inside = (c - RADIUS >= w.first[own]) & (c + RADIUS + 2 <= w.last[own]) & (w.last[own] - w.first[own] > long)
    c, own = c[inside], own[inside]
    a, b = c - RADIUS, c + RADIUS + 2
    same = own[1:] == own[:-1]
    lo, hi = w.first[own], w.last[own]
    lo[1:] = np.where(same, a[:-1], lo[1:])
    hi[:-1] = np.where(same, b[1:], hi[:-1])
    return own, a, b, lo, hi


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


UNITS = {
    "doc": "long",
    "key": "binary",
    "n": "int",
    "lines": "array<struct<start:int,end:int,h:long,keys:array<long>>>",
    "pieces": "array<struct<start:int,end:int,lo:int,hi:int,h:long,g:long>>",
}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def lists(owner: np.ndarray, rows: int, fields: dict[str, pa.Array]) -> pa.Array:
    """Records by their (sorted) owners as one list for each of ``rows`` rows."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def line_hash(w: Words) -> np.ndarray:
    return mixed(w.run(w.first, w.last) + U(1))


def small(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def keyed(docs: DataFrame, text: str, *others: Column) -> DataFrame:
    """The texts with a key: equal texts have equal words at equal places."""
    return docs.select(*others, F.col(text).alias("text"), F.unhex(F.md5(text_of(text))).alias("key"))


def units(docs: DataFrame, id: str, text: str, places: np.ndarray, least_words: int, least_chars: int, long: int) -> DataFrame:
    """For each document its paragraphs (those that can be similar to others with band keys) and pieces."""

    def run(batches):
        rows = Rows()
        for batch in slices(batches, "text"):
            w, n = Words(batch.column("text")), batch.num_rows
            doc = w.doc[w.first]
            start, end = w.start[w.first], w.end[w.last - 1]
            size = w.last - w.first
            banded = (size >= SHINGLE) & ((size >= least_words) | (end - start >= least_chars))
            count = size[banded] - SHINGLE + 1
            keys = band_keys((w.runs(SHINGLE) >> U(24))[ranges(w.first[banded], count)], np.cumsum(count) - count, places)
            offsets = np.r_[0, np.cumsum(banded) * keys.shape[1]].astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
            lines = lists(doc, n, {"start": small(start), "end": small(end), "h": signed(line_hash(w)), "keys": keys})
            own, a, b, lo, hi = pieces(w, long)
            with np.errstate(over="ignore"):
                around = mixed(w.run(lo, hi) + (a - lo).astype(U))
            inside = lists(
                doc[own] if len(own) else own, n, {"start": small(w.start[a]), "end": small(w.end[b - 1]), "lo": small(w.start[lo]), "hi": small(w.end[hi - 1]), "h": signed(w.run(a, b)), "g": signed(around)}
            )
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([rows.take() for _ in range(n)], pa.int64()), batch.column("key"), small(w.chars), lines, inside], names=["id", *UNITS])

    schema = ddl({"id": docs.schema[id].dataType.simpleString()} | UNITS)
    return staged(keyed(docs, text, F.col(id).alias("id")).mapInArrow(run, schema), "passage-units")


DETAILS = {
    "h": "long",
    "n": "int",
    "sig": "binary",
    "set": "binary",
    "keys": "array<long>",
    "start": "int",
    "before": "array<long>",
    "before_at": "array<int>",
    "after": "array<long>",
    "after_at": "array<int>",
}


def details(docs: DataFrame, text: str, wanted: DataFrame, places: np.ndarray, long: int) -> DataFrame:
    """Read again of wanted texts (key, paragraphs: their starts, seeds: starts of pieces): features of the paragraphs (h not null), and the words beside the pieces, nearest first, with the places to which they reach."""

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"))
            doc, at = w.doc[w.first], w.start[w.first]
            own, a, b, lo, hi = pieces(w, long)
            lines = [set(x or ()) for x in batch.column("paragraphs").to_pylist()]
            seeds = [set(x or ()) for x in batch.column("seeds").to_pylist()]
            source, out = [], []
            whole = line_hash(w).view(np.int64)
            for k in [k for k, (d, x) in enumerate(zip(doc.tolist(), at.tolist())) if x in lines[d]]:
                s = np.unique(w.run(x := np.arange(w.first[k], w.last[k] - SHINGLE + 1), x + SHINGLE) >> U(24))
                source.append(doc[k])
                out.append((int(whole[k]), len(s), signature(s), packed(s), band_keys(s, np.zeros(1, np.int64), places)[0], None, None, None, None, None))
            for k in [k for k, (d, x) in enumerate(zip(doc[own].tolist() if len(own) else (), w.start[a].tolist())) if x in seeds[d]]:
                left, right = slice(lo[k], a[k]), slice(b[k], hi[k])
                h = w.h.view(np.int64)
                source.append(w.doc[a[k]])
                out.append((None, 0, None, None, None, int(w.start[a[k]]), h[left][::-1], w.start[left][::-1].astype(np.int32), h[right], w.end[right].astype(np.int32)))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(source, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", *DETAILS])

    found = sieve(keyed(docs, text), wanted, "key").join(wanted.hint("merge"), "key").mapInArrow(run, ddl({"key": "binary"} | DETAILS))
    return staged(found, "passage-details")


def equal_words(a: Column, b: Column) -> Column:
    """Equal values at the front of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def repeated_passages(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", similar: float = SIMILAR, recall: float = 0.999, least_words: int = 20, long: int = 40, least_chars: int = 110, bucket: int = 1024, group: int = 1024
) -> DataFrame:
    """One row for each row of ``docs``: id, n_chars, n_removed (code points), spans (array of start and end of what goes, in code points).

    Of equal or similar paragraphs and of equal passages inside lines the first by id (null last), row and place
    stays.  Paragraphs of five words are compared by similarity if they have ``least_words`` or ``least_chars``, by
    equality always.  A passage inside a line is found by its pieces and goes to its last word on either side, as
    far as it equals the first place of the piece next to that side.  A span goes if it has ``least_chars`` code
    points, or half of them and a piece.  ``docs`` is read twice; texts with nothing to look at again stay where
    they are.  Null, empty and short texts lose nothing; of repeated rows the later ones lose their long enough
    paragraphs.
    """
    places = stream(11, BAND * bands(similar, recall)) | U(1)
    rows = units(docs, id, text, places, least_words, least_chars, long)
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("doc"), F.col("start"))
    lines = rows.select("id", "doc", F.explode("lines").alias("x")).select("id", "doc", "x.start", "x.end", "x.h")
    spans = lines.withColumns({"kind": F.lit(LINE), "lo": F.lit(None).cast("int"), "hi": F.lit(None).cast("int"), "g": F.lit(None).cast("long")})
    inside = rows.select("id", "doc", F.explode("pieces").alias("x")).select("id", "doc", "x.start", "x.end", "x.h", F.lit(PIECE).alias("kind"), "x.lo", "x.hi", "x.g")
    spans = spans.unionByName(inside)
    # only hashes move to find those that repeat; places move for those alone
    often = staged(spans.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "passage-repeats")
    again = staged(met(spans, often, "h", "left_semi"), "passage-again")
    lead = F.struct(*[F.col(f"first.{c}") for c in ("last", "id", "doc", "start")])
    first = staged(again.groupBy("h", "kind").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "doc", "start", "g")).alias("first")), "passage-first")
    equal = again.join(first.hint("merge"), ["h", "kind"]).where(order != lead)
    equal = staged(equal.select("doc", "start", "end", "kind", "lo", "hi", (F.col("g") == F.col("first.g")).alias("alike"), F.col("first.doc").alias("doc0"), F.col("first.start").alias("start0")), "passage-equal")
    # different paragraphs that collide in a band
    bands_ = rows.select("doc", F.explode("lines").alias("x")).where(F.size("x.keys") > 0).select("doc", "x.start", "x.h", F.explode("x.keys").alias("band"))
    crowds = staged(bands_.groupBy("band").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("band"), "passage-bands")
    close = met(bands_, crowds, "band", "left_semi").groupBy("h").agg(F.min(F.struct("doc", "start")).alias("at")).select("h", "at.doc", "at.start")
    close = staged(close, "passage-close")
    # the words beside a seed are looked at where hashes do not settle it
    torn = equal.where((F.col("kind") == PIECE) & ~F.col("alike"))
    asked = close.select("doc", "start", F.lit(LINE).alias("kind")).union(torn.select("doc", "start", "kind")).union(torn.select("doc0", "start0", "kind"))
    names = rows.select("doc", "key")
    asked = met(names, staged(asked.distinct(), "passage-asked"), "doc")
    starts = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("start")))
    wanted = staged(asked.groupBy("key").agg(starts(LINE).alias("paragraphs"), starts(PIECE).alias("seeds")), "passage-wanted")
    found = details(docs, text, wanted, places, long)
    sets = staged(found.where("h IS NOT NULL").dropDuplicates(["h"]).select(F.col("h").alias("uid"), F.md5("set").cast("binary").alias("rid"), "n", "sig", "set", "keys"), "passage-sets")
    near = resolve(sets, similar=similar, bucket=bucket, group=group, label="passage").where("links > 0 OR copies > 1").select("rid", "root")
    near = staged(sets.select(F.col("uid").alias("h"), "rid").join(near.hint("merge"), "rid").select("h", "root"), "passage-near")
    kin = staged(met(lines, near, "h"), "passage-lines")
    lead = staged(kin.groupBy("root").agg(F.min(order).alias("first")), "passage-leads")
    alike = kin.join(lead.hint("merge"), "root").where(order != F.col("first")).select("doc", "start", "end", F.lit(LINE).alias("kind"))
    whole = equal.where(F.col("kind") == LINE).select("doc", "start", "end", "kind").union(alike)
    sides = staged(found.where("start IS NOT NULL").select("key", "start", "before", "before_at", "after", "after_at").dropDuplicates(["key", "start"]), "passage-sides")
    torn = met(names, torn.select("doc", "start", "end", "doc0", "start0"), "doc").withColumnRenamed("key", "key1")
    firsts = staged(met(names, staged(equal.where((F.col("kind") == PIECE) & ~F.col("alike")).select(F.col("doc0").alias("doc")).distinct(), "passage-torn"), "doc"), "passage-named")
    torn = torn.join(firsts.withColumnsRenamed({"doc": "doc0", "key": "key0"}).hint("merge"), "doc0")
    mine = sides.withColumnsRenamed({"key": "key1"})
    theirs = sides.select(F.col("key").alias("key0"), F.col("start").alias("start0"), F.col("before").alias("before0"), F.col("after").alias("after0"))
    torn = torn.join(mine.hint("merge"), ["key1", "start"]).join(theirs.hint("merge"), ["key0", "start0"])
    left, right = equal_words(F.col("before"), F.col("before0")), equal_words(F.col("after"), F.col("after0"))
    reach = lambda n, at, none: F.when(n > 0, F.element_at(at, n)).otherwise(F.col(none))
    torn = torn.withColumns({"l": left, "r": right}).select("doc", reach(F.col("l"), "before_at", "start").alias("start"), reach(F.col("r"), "after_at", "end").alias("end"), F.lit(PIECE).alias("kind"))
    full = equal.where((F.col("kind") == PIECE) & F.col("alike")).select("doc", F.col("lo").alias("start"), F.col("hi").alias("end"), "kind")
    by_doc = Window.partitionBy("doc").orderBy("start", "end")
    runs_ = (
        whole.union(full).union(torn)
        .withColumn("reach", F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("fresh", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 2), 1).otherwise(0))
        .withColumn("island", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("kind").alias("kind"))
        .where((F.col("end") - F.col("start") >= least_chars) | ((F.col("kind") == PIECE) & (2 * (F.col("end") - F.col("start")) >= least_chars)))
    )
    gone = runs_.groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (
        rows.select("id", "doc", F.col("n").cast("long").alias("n_chars"))
        .join(gone.hint("merge"), "doc", "left")
        .select("id", "n_chars", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", none).alias("spans"))
    )


def without(text: F.Column, spans: F.Column) -> F.Column:
    """The text without the spans, for use on a row that has both."""
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["kept"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("kept"), s["end"].alias("at")),
    )
    return F.concat(cut["kept"], F.substring(text, cut["at"] + 1, F.length(text)))
