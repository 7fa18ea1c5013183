"""Line deduplication by winnowing over line hashes.

A run is ``run`` lines in a row.  The line of least hash in each window of ``run`` lines is selected as the
window's fingerprint, so any two equal runs select the same line at the same place.  Fingerprints that occur at
one place only are dropped.  At the places of the others, the match is extended both ways over the windows that
selected the fingerprint; extended matches of adjoining windows grow together.  Of windows with equal lines all
but the first (by document, then position) are repeats, and their lines are deleted.  A line of ``words`` words,
where that is given, is a window of its own, too.

No pairs are made: each place is compared with the first of its kind, by a sum over hash and first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_of, name_of, staged, text_of
from .similar import met


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def _long(normal: Column, words: int) -> Column:
    return F.size(F.split(normal, " ")) >= words


def repeated_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", run: int = 2, words: int | None = None) -> DataFrame:
    """For each different (id, text) with repeats: id, key (hash of the text), removed (places of lines, from 0)."""
    numbered = F.transform(F.split(text_of(text), "\n", -1), lambda line, k: F.struct(k.alias("k"), _normal(line).alias("line")))
    full = F.filter(numbered, lambda x: F.length(x["line"]) > 0)
    alone = (lambda x: []) if words is None else (lambda x: [_long(x["line"], words).alias("alone")])
    marks = F.transform(full, lambda x: F.struct(x["k"].alias("k"), F.xxhash64(x["line"]).alias("h"), F.hash(x["line"]).alias("c"), *alone(x)))
    some = F.size("marks") >= run if words is None else (F.size("marks") >= run) | F.exists("marks", lambda x: x["alone"])
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text_of(text)).alias("key"), marks.alias("marks")).where(some).dropDuplicates(["id", "key"])
    flags = [] if words is None else [F.col("marks.alone").alias("alone")]
    rows = staged(rows, "line-hashes").select("id", "key", F.col("marks.k").alias("place"), F.col("marks.h").alias("hash"), F.col("marks.c").alias("check"), *flags)
    # a window: place of its fingerprint, hashes of the window
    part = F.slice(F.col("hash"), F.col("j") + 1, run)
    windows = rows.where(F.size("place") >= run).select("id", "key", "hash", "check", F.posexplode(F.sequence(F.lit(0), F.size("place") - run)).alias("j", "at")).drop("at")
    windows = windows.select(
        (F.col("j") + F.array_position(part, F.array_min(part)) - 1).alias("p"),
        "id",
        "key",
        "j",
        F.array_min(part).alias("print"),
        F.xxhash64(part, F.slice(F.col("check"), F.col("j") + 1, run)).alias("w1"),
        F.hash(F.slice(F.col("check"), F.col("j") + 1, run), part).alias("w2"),
        F.lit(run).alias("size"),
    )
    if words is not None:
        lines = rows.select("id", "key", "hash", "check", F.posexplode("alone").alias("j", "alone")).where("alone")
        h, c = F.get("hash", F.col("j")), F.get("check", F.col("j"))
        windows = windows.union(lines.select(F.col("j").alias("p"), "id", "key", "j", h.alias("print"), F.xxhash64(F.array(h), F.array(c)).alias("w1"), F.hash(F.array(c), F.array(h)).alias("w2"), F.lit(1).alias("size")))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("key"), F.col("j"))
    place = F.struct("id", "key", "p")
    # sums are written before they meet the windows, so that Spark can split a join where one line is very common
    often = staged(windows.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("NOT a <=> z").select("print"), "line-prints")
    matched = staged(met(windows, often, "print", "left_semi"), "line-places")
    first = matched.groupBy("w1", "w2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2", "first")
    first = staged(first, "line-firsts").hint("merge")
    same_doc = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.key") == F.col("key"))
    # a window is no repeat of itself, nor of one that it overlaps
    repeats = matched.join(first, ["w1", "w2"]).where(~same_doc | (F.col("first.j") + F.col("size") <= F.col("j")))
    found = repeats.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("j", "size"))).alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["j"], x["j"] + x["size"] - 1))))
    return (
        found.withColumn("covered", covered)
        .withColumnsRenamed({"id": "__id", "key": "__key"})
        .join(rows.select("id", "key", "place"), F.col("__id").eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key")))
        .select("id", "key", F.transform("covered", lambda k: F.get("place", k)).alias("removed"))
    )


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", run: int = 2, words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, the text without later repeats of ``run`` or more lines (and of single lines of ``words`` or more words, where given), and two columns more: n_lines, removed (places of the deleted lines).

    The first of equal runs stays, by id (null last), then hash of the text, then place.  Lines are compared
    without outer white space and with inner white space as one space; lines without other characters take no
    part and stay.  A null text stays null.  Of repeated rows with equal id and text, one (by a hash of all columns)
    is the first and the others lose all lines if they have ``run`` lines or more, else those of ``words`` words.  No row is dropped.  Columns of ``docs`` by the names
    of the two give way to them.
    """
    found = repeated_lines(docs, id=id, text=text, run=run, words=words).select(name_of("id").alias("__i"), F.col("key").alias("__k"), F.col("removed").alias("__removed"))
    lines = F.split(text_of("__text"), "\n", -1)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("__none"), *others).alias("__row"), name_of(id).alias("__i"), F.col(text).alias("__text"), F.xxhash64(text_of(text)).alias("__k"), hash_of(docs).alias("__tie"))
    rows = rows.join(found, ["__i", "__k"], "left")
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("__i", "__k").orderBy("__tie")))
    none = F.array().cast("array<int>")
    kept = F.filter(F.transform(lines, lambda line, k: F.struct(k.alias("k"), _normal(line).alias("line"))), lambda x: F.length(x["line"]) > 0)
    full = F.transform(kept, lambda x: x["k"])
    alone = none if words is None else F.transform(F.filter(kept, lambda x: _long(x["line"], words)), lambda x: x["k"])
    removed = F.when(F.col("__copy") == 1, F.coalesce(F.sort_array("__removed"), none)).otherwise(F.when(F.size(full) >= run, full).otherwise(alone))
    rows = rows.withColumn("__removed", removed)
    clean = F.when(F.size("__removed") == 0, F.col("__text")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__removed"), lambda k: F.get(lines, k)), "\n"))
    own = [c for c in docs.columns if c not in ("n_lines", "removed")]
    return rows.select(*[clean.alias(text) if c == text else F.col(f"__row.`{c}`").alias(c) for c in own], F.size(lines).cast("long").alias("n_lines"), F.col("__removed").alias("removed"))
