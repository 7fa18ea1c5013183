"""The engine under the near-duplicate operators: sets of shingle hashes, buckets, verified links, classes.

1. Rows whose sets are equal collapse to one representative set, with the number of its copies.
2. A method (chosen paths, bands) gives each set bucket keys.  Buckets of one set go.
3. In each bucket, sets are compared by small MinHash signatures, and sets that may be similar are tied.
4. Ties make candidate groups, in which *all* pairs are verified by exact Jaccard similarity; what leaves a task
   are numbers of links and spanning ties, never pairs.
5. Verified ties make the classes.

A bucket or group beyond ``bucket`` or ``group`` sets is first compared with one of its sets, the least: each of
the others gets a level by its distance from it (in a bucket: tied or not).  Two sets so near to it that they must
be similar to each other need no comparison: they are tied through it, and their links are counted level by level.
The rest is dealt out as pairs of blocks of one level, so no task holds more than two blocks.  So a group of copies
with some edits each, a third of all rows say, is linear work; only sets at some distance from the least one meet
all others of their group.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHINGLE, SIMILAR, staged, tidy
from .words import mixed

U = np.uint64
#: One odd multiplier for each place of a signature and one seed for each run: a rule, no data.
SIGNATURE = 64


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mixed(U(seed) * U(0xD1342543DE82EF95) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


PLACES = stream(1, SIGNATURE) | U(1)


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted 40-bit hashes of the different runs of ``size`` words; fewer words are one run, no words none."""
    if not words:
        return np.empty(0, U)
    if len(words) < size:
        return short(np.array([xxhash.xxh3_64_intdigest(b"\0".join(words))], U))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    return short(runs(h, size))


def short(h: np.ndarray) -> np.ndarray:
    """The set of the hashes' upper 40 bits, sorted: two sets of a thousand shingles share one by chance in a millionth of cases."""
    return np.unique(h >> U(24))


def packed(s: np.ndarray) -> bytes:
    """Five bytes each: what is staged and moved."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


#: Bits of a sieve, 64 a row: half a million rows of two numbers at most, whatever the tables' sizes.
SIEVE = 1 << 25


def sieve(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """``big`` without most of the rows whose ``on`` is not in ``small``, ahead of a join that decides.

    The values of ``small`` set bits of a table of SIEVE bits, which is sent to all tasks: a bound that no data
    change.  The more values there are, the more other rows pass.
    """
    place = F.xxhash64(on).bitwiseAND(F.lit(SIEVE - 1).cast("long"))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63).cast("long")).cast("int")
    bits = small.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    rows = big.withColumn("__word", word).join(F.broadcast(bits), "__word")
    return rows.where(F.call_function("shiftrightunsigned", F.col("__bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1).drop("__word", "__bits")


def met(big: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``big`` join ``small``, where few rows of ``big`` are wanted: the sieve keeps most of them where they are, the rest are dealt out."""
    return sieve(big, small, on).join(small.hint("merge"), on, how)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` hashes."""
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for k in range(size):
            out = mixed(out * U(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def signature(s: np.ndarray) -> bytes:
    """One byte of the least hash for each place; two sets agree in a place with about their similarity."""
    least = np.full(SIGNATURE, np.iinfo(U).max, U)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            least = np.minimum(least, mixed_low(s[at : at + 4096, None] * PLACES).min(axis=0))
    return (mixed(least) & U(255)).astype(np.uint8).tobytes()


def mixed_low(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> U(32))


def least_signature_matches(similar: float) -> int:
    """Places in which two sets of the given similarity agree, but for 5 standard deviations."""
    return max(1, math.floor(SIGNATURE * similar - 5 * math.sqrt(SIGNATURE * similar * (1 - similar))))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that edges a-b tie it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    return label


def grouped(batches, columns: list[str], key: str):
    """Arrow batches sorted by ``key`` as dicts of columns in which no group is cut in two."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(columns)
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        k = table.column(key).to_numpy()
        start = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if start:
            yield table.slice(0, start)
        rest = table.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


TIES = "a long, b long"


def tie_alike(rows: DataFrame, similar: float) -> DataFrame:
    """Ties (a, b) between sets of one group that may be similar by their signatures; rows: group, uid, sig."""
    least = least_signature_matches(similar)

    @tidy()
    def run(batches):
        for t in grouped(batches, ["group", "uid", "sig"], "group"):
            group, uid, sig = t.column("group").to_numpy(), t.column("uid").to_numpy(), _matrix(t.column("sig"), SIGNATURE)
            found_a, found_b = [], []
            at = np.arange(len(group))
            d = 1
            while True:
                at = at[at + d < len(group)]
                at = at[group[at] == group[at + d]]
                if not len(at):
                    break
                hit = at[(sig[at] == sig[at + d]).sum(axis=1) >= least]
                found_a.append(hit)
                found_b.append(hit + d)
                d += 1
            if not found_a:
                continue
            label = roots(len(uid), np.concatenate(found_a), np.concatenate(found_b))
            tied = np.flatnonzero(label != np.arange(len(uid)))
            if len(tied):
                a, b = uid[label[tied]], uid[tied]
                other = a != b
                if other.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[other]), pa.array(np.maximum(a, b)[other])], names=["a", "b"])

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, TIES)


VERIFIED = "uid long, links long, root long"


def _exact(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n <= 6:
        out = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i + 1, n):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        out[np.arange(n), np.arange(n)] = size
        return out
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width, top = 4096, int(code[-1]) + 1 if len(code) else 0
    for at in range(0, top, width):
        lo, hi = np.searchsorted(code, [at, at + width])
        x = np.zeros((n, min(width, top - at)), np.float32)
        x[owner[lo:hi], code[lo:hi] - at] = 1
        out += x @ x.T
    out = out.astype(np.int64)
    out[np.arange(n), np.arange(n)] = size
    return out


def verify(rows: DataFrame, similar: float) -> DataFrame:
    """For each group's sets: links (copies of similar other sets that this task answers for) and the least similar set tied to it.

    rows: group, uid, copies, set, block, i, j.  A task of blocks i < j answers for pairs across, one of i = j for pairs within.
    """
    num, den = as_ratio(similar)

    @tidy()
    def run(batches):
        for t in grouped(batches, ["group", "uid", "copies", "set", "block", "i", "j"], "group"):
            group, uid, copies = (t.column(c).to_numpy() for c in ("group", "uid", "copies"))
            sets = [unpacked(s) for s in t.column("set").to_pylist()]
            block, i, j = (t.column(c).to_numpy() for c in ("block", "i", "j"))
            bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            out_uid, out_links, out_root = [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo < 2:
                    continue
                shared = _exact(sets[lo:hi])
                size = np.diagonal(shared)
                link = den * shared >= num * (size[:, None] + size[None, :] - shared)
                np.fill_diagonal(link, False)
                if i[lo] != j[lo]:
                    link &= block[lo:hi, None] != block[None, lo:hi]
                a, b = np.nonzero(np.triu(link))
                if not len(a):
                    continue
                label = roots(hi - lo, a, b)
                some = np.flatnonzero(link.any(axis=1))
                out_uid.append(uid[lo:hi][some])
                out_links.append((link @ copies[lo:hi])[some])
                out_root.append(uid[lo:hi][label[some]])
            if out_uid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (out_uid, out_links, out_root)], names=["uid", "links", "root"])

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, VERIFIED)


#: Levels within which two sets of a group may be sure to be similar.
LEVELS = 8
#: Blocks of one level at most.
_WIDE = 1 << 24


def levels(crowd: DataFrame, key: str, values: DataFrame, value: str, level: Callable[[bytes, list[bytes]], np.ndarray]) -> DataFrame:
    """(key, uid, level, least) of the rows ``crowd`` (key, uid, parts): ``level(least set's value, values)`` against the set of least uid.

    The least set is sent to each of ``parts`` shares of its group, so no task has a whole group.
    """
    least = staged(crowd.groupBy(key).agg(F.min("uid").alias("uid"), F.max("parts").alias("parts")), "near-least")
    theirs = values.join(least.hint("merge"), "uid").select(key, F.col("uid").alias("first"), F.col(value).alias("least"), F.explode(F.expr("sequence(0, cast(parts as int) - 1)")).alias("share"))
    rows = met(values.select("uid", value), crowd, "uid").withColumn("share", F.pmod(F.xxhash64("uid", F.lit(9)), F.col("parts")).cast("int"))

    @tidy()
    def run(batches):
        for batch in batches:
            by, uid, least, value_, first = (batch.column(c) for c in range(5))
            by, least, value_ = by.to_numpy(), least.to_pylist(), value_.to_pylist()
            out = np.zeros(len(by), np.int32)
            bounds = np.flatnonzero(np.r_[True, by[1:] != by[:-1], True])
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                out[lo:hi] = level(least[lo], value_[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(by), uid, pa.array(out), first], names=[key, "uid", "level", "least"])

    joined = rows.join(theirs.hint("merge"), [key, "share"]).select(key, "uid", "least", value, "first")
    return staged(joined.mapInArrow(run, f"{key} long, uid long, level int, least long"), "near-levels")


def dealt(rows: DataFrame, key: str, most: int, limit: int, seed: int) -> DataFrame:
    """(key, uid, block, i, j, group): rows (key, uid, level, words) dealt to blocks of ``most`` sets of one level and to each pair of blocks (i <= j) of their own, unless the two levels add up to ``limit`` or less."""
    count = F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("words") / 1_000_000))
    sizes = rows.groupBy(key, "level").agg(count.cast("int").alias("parts"))
    every = staged(sizes.groupBy(key).agg(F.collect_list(F.struct("level", "parts")).alias("every")), "near-blocks")
    own = F.filter("every", lambda x: x["level"] == F.col("level"))[0]["parts"]
    others = F.flatten(F.transform(F.filter("every", lambda x: x["level"] + F.col("level") > limit), lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda b: x["level"] * _WIDE + b)))
    return (
        rows.join(every.hint("merge"), key)
        .withColumn("block", F.col("level") * _WIDE + F.pmod(F.xxhash64("uid", F.lit(seed)), own).cast("int"))
        .select(key, "uid", "block", F.explode(others).alias("other"))
        .select(key, "uid", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .withColumn("group", F.xxhash64(key, "i", "j"))
    )


def agreeing(similar: float) -> Callable[[bytes, list[bytes]], np.ndarray]:
    """Level 0 for signatures that may belong to sets as similar as that, else 1."""
    least = least_signature_matches(similar)

    def level(mine: bytes, others: list[bytes]) -> np.ndarray:
        both = np.frombuffer(b"".join(others), np.uint8).reshape(-1, SIGNATURE) == np.frombuffer(mine, np.uint8)
        return (both.sum(axis=1) < least).astype(np.int32)

    return level


def as_ratio(similar: float) -> tuple[int, int]:
    return (round(similar * 100), 100) if float(similar * 100).is_integer() else similar.as_integer_ratio()


def apart(similar: float) -> Callable[[bytes, list[bytes]], np.ndarray]:
    """Levels of sets by the elements x that they lack of the least set of n or have beside it: two sets with x + y <= n (1 - similar) / (1 + similar) share n - x - y of n + x + y elements at worst."""
    num, den = as_ratio(similar)

    def level(mine: bytes, others: list[bytes]) -> np.ndarray:
        a = unpacked(mine)
        sets = [unpacked(x) for x in others]
        size = np.array([len(x) for x in sets])
        hit = np.isin(np.concatenate(sets), a)
        shared = np.add.reduceat(hit, np.r_[0, np.cumsum(size)[:-1]])
        x = np.maximum(len(a) - shared, size - shared)
        return np.minimum(-(-LEVELS * x * (den + num) // max(1, len(a) * (den - num))), LEVELS + 1).astype(np.int32)

    return level


def sure(rows: DataFrame) -> DataFrame:
    """Links within levels that need no comparison; rows: root, uid, copies, level."""
    by = rows.groupBy("root", "level").agg(F.sum("copies").alias("n"))
    every = staged(by.groupBy("root").agg(F.collect_list(F.struct("level", "n")).alias("every")), "near-sure")
    mine = F.aggregate(F.filter("every", lambda x: x["level"] + F.col("level") <= LEVELS), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    own = F.when(2 * F.col("level") <= LEVELS, F.col("copies")).otherwise(0)
    return rows.where(F.col("level") <= LEVELS).join(every.hint("merge"), "root").select("uid", (mine - own).alias("links"), "root")


def components(ties: DataFrame, label: str) -> DataFrame:
    """(uid, root): the least node of each node's component, for every node of ``ties`` (a, b).

    Alternating large and small stars: each round ties a node's neighbours to its least neighbour, so rows never
    multiply; it ends when a round changes nothing.  Least neighbours are written before they meet the edges, so
    both sides of a join are plain shuffles, which Spark splits where a node has very many edges.
    """
    edges = staged(ties.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-ties")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    before = edges.agg(mark).first()
    while before[0]["n"]:
        # large star: larger neighbours go to the least; a node without smaller neighbours is the least itself
        low = staged(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m")), f"{label}-low")
        large = edges.join(low.hint("merge"), F.col("a") == F.col("v"), "left").select(F.coalesce("m", "a").alias("a"), "b")
        large = large.distinct()
        # small star: a node and its smaller neighbours, few by now, go to the least of these
        least = large.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m"))
        small = large.join(least, F.col("b") == F.col("v")).select("a", "b", "m")
        turned = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        edges = staged(turned, f"{label}-ties")
        now = edges.agg(mark).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("uid"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("uid"), F.col("a").alias("root"))).distinct()


Split = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def resolve(features: DataFrame, *, similar: float = SIMILAR, split: Split | None = None, depth: int = 3, bucket: int = 1024, group: int = 1024, label: str = "near") -> DataFrame:
    """Classes of the sets in ``features`` (staged: uid, rid, n, sig, set, keys): rid, uid, copies, links, root.

    ``links``: rows with another set that is similar, their copies counted; ``root``: the least uid of the class.
    ``split(set, keys, level)`` gives deeper keys for sets of crowded buckets, up to ``depth`` levels.
    """
    sets = features.where("n > 0")
    reps = staged(sets.groupBy("rid").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies")), f"{label}-sets")
    keys = sets.select("uid", "keys").join(reps.select("uid").hint("merge"), "uid", "left_semi").select("uid", F.explode("keys").alias("key"))
    level, calm = 1, []
    while True:
        # written before they meet the keys, so that Spark can split the join where a key has very many rows
        crowds = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), f"{label}-crowds")
        live = staged(keys.join(crowds.hint("merge"), "key"), f"{label}-buckets")
        if split is None or level >= depth:
            calm.append(live)
            break
        calm.append(live.where(F.col("members") <= bucket))
        crowded = live.where(F.col("members") > bucket)
        if not crowded.take(1):
            break
        keys = staged(_split(crowded.select("uid", "key"), sets, split, level), f"{label}-deeper")
        level += 1
    live = calm[0]
    for x in calm[1:]:
        live = live.union(x)
    sigs = sets.select("uid", "sig")
    alike = live.where(F.col("members") <= bucket).select("uid", F.col("key").alias("group")).join(sigs.hint("merge"), "uid")
    ties = tie_alike(alike.select("group", "uid", "sig"), similar)
    crowd = live.where(F.col("members") > bucket).select("uid", "key", F.ceil(F.col("members") / bucket).alias("parts"))
    if crowd.take(1):
        level = levels(crowd, "key", sigs, "sig", agreeing(similar))
        apart_ = dealt(level.withColumn("words", F.lit(0)), "key", bucket, 0, 1).join(sigs.hint("merge"), "uid")
        near = level.where("level = 0").select(F.col("least").alias("a"), F.col("uid").alias("b"))
        ties = ties.union(tie_alike(apart_.select("group", "uid", "sig"), similar)).union(near)
    groups = staged(components(ties, label), f"{label}-groups")
    # blocks are bounded in sets and in words
    sized = groups.join(sets.select("uid", "n").hint("merge"), "uid").join(reps.select("uid", "copies").hint("merge"), "uid")
    load = staged(sized.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("words")), f"{label}-loads")
    parts = F.greatest(F.ceil(F.col("members") / group), F.ceil(F.col("words") / 1_000_000))
    narrow = staged(sized.join(load.hint("merge"), "root").select("uid", "root", "copies", F.col("n").alias("words"), parts.alias("parts")), f"{label}-members")
    one = narrow.where("parts = 1").select("uid", "copies", F.col("root").alias("group"), F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    crowd = narrow.where("parts > 1")
    checked = []
    if crowd.take(1):
        level = levels(crowd.select("uid", "root", "parts"), "root", sets.select("uid", "set"), "set", apart(similar))
        level = staged(level.join(crowd.select("uid", "copies", "words").hint("merge"), "uid"), f"{label}-levels")
        apart_ = dealt(level, "root", group, LEVELS, 2).join(level.select("uid", "copies").hint("merge"), "uid")
        one = one.unionByName(apart_.select("uid", "copies", "group", "block", "i", "j"))
        checked.append(sure(level))
    members = met(sets.select("uid", "set"), one, "uid")
    checked.append(verify(members, similar))
    checked = staged(checked[0] if len(checked) == 1 else checked[1].union(checked[0]), f"{label}-links")
    links = checked.groupBy("uid").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("uid").alias("a"), F.col("root").alias("b")), label)
    return (
        reps.join(links, "uid", "left").join(classes, "uid", "left").select("rid", "uid", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "uid").alias("root"))
    )


def _split(crowded: DataFrame, sets: DataFrame, split: Split, level: int) -> DataFrame:
    @tidy()
    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            uid = batch.column("uid").to_numpy()
            out_u, out_k = [], []
            for u, k, s in zip(uid, keys, batch.column("set").to_pylist()):
                found = split(unpacked(s), k, level)
                out_k.append(found)
                out_u.append(np.full(len(found), u))
            if out_k:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u).astype(np.int64)), pa.array(np.concatenate(out_k).astype(np.int64))], names=["uid", "key"])

    return met(sets.select("uid", "set"), crowded, "uid").mapInArrow(run, "uid long, key long")


FEATURES = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("rid", T.BinaryType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("sig", T.BinaryType()),
        T.StructField("set", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


class Rows:
    """Numbers the rows of a task, apart from those of other tasks; the table is staged, so a number is given once."""

    def __init__(self):
        from pyspark import TaskContext

        self.next = TaskContext.get().partitionId() << 40

    def take(self) -> int:
        self.next += 1
        return self.next - 1


def digest(s: np.ndarray) -> bytes:
    return md5(packed(s), usedforsecurity=False).digest()
