import random

import pytest
from docloom.llm.hamming import nearest_codes, segment_widths, sign_code
from pyspark.sql import functions as F


def spec(base, asked, k):
    out = {}
    for q, c in asked:
        rows = sorted({((c ^ d) & (2**64 - 1)).bit_count() * 10**9 + i for i, d in base if i != q})
        out[q] = [(x % 10**9, x // 10**9) for x in rows[:k]]
    return out


def test_exact(spark):
    r = random.Random(1)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    centres = [r.getrandbits(64) for _ in range(6)]
    codes = [signed(r.choice(centres) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) if r.random() < 0.7 else r.getrandbits(64)) for _ in range(500)] + [signed(centres[0])] * 200
    base = list(enumerate(codes))
    asked = base[::35]
    got = nearest_codes(spark.createDataFrame(base, "id long, code long"), spark.createDataFrame(asked, "query_id long, code long"), k=5).collect()
    found = {}
    for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
        found.setdefault(x.query_id, []).append((x.id, x.distance))
    assert found == spec(base, asked, 5)


def test_few_and_null(spark):
    base = spark.createDataFrame([(1, 5), (2, 5), (2, 5), (3, None), (None, 7)], "id long, code long")
    asked = spark.createDataFrame([(1, 5), (9, 4), (4, None)], "query_id long, code long")
    got = sorted(tuple(x) for x in nearest_codes(base, asked, k=5).collect())
    assert got == [(1, 1, 2, 0), (9, 1, 1, 1), (9, 2, 2, 1)]
    assert nearest_codes(base.limit(0), asked, k=5).count() == 0 and nearest_codes(base, asked.limit(0), k=5).count() == 0


def test_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0],), (None,), ([],), ([None, 1.0],)], "v array<float>")
    assert [x[0] for x in df.select(sign_code("v")).collect()] == [9, None, 0, 2]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_proven_coverage(spark, sf):
    """Every query of the given tables ends by proven coverage, long before radii reach a segment's width, and is exact."""
    codes = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    rows = [tuple(r) for r in codes.collect()]
    rounds = []
    got = nearest_codes(codes, codes.where("id % 50 = 0").withColumnRenamed("id", "query_id"), rounds=rounds).collect()
    assert rounds[-1][1] == 0 and rounds[-1][0] <= 4 < min(segment_widths(len(rows)))
    found = {}
    for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
        found.setdefault(x.query_id, []).append((x.id, x.distance))
    assert found == spec(rows, [r for r in rows if r[0] % 50 == 0], 10)


def test_many_share_a_segment(spark, monkeypatch):
    """A segment value that most codes have is dealt out in parts; widths that do not divide 64; columns with clashing names."""
    monkeypatch.setattr("docloom.llm.hamming.PART", 7)
    r = random.Random(5)
    base = [(k, (0x1234 << 40) + r.getrandbits(12) if r.random() < 0.7 else r.getrandbits(63)) for k in range(400)]
    names = "long, code long, q string, value string, place string, part string, need string, d string, lead string"
    clash = lambda rows: [(*x, *["x"] * 7) for x in rows]
    for bits in (8, 11):
        got = nearest_codes(spark.createDataFrame(clash(base), f"id {names}"), spark.createDataFrame(clash(base[::40]), f"query_id {names}"), k=3, bits=bits).collect()
        found = {}
        for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
            found.setdefault(x.query_id, []).append((x.id, x.distance))
        assert found == spec(base, base[::40], 3)
    assert sum(segment_widths(10, 11)) == sum(segment_widths(10**7)) == 64
