"""Text functions against plain Python specifications and the edge cases of the fixtures."""

import hashlib
import re
import uuid

from docloom.functions import ids
from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.params import Params, lookup, merged, service_url
from pyspark.sql import functions as F

LINE = re.compile(r"(?:\n+|(?<=\.)\s+)")


def lines(t):
    return [x.strip() for x in LINE.split(t) if x and x.strip()]


def test_clean_text(values):
    assert values(X.clean_text, ["Te-\nst\r\n\nA", None, "a\tb  c\nd", "x\n\n\ny"]) == ["Тest\n\nА".replace("Тest", "Теst"), "", "а b с d", "х\n\n у"]
    once = values(X.clean_text, ["word--\n\n\nnext"])[0]
    assert values(X.clean_text, [once])[0] != once


def test_normalize(values):
    assert values(X.normalize_text, ["a\r\rb\t c \n\n\n\n d", "", "  x  \n\n\ny"]) == ["a\n\nb c\n\nd", "", "x\n\ny"]
    # letters outside the two alphabets become one space; spaces are not collapsed again
    assert values(X.normalize_for_hash, ["École — X", "  A\n\nb "]) == ["cole   x", "a b"]
    assert values(X.text_hash, ["A  b"]) == [hashlib.sha1(b"a b").hexdigest()]


def test_citations(values):
    is_citation = lambda c: X.is_citation(F.col(c))
    rows = ["1) Smith J Title of the paper", "Smith et al.", "see 10.1000/xyz for more text", "in 2019;54(6):1157-1170 and so", "plain words of a longer line", "Published in some long line"]
    assert values(is_citation, rows) == [True, False, True, True, False, True]
    cleaned = values(X.clean_text, ["doi: abc this is long text", "Published 2010 in something"])
    assert values(is_citation, cleaned) == [False, False]
    many = "\n".join(["1) Smith J Title of the paper"] * 3 + ["just words here"] * 2)
    few = "\n".join(["1) Smith J Title of the paper"] * 2 + ["just words here"] * 3)
    page = values(X.references_page, [many, few, "1) Smith J Title of the paper"])
    assert [p["is_refs"] for p in page] == [True, False, False] and page[0]["ratio"] == 0.6
    assert values(X.drop_citations, [many]) == ["just words here\njust words here"]
    assert values(X.drop_loose_citations, ["metal is loose\nkept line"]) == ["kept line"]
    assert values(X.has_references_header, ["a\nReferences:\nb", "a reference"]) == [True, False]


def test_noise(values):
    long = "word " * 30
    rows = ["", "short", "1234567 ab " * 20, "a.,;: b.,; " * 20, "\n".join(["tiny line"] * 20), long]
    assert values(X.is_noise, rows) == [True, True, True, True, True, False]


def test_meaningless(values):
    assert values(X.looks_meaningless, ["ab", "k60.1", "!!!", "aaaa aaa", "боль", None, "a real question"]) == [True, False, True, True, True, True, False]


def test_split_lines(values):
    rows = ["One. Two\n\nthree.  four ", "", "a.b c"]
    assert values(X.split_lines, rows) == [lines(t) for t in rows]


def test_compact(values):
    got = values(lambda c: X.compact_text(c, 30), ["Боль в груди. Боль в груди. Кашель сухой. Одышка при ходьбе.", "Пациент отрицает, жар.", ""])
    assert got[0] == "Боль в груди. Кашель сухой." and "нет." in got[1] or got[1] != "" and got[2] == ""


def test_trims(values):
    assert values(lambda c: X.safe_trim(c, 10, 3), ["short", "abcd efgh ijkl", "abcdefghijklmn", "ab cdefghijklmn"]) == ["short", "abcd efgh …", "abcdefghij …", "ab cdefghi …"]
    assert values(lambda c: X.head(c, 3, "…"), ["abc", "abcd"]) == ["abc", "abc…"]


def test_fences(values):
    assert values(X.strip_fences, ["x ```json\n{}\n``` y", " plain "]) == ["{}", "plain"]
    assert values(X.strip_fences_loose, ["```json\n{1}\n``", "a``"]) == ["{1}", "a"]
    # a text that begins with a fence and has no line break is all fence
    assert values(X.clean_free_text, ["``` a", "`q`"]) == ["", "q"]
    got = values(X.thoughts, ["<think>a</think>b<think>c</think> d"])[0]
    assert got["thought"] == "c" and got["answer"] == "b d"


def test_case_and_plan(values):
    got = values(X.case_and_plan, ["Жалобы на боль\nПлан лечения:\n- парацетамол 500 мг\n2) покой и тепло", "только жалобы"])
    assert got[0]["plan"] == "- парацетамол 500 мг\n2) покой и тепло" and "Жалобы" in got[0]["case_text"] and "парацетамол" not in got[0]["case_text"]
    assert got[1]["plan"] == "" and got[1]["case_text"] == "только жалобы"


def test_fill(spark):
    row = spark.range(1).select(X.fill("a {x} {y} {z}", x=F.lit("{y}"), y=F.lit("2")).alias("t")).first()
    assert row.t == "a {y} 2 {z}"


def test_ids(spark):
    names = ["a_b", "doc_ü", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(ids.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    df = spark.createDataFrame([("a_p1_c2_p3_c4",), ("x",)], "c string")
    got = df.select(ids.parse_chunk_id(F.col("c")).alias("g"), ids.parse_chunk_id(F.col("c"), lazy=True).alias("l")).collect()
    assert (got[0].g.doc_id, got[0].g.page, got[0].l.doc_id) == ("a_p1_c2", 3, "a_p1_c2") and got[1].g.page is None
    df = spark.createDataFrame([("5", "on"), ("x", ""), (None, "no")], "i string, b string")
    assert [tuple(r) for r in df.select(ids.coerced(F.col("i"), "int", 7), ids.coerced(F.col("b"), "boolean", True)).collect()] == [(5, True), (7, True), (7, False)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(V.unit(F.col("a")).alias("u"), V.unit(F.col("z")).alias("z"), V.cosine(F.col("a"), F.col("z")).alias("c"), V.norm(F.col("a")).alias("n"), V.unit(F.col("z"), softened=True).alias("s")).first()
    assert r.u == [0.6, 0.8] and r.z == [0.0, 0.0] and r.c == 0.0 and r.n == 5.0 and r.s == [0.0, 0.0]


def test_params():
    p = Params.from_mapping({"k": "12", "rerank": "off", "b": "x", "per_doc": ""})
    assert (p.k, p.rerank, p.b, p.per_doc) == (12, False, 0.4, 1)
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert lookup({"a": {"b": 1}}, "a", "b") == 1 and lookup({}, "a", default=5) == 5
    assert service_url("host:1/", "d") == "http://host:1" and service_url("http://https://h", "d") == "https://h" and service_url("", "d") == "d"
    try:
        Params(child_words=10, child_overlap=10)
    except ValueError:
        return
    raise AssertionError("an overlap as large as the window must be refused")
