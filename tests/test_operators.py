"""Folds, windows, deltas, search and context against plain Python, on generated rows."""

import json
import random
import re

import pytest
from docloom.functions import results
from docloom.operators import chunks, context, delta, pages, search
from docloom.params import Params
from docloom.plans import retrieval
from docloom.schemas import SCORED
from docloom.sources import files
from docloom.sources.embedders import HashingEmbedder, with_vectors
from docloom.streaming.ingest import ingest_stream, latest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = Params()


def pack(text, size):
    out, buf = [], None
    for t in re.split(r"(\n\n|[.!?]\s+)", text):
        if buf is not None and len(buf) + len(t) > size:
            out.append(buf.strip())
            buf = t
        else:
            buf = (buf or "") + t
    return out + [buf.strip()]


def test_page_packing(values):
    r = random.Random(1)
    rows = ["".join(r.choice(["слово ", "да. ", "нет!\n", "\n\n", "ж" * 30]) for _ in range(r.randint(0, 60))).strip() for _ in range(60)] + ["", "ж" * 2500]
    p = P.with_(page_chars=80)
    clean = values(lambda c: __import__("docloom.functions.text", fromlist=["x"]).clean_text(c), rows)
    assert values(lambda c: pages.packed(c, p), rows) == [pack(t, 80) for t in clean]


def test_line_packing(values):
    r = random.Random(2)
    rows = ["\n".join("x" * r.randint(0, 40) for _ in range(r.randint(1, 30))) for _ in range(40)]

    def spec(t):
        out, cur, n = [], [], 0
        for line in t.split("\n"):
            cur.append(line)
            n += len(line) + 1
            if n >= 200:
                out.append("\n".join(cur))
                cur, n = [], 0
        return out + (["\n".join(cur)] if cur else [])

    assert values(lambda c: pages.line_packed(c, P.with_(line_page_chars=200)), rows) == [spec(t) for t in rows]


@given(st.integers(1, 50), st.integers(0, 49), st.integers(0, 300))
def test_window_count(size, overlap, n):
    if overlap >= size:
        return
    i, count = 0, 0
    while i < n:
        count += 1
        j = min(i + size, n)
        if j == n:
            break
        i = j - overlap
    closed = 0 if n == 0 else 1 if n <= size else 1 + -(-(n - size) // (size - overlap))
    assert closed == count


def test_windows(spark):
    for n, expect in ((0, 0), (1, 1), (179, 1), (180, 1), (181, 2), (320, 2), (321, 3)):
        df = spark.createDataFrame([("d", " ".join(map(str, range(n))))], "doc_id string, text string")
        assert chunks.word_windows(df, p=P.with_(child_overlap=40)).count() == expect


def spec_parents(rows, size):
    out, cur, seen = [], [], []
    for page, text in rows:
        w = text.split()
        for i in range(0, len(w), size):
            cur += w[i : i + size]
            seen.append(page)
            if len(cur) >= size:
                out.append((" ".join(cur[:size]), min(seen), max(seen)))
                cur, seen = [], []
    return out + ([(" ".join(cur), min(seen), max(seen))] if cur else [])


def test_parents(spark):
    r = random.Random(3)
    rows = [(f"d{d}", k + 1, " ".join(f"w{d}{k}{i}" for i in range(r.randint(0, 23)))) for d in range(25) for k in range(r.randint(0, 6))]
    df = spark.createDataFrame(rows, "doc_id string, page int, text string")
    got = sorted(chunks.parents(df, P.with_(parent_words=10, child_words=5, child_overlap=1)).collect())
    expect = sorted((d, i + 1, t, a, b) for d in {x[0] for x in rows} for i, (t, a, b) in enumerate(spec_parents([(p, t) for x, p, t in rows if x == d], 10)))
    assert [tuple(x) for x in got] == expect
    whole = chunks.parents(df, P.with_(parent_words=10, child_words=5, child_overlap=1, lossy_parents=False)).collect()
    assert sum(len(x.text.split()) for x in whole) == sum(len(t.split()) for _, _, t in rows)
    kids = chunks.children(df, P.with_(parent_words=10, child_words=5, child_overlap=1)).collect()
    assert all(k.len_words <= 5 and k.page_start <= k.page_end for k in kids)


def test_tail_cut(spark):
    r = random.Random(4)
    docs = {f"d{k}": [(r.random() < 0.6, r.randint(0, 400)) for _ in range(r.randint(1, 12))] for k in range(120)}

    def spec(rows):
        n, run, first, before = len(rows), 0, -1, 0
        for i, (flag, size) in enumerate(rows):
            if not flag:
                run = 0
            elif i >= int(n * 0.6):
                run += 1
                first = i if run == 1 else first
                if run >= 2 and before >= 1000:
                    return first
            before += size
        return -1

    df = spark.createDataFrame([(d, i + 1, "x" * n, f) for d, rows in docs.items() for i, (f, n) in enumerate(rows)], "doc_id string, page int, text string, flag boolean")
    p = P.with_(refs_min_chars=1000)
    got = pages.tail_cut(pages.flagged(df, p).withColumn("is_refs", F.col("flag")), p).select("doc_id", "cut").distinct().collect()
    assert {x.doc_id: x.cut for x in got} == {d: spec(rows) for d, rows in docs.items()}


def test_dedup_and_delta(spark):
    rows = [("A", "P1", 1, 1, "h1"), ("B", "P1", 1, 1, "h1"), ("B", "P1", 1, 2, "h2"), ("C", "P1", 1, 1, "h3")]
    df = spark.createDataFrame(rows, "doc_id string, parent_id string, parent int, child int, text_hash string")
    assert sorted(x.doc_id for x in chunks.first_of_each_hash(df).collect()) == ["A", "B", "C"]
    stored = df.where("doc_id = 'A'")
    assert sorted((x.doc_id, x.text_hash) for x in chunks.first_of_each_hash(df, stored).collect()) == [("B", "h1"), ("B", "h2"), ("C", "h3")]
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_id string, sha1 string")
    known = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "0")], "doc_id string, sha1 string")
    assert {x.doc_id: x.status for x in delta.changes(now, known, "doc_id").collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert delta.pending(now, now, "doc_id").count() == 0 and delta.pending(now, known, "doc_id", skip_changed=True).count() == 1
    assert sorted((x.doc_id, x.sha1) for x in delta.upsert(known, now, "doc_id").collect()) == [("a", "1"), ("b", "2"), ("c", "3"), ("z", "0")]
    f = spark.createDataFrame([("/x/a.txt",), ("/y/a.pdf",), ("/y/b.pdf",)], "source_path string")
    assert sorted(x.doc_id for x in delta.file_ids(f).collect()) == ["a", "a_2", "b"]
    at = spark.createDataFrame([(5.0,)], "at double")
    assert delta.stale(at, 4.0).first().needs_rebuild and not delta.stale(at, 6.0).first().needs_rebuild


def test_fusion(spark):
    a = spark.createDataFrame([(1, f"d{k}", k) for k in (1, 2, 3)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, f"b{k}", k) for k in (1, 2, 3)], "query_id int, chunk_id string, rank int")
    fused = search.fuse([a, b]).orderBy("position").collect()
    assert [x.chunk_id for x in fused] == ["d1", "b1", "d2", "b2", "d3", "b3"]
    rows = spark.createDataFrame([(1, "x", "", 1), (1, "x", "t", 2), (1, "x", "u", 3), (1, "y", "v", 4)], "query_id int, doc_id string, text string, position int")
    assert [(x.doc_id, x.text) for x in search.capped(rows, 1, 5).orderBy("place").collect()] == [("x", "t"), ("y", "v")]
    sims = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 1.0)], "query_id int, place int, s double")
    assert [x.place for x in search.reranked(sims, F.col("s"), 2).orderBy("place_after").collect()] == [2, 1, 3]


def test_hit_attributes(spark):
    hits = spark.createDataFrame([("a_p2_c1", None), ("b_p3_c1", '{"doc_id":"R","page":9}'), ("c_p4_c2", None), ("odd", None)], "chunk_id string, raw string")
    meta = spark.createDataFrame([("a_p2_c1", "M", 5)], "chunk_id string, doc_id string, page int")
    assert sorted((x.doc_id, x.page) for x in search.hit_attributes(hits, meta).collect()) == [("M", 5), ("R", 9), ("c", 4), ("unknown", 1)]


def test_context(spark):
    rows = spark.createDataFrame([(1, k, f"d{k}", 1, 2, "x" * 3000) for k in (1, 2, 3)], "query_id int, place int, doc_id string, page_start int, page_end int, text string")
    p = P.with_(context_text_chars=9000, context_chars=8000)
    got = context.contexts(rows, p).first()
    assert got.context.count("### [") == 2 and got.citations == ["d1 стр.1-2", "d2 стр.1-2", "d3 стр.1-2"]
    assert context.contexts(rows, p.with_(context_chars=100)).first().context == ""
    turns = spark.createDataFrame([(1, k, "user", "..." if k == 5 else f"жалоба номер {k}.") for k in range(8)] + [(1, 9, "assistant", "x")], "conv_id int, turn int, role string, text string")
    case = context.case_from_history(turns).first()
    assert case.raw_case.split("\n\n") == [f"жалоба номер {k}." for k in (2, 3, 4, 6, 7)]


def test_results(values):
    fenced = "```json\n" + json.dumps({"critical_errors": ["e", {"type": "t", "explain": ""}, {}], "recommendations": ["a", {"what_to_change": "b", "rationale": "c"}, "a", 5], "citations": ["s", ""], "meta": {"k": 1}, "disclaimer": "d"}) + "\n```"
    got = values(results.from_text, [fenced, 'prose {"recommendations": "one"} more', "plain prose", None])
    assert [(e["type"], e["explain"]) for e in got[0]["critical_errors"]] == [("", "e"), ("t", "")]
    assert got[0]["recommendations"] == ["a", "b — c", "5"] and got[0]["citations"] == ["s"] and got[0]["disclaimer"] == "d" and got[0]["meta"] == {"k": "1"}
    assert got[1]["recommendations"] == ["one"] and got[2]["free_text"] == "plain prose" and got[3]["free_text"] == ""
    whole = values(results.from_object, [json.dumps({"response": '{"recommendations": ["r"], "answer": "said"}'}), json.dumps({"text": "only words"})])
    assert whole[0]["recommendations"] == ["r"] and whole[0]["free_text"] == "said" and whole[1]["free_text"] == "only words"
    scored = values(lambda c: results.scored(c, SCORED), ['{"score": 7, "subscores": {"dose": 3}, "critical_errors": [], "recommendations": [], "disclaimer": "x"}', "no json"])
    assert scored[0]["score"] == 7 and scored[1]["score"] == 0 and scored[1]["recommendations"] == []
    text = values(lambda c: context.report(results.scored(c, SCORED)), ['{"score": 7, "critical_errors": [{"type": "T", "explain": "E", "citations": [{"doc_id": "d", "pages": [1, 2]}]}], "recommendations": []}'])[0]
    assert "SCORE: 7" in text and "  1) T: E [src: d:1,2]" in text


def test_sources(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.pages.jsonl").write_text('{"page": 1, "text": "x y"}\n{"page": 1\n[]\n\n{"page": null}\n', encoding="utf-8")
    got = sorted((x.page, x.text, x.ok) for x in files.read_pages(spark, str(tmp_path / "pages")).collect())
    assert got == [(0, "", False), (0, "", True), (1, "xy", True)]
    (tmp_path / "raw").mkdir()
    for n in ("a.TXT", "~$b.docx", "c.html"):
        (tmp_path / "raw" / n).write_text("h")
    assert [x.ext for x in files.raw_files(spark, str(tmp_path / "raw")).collect()] == ["txt"]
    assert files.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"docs": [{"doc_id": "a", "sha1": "1"}]}))
    (tmp_path / "s.json").write_text(json.dumps({"a": "1", "b": "2"}))
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first().doc_id == "a"
    assert sorted(tuple(x) for x in files.read_state(spark, str(tmp_path / "s.json")).collect()) == [("a", "1"), ("b", "2")]
    html = spark.createDataFrame([("<h1>T</h1><p>a<script>x</script></p>",)], "h string").select(files.html_text("h").alias("t")).first().t
    assert "### [HEADING] T" in html and "x" not in html.replace("[HEADING]", "")


def test_plans(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{k}", " ".join(f"слово{(k * 7 + i) % 50}" for i in range(200)) + ".") for k in range(6)], "doc_id string, text string")
    state = spark.createDataFrame([], "doc_id string, sha1 string")
    made = chunks.search_chunks(retrieval.ingest(docs), P)
    every, new_state, counts = retrieval.reindex(docs, state, made.limit(0))
    assert every.select("doc_id").distinct().count() == 6 and {x.status: x.docs for x in counts.collect()} == {"new": 6}
    assert retrieval.reindex(docs, new_state, every)[0].count() == every.count()
    rows = with_vectors(every.select("chunk_id", "doc_id", F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.col("text").alias("chunk_text")), HashingEmbedder)
    index = retrieval.Index(search.keyword_index(every, P), every, rows)
    asked = with_vectors(spark.createDataFrame([(1, "слово3 слово4")], "query_id int, text string"), HashingEmbedder, text="text")
    found = retrieval.hybrid(index, asked, P).collect()
    assert 0 < len(found) <= P.k and len({x.doc_id for x in found}) == len(found)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"doc_id": r.doc_id, "text": r.text}, ensure_ascii=False) for r in docs.collect()), encoding="utf-8")
    ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert latest(spark, str(tmp_path / "out")).count() == every.count()


def test_sql(spark):
    from docloom.sql import register

    assert "doc_words" in register(spark)
    assert spark.sql("SELECT size(doc_words('a  b')) AS n, doc_citation('d', 1, 2) AS c").first() == (2, "d стр.1-2")


def test_stored_index(spark, tmp_path):
    """Putting documents in and taking them out leaves the index that a new one would be; a search reads the buckets of its terms only."""
    from docloom.sources import index as store

    rows = [(f"c{k}", f"d{k % 4}", f"alpha beta{k % 3} gamma{k}" * (1 + k % 2)) for k in range(20)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")
    folder = f"file://{tmp_path}/index"
    store.write_index(df, folder)
    new = spark.createDataFrame([("c1", "d1", "alpha delta"), ("c99", "d9", "delta")], "chunk_id string, doc_id string, text string")
    store.upsert_index(new, folder, gone=df.where("doc_id = 'd2'"))
    assert store.version(spark, folder) == 2
    now = df.where("doc_id NOT IN ('d1', 'd2')").unionByName(new)
    asked = spark.createDataFrame([(1, "alpha delta"), (2, "gamma3 beta0 nothing")], "query_id long, text string")
    fresh = search.keyword_top(search.keyword_index(now, P), asked, 5).collect()
    kept = store.read_index(spark, folder, asked)
    assert sorted(search.keyword_top(kept, asked, 5).collect()) == sorted(fresh)
    assert kept.postings.count() < store.read_index(spark, folder).postings.count()


def test_stored_index_disk(spark, tmp_path, monkeypatch):
    """A change of one document writes little beside a large index, and a posting takes few bytes; odd documents and many small segments give what a new index would."""
    from docloom.operators import postings
    from docloom.sources import index as store

    size = lambda folder: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    text = lambda k: " ".join(f"word{(k * k + i * i * 7) % 997}" for i in range(150))
    rows = [(f"a long id of a chunk {k}", f"a long id of a document {k // 2}", text(k)) for k in range(2000)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string").coalesce(1)
    store.write_index(df, f"file://{tmp_path}/large")
    before, n = size(tmp_path / "large"), sum(len(set(t.split())) for _, _, t in rows)
    assert before < 5 * n
    store.upsert_index(df.limit(2), f"file://{tmp_path}/large")
    assert size(tmp_path / "large") < 1.2 * before

    monkeypatch.setattr(postings, "SEGMENT", 3)
    odd = [("e1", "e", ""), ("e2", "e", None), ("n1", None, "word1 word5"), ("u1", "u", "Ünïcode слово word5 слово"), *rows[:20]]
    df = spark.createDataFrame(odd, df.schema)
    folder = f"file://{tmp_path}/odd"
    store.write_index(df.limit(0), folder)
    store.upsert_index(df, folder)
    new = spark.createDataFrame([("u2", "u", "слово"), (odd[4][0], odd[4][1], "word5 again")], df.schema)
    store.upsert_index(new, folder, gone=spark.createDataFrame([(odd[7][1],), ("e",), (None,)], "doc_id string"))
    store.upsert_index(new, folder, gone=spark.createDataFrame([(odd[9][1],), ("nothing",)], "doc_id string"))
    out = {"u", "e", odd[4][1], odd[7][1], odd[9][1]}
    now = spark.createDataFrame([r for r in odd if r[1] not in out], df.schema).unionByName(new)
    asked = spark.createDataFrame([(1, "word5 слово ünïcode"), (2, "nothing"), (3, " ".join(f"word{k}" for k in range(300))), (4, None)], "query_id long, text string")
    kept, fresh = store.read_index(spark, folder, asked), search.keyword_index(now)
    assert kept.totals.first() == fresh.totals.first()
    for lot, block in ((256, 1024), (1, 2)):
        got = sorted(search.keyword_top(kept, asked, 5, lot=lot, block=block).collect())
        assert got and got == sorted(search.keyword_top(fresh, asked, 5).collect())
    # what no query asks for doesn't leave the task that reads it
    assert {r.term for r in kept.df.collect()} == {r.term for r in fresh.df.collect()} & ({"слово", "ünïcode", "nothing"} | {f"word{k}" for k in range(300)})
    whole = store.read_index(spark, folder)
    assert sorted(whole.df.collect()) == sorted(fresh.df.collect())
    assert sorted(whole.postings.collect()) == sorted(fresh.postings.select("term", "chunk_id", "tf", "dl").collect())


def test_reindex_stored(spark, tmp_path):
    from docloom.plans import retrieval as plans

    folder = f"file://{tmp_path}/all"
    text = "A sentence of the text that says something about things. " * 20
    docs = spark.createDataFrame([(f"d{k}", f"{k} " + text) for k in range(6)], "doc_id string, text string")
    first = {r.status: r.docs for r in plans.reindex_stored(docs, folder).collect()}
    changed = docs.withColumn("text", F.when(F.col("doc_id") == "d1", F.concat("text", F.lit("More of it here."))).otherwise(F.col("text")))
    more = changed.union(spark.createDataFrame([("d9", text)], docs.schema))
    second = {r.status: r.docs for r in plans.reindex_stored(more, folder).collect()}
    assert first == {"new": 6} and second == {"unchanged": 5, "changed": 1, "new": 1}
    states = files.read_state(spark, f"{folder}/state")
    assert states.count() == 7 and files.job_states(spark, f"{folder}/jobs").first().state == files.DONE
    with pytest.raises(Exception, match="nowhere"):
        plans.reindex_stored(more.withColumn("text", F.raise_error(F.lit("nowhere")).cast("string")), folder)
    assert files.job_states(spark, f"{folder}/jobs").first().state == files.FAILED


def test_writers(spark, tmp_path):
    files.write_state(spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, sha1 string"), f"file://{tmp_path}/state")
    assert sorted(map(tuple, files.read_state(spark, f"file://{tmp_path}/state").collect())) == [("a", "1"), ("b", "2")]
    files.write_manifest(spark.createDataFrame([("a", 3), ("b", None)], "doc_id string, pages int"), f"file://{tmp_path}/manifest")
    got = files.read_manifest(spark, f"file://{tmp_path}/manifest").select("doc_id", "pages").collect()
    assert sorted((r.doc_id, r.pages or 0) for r in got) == [("a", 3), ("b", 0)]


def test_dense_blocks(spark):
    """Blocks and lots of any size give the same rows; zero and null vectors score 0 or take no part."""
    r = random.Random(1)
    rows = [(k, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for k in range(60)] + [(60, [0.0] * 4), (61, None)]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = df.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    got = [sorted(map(tuple, search.dense_top(df, asked, 5, block=b, lot=q).collect())) for b, q in ((4096, 512), (7, 3), (1, 1))]
    assert got[0] == got[1] == got[2]
    length = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    for i, v in rows[:60:7]:
        best = sorted((-round(sum(a * b for a, b in zip(v, w)) / length(v) / length(w), 6), j) for j, w in rows if w is not None)[:5]
        assert [(-s, j) for _, j, s, _ in sorted((x for x in got[0] if x[0] == i), key=lambda x: x[3])] == [(s, j) for s, j in best]
