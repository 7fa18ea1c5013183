"""Embedding services, charsets, displays, checks of results, texts of pages in retrieval."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from docloom.functions import results
from docloom.operators import search
from docloom.params import Params, preset
from docloom.plans import retrieval
from docloom.schemas import SCORED
from docloom.sources import files
from docloom.sources.embedders import HttpEmbedder, as_vectors, with_vectors
from pyspark.sql import functions as F


def test_formats():
    want = as_vectors([[3.0, 4.0]])
    assert np.allclose(want, [[0.6, 0.8]]) and want.dtype == np.float32
    for out in (np.array([3, 4]), {"dense_vecs": [[3, 4]]}, {"dense_vecs": None, "embeddings": [[3, 4]]}, {"sentence_embeddings": [3, 4]}):
        assert np.allclose(as_vectors(out), want)
    assert not as_vectors([[0, 0]]).any()
    with pytest.raises(ValueError):
        as_vectors({"tokens": [[3, 4]]})


@pytest.fixture
def service():
    """A service that is busy at each first call of a prompt and refuses the prompt 'no'."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            seen.append(prompt)
            code = 400 if prompt == "no" else 503 if seen.count(prompt) == 1 else 200
            body = json.dumps({"embedding": [float(len(prompt)), 0.0]}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_service(spark, service):
    url, seen = service
    make = lambda: HttpEmbedder(url, "m", 2, backoff=0.01, pause=0.0, most=300)
    assert np.allclose(make().embed(["ab", "c"]), [[1, 0], [1, 0]]) and seen == ["ab", "ab", "c", "c"]
    make().embed(["w " * 400])
    assert seen[-1].endswith(" …") and len(seen[-1]) <= 302
    with pytest.raises(Exception, match="400"):
        make().embed(["no"])
    assert seen.count("no") == 1
    with pytest.raises(ValueError):
        HttpEmbedder(url, "m", 3, backoff=0.01).embed(["ab"])
    rows = with_vectors(spark.createDataFrame([("x",), ("yy",)], "chunk_text string"), make)
    assert [r.vector for r in rows.collect()] == [[1.0, 0.0]] * 2


def test_charsets(spark):
    text = "Привет, это текст о лечении"
    data = [text.encode(c) for c in ("utf-8", "utf-8-sig", "utf-16", "cp1251", "koi8-r", "cp866")] + [b"", None]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(data)], "k int, content binary")
    got = [r.t for r in rows.select("k", files.detected_text("content").alias("t")).orderBy("k").collect()]
    assert got == [text] * 6 + ["", ""]


def test_display(spark):
    docs = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "query_id string, doc_id string")
    words = spark.createDataFrame([("q", "a", 7, 1), ("q", "a", 2, 3), ("q", "c", 5, 2)], "query_id string, doc_id string, page int, rank int")
    points = spark.createDataFrame([("q", "a", "first", 1), ("q", "a", "last", 2), ("q", "b", None, 3)], "query_id string, doc_id string, payload string, rank int")
    got = {r.doc_id: (r.page, r.payload) for r in search.displayed(docs, words, points).collect()}
    assert got == {"a": (7, "last"), "b": (None, None), "c": (5, None)}


def test_tables(spark):
    spark.createDataFrame([("d", 1, 2)] * 3, "doc_id string, page_start int, page_end int").createOrReplaceTempView("only_a_view")
    files.save_table(spark.table("only_a_view"), "some_points", recreate=True)
    assert "some_points" in files.collections(spark) and "only_a_view" not in files.collections(spark)
    assert [tuple(r) for r in files.sample_points(spark.table("some_points"), 2).collect()] == [("d", 1, 2)] * 2


def test_valid_score(values):
    whole = {
        "score": 50,
        "subscores": dict.fromkeys(("diagnosis", "med_choice", "dose", "interactions", "contraindications", "monitoring"), 10),
        "critical_errors": [{"type": "t", "explain": "e"}],
        "recommendations": [{"what_to_change": "w", "rationale": "r", "citations": [{"doc_id": "d", "pages": [1]}]}],
        "citations": [{"doc_id": "d", "pages": [1], "quote": "q"}],
        "disclaimer": "x",
    }
    wrong = [
        {"score": 0},
        {"score": 101},
        {"subscores": {"dose": 3}},
        {"subscores": {**whole["subscores"], "dose": 101}},
        {"critical_errors": [{"type": "t"}]},
        {"recommendations": [{"what_to_change": "w", "rationale": "r", "citations": [{"doc_id": "d"}]}]},
        {"citations": [{"doc_id": "d", "pages": [1]}]},
        {"citations": None},
        {"disclaimer": None},
    ]
    rows = [json.dumps(x) for x in [whole, {**whole, "critical_errors": [], "citations": []}, *({**whole, **w} for w in wrong)]]
    got = values(lambda c: results.valid_score(F.from_json(c, SCORED)), [*rows, "{}", None])
    assert got == [True, True] + [False] * (len(wrong) + 2)


def test_text_of_pages(spark):
    pages = spark.createDataFrame([("d", 1, "alpha beta"), ("d", 2, "gamma"), ("e", 1, "alpha other")], "doc_id string, page int, text string")
    points = spark.createDataFrame([("p1", "d", 1, 2, "", [1.0, 0.0]), ("p2", "e", 1, 1, "told", [0.9, 0.1])], "chunk_id string, doc_id string, page_start int, page_end int, chunk_text string, vector array<double>")
    index = retrieval.build(pages, Params(), points=points)
    asked = spark.createDataFrame([("q", "zzz", [1.0, 0.0])], "query_id string, text string, vector array<double>")
    assert {r.chunk_id for r in retrieval.hybrid(index, asked).collect()} == {"p2"}
    got = {r.chunk_id: r.text for r in retrieval.hybrid(index, asked, page_rows=pages).collect()}
    assert got == {"p1": "alpha beta\n\ngamma", "p2": "told"}


def test_presets():
    assert preset("llama3.1:8b")["num_ctx"] == 4096 and preset("unknown") == {} and preset("a", {"a": {"k": 1}}) == {"k": 1}
    preset("llama3.1:8b").clear()
    assert preset("llama3.1:8b")
