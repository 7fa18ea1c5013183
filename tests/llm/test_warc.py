import base64
import gzip
import hashlib
import random

import pytest
from docloom.llm import warc
from pyarrow import fs


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, monkeypatch):
    r = random.Random(1)
    bodies = [None, "", "<p>ä", "x" * 5000, "same", "same", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"]
    rows = [(k, r.choice(["http://a/é %41\r\nX-Page-ID: 7", None, "u"]), r.choice(bodies)) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index, folder = warc.archive(df)
    got = {x.page_id: x for x in warc.read_archive(index, folder).collect()}
    assert sorted(got) == list(range(200))
    for k, url, body in rows:
        x, body = got[k], body or ""
        last = max(i for i, _, b in rows if (b or "") == body)
        assert (x.url, x.payload_bytes, x.payload_digest) == (url or "", len(body.encode()), sha1(body))
        assert (x.record_type, x.refers_to) == (("response", None) if k == last else ("revisit", last))
        assert x.payload == (body.encode() if k == last else None)
    # every record is a member of its own at its offset; no monolithic file is left
    store, root = fs.FileSystem.from_uri(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".gz")]
    assert files and not any(".mono." in f for f in files)
    places = {}
    for x in index.collect():
        places.setdefault(x.file, []).append((x.offset, x.length))
    assert sorted(places) == sorted(files)
    for f, members in places.items():
        data = store.open_input_file(f).read()
        at = 0
        for offset, length in sorted(members):
            assert offset == at and gzip.decompress(data[offset : offset + length]).startswith(b"WARC/1.1\r\n")
            at += length
        assert at == len(data)


def test_ties_and_nulls(spark):
    df = spark.createDataFrame([(2, "a", "x"), (2, "b", "x"), (1, "c", "x"), (None, "d", "y"), (None, "e", "y"), (3, "f", None)], "page_id long, url string, html string")
    index, folder = warc.archive(df)
    got = sorted(((x.page_id or 0), x.record_type, x.refers_to or 0) for x in warc.read_archive(index, folder).collect())
    assert got == [(0, "response", 0), (0, "revisit", 0), (1, "revisit", 2), (2, "response", 0), (2, "revisit", 2), (3, "response", 0)]
    index, folder = warc.archive(df.limit(0))
    assert warc.read_archive(index, folder).count() == 0
    index, folder = warc.archive(df, least_bytes=2)
    assert {x.record_type for x in warc.read_archive(index, folder).collect()} == {"response"}


def test_streams():
    made = [warc.record("response", f"urn:uuid:{k}", "u", sha1("p"), b"p" * (k * 1000), None, k, k * 1000) for k in range(40)]
    mono = gzip.compress(b"".join(made))

    class Stream:
        def __init__(self, data):
            self.data, self.at = data, 0

        def read(self, n):
            self.at += n
            return self.data[self.at - n : self.at]

    assert list(warc.records(warc.inflated(Stream(mono), 100))) == made
    several = b"".join(gzip.compress(x) for x in made)
    assert list(warc.records(warc.inflated(Stream(several), 777))) == made
    with pytest.raises(ValueError):
        list(warc.records(iter([b"".join(made)[:-3]])))


def test_record_ids(spark):
    """Ids are unique and the same in every run, and a revisit's reference is the id of a response with its payload; clashing columns and a long payload make no difference."""
    r = random.Random(2)
    rows = [(k, f"u{k % 7}", r.choice(["a", "b", "", None, f"own {k}", "long " * 400_000]), "x", "y", "z", "w") for k in range(120)] + [(None, "n", "a", "x", "y", "z", "w"), (5, "u", "a", "x", "y", "z", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string, kind string, page string")
    seen = []
    for parts in (2, 5):
        index, folder = warc.archive(df.repartition(parts))
        store, _ = fs.FileSystem.from_uri(folder)
        heads = [warc.parsed(gzip.decompress(store.open_input_file(x.file).read()[x.offset : x.offset + x.length]))["headers"] for x in index.collect()]
        ids = [h["warc-record-id"] for h in heads]
        assert len(set(ids)) == len(ids) == len(rows)
        responses = {h["warc-record-id"]: h["warc-payload-digest"] for h in heads if h["warc-type"] == "response"}
        assert all(responses[h["warc-refers-to"]] == h["warc-payload-digest"] for h in heads if h["warc-type"] == "revisit")
        assert len(set(responses.values())) == len(responses)
        seen.append(sorted(ids))
    assert seen[0] == seen[1]
