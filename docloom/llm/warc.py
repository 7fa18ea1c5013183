"""WARC archives: write crawls as monolithic gzip files, normalise them to one member per record with an offset index, read them back.

A monolithic file is one gzip stream, so a record in it can be reached only through all before it.  The
normaliser inflates such a file once as a stream, cuts it at the records' own lengths, deflates each record as a
member of its own into a new file and notes member by member where it starts.  Readers then seek.

Files go through pyarrow's file systems into the shared folder, under a name of the task attempt, and count only
when the task has ended: the index rows that a task returns name the files that it has closed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, temporary, text_of

#: Bytes of records after which a file is full, and bytes that are read and inflated at once.
FILE_BYTES, STEP = 32 << 20, 1 << 18
GZIP = 31
INDEX = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("record_id", T.StringType())])


def base32(hexa: str) -> str:
    return base64.b32encode(bytes.fromhex(hexa)).decode()


def record(kind: str, record_id: str, url: str, digest: str, payload: bytes, refers_to: str | None, page: int | None, size: int, refers_page: int | None = None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers, with the length of the payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {escaped(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <{refers_to}>")
        if refers_page is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_page}")
    head.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def named(kind: str, page: int | None, digest: str, url: str = "", turn: int = 0) -> str:
    """The id of a record, told from what it holds: a response's from its page and payload, so that revisits and reruns name the same."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([kind, page, digest, url, turn]))}"


def escaped(url: str) -> str:
    """A URL in one header line: control characters, spaces, percent signs and what is not ASCII as %XX of UTF-8."""
    return "".join(c if 32 < ord(c) < 127 and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def unescaped(url: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url.encode()).decode("utf-8", "surrogatepass")


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for line in block.decode().split("\r\n")[1:] if line for k, _, v in [line.partition(":")]}


def inflated(stream, step: int = STEP) -> Iterator[bytes]:
    """Bytes of a gzip stream (of one or more members), a bounded piece at a time."""
    z, more = zlib.decompressobj(GZIP), b""
    while more or (more := stream.read(step)):
        out = z.decompress(more, step)
        if out:
            yield out
        if z.eof:
            more, z = z.unused_data, zlib.decompressobj(GZIP)
        else:
            more = z.unconsumed_tail
    if rest := z.flush():
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, one at a time."""
    buffer = bytearray()
    for piece in pieces:
        buffer += piece
        while (end := buffer.find(b"\r\n\r\n")) >= 0:
            size = end + 4 + int(headers(bytes(buffer[:end]))["content-length"]) + 4
            if len(buffer) < size:
                break
            yield bytes(buffer[:size])
            del buffer[:size]
    if buffer:
        raise ValueError("an archive ends inside a record")


def parsed(data: bytes) -> dict:
    head, _, body = data.partition(b"\r\n\r\n")
    h = headers(head)
    body = body[: int(h["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return {"headers": h, "http": headers(http), "payload": payload}


def _normalise(store, source: str, target: str) -> list[tuple[str, int, int, str]]:
    """Rewrite a monolithic file with one member per record: the index rows."""
    rows, at = [], 0
    with store.open_input_stream(source, compression=None) as raw, store.open_output_stream(target, compression=None) as out:
        for data in records(inflated(raw)):
            z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            member = z.compress(data) + z.flush()
            out.write(member)
            rows.append((target, at, len(member), headers(data[: data.find(b"\r\n\r\n")])["warc-record-id"].strip("<>")))
            at += len(member)
    return rows


def _plan(pages: DataFrame, id: str, html: str, least_bytes: int) -> DataFrame:
    """Groups of several equal payloads: digest, first (the largest id), ties (rows with it), several (true)."""
    payload = text_of(html).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("page"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least_bytes)
    by_id = rows.groupBy("digest", "page").agg(F.count(F.lit(1)).alias("n"))
    found = by_id.groupBy("digest").agg(F.max(F.struct("page", "n")).alias("top"), F.sum("n").alias("members"))
    return found.where("members > 1").select("digest", F.col("top.page").alias("first"), F.col("top.n").alias("ties"), F.lit(True).alias("several"))


def archive(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write a WARC record for each row: (index, folder).

    index: file, offset, length, record_id of each record, itself written beside the files as ``index.parquet``.
    The payload is the html in UTF-8, null as empty.  Of records with equal payloads of ``least_bytes`` or more,
    that with the largest id is the response and the others revisit it; of repeated rows with this id, one is.
    A null id is less than any other; null urls are written as ''.  Record ids are told from page, payload and url,
    so reruns agree and a revisit names its response's id; rows of one task that agree in all three are numbered.
    Other columns play no part.  Without a ``folder`` the files are working
    tables of this driver, deleted when it ends.
    """
    spark = pages.sparkSession
    folder = (folder or temporary(spark, "warc")).rstrip("/")
    chosen = staged(_plan(pages, id, html, least_bytes), "warc-plan")
    payload = text_of(html).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    both = rows.join(chosen, "digest", "left").withColumn("leads", F.coalesce("several", F.lit(False)) & F.col("page").eqNullSafe(F.col("first"))).withColumn("copy", F.lit(1))
    if chosen.where("ties > 1").take(1):
        # rows that tie for the response, and only they, are numbered
        tied = F.col("leads") & (F.col("ties") > 1)
        copy = F.row_number().over(Window.partitionBy("digest").orderBy("url"))
        both = both.where(~tied | F.col("ties").isNull()).union(both.where(tied).withColumn("copy", copy))
    kind = F.when(F.col("several").isNull() | (F.col("leads") & (F.col("copy") == 1)), "response").otherwise("revisit")
    planned = both.select("page", "url", "payload", "digest", kind.alias("kind"), F.when(kind == "revisit", F.col("first")).alias("refers_to"))
    store_uri = folder

    def run(batches):
        store, root = fs.FileSystem.from_uri(store_uri)
        store.create_dir(root, recursive=True)
        name, state, n = uuid.uuid4().hex, None, 0
        again: dict[tuple, int] = {}

        def close():
            source, out, z, _ = state
            out.write(z.flush())
            out.close()
            found = _normalise(store, source, source.replace(".mono.warc.gz", ".warc.gz"))
            store.delete_file(source)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=INDEX.names)

        for batch in batches:
            columns = [batch.column(c) for c in ("page", "url", "payload", "digest", "kind", "refers_to")]
            for k in range(batch.num_rows):
                page, address, data, digest, what, refers = (c[k].as_py() for c in columns)
                if state is None:
                    source = f"{root}/{name}-{n}.mono.warc.gz"
                    state = [source, store.open_output_stream(source, compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0]
                    n += 1
                if what == "response" and len(data) >= least_bytes:
                    own = named("response", page, digest)
                else:  # rows that agree in all of this get numbers
                    turn = again[key] = again.get(key := (what, page, digest, address), -1) + 1
                    own = named(what, page, digest, address, turn)
                made = record(what, own, address, base32(digest), data, named("response", refers, digest) if what == "revisit" else None, page, len(data), refers)
                state[1].write(state[2].compress(made))
                state[3] += len(made)
                if state[3] >= FILE_BYTES:
                    yield close()
                    state = None
        if state is not None:
            yield close()

    index_path = f"{folder}/index.parquet"
    planned.mapInArrow(run, INDEX).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path), folder


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)
_READ = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())


def read_archive(index: DataFrame, folder: str, *, payload: bool = True) -> DataFrame:
    """The records that ``index`` points to: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    Each record is read at its offset and inflated by itself.  A response whose payload has another digest or
    length than its headers say is an error.
    """

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        open_file, name = None, None
        for batch in batches:
            out: list[list] = [[] for _ in _READ]
            size = 0
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if open_file is not None:
                        open_file.close()
                    open_file, name = store.open_input_file(file), file
                r = parsed(zlib.decompress(open_file.read_at(length, offset), GZIP))
                h, kind, data = r["headers"], r["headers"]["warc-type"], r["payload"]
                digest, count = h["warc-payload-digest"].removeprefix("sha1:"), int(r["http"]["content-length"])
                if kind == "response" and (count != len(data) or digest != base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()):
                    raise ValueError(f"{file} at {offset}: the payload is not what its headers say")
                page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                row = (page and int(page), unescaped(h["warc-target-uri"]), data if payload and kind == "response" else None, count, digest, kind, refers and int(refers))
                for c, v in zip(out, row):
                    c.append(v)
                size += len(data)
                if size > STEP * 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _READ)], names=READ.names)
                    out, size = [[] for _ in _READ], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _READ)], names=READ.names)
        if open_file is not None:
            open_file.close()

    return index.mapInArrow(run, READ)
