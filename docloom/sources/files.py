"""Readers and writers: raw files, page tables, manifests, states, points.

PDF layers, scans and word models need libraries that are not here: their places are columns that another job fills.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as X
from ..functions.unicode import nfkc


def raw_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("pdf", "docx", "txt"), *, skip_locks: bool = True) -> DataFrame:
    """source_path, modified, length, content, sha1, ext of files below a folder by extension, lock files left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select(F.col("path").alias("source_path"), F.col("modificationTime").alias("modified"), "length", "content", F.sha1("content").alias("sha1"), ext.alias("ext"))
    rows = rows.where(F.col("ext").isin(*extensions))
    return rows.where(~F.element_at(F.split("source_path", "/"), -1).startswith("~$")) if skip_locks else rows


def text_of(content: F.Column, charset: str = "UTF-8") -> F.Column:
    """Bytes as text, wrong ones left out."""
    return F.replace(F.decode(content, charset) if charset != "UTF-8" else F.call_function("make_valid_utf8", content.cast("string")), F.lit("�"), F.lit(""))


@F.pandas_udf(T.StringType())
def detected_text(content: pd.Series) -> pd.Series:
    """Bytes as text by their mark, else UTF-8 if they are that, else the Cyrillic charset that gives most small letters."""

    def small(text: str) -> int:
        return sum("а" <= c <= "я" or c == "ё" for c in text)

    def read(data) -> str:
        if data is None:
            return ""
        for mark, charset in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if data.startswith(mark):
                return data.decode(charset, "ignore")
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return max((data.decode(c, "ignore") for c in ("cp1251", "koi8-r", "cp866")), key=small)

    return content.map(read)


@F.pandas_udf(T.StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Paragraphs of a DOCX file that have text, then rows of its tables with cells by ' | '."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def text(node) -> str:
        return "".join((n.text or "") if n.tag == w + "t" else "\t" if n.tag == w + "tab" else "\n" if n.tag in (w + "br", w + "cr") else "" for n in node.iter())

    def read(data) -> str:
        try:
            body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(w + "body")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return ""
        parts = [t for p in body.findall(w + "p") if (t := text(p).strip())]
        for row in body.iter(w + "tr"):
            cells = ["\n".join(text(p) for p in c.findall(w + "p")).strip() for c in row.findall(w + "tc")]
            if any(cells):
                parts.append(" | ".join(c for c in cells if c))
        return "\n".join(parts).strip()

    return content.map(read)


class _Text(HTMLParser):
    """Text nodes line by line, headings of the first three levels marked before them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.heading: list[str] | None = None
        self.at = 0
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "template")
        if tag in ("h1", "h2", "h3"):
            self.heading, self.at = [], len(self.parts)

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in ("script", "style", "template")))
        if tag in ("h1", "h2", "h3") and self.heading is not None:
            self.parts.insert(self.at, "\n\n### [HEADING] " + "".join(t.strip() for t in self.heading) + "\n")
            self.heading = None

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.heading is not None:
                self.heading.append(data)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text nodes of a page joined by line breaks, with marks before headings."""

    def read(page) -> str:
        parser = _Text()
        parser.feed(page or "")
        parser.close()
        return "\n".join(parser.parts)

    return html.map(read)


def read_page_lines(lines: DataFrame, *, value: str = "value", normalise: bool = True) -> DataFrame:
    """Lines of page files as page, text, ok: lines are cleaned, blank ones and such as are no object left out; lines that are no JSON have ok false."""
    clean = X.strip(X.printable(value))
    rows = lines.withColumn("__line", nfkc(clean) if normalise else clean).where("__line <> ''").withColumn("__v", F.try_parse_json("__line"))
    kind = F.schema_of_variant("__v")
    rows = rows.where(F.col("__v").isNull() | kind.startswith("OBJECT"))
    page = F.coalesce(F.try_variant_get("__v", "$.page", "int"), F.lit(0))
    text = F.coalesce(F.try_variant_get("__v", "$.text", "string"), F.lit(""))
    return rows.withColumns({"page": page, "text": text, "ok": F.col("__v").isNotNull()}).drop("__line", "__v")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, page, text, ok of all page files (<doc_id>.pages.jsonl) in a folder."""
    lines = spark.read.text(f"{folder}/*.pages.jsonl").withColumn("__path", F.col("_metadata.file_path"))
    name = F.element_at(F.split("__path", "/"), -1)
    doc = F.replace(F.regexp_replace(F.url_decode(name), r"\.jsonl$", ""), F.lit(".pages"), F.lit(""))
    return read_page_lines(lines.withColumn("doc_id", doc)).drop("__path", "value").select("doc_id", "page", "text", "ok")


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages by document: documents that are written again replace their own rows only."""
    pages.write.partitionBy("doc_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _at(spark, path)
    return store.exists(p)


def tempfolder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written beside its place and then moved there, so readers see the old one or the new."""
    store, p = _at(spark, path)
    _, new = _at(spark, f"{path}.new")
    out = store.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(p):
        store.delete(p, False)
    if not store.rename(new, p):
        raise OSError(f"{path} could not be written")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a manifest; none if it is not there or no manifest."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.MANIFEST_DOC)
    docs = spark.read.schema(schemas.MANIFEST).option("multiLine", "true").json(path)
    return docs.select(F.explode("docs").alias("d")).select("d.*")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and sha1 of a state file, an object of both."""
    if not exists(spark, path):
        return spark.createDataFrame([], "doc_id string, sha1 string")
    whole = spark.read.text(path, wholetext=True)
    # one object, or one in each line
    objects = whole.select(F.explode(F.split(F.regexp_replace("value", r"\}\s*\n\s*\{", "}\x02{"), "\x02")).alias("value"))
    return objects.select(F.explode(F.from_json("value", schemas.STATE)).alias("doc_id", "sha1"))


def write_state(state: DataFrame, path: str) -> None:
    """doc_id and sha1 as rows of JSON objects of one key, which ``read_state`` reads; the last state gives way."""
    state.select(F.to_json(F.create_map(F.col("doc_id").cast("string"), F.col("sha1"))).alias("value")).write.mode("overwrite").text(path)


def write_manifest(docs: DataFrame, path: str) -> None:
    """Documents of a manifest, one object each with itself in ``docs``, which ``read_manifest`` reads; fields that ``docs`` lacks are null."""
    have = set(docs.columns)
    row = F.struct(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.MANIFEST_DOC.fields])
    docs.select(F.array(row).alias("docs")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


#: States of a job, in order.
QUEUED, RUNNING, DONE, FAILED = "queued", "running", "done", "failed"


def log_job(spark: SparkSession, path: str, job: str, state: str, detail: str = "") -> None:
    """One row more in the log of jobs: job, state, detail, at."""
    rows = spark.createDataFrame([(job, state, detail)], "job string, state string, detail string")
    rows.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each job."""
    rows = spark.read.schema("job string, state string, detail string, at timestamp").json(path)
    # of states logged at one time the later kind counts
    order = F.struct("at", F.array_position(F.array(*map(F.lit, (QUEUED, RUNNING, DONE, FAILED))), F.col("state")))
    return rows.groupBy("job").agg(F.max_by("state", order).alias("state"), F.max_by("detail", order).alias("detail"), F.max("at").alias("at"))


def stored_hashes(points: DataFrame, doc_id: str | None = None) -> DataFrame:
    rows = points if doc_id is None else points.where(F.col("doc_id") == doc_id)
    return rows.select("doc_id", "text_hash").distinct()


def save_table(df: DataFrame, name: str, *, recreate: bool = False) -> None:
    """A table made anew, or added to if it is there with the same columns."""
    df.write.mode("overwrite" if recreate else "append").saveAsTable(name)


def collections(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the tables of points, in order."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def sample_points(points: DataFrame, n: int = 10) -> DataFrame:
    """Document and pages of any ``n`` points."""
    return points.select("doc_id", "page_start", "page_end").limit(n)


def write_results(results: DataFrame, path: str, *, mode: str = "append") -> None:
    """Results as JSON, one file row each; ``report`` of operators.context gives the text beside it."""
    results.write.mode(mode).json(path)
