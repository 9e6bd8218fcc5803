"""Markdown documents with frontmatter: scan, validation, and sections cut out byte for byte.

A document is one row, and stays one through parsing: its lines and sections are arrays, so
nothing is shuffled until sections become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import is_blank, once, slugify, trim, trim_end, with_first_repeat
from plumbline.policy import FRONTMATTER_KEYS
from plumbline.sources.ledger import file_system
from plumbline.sources.shared import numbered, qualified, shared_dir, stored

CHUNK = ("chunkId", "docId", "docTitle", "docType", "effectiveDate", "version", "sectionHeading", "text")


class ChunkError(ValueError):
    """A document that can't be loaded; ``kind`` says why."""

    def __init__(self, kind: str, file: str):
        super().__init__(f"{file}: {kind}")
        self.kind, self.file = kind, file


#: Schemes that executors open by themselves, and files that a task reads, about.
_OPENED, FILES_PER_TASK = ("file", "hdfs", "s3", "gs"), 2_000
_FILE = "name string, source string"


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """name and is_file of every entry of a folder, hidden ones included, listed by one task and written to the shared folder."""

    def run(batches):
        from pyarrow import fs

        for _ in batches:
            system, path = file_system(folder)
            found = system.get_file_info(fs.FileSelector(path))
            for lo in range(0, len(found), 10_000):
                part = found[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([f.base_name for f in part], pa.string()), pa.array([f.is_file for f in part], pa.bool_())], names=["name", "is_file"])

    listed = spark.range(0, 1, 1, 1).mapInArrow(run, "name string, is_file boolean")
    return stored(listed, shared_dir(spark, "entries"))


def _sources(names: DataFrame, folder: str, n: int) -> DataFrame:
    """name and source of files of a folder, each read where it is needed."""

    def run(batches):
        system, path = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{path}/{name}") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text], pa.string())], names=["name", "source"])

    return names.repartition(max(1, -(-n // FILES_PER_TASK)), "name").mapInArrow(run, _FILE)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """name and source of every regular .md file directly in ``folder``; others raise, an empty folder gives no rows.

    Executors list and read; the driver gets counts and the first bad name. A folder whose scheme
    only Spark's readers know is read by these, whose listing is the driver's.
    """
    whole = qualified(spark, folder)
    if whole.split(":", 1)[0] not in _OPENED:
        return _read_by_spark(spark, folder)
    entries = _entries(spark, whole)
    bad = F.when(~F.col("is_file") | ~F.col("name").endswith(".md"), F.col("name"))
    n, first = entries.agg(F.count("*"), F.min(bad)).first()
    if first is not None:
        raise ChunkError("non-markdown-entry", first)
    return _sources(entries.select("name"), whole, n)


def _read_by_spark(spark: SparkSession, folder: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    listing = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = {s.getPath().getName(): s.isFile() for s in listing}
    # Spark's readers pass over hidden names, so these can't be read here
    bad = sorted(n for n, is_file in names.items() if not is_file or not n.endswith(".md") or n[0] in "_.")
    if bad:
        raise ChunkError("non-markdown-entry", bad[0])
    if not names:
        return spark.createDataFrame([], _FILE)
    name = F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1))
    return spark.read.text([str(s.getPath()) for s in listing], wholetext=True).select(name.alias("name"), F.col("value").alias("source"))


def with_lines(docs: DataFrame) -> DataFrame:
    """pos, start and text of every line of ``source``, one row each, carriage returns kept; start in characters.

    A document's lines are made where it is read, nothing is shuffled; a null source has none.
    """
    schema = "name string, pos long, start long, line string"

    def run(batches):
        for batch in batches:
            for name, source in zip(batch.column(0), batch.column(1), strict=True):
                if not source.is_valid:
                    continue
                lines = source.as_py().split("\n")
                starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
                cols = [pa.repeat(name, len(lines)), pa.array(np.arange(len(lines))), pa.array(starts, pa.int64()), pa.array(lines, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["name", "pos", "start", "line"])

    return docs.select("name", "source").mapInArrow(run, schema)


def _first(kinds: Column) -> Column:
    return F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0))


def parse(docs: DataFrame) -> DataFrame:
    """name, error, front (map), sections (array of heading, slug, text) of ``docs`` (``name``, ``source``).

    error: the kind of the first problem in reading order, or null.
    """
    lines = F.transform(F.split("source", "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    docs = once(docs, lines=lines)
    close = F.array_position(F.slice("lines", 2, F.size("lines")), "---")  # 0: never closed
    docs = once(docs, close=close)
    docs = once(docs, block=F.slice("lines", 2, F.greatest(F.col("close") - 1, F.lit(0)).cast("int")))
    pattern = r"\A([A-Za-z][A-Za-z0-9_-]*):[ \t]*(\S.*)\z"
    key = lambda x: F.regexp_extract(x, pattern, 1)
    docs = with_first_repeat(once(docs, keys=F.transform("block", key)), again="keys")
    problem = F.transform(
        "block",
        lambda x, i: F.when(~x.rlike(pattern), "malformed-frontmatter-line")
        .when(~key(x).isin(*FRONTMATTER_KEYS), "unknown-key")
        .when(i == F.col("again"), "duplicate-key"),
    )
    front_error = (
        F.when(F.get("lines", F.lit(0)) != "---", "missing-frontmatter")
        .when(F.col("close") == 0, "unterminated-frontmatter")
        .otherwise(F.coalesce(_first(problem), F.when(~F.forall(F.array(*map(F.lit, FRONTMATTER_KEYS)), lambda k: F.array_contains(F.col("keys"), k)), "missing-key")))
    )
    docs = once(docs, front_error=front_error)
    values = F.transform("block", lambda x: trim_end(F.regexp_extract(x, pattern, 2)))
    front = F.when(F.col("front_error").isNull(), F.map_from_arrays("keys", values))
    # the text after the frontmatter, with its line ends
    used = F.aggregate(F.slice(F.split("source", "\n", -1), 1, F.col("close").cast("int") + 1), F.lit(0), lambda n, x: n + F.length(x) + 1)
    body = F.when(F.col("front_error").isNull(), F.col("source").substr(used + 1, F.length("source")))
    docs = once(docs, front=front, body=F.concat(F.lit("\n"), body))
    pieces = F.split("body", r"(?<=\n)(?=## )", -1)
    docs = once(docs, pieces=pieces)
    cut = F.transform(
        F.slice("pieces", 2, F.size("pieces")),
        lambda p: F.struct(
            trim(F.substring(F.substring_index(p, "\n", 1), 4, 2147483647)).alias("heading"),
            trim(F.when(F.contains(p, F.lit("\n")), p.substr(F.locate("\n", p) + 1, F.length(p))).otherwise("")).alias("text"),
        ),
    )
    docs = once(docs, cut=cut)
    section = F.transform("cut", lambda s: F.struct(s["heading"].alias("heading"), slugify(s["heading"]).alias("slug"), s["text"].alias("text")))
    docs = once(docs, sections=section)
    docs = with_first_repeat(once(docs, slugs=F.transform("sections", lambda s: s["slug"])), collides="slugs")
    per_section = F.transform(
        "sections",
        lambda s, i: F.when(s["slug"] == "", "empty-slug")
        .when(i == F.col("collides"), "slug-collision")
        .when(s["text"] == "", "empty-section"),
    )
    error = (
        F.when(F.col("front_error").isNotNull(), F.col("front_error"))
        .when(F.concat(F.element_at("front", F.lit("id")), F.lit(".md")) != F.col("name"), "id-filename-mismatch")
        .when(~is_blank(F.get("pieces", F.lit(0))), "preamble-text")
        .when(F.size("sections") == 0, "no-sections")
        .otherwise(_first(per_section))
    )
    return once(docs, error=error).select("name", "error", "front", "sections")


def sections(parsed: DataFrame) -> DataFrame:
    """The CHUNK columns and ``pos`` of every section of the documents without an error."""
    rows = parsed.where("error is null").select("front", F.posexplode("sections").alias("pos", "s"))
    get = lambda k: F.element_at("front", F.lit(k))
    return rows.select(
        F.concat_ws("#", get("id"), "s.slug").alias("chunkId"),
        get("id").alias("docId"),
        get("title").alias("docTitle"),
        get("docType").alias("docType"),
        get("effectiveDate").alias("effectiveDate"),
        get("version").alias("version"),
        F.col("s.heading").alias("sectionHeading"),
        F.col("s.text").alias("text"),
        F.col("pos").cast("long").alias("pos"),
    )


def in_document_order(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``ord``, from 0, in the order of file names and of sections in a file."""
    return numbered(chunks, [F.concat("docId", F.lit(".md")), F.col("pos")], "ord")


def _checked(parsed: DataFrame) -> DataFrame:
    """The sections; an error if a document has one, the first by name. Parsed documents are kept for both and let go."""
    parsed = parsed.persist()
    try:
        bad = parsed.where("error is not null").agg(F.min_by(F.struct("name", "error"), "name").alias("bad")).first()["bad"]
        if bad:
            raise ChunkError(bad["error"], bad["name"])
        return in_document_order(sections(parsed))
    finally:
        parsed.unpersist()


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """The sections of one file, with their order ``ord``."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    text = spark.read.text(path, wholetext=True).select(F.lit(name).alias("name"), F.col("value").alias("source"))
    return _checked(parse(text))


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of a whole folder in document order (``ord``); one bad document fails it, the first by name."""
    return _checked(parse(read_files(spark, folder)))
