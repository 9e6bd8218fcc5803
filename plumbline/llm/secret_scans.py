"""Secret scans over an incremental ledger of content-addressed texts.

Every version of every path is addressed by the SHA-256 of its text. The ledger has one row for
each (blob, rule version) that was scanned, with what was found. A scan hashes all versions,
keeps the blobs the ledger does not have under the current rules, scans one copy of each,
appends the rows, and joins the ledger back to all paths. A ledger row is written whole with its
findings, so a run that dies leaves either the pair or nothing, and the next run goes on.

The text of a blob is fetched without shuffling texts where the list that selects it is small
enough to broadcast (``SMALL`` ids at most, counted first): the rows to scan, or else the rows
not to scan. Beyond that both sides are shuffled by blob and id.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, shared_dir, stored, table

SMALL = 200_000

#: Kinds every rule version has, in the order of the digest, with what a match must satisfy.
_assign = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
BASE = {
    "assign": (_assign, lambda m: len(m[2]) >= 12),
    # the same as [A-Z0-9]+ and [0-9a-f]+ with shorter matches dropped: a run holds one match
    "access": (re.compile(r"AKIA[A-Z0-9]{14,}"), lambda m: True),
    "hex": (re.compile(r"[0-9a-f]{16,}"), lambda m: True),
}
EXTRA = {
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "code_host": re.compile(r"\bgh[opsur]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    "api": re.compile(r"\bAIza[A-Za-z0-9_-]{35}"),
    "url_login": re.compile(r"://[^\s:/@]{1,64}:[^\s:/@]{6,128}@"),
}
_may = re.compile(r"AKIA|eyJ|gh[opsur]_|xox[abprs]-|AIza|-----BEGIN |://").search
ORDER = {k: i for i, k in enumerate([*BASE, *EXTRA])}
RULES_VERSION = "r%08x" % zlib.crc32("\n".join([*(p.pattern for p, _ in BASE.values()), *(p.pattern for p in EXTRA.values())]).encode())
ROW = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base string, spans string"


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start and then kind; in code points, end exclusive."""
    out = [(m.start(), kind, m.end()) for kind, (p, keep) in BASE.items() for m in p.finditer(text) if keep(m)]
    if _may(text):
        out += [(m.start(), kind, m.end()) for kind, p in EXTRA.items() for m in p.finditer(text)]
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]], s[2]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def _scan(batches):
    """Ledger rows of (blob, text) batches; a blob repeated within a task is scanned once."""
    seen: set[str] = set()
    for batch in batches:
        blobs, texts = batch.column(0).to_pylist(), batch.column(1)
        rows = []
        for i, blob in enumerate(blobs):
            if blob in seen:
                continue
            seen.add(blob)
            spans = find_secrets(texts[i].as_py())
            n = [sum(s[1] == k for s in spans) for k in BASE]
            rows.append((blob, RULES_VERSION, *n, joined(s for s in spans if s[1] in BASE), joined(spans)))
        if len(seen) > 1_000_000:
            seen.clear()
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The rows of a ledger, each (blob, rule version) once: two scans at a time may both have appended it."""
    return spark.read.schema(ROW).parquet(ledger).dropDuplicates(["blob", "rule_version"])


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def scan(docs: DataFrame, ledger: str) -> DataFrame:
    """doc_id and the ledger's row for every row of ``docs`` (``doc_id``, ``text``); scans what is new.

    Null text is the empty blob, which has no findings. Null ids, repeated ids and repeated rows
    stay rows of their own: a doc_id with several texts is a path with several versions. An empty
    table gives no rows and leaves the ledger as it was. Texts of any length are searched whole,
    and other columns are not looked at.
    """
    spark = docs.sparkSession
    work = shared_dir(spark, "secrets")
    if not _exists(spark, ledger):
        spark.createDataFrame([], ROW).write.mode("append").parquet(ledger)  # so that it can be read
    texts = id_and_text(docs).withColumn("blob", F.sha2("text", 256)).withColumn("path", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    paths = stored(texts.select("doc_id", "path", "blob"), f"{work}/paths")
    known = read_ledger(spark, ledger).where(F.col("rule_version") == RULES_VERSION).select("blob")
    todo = stored(paths.join(known, "blob", "left_anti").groupBy("blob").agg(F.min("path").alias("path")), f"{work}/todo")
    n_todo, n_all = todo.count(), paths.count()
    keys = ["blob", "path"]
    if n_todo <= SMALL:
        new = texts.join(F.broadcast(todo), keys, "left_semi")
    elif n_all - n_todo <= SMALL:
        new = texts.join(F.broadcast(paths.select(keys).join(todo, keys, "left_anti")), keys, "left_anti")
    else:
        new = texts.join(todo.hint("merge"), keys, "left_semi")
    if n_todo:
        new.select("blob", "text").mapInArrow(_scan, ROW).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    rows = read_ledger(spark, ledger).where(F.col("rule_version") == RULES_VERSION)
    return paths.select("doc_id", "blob").join(rows, "blob")


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), shared_dir(spark, "ledger"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "blob")


QUERIES = {"op9_secret_ledger": op9_secret_ledger}
ORACLE_SQL: dict[str, str] = {}
