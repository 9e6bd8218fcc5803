"""Calls of paid services, each made once, whatever fails.

A ledger is a folder that driver and executors share. Replies are appended by the task that got
them, a small file for each batch of calls, under a name that is moved into place when it is
whole. So a task that dies half-way leaves what it has paid for, and the next attempt reads it
before it asks for the rest; only the batch in flight can be lost. A ledger that is given again,
in another run, holds the replies of the earlier ones.

A reply that failed is a row, too, with its ``problem`` and what it used. A failure in FINAL is
an answer of the service: it stands, and asking again would cost again. Others (a broken
connection) are asked again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.shared import qualified

#: Failures that are kept and not asked for again.
FINAL = ("model-refusal", "truncated", "empty-response")
#: Requests of a task, about; and files of replies that an attempt reads back at once.
PER_TASK = 2_000
_COMMON = [("key", pa.string()), ("run", pa.string()), ("at", pa.int64()), ("problem", pa.string()), ("message", pa.string())]

Call = Callable[[list[dict]], list[dict]]


class CallFailed(RuntimeError):
    """A call failed; ``kind`` and the message are those of its row."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind

    def __reduce__(self):
        return type(self), (self.kind, str(self))


def file_system(folder: str):
    """(file system, path in it) of a folder, for executors."""
    from pyarrow import fs

    if folder.startswith("file:"):  # its characters are no escapes
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class _Own:
    """The files of one task of a run, whichever attempt it is."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.fs, self.path = file_system(folder)
        self.schema = schema
        self.fs.create_dir(self.path, recursive=True)

    def read(self) -> Iterator[pa.Table]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for f in self.fs.get_file_info(fs.FileSelector(self.path)):
            if f.base_name.endswith(".parquet") and not f.base_name.startswith("_"):
                yield pq.read_table(f.path, filesystem=self.fs, columns=["key", "problem", "message"])

    def append(self, rows: list[dict]) -> None:
        import pyarrow.parquet as pq

        name = f"{uuid.uuid4().hex}.parquet"
        pq.write_table(pa.Table.from_pylist(rows, self.schema), f"{self.path}/_{name}", filesystem=self.fs)
        self.fs.move(f"{self.path}/_{name}", f"{self.path}/{name}")


def _schema(fields: pa.Schema) -> tuple[pa.Schema, T.StructType]:
    from pyspark.sql.pandas.types import from_arrow_schema

    whole = pa.schema([*[pa.field(n, t) for n, t in _COMMON], *fields])
    return whole, from_arrow_schema(whole)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read(spark: SparkSession, folder: str, fields: pa.Schema) -> DataFrame:
    """Every row of a ledger: key, run, at (ns), problem, message and the fields; none for a folder that isn't there."""
    _, schema = _schema(fields)
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def replies(ledger: DataFrame) -> DataFrame:
    """One row for each key: its first good reply, or its first final failure. Two attempts at a time may both have asked."""
    order = Window.partitionBy("key").orderBy(F.col("problem").isNotNull(), "at", "run")
    rows = ledger.where(F.col("problem").isNull() | F.col("problem").isin(*FINAL))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def ask_once(requests: DataFrame, folder: str, fields: pa.Schema, call: Call, batch: int, characters: int | None = None, size: str | None = None) -> DataFrame:
    """The reply (a row of ``replies``) to each key of ``requests`` (key and what ``call`` reads), asking for those the ledger lacks.

    call: a list of requests as dicts to as many rows of ``fields`` as dicts, in order, with
    ``problem`` and ``message`` for a failure. It gets at most ``batch`` requests, and of those with
    more ``characters`` in the column ``size`` one at a time. Equal keys are one request. Null keys
    are left out; no call is made for no requests. Raises CallFailed where a reply is a failure.
    """
    spark = requests.sparkSession
    folder = qualified(spark, folder)
    whole, _ = _schema(fields)
    todo, known = requests.where("key is not null").dropDuplicates(["key"]), _exists(spark, folder)
    if known:
        todo = todo.join(replies(read(spark, folder, fields)).select("key"), "key", "left_anti")
    todo = todo.persist()
    run = uuid.uuid4().hex
    try:
        n = todo.count()
        if n:
            # a key's task follows from the key alone, so an attempt finds the files of the one before
            parts = -(-n // PER_TASK)
            todo.repartition(parts, "key").mapInArrow(_task(f"{folder}/{run}", run, whole, call, batch, characters, size), "n long").agg(F.sum("n")).collect()
    except Exception as e:
        failed = read(spark, folder, fields).where((F.col("run") == run) & F.col("problem").isNotNull()).orderBy("at").first()
        if failed is None:
            raise
        raise CallFailed(failed["problem"], failed["message"]) from e
    finally:
        todo.unpersist()
    found = requests.where("key is not null").select("key").distinct().join(replies(read(spark, folder, fields)), "key")
    bad = found.where("problem is not null").orderBy("at").first() if known else None  # of an earlier run
    if bad is not None:
        raise CallFailed(bad["problem"], bad["message"])
    return found.withColumn("new", F.col("run") == run)


def _task(folder: str, run: str, schema: pa.Schema, call: Call, batch: int, characters: int | None, size: str | None):
    def ask(own: _Own, queue: list[dict]) -> int:
        import time

        at = time.time_ns()
        rows = [{"key": r["key"], "run": run, "at": at} | row for r, row in zip(queue, call(queue), strict=True)]
        own.append(rows)
        for row in rows:
            if row.get("problem"):
                raise CallFailed(row["problem"], row["message"])
        return len(rows)

    def work(batches):
        from pyspark import TaskContext

        own, done = _Own(f"{folder}/part-{TaskContext.get().partitionId():06d}", schema), set()
        for table in own.read():
            for key, problem, message in zip(*(table.column(k).to_pylist() for k in ("key", "problem", "message")), strict=True):
                if problem in FINAL:
                    raise CallFailed(problem, message)
                if problem is None:
                    done.add(key)
        queue, held, n = [], 0, 0
        for rows in batches:
            for row in rows.to_pylist():
                if row["key"] in done:
                    continue
                weight = len(row[size]) if size else 0
                if queue and (len(queue) >= batch or characters and held + weight > characters):
                    n += ask(own, queue)
                    queue, held = [], 0
                queue.append(row)
                held += weight
        if queue:
            n += ask(own, queue)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return work
