"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, a temporary folder of this machine is used if all of Spark runs
    on it; elsewhere executors could not read it, so that is an error. A path without a scheme is
    one of the default file system.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_plumbline_shared", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can read and write")
        base = sc._plumbline_shared = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    folder = f"{qualified(spark, base).rstrip('/')}/plumbline-{tag}-{uuid.uuid4().hex[:12]}"
    for own in getattr(sc, "_plumbline_scratch", [])[-1:]:
        own.append(folder)
    return folder


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme; without one it is of the default file system, and relative to its working folder."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, in the end, the folders that ``shared_dir`` gave out meanwhile: what was made of them must be written by then."""
    sc = spark.sparkContext
    if not hasattr(sc, "_plumbline_scratch"):
        sc._plumbline_scratch = []
    sc._plumbline_scratch.append(own := [])
    try:
        yield own
    finally:
        sc._plumbline_scratch = [x for x in sc._plumbline_scratch if x is not own]
        for folder in own:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number ``name``, from 0, in an order.

    Rows are dealt into ranges of that order, numbered inside them and written to the shared
    folder, so that the ranges stay what they are; only a count for each range comes to the driver.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ranged = stored(ranged, shared_dir(rows.sparkSession, "numbered"))
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    starts = F.create_map(*[F.lit(x).cast("long") for kv in (before or {0: 0}).items() for x in kv])
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # the number inside the partition
    return ranged.withColumn(name, F.element_at(starts, F.col("_part").cast("long")) + at).drop("_part", "_at")
