"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.shared import shared_dir, stored

__all__ = ["id_and_text", "parts_for", "shared_dir", "shuffle_parts", "small_batches", "stored", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns text operators need, null text as empty; other columns stay out of the way."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )


def utf8(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a column of texts without nulls."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def parts_for(rows: DataFrame, part_bytes: int) -> int:
    """Partitions for the texts of ``rows``: as many as the session's, or more where the counted bytes ask for them."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_parts(rows.sparkSession), -(-size // part_bytes))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Arrow batches of so many rows at most while texts are read, which bounds the memory of both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(was)) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)
