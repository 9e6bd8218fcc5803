"""Token, latency and cost accounting from cumulative counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.policy import EMBEDDING_USD_PER_MILLION, INPUT_USD_PER_MILLION, OUTPUT_USD_PER_MILLION

COUNTERS = ("embedding_tokens", "input_tokens", "output_tokens", "latency_ms")


def embedding_cost(tokens: Column) -> Column:
    return tokens / 1_000_000 * EMBEDDING_USD_PER_MILLION


def generation_cost(inputs: Column, outputs: Column) -> Column:
    return inputs / 1_000_000 * INPUT_USD_PER_MILLION + outputs / 1_000_000 * OUTPUT_USD_PER_MILLION


def with_cost(rows: DataFrame) -> DataFrame:
    cost = embedding_cost(F.col("embedding_tokens")) + generation_cost(F.col("input_tokens"), F.col("output_tokens"))
    return rows.withColumn("cost_usd", cost)


def deltas(snapshots: DataFrame, key: str = "run_id") -> DataFrame:
    """Usage of each step from cumulative snapshots (key, pos, COUNTERS); the first one (indexing) stays as it is."""
    order = Window.partitionBy(key).orderBy("pos")
    step = [(F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0))).alias(c) for c in COUNTERS]
    return with_cost(snapshots.select(key, "pos", *step))


def totals(usage: DataFrame, key: str = "run_id") -> DataFrame:
    """Summed counters, and the cost of the sums."""
    return with_cost(usage.groupBy(key).agg(*[F.sum(c).alias(c) for c in COUNTERS]))


def of_run(indexing: DataFrame, asked: DataFrame, results: DataFrame) -> DataFrame:
    """run_id, pos, question_id, COUNTERS and cost of the index build (pos -1) and of each question.

    indexing and asked: of embed_with_usage; asked has pos and question_id. results: of
    answer_questions.
    """
    zero = F.lit(0).cast("long")
    build = indexing.agg(
        F.coalesce(F.sum("embedding_tokens"), zero).alias("embedding_tokens"), zero.alias("input_tokens"), zero.alias("output_tokens"),
        F.coalesce(F.sum("embedding_ms"), zero).alias("latency_ms"),
    ).select(F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("question_id"), *COUNTERS)
    each = asked.select(F.col("pos").cast("long").alias("pos"), "question_id", "embedding_tokens", "embedding_ms").join(
        results.select("question_id", "input_tokens", "output_tokens", "generation_ms"), "question_id"
    )
    each = each.withColumn("latency_ms", F.col("embedding_ms") + F.col("generation_ms")).select("pos", "question_id", *COUNTERS)
    return with_cost(build.unionByName(each)).withColumn("run_id", F.lit("run"))
