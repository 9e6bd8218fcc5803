"""``python -m plumbline``: run a question set against a corpus, report, and gate.

Exit codes: 0 the gate is met (or calibration ran), 1 it is not, 2 the run could not be set up.
"""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import answer, calibrate, evaluate, report, retrieve, usage
from plumbline.policy import DEFAULT_K, SIMILARITY_FLOOR
from plumbline.sources import corpus, environment, models
from plumbline.sources.shared import scratch, shared_dir, stored

PASS, GATE_FAILED, SETUP_ERROR = 0, 1, 2
USAGE = """Usage: python -m plumbline [--calibrate]

  --calibrate  measure how far correct and wrong retrievals are apart; asks no generator
  --help, -h   this text

PLUMBLINE_GENERATOR names the generator as module:function; or PLUMBLINE_GENERATION_URL, _KEY and
_MODEL name a message service. PLUMBLINE_EMBEDDER names the embedder; or PLUMBLINE_EMBEDDING_URL,
_KEY and _MODEL name a service (default: the offline lexical one). PLUMBLINE_LEDGER names a folder,
shared with all executors, that keeps vectors and replies from run to run. All may stand in .env, too."""


@dataclass
class Options:
    argv: list[str]
    questions: str = "questions.json"
    corpus: str | None = None
    artifacts: str = "eval-results"
    dotenv: str = ".env"
    env: Mapping[str, str] = field(default_factory=lambda: os.environ)
    embedder: models.Embed | None = None
    generator: models.Generate | None = None
    spark: SparkSession | None = None
    out: Callable[[str], None] = print
    now: Callable[[], str] = lambda: datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    k: int = DEFAULT_K
    floor: float = SIMILARITY_FLOOR


def parse_args(argv: list[str]) -> tuple[bool, bool, list[str]]:
    """(calibrate, help, unknown arguments)"""
    known = {"--calibrate", "--help", "-h"}
    return "--calibrate" in argv, bool({"--help", "-h"} & set(argv)), [a for a in argv if a not in known]


def _load(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _index(chunks: DataFrame, embedder: models.Embed, ledger: str | None) -> DataFrame:
    return models.embed_with_usage(chunks, "text", embedder, "document", ledger).withColumn("chunk_id", F.col("chunkId"))


def main(o: Options) -> int:
    """Runs as the arguments say. Tables of the run are removed in the end; a ledger that is named stays."""
    calibrating, wants_help, unknown = parse_args(o.argv)
    if wants_help:
        o.out(USAGE)
        return PASS
    if unknown:
        o.out(f"unknown arguments: {', '.join(unknown)}\n\n{USAGE}")
        return SETUP_ERROR
    env = environment.merge_environment(o.env, environment.read_dotenv(o.dotenv))
    has = lambda name: bool(env.get(name, "").strip())
    if not calibrating and o.generator is None and not has("PLUMBLINE_GENERATION_URL"):
        values, problems = environment.resolve_keys(["PLUMBLINE_GENERATOR"], env)
        if problems:
            o.out("\n".join(problems))
            return SETUP_ERROR
    spark = o.spark or SparkSession.builder.appName("plumbline").getOrCreate()
    with scratch(spark):
        return _run(o, spark, env, calibrating)


def _run(o: Options, spark: SparkSession, env: Mapping[str, str], calibrating: bool) -> int:
    kept: list[DataFrame] = []
    has = lambda name: bool(env.get(name, "").strip())

    def keep(df: DataFrame) -> DataFrame:
        """Kept until the run ends."""
        kept.append(df.persist())
        return kept[-1]

    try:
        service = (lambda: models.http_embedder(env)) if has("PLUMBLINE_EMBEDDING_URL") else (lambda: models.hash_embedder)
        embedder = o.embedder or (_load(env["PLUMBLINE_EMBEDDER"].strip()) if has("PLUMBLINE_EMBEDDER") else service())
        generator = None if calibrating else o.generator or (_load(env["PLUMBLINE_GENERATOR"].strip()) if has("PLUMBLINE_GENERATOR") else models.http_generator(env))
        questions = keep(evaluate.load_question_set(spark, o.questions))
        chunks = corpus.load_corpus(spark, o.corpus or os.path.join(os.path.dirname(o.questions) or ".", "corpus")).drop("pos", "ord")
        kept_calls = env.get("PLUMBLINE_LEDGER", "").strip().rstrip("/")
        vectors, replies = (f"{kept_calls}/{x}" if kept_calls else None for x in ("vectors", "replies"))
        index = keep(_index(chunks, embedder, vectors))
        retrieve.check_dimension(index)
        asked = keep(models.embed_with_usage(questions.withColumn("question_id", F.col("pos").cast("long")), "question", embedder, "query", vectors).withColumnRenamed("vector", "query"))
        folder = o.corpus or os.path.join(os.path.dirname(o.questions) or ".", "corpus")
        run = {"generatedAt": o.now(), "embedder": models.model_name(embedder), "generator": models.model_name(generator), "corpusDir": folder, "chunkCount": index.count(), "k": o.k, "threshold": o.floor}
        if calibrating:
            return _calibrate(o, asked, index, run, hasattr(embedder, "with_usage"))
        results = keep(answer.answer_questions(asked.select("question_id", "question", "query"), index, generator, o.k, o.floor, ledger=replies))
        scores = keep(evaluate.score(asked, results))
        categories = keep(evaluate.gate(scores))
        steps, told = None, None
        if hasattr(embedder, "with_usage") or hasattr(generator, "with_usage"):
            found = keep(usage.of_run(index, asked, results))
            names = {r["question_id"]: r["id"] for r in asked.select("question_id", "id").collect()}
            steps = [r.asDict() | {"label": names.get(r["question_id"], "(index build)")} for r in found.orderBy("pos").collect()]
            steps = {"steps": steps, "totals": usage.totals(found.drop("cost_usd")).first().asDict()}
            told = report.usage_report(steps["steps"], steps["totals"])
        text = report.gate_report(scores, categories, told)
        artifact = report.gate_artifact(scores, categories, run, steps)
    except Exception as e:  # a partial run reports nothing and writes nothing
        o.out(f"the run failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        return SETUP_ERROR
    finally:
        for df in kept:
            df.unpersist()
    o.out(text)
    _write(o, artifact, "eval", run["generatedAt"])
    return PASS if artifact["verdict"] == "PASS" else GATE_FAILED


def _calibrate(o: Options, asked: DataFrame, index: DataFrame, run: dict, metered: bool) -> int:
    pairs = calibrate.Grid(asked.select("question_id", "query", "outcome", F.col("expectedChunkIds").alias("expected")), index)
    sides = calibrate.distribution_of(pairs).collect()
    few = stored(calibrate.decisive_of(pairs), shared_dir(asked.sparkSession, "decisive"))
    apart = calibrate.separation(few).first()
    lists = [f(few).collect() for f in (calibrate.boundary_lowest_correct, calibrate.boundary_highest_wrong)]
    refused = calibrate.must_refuse_ceiling(few).orderBy(F.desc("score"), "question_id", "chunk_id").collect()
    found = (sides, apart, *lists, refused, o.floor)
    o.out(report.calibration_report(*found))
    used = None
    if metered:
        sums = [F.sum("embedding_tokens").alias("embedding_tokens"), F.count_if(F.col("embedding_ms") > 0).alias("embedding_calls"), F.sum("embedding_ms").alias("latency_ms")]
        both = [rows.agg(*sums).first() for rows in (index, asked)]
        used = {k: sum(r[k] or 0 for r in both) for k in ("embedding_tokens", "embedding_calls", "latency_ms")}
    _write(o, report.calibration_artifact(*found, run, used), "calibration", run["generatedAt"])
    return PASS


def _write(o: Options, artifact: dict, prefix: str, moment: str) -> None:
    """A failure to write is told and changes no exit code."""
    try:
        report.write_pair(artifact, o.artifacts, prefix, moment)
    except OSError as e:
        o.out(f"the artifact was not written: {e.strerror}")


if __name__ == "__main__":
    sys.exit(main(Options(sys.argv[1:])))
