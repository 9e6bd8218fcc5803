"""Question sets, scores against ground truth, and the gate for each category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import is_blank, once, with_first_repeat
from plumbline.operators.generation import kind_of, strict_json
from plumbline.policy import GATE, HEADLINE_KINDS, OUTCOMES
from plumbline.sources.shared import numbered

QUESTION = "struct<id:string,question:string,outcome:string,expectedChunkIds:array<string>,contradictionDocIds:array<string>,rationale:string>"
#: Fixed value: a chunk id inside a text.
CHUNK_ID = r"[a-z0-9]+(?:-[a-z0-9]+)*#[a-z0-9]+(?:-[a-z0-9]+)*"


class QuestionSetError(ValueError):
    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


def validate_question_sets(sets: DataFrame) -> DataFrame:
    """set_id, error, corpus_dir, questions (array of QUESTION) of (set_id, source).

    error: the kind of the first problem; the set's own first, then question by question.
    """
    v = F.col("v")
    entries = F.try_variant_get(v, "$.questions", "array<variant>")
    get = lambda q, k, t="string": F.try_variant_get(q, f"$.{k}", t)
    kind = lambda x: F.coalesce(kind_of(x), F.lit("VOID"))
    text_ok = lambda q, k: (kind(get(q, k, "variant")) == "STRING") & ~is_blank(get(q, k))

    def strings_ok(q: Column, k: str) -> Column:
        a = get(q, k, "variant")
        return get(q, k, "variant").isNull() | ((kind(a) == "ARRAY") & F.coalesce(F.forall(get(q, k, "array<variant>"), lambda s: (kind(s) == "STRING") & ~is_blank(s.cast("string"))), F.lit(False)))

    def problem(q: Column, i: Column) -> Column:
        expected, sides = (F.coalesce(get(q, k, "array<string>"), F.array().cast("array<string>")) for k in ("expectedChunkIds", "contradictionDocIds"))
        outcome = F.when(kind(get(q, "outcome", "variant")) == "STRING", get(q, "outcome"))
        return (
            F.when(kind(q) != "OBJECT", "malformed-question")
            .when(~text_ok(q, "id"), "malformed-question")
            .when(i == F.col("again"), "duplicate-id")
            .when(~text_ok(q, "question") | ~text_ok(q, "rationale"), "malformed-question")
            .when(~F.coalesce(outcome.isin(*OUTCOMES), F.lit(False)), "unknown-outcome")
            .when(~strings_ok(q, "expectedChunkIds") | ~strings_ok(q, "contradictionDocIds"), "malformed-question")
            .when(F.exists(expected, lambda c: ~F.contains(c, F.lit("#"))), "malformed-chunk-id")
            .when((outcome == "answered") & (F.size(expected) == 0), "missing-expected-chunk-ids")
            .when((outcome == "refused-contradiction") & (F.size(sides) < 2), "missing-contradiction-doc-ids")
        )

    def question(q: Column) -> Column:
        lists = [F.coalesce(get(q, k, "array<string>"), F.array().cast("array<string>")).alias(k) for k in ("expectedChunkIds", "contradictionDocIds")]
        return F.struct(*[get(q, k).alias(k) for k in ("id", "question", "outcome")], *lists, get(q, "rationale").alias("rationale"))

    rows = once(sets, v=strict_json(F.coalesce("source", F.lit(""))))
    rows = once(rows, entries=entries)
    rows = with_first_repeat(once(rows, ids=F.transform("entries", lambda q: get(q, "id"))), again="ids")
    corpus = F.when(kind(get(v, "corpusDir", "variant")) == "STRING", get(v, "corpusDir"))
    first = F.get(F.filter(F.transform("entries", problem), lambda k: k.isNotNull()), F.lit(0))
    error = (
        F.when(v.isNull(), "not-json")
        .when(kind(v) != "OBJECT", "not-an-object")
        .when(is_blank(corpus), "missing-corpus-dir")
        .when(F.col("entries").isNull() | (F.size("entries") == 0), "missing-questions-array")
        .otherwise(first)
    )
    rows = rows.withColumn("error", error)
    return rows.select(
        "set_id", "error", F.when(F.col("error").isNull(), corpus).alias("corpus_dir"),
        F.when(F.col("error").isNull(), F.transform("entries", question)).alias("questions"),
    )


def load_question_set(spark: SparkSession, path: str) -> DataFrame:
    """pos and the fields of QUESTION of one file; raises for a bad one."""
    source = spark.read.text(path, wholetext=True).select(F.lit(0).alias("set_id"), F.col("value").alias("source"))
    checked = validate_question_sets(source)  # one file; read again for its questions
    error = checked.select("error").first()
    if error is None or error["error"]:
        raise QuestionSetError(error["error"] if error else "not-json")
    return checked.select(F.posexplode("questions").alias("pos", "q")).select("pos", "q.*")


def evidence(claims: Column, detail: Column) -> tuple[Column, Column]:
    """(sorted distinct chunk ids, sorted distinct document ids): cited by the claims, or named in a refusal."""
    cited = F.flatten(F.transform(claims, lambda c: c["citations"]))
    ids = F.array_sort(F.array_distinct(F.when(claims.isNotNull(), cited).otherwise(F.regexp_extract_all(detail, F.lit(CHUNK_ID), F.lit(0)))))
    return ids, F.array_sort(F.array_distinct(F.transform(ids, lambda i: F.substring_index(i, "#", 1))))


def failure_kind(outcome: Column, kind: Column, chunk_ids: Column, doc_ids: Column, expected: Column, sides: Column) -> Column:
    """Why a question fails, or null if it passes."""
    missing = lambda want, have: F.exists(want, lambda w: ~F.array_contains(have, w))
    return (
        F.when((outcome == "refused-no-documents") & (kind == "answered"), "hallucinated-answer")
        .when((outcome == "refused-contradiction") & (kind == "answered"), "resolved-contradiction")
        .when((outcome == "refused-contradiction") & missing(sides, doc_ids), "missing-contradiction-source")
        .when((outcome == "answered") & (kind == "refused"), "over-refusal")
        .when((outcome == "answered") & missing(expected, chunk_ids), "missing-citation")
    )


def score(questions: DataFrame, results: DataFrame) -> DataFrame:
    """pos, id, category, passed, failure, headline, note, message and what was observed, for each question.

    missing: what the question wants named and the result doesn't name: expected chunks, or the
    documents of a contradiction. extra: what an answer cites beyond that, which is no failure.
    note: the observed evidence in one line; message: the failure with it, null if it passed.

    questions: pos, question_id and the fields of QUESTION. results: of answer_questions.
    """
    rows = questions.join(results.drop("question"), "question_id")
    chunk_ids, doc_ids = evidence(F.col("claims"), F.col("detail"))
    rows = rows.withColumns({"chunk_ids": chunk_ids}).withColumn("doc_ids", doc_ids)
    failure = failure_kind(*(F.col(c) for c in ("outcome", "kind", "chunk_ids", "doc_ids", "expectedChunkIds", "contradictionDocIds")))
    rows = rows.withColumn("failure", failure)
    rest = lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x))  # noqa: E731  (repeats stay)
    none = F.array().cast("array<string>")
    outcome, answered = F.col("outcome"), F.col("kind") == "answered"
    wanted = F.when(outcome == "answered", F.col("expectedChunkIds")).when(outcome == "refused-contradiction", F.col("contradictionDocIds")).otherwise(none)
    rows = rows.withColumn("wanted", F.coalesce(wanted, none)).withColumn("named", F.when(outcome == "refused-contradiction", F.col("doc_ids")).otherwise(F.col("chunk_ids")))
    rows = rows.withColumns({"missing": rest(F.col("wanted"), F.col("named")), "extra": F.when(answered, rest(F.col("named"), F.col("wanted"))).otherwise(none)})
    n = F.coalesce(F.size("claims"), F.lit(0)).cast("string")
    part = lambda what, ids: F.when(F.size(ids) > 0, F.concat(F.lit(f"{what}: "), F.array_join(ids, ", ")))
    # one line of evidence for every result, whatever the rule that it met
    note = F.concat_ws("; ", F.concat_ws(": ", "kind", "reason"), F.when(answered, F.concat(F.lit("claims: "), n)), part("missing", "missing"), part("extra", "extra"))
    message = F.when(F.col("failure").isNotNull(), F.concat("failure", F.lit(" in "), "id", F.lit(" (wanted: "), "outcome", F.lit("; got: "), note, F.lit(")")))
    return rows.select(
        "pos", "question_id", "id", F.col("outcome").alias("category"), F.col("failure").isNull().alias("passed"), "failure",
        F.coalesce(F.col("failure").isin(*HEADLINE_KINDS), F.lit(False)).alias("headline"), note.alias("note"), message.alias("message"), "missing", "extra",
        "kind", "reason", n.cast("long").alias("n_claims"), F.coalesce(F.size("rejected"), F.lit(0)).cast("long").alias("n_rejected"), "chunk_ids", "doc_ids",
    )


def gate_policy(spark: SparkSession) -> DataFrame:
    rows = [(i, c, label, share) for i, (c, (label, share)) in enumerate(GATE.items())]
    return spark.createDataFrame(rows, "ord int, category string, label string, threshold double")


def gate(scores: DataFrame) -> DataFrame:
    """Each category with total, passed, rate and met; a category without questions has rate 1. No blended score."""
    counts = scores.groupBy("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    rows = F.broadcast(gate_policy(scores.sparkSession)).join(counts, "category", "left").fillna(0, ["total", "passed"])
    rate = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("passed") / F.when(F.col("total") == 0, 1).otherwise(F.col("total")))
    return rows.withColumn("rate", rate).withColumn("met", F.col("rate") >= F.col("threshold"))


def verdict(categories: DataFrame) -> DataFrame:
    """One row: passed only if every category is met."""
    return categories.agg(F.bool_and("met").alias("passed"), F.sum("total").alias("total_questions"), F.sum("passed").alias("total_passed"))


def violations(scores: DataFrame) -> DataFrame:
    """Failed questions with ``ord`` from 1: headline failures first, then in question order."""
    failed = scores.where(~F.col("passed"))
    return numbered(failed, [F.desc("headline"), F.asc("pos")], "ord").withColumn("ord", F.col("ord") + 1)
