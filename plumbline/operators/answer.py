"""A batch of questions, answered with verified claims or refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import fixed, json_quote, once
from plumbline.operators import contradict, generation, retrieve, verify
from plumbline.policy import DEFAULT_K, SIMILARITY_FLOOR
from plumbline.sources.models import Generate, generate
from plumbline.sources.shared import shared_dir, stored


def decide(n_above: Column, problem: Column, n_claims: Column, n_verified: Column, contradicts: Column) -> Column:
    """The refusal reason, or null for an answer. The order is fixed."""
    return (
        F.when(n_above == 0, "no-relevant-documents")
        .when(problem.isNotNull() | (n_claims == 0), "no-claims-produced")
        .when(n_verified == 0, "claims-failed-verification")
        .when(contradicts, "contradictory-sources")
    )


def _shown_rows(questions: DataFrame, index: DataFrame, k: int, floor: float, apart) -> DataFrame:
    """One row for each question: question_id, question, and its hits above and below the floor, as arrays in rank order.

    A hit above it has the columns of its chunk, one below only its id.
    """
    n = questions.count()
    hits = retrieve.partition_by_floor(retrieve.search(questions, index, k, apart, n), floor)
    few = F.broadcast(hits) if k * n <= BROADCAST_HITS else hits
    full = index.select("chunk_id", *(c for c in generation.SHOWN if c not in ("rank", "score"))).join(few, "chunk_id")
    listed = lambda above, *c: F.array_sort(F.collect_list(F.when(F.col("above") == above, F.struct(*c))))
    sides = full.groupBy("question_id").agg(listed(True, *generation.SHOWN).alias("shown"), listed(False, "rank", "chunkId", "score").alias("near_misses"))
    return questions.select("question_id", "question").join(sides, "question_id", "left")


#: Hits that may be broadcast to the chunks they name.
BROADCAST_HITS = 500_000
_TYPED = "array<struct<well_formed:boolean,text:string,status:string,citations:array<string>,quotes:array<struct<chunkId:string,quote:string>>>>"


def answer_questions(
    questions: DataFrame, index: DataFrame, generator: Generate, k: int = DEFAULT_K, floor: float = SIMILARITY_FLOOR, store=None,
    apart: tuple[str, str] | None = None, ledger: str | None = None,
) -> DataFrame:
    """One row for each question: kind, reason, detail, claims, rejected, retrieved, near_misses, tokens and ms used.

    questions: question_id (unique), question, query. index: the chunk columns, chunk_id and
    vector. A question's hits, claims and verdicts stay in its one row, so after the search only
    the generator's replies are joined. ``store`` keeps the rows of questions and hits and returns
    them (default: written to the shared folder), so that both questions and index are read once.
    Only questions with a chunk above the floor reach the generator, and each prompt once:
    ``ledger`` is the folder of its replies, see ``generate``. apart: see ``search``. A failing
    generator fails the run; it is never a refusal.
    """
    if store is None:
        folder = shared_dir(questions.sparkSession, "answers")
        store = lambda df: stored(df, f"{folder}/hits")
    rows = store(_shown_rows(questions, index, k, floor, apart))
    asked = rows.where(F.size("shown") > 0)
    prompts = asked.select("question_id", F.lit(generation.SYSTEM_PROMPT).alias("system"), generation.prompt_of(F.col("question"), F.col("shown")).alias("user"))
    raw = generate(prompts, generator, ledger)

    rows = generation.parse_claims(rows.join(raw, "question_id", "left"))
    rows = once(rows, typed=F.coalesce(F.transform("claims", generation.typed_claim), F.array().cast(_TYPED))).drop("claims")
    rows = once(rows, first=verify.first_of_each(F.coalesce("shown", F.array().cast(rows.schema["shown"].dataType))))
    numbered = F.transform("typed", lambda c, i: F.struct(i.alias("pos"), *[c[f].alias(f) for f in ("well_formed", "text", "status", "citations", "quotes")]))
    rows = verify.verify_row(rows.withColumn("all", numbered), "all", "first")
    rows = once(rows, good=F.filter("all", lambda c: c["reason"].isNull()))
    rows = once(rows, values=contradict.values_of(F.col("good"), F.col("first")))
    rows = once(rows, pair=contradict.first_pair(F.col("values"))).select("*", "pair.unit", "pair.a", "pair.b")
    claim = lambda c: F.struct(*[c[f].alias(f) for f in ("pos", "text", "status", "citations", "quotes", "reason")])
    hit = lambda h: F.struct(*[h[f].alias(f) for f in ("rank", "chunkId", "score")])
    rows = rows.withColumns(
        {
            "all": F.transform("all", claim),
            "retrieved": F.transform("shown", hit),
            "n_above": F.coalesce(F.size("shown"), F.lit(0)),
            "n_claims": F.size("typed"),
            "n_verified": F.size("good"),
            "contradicts": F.col("pair").isNotNull(),
        }
    )
    # a question that was not asked has no reply, which is no reply without text
    rows = rows.withColumn("problem", F.when(F.col("n_above") > 0, F.col("problem")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    reason = decide(*(F.col(c) for c in ("n_above", "problem", "n_claims", "n_verified", "contradicts")))
    ids = lambda c: F.array_join(F.transform(c, lambda h: h["chunkId"]), ", ")
    best = F.get(F.col("near_misses"), F.lit(0))
    rejected = F.filter("all", lambda c: c["reason"].isNotNull())
    stripped = F.array_join(F.transform(rejected, lambda c: F.concat(F.lit("["), c["reason"]["kind"], F.lit("] "), c["reason"]["message"])), " ")
    detail = (
        F.when(
            F.col("refusal") == "no-relevant-documents",
            F.concat(
                F.lit("nothing reached the floor of "), F.lit(f"{floor:.4f}"), F.lit(" for "), json_quote(F.col("question")), F.lit("; "),
                F.coalesce(F.concat(F.lit("the best score was "), fixed(best["score"], 4), F.lit(", of "), best["chunkId"]), F.lit("the search returned nothing")),
                F.lit("; the generator was not asked"),
            ),
        )
        .when(
            F.col("refusal") == "no-claims-produced",
            F.concat(F.coalesce("problem", F.lit("the generator returned no claims")), F.lit("; shown: "), ids("retrieved")),
        )
        .when(F.col("refusal") == "claims-failed-verification", F.concat(F.lit("all claims failed verification: "), stripped))
        .when(
            F.col("refusal") == "contradictory-sources",
            F.concat(F.lit("two documents disagree, in "), "unit", F.lit(". First: "), contradict.describe_position("a"), F.lit(". Second: "), contradict.describe_position("b")),
        )
    )
    answered = F.col("refusal").isNull()
    return (
        rows.withColumn("refusal", reason)
        .select(
            "question_id",
            "question",
            F.when(answered, "answered").otherwise("refused").alias("kind"),
            F.col("refusal").alias("reason"),
            detail.alias("detail"),
            F.when(answered, F.filter("all", lambda c: c["reason"].isNull())).alias("claims"),
            F.when(answered, rejected).alias("rejected"),
            F.when(answered, F.col("retrieved")).alias("retrieved"),
            F.when(~answered, F.col("near_misses")).alias("near_misses"),
            *[zero(F.col(c)).alias(c) for c in ("input_tokens", "output_tokens", "generation_ms")],
        )
    )
