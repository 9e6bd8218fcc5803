"""Prompts for the generator and the strict parse of what it returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import fixed, snippet, trim
from plumbline.operators.verify import PHRASES

#: Fixed value: the reply's wire format.
REPLY = '{"claims": [{"text": string, "status": "stated" | "inferred", "citations": [string], "supportingQuotes": [{"chunkId": string, "quote": string}]}]}'

#: The reply format, what a claim is, and every check it will go through, in the words of the checks themselves.
SYSTEM_PROMPT = "\n".join(
    [
        "You answer a question from the passages that come with it, as claims that a program verifies.",
        f"Your whole reply is one JSON object: {REPLY}",
        "A claim is one sentence that can be true or false. It is stated if a passage says it, inferred if it takes several passages together.",
        "The program knows the passages, character by character, and nothing else. It drops a claim that",
        *(f"- {phrase}" for phrase in PHRASES.values()),
        'If no claim would be left, reply {"claims": []}. If passages contradict each other, make a claim of each side.',
    ]
)


def prompt_of(question: Column, shown: Column) -> Column:
    """The user message for a question and its shown chunks: an array of structs in rank order, with score and the chunk columns.

    Its labels are fixed values: generators, and replies recorded for them, read passages by these
    lines.
    """

    def block(c: Column, i: Column) -> Column:
        return F.concat_ws(
            "\n",
            F.concat(F.lit("--- chunk "), (i + 1).cast("string"), F.lit(" of "), F.size(shown).cast("string"), F.lit(" ---")),
            F.concat(F.lit("chunkId: "), c["chunkId"]),
            F.concat(F.lit("document: "), c["docTitle"], F.lit(" ("), c["docType"], F.lit(", version "), c["version"], F.lit(", effective "), c["effectiveDate"], F.lit(")")),
            F.concat(F.lit("section: "), c["sectionHeading"]),
            F.concat(F.lit("similarity: "), fixed(c["score"], 4)),
            F.lit("text:"),
            c["text"],
        )

    head = F.concat(F.lit("Question: "), question, F.lit("\n\nRetrieved chunks ("), F.size(shown).cast("string"), F.lit("). Cite by the exact chunkId shown.\n\n"))
    return F.concat(head, F.array_join(F.transform(shown, block), "\n\n"))


#: The columns of a shown chunk.
SHOWN = ("rank", "score", "chunkId", "docId", "docTitle", "docType", "version", "effectiveDate", "sectionHeading", "text")


def render_prompts(shown: DataFrame) -> DataFrame:
    """question_id, system, user from shown chunks, a row each: question_id, question and SHOWN."""
    listed = F.array_sort(F.collect_list(F.struct(*SHOWN)))
    rows = shown.groupBy("question_id", "question").agg(listed.alias("all"))
    return rows.select("question_id", F.lit(SYSTEM_PROMPT).alias("system"), prompt_of(F.col("question"), F.col("all")).alias("user"))


#: The opening and closing line of a fenced block.
FENCE_OPEN, FENCE_CLOSE = r"\A```[A-Za-z0-9_-]*[ \t]*\r?\n", r"\r?\n[ \t]*```\z"


def strip_fence(raw: Column) -> Column:
    """Trimmed; a text that is one fenced block as a whole is unwrapped."""
    t = trim(raw)
    inner = trim(F.regexp_replace(F.regexp_replace(t, FENCE_OPEN, ""), FENCE_CLOSE, ""))
    return F.when(t.rlike(FENCE_OPEN) & t.rlike(FENCE_CLOSE), inner).otherwise(t)


def strict_json(s: Column) -> Column:
    """The variant of a text that is exactly one JSON value, else null.

    The parser alone takes trailing text; a value that also parses inside a list of one element
    and inside an object has none.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}")))
    one = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(listed.isNotNull() & named.isNotNull() & one, F.try_variant_get(listed, "$[0]", "variant"))


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on, of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A(\w+)", 1)


def parse_claims(responses: DataFrame) -> DataFrame:
    """``responses`` with problem and claims (array of variants, unchecked) in place of raw; null raw counts as empty."""
    others = [c for c in responses.columns if c != "raw"]
    raw = F.coalesce("raw", F.lit(""))
    claims = F.when(
        (kind_of(F.col("parsed")) == "OBJECT") & (kind_of(F.try_variant_get("parsed", "$.claims", "variant")) == "ARRAY"),
        F.try_variant_get("parsed", "$.claims", "array<variant>"),
    )
    # unnested from arrays: a filter on the result, moved below, must not repeat the parse for each use
    rows = responses.select(*others, "raw", F.explode(F.array(strip_fence(raw))).alias("source"))
    rows = rows.select("*", F.explode(F.array(strict_json(F.col("source")))).alias("parsed"))
    rows = rows.select("*", F.explode(F.array(claims)).alias("claims"))
    told = F.concat(F.lit("; raw response: "), snippet(raw, 200))
    problem = (
        F.when(F.col("source") == "", "the generator returned nothing")
        .when(F.col("parsed").isNull(), F.concat(F.lit("the response is no valid JSON"), told))
        .when(kind_of(F.col("parsed")) != "OBJECT", F.concat(F.lit("the response is no object"), told))
        .when(F.col("claims").isNull(), F.concat(F.lit("the response has no list of claims"), told))
    )
    return rows.select(*others, problem.alias("problem"), "claims")


def claim_rows(parsed: DataFrame) -> DataFrame:
    """One row for each claim of the parsed responses: question_id, pos and the typed claim columns."""
    rows = parsed.where("claims is not null").select("question_id", F.posexplode("claims").alias("pos", "claim"))
    return typed_claims(rows)


def typed_claim(claim: Column) -> Column:
    """struct<well_formed, text, status, citations, quotes> of a claim (variant)."""
    get = lambda k, t: F.try_variant_get(claim, k, t)
    is_string = lambda v: kind_of(v) == "STRING"
    citations, quotes = get("$.citations", "array<variant>"), get("$.supportingQuotes", "array<variant>")
    good = (
        (kind_of(claim) == "OBJECT")
        & is_string(get("$.text", "variant"))
        & is_string(get("$.status", "variant"))
        & get("$.status", "string").isin("stated", "inferred")
        & F.forall(citations, is_string)
        & F.forall(
            quotes,
            lambda q: (kind_of(q) == "OBJECT")
            & is_string(F.try_variant_get(q, "$.chunkId", "variant"))
            & is_string(F.try_variant_get(q, "$.quote", "variant")),
        )
    )
    quote = lambda q: F.struct(F.try_variant_get(q, "$.chunkId", "string").alias("chunkId"), F.try_variant_get(q, "$.quote", "string").alias("quote"))
    fields = {
        "well_formed": (F.lit(True), "boolean"),
        "text": (get("$.text", "string"), "string"),
        "status": (get("$.status", "string"), "string"),
        "citations": (get("$.citations", "array<string>"), "array<string>"),
        "quotes": (F.transform(quotes, quote), "array<struct<chunkId:string,quote:string>>"),
    }
    right = F.struct(*[c.cast(t).alias(k) for k, (c, t) in fields.items()])
    wrong = F.struct(*[F.lit(None if k != "well_formed" else False).cast(t).alias(k) for k, (_, t) in fields.items()])
    return F.when(good, right).otherwise(wrong)


def typed_claims(rows: DataFrame) -> DataFrame:
    """``claim`` (variant) replaced by well_formed, text, status, citations, quotes."""
    # unnested from an array, so that later uses of a field don't repeat the checks
    return rows.select("question_id", "pos", F.inline(F.array(typed_claim(F.col("claim")))))
