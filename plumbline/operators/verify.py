"""Deterministic checks of claims against exactly the chunks that were shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_blank, once, snippet
from plumbline.policy import REJECTION_KINDS

#: What is said of each kind.
PHRASES = dict(
    zip(
        REJECTION_KINDS,
        (
            "lacks a field, or has one of another type",
            "has no text",
            "cites nothing",
            "cites a chunk twice",
            "is stated, but cites several chunks",
            "is inferred, but cites one chunk",
            "has a blank quote",
            "quotes a chunk that it does not cite",
            "cites a chunk that was not shown",
            "quotes what the chunk does not contain",
            "cites a chunk without quoting it",
        ),
        strict=True,
    )
)


def _problem(kind: str, chunk: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if chunk is None else chunk).alias("chunkId"))


def _get_first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _fields(claim: Column | None):
    """The fields of a claim: of a struct, or the columns of their names."""
    return (lambda k: F.col(k)) if claim is None else (lambda k: claim[k])


def shape_problem(claim: Column | None = None) -> Column:
    """struct<kind, chunkId>: first problem of a claim by itself (well_formed, text, status, citations, quotes), or null."""
    field = _fields(claim)
    cites, quotes, status = field("citations"), field("quotes"), field("status")
    repeated = _get_first(F.filter(cites, lambda c, i: F.array_contains(F.slice(cites, 1, i), c)))

    def bad(q: Column) -> Column:
        return (
            F.when(is_blank(q["chunkId"]), _problem("empty-quote"))
            .when(is_blank(q["quote"]), _problem("empty-quote", q["chunkId"]))
            .when(~F.array_contains(cites, q["chunkId"]), _problem("quote-for-uncited-chunk", q["chunkId"]))
        )

    first_bad = _get_first(F.filter(F.transform(quotes, bad), lambda r: r.isNotNull()))
    return (
        F.when(~field("well_formed"), _problem("malformed-claim"))
        .when(is_blank(field("text")), _problem("empty-claim-text"))
        .when(F.size(cites) == 0, _problem("empty-citations"))
        .when(F.size(F.array_distinct(cites)) < F.size(cites), _problem("duplicate-citation", repeated))
        .when((status == "stated") & (F.size(cites) != 1), _problem("stated-claim-multiple-citations"))
        .when((status == "inferred") & (F.size(cites) < 2), _problem("inferred-claim-single-citation"))
        .otherwise(first_bad)
    )


def content_problem(shown: Column, claim: Column | None = None) -> Column:
    """struct<kind, chunkId>: first problem of a well-shaped claim against ``shown`` (map of chunk id to text), or null."""
    field = _fields(claim)
    cites, quotes = field("citations"), field("quotes")
    known = F.coalesce(shown, F.create_map().cast("map<string,string>"))
    absent = F.transform(F.filter(cites, lambda c: ~F.map_contains_key(known, c)), lambda c: _problem("chunk-not-retrieved", c))
    wrong = F.filter(quotes, lambda q: ~F.coalesce(F.contains(F.try_element_at(known, q["chunkId"]), q["quote"]), F.lit(False)))
    wrong = F.transform(wrong, lambda q: _problem("quote-not-in-chunk", q["chunkId"]))
    bare = F.filter(cites, lambda c: ~F.exists(quotes, lambda q: q["chunkId"] == c))
    bare = F.transform(bare, lambda c: _problem("citation-without-quote", c))
    return _get_first(F.concat(absent, wrong, bare))


def with_message(problem: Column, text: Column) -> Column:
    """struct<kind, message, chunkId> of a problem of the claim with this text, or null."""
    said = F.element_at(F.create_map(*[F.lit(v) for kv in PHRASES.items() for v in kv]), problem["kind"])
    name = F.coalesce(F.concat(F.lit("the claim "), snippet(text), F.lit(" ")), F.lit("a claim "))
    chunk = F.coalesce(F.concat(F.lit(": "), problem["chunkId"]), F.lit(""))
    return F.when(problem.isNotNull(), F.struct(problem["kind"].alias("kind"), F.concat(name, said, chunk).alias("message"), problem["chunkId"].alias("chunkId")))


def first_of_each(shown: Column) -> Column:
    """Shown chunks (array of structs in rank order) without later ones of the same id."""
    return F.filter(shown, lambda s, i: ~F.exists(F.slice(shown, 1, i), lambda o: o["chunkId"] == s["chunkId"]))


def text_by_id(shown: Column) -> Column:
    """map of chunk id to text of shown chunks with distinct ids."""
    return F.map_from_entries(F.transform(shown, lambda s: F.struct(s["chunkId"], s["text"])))


def verify_row(rows: DataFrame, claims: str, shown: str) -> DataFrame:
    """``rows`` with a field ``reason`` in each claim of the array ``claims``, null where verified; nothing is joined or shuffled.

    shown: the array of the chunks that were shown to the row's generator, in rank order and with
    distinct ids. The checks' order is fixed, and a claim's first problem is its reason.
    """
    others = [c for c in rows.columns if c != claims]
    rows = once(rows, known=text_by_id(F.col(shown)))

    def problem(c: Column) -> Column:
        shape = shape_problem(c)
        return F.struct(c.alias("claim"), shape.alias("shape"), F.when(shape.isNull(), content_problem(F.col("known"), c)).alias("content"))

    rows = once(rows, checked=F.transform(claims, problem))
    fields = [f.name for f in rows.schema[claims].dataType.elementType]

    def told(x: Column) -> Column:
        c = x["claim"]
        return F.struct(*[c[k].alias(k) for k in fields], with_message(F.coalesce(x["shape"], x["content"]), c["text"]).alias("reason"))

    return once(rows.select(*others, "checked"), **{claims: F.transform("checked", told)}).drop("checked")


def verify(claims: DataFrame, shown: DataFrame) -> DataFrame:
    """``claims`` with ``reason``, null where verified.

    claims: question_id, pos and the typed claim columns. shown: question_id, rank, chunkId, text.
    A question's shown chunks are few, so they are one map; of a repeated id the first counts.
    The checks' order is fixed, and a claim's first problem is its reason.
    """
    maps = (
        shown.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunkId", "text"))).alias("all"))
        .select("question_id", text_by_id(first_of_each(F.col("all"))).alias("shown"))
    )
    return (
        claims.join(maps, "question_id", "left")
        .withColumn("problem", shape_problem())
        .withColumn("problem", F.when(F.col("problem").isNotNull(), F.col("problem")).otherwise(content_problem(F.col("shown"))))
        .withColumn("reason", with_message(F.col("problem"), F.col("text")))
        .drop("problem", "shown")
    )


def summarise(verdicts: DataFrame, key: str = "question_id") -> DataFrame:
    """total, verified, rejected and a count for each of the kinds, zeroes included."""
    kinds = [F.count_if(F.col("reason.kind") == k).alias(k) for k in REJECTION_KINDS]
    return verdicts.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("verified"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), *kinds
    )
