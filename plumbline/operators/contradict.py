"""Numbers that disagree across documents, among verified claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import content_words, json_quote, measurements, once
from plumbline.policy import MIN_SUBJECT_OVERLAP


def first_pair(values: Column) -> Column:
    """struct<i, j, at_a, at_b, unit, a, b>: the first disagreeing pair of an answer's values, or null.

    values: an array of structs in order of pos (of the claim) and at (of the value in the claim),
    with words (of the claim's subject), docId, magnitude, units and any other fields. Two values
    of claims i < j disagree when the claims share two subject words, documents and magnitudes (as
    text) differ and they have a unit in common; ``unit`` is the first of a's units. Pairs come in
    the order of i, j and their values.
    """

    def partner(a: Column) -> Column:
        disagrees = lambda b: (
            (a["pos"] < b["pos"])
            & (a["docId"] != b["docId"])
            & (a["magnitude"] != b["magnitude"])
            & F.arrays_overlap(a["units"], b["units"])
            & (F.size(F.array_intersect(a["words"], b["words"])) >= MIN_SUBJECT_OVERLAP)
        )
        unit = lambda b: F.get(F.filter(a["units"], lambda u: F.array_contains(b["units"], u)), F.lit(0))
        pair = lambda b: F.struct(
            a["pos"].alias("i"), b["pos"].alias("j"), a["at"].alias("at_a"), b["at"].alias("at_b"), unit(b).alias("unit"), a.alias("a"), b.alias("b")
        )
        # of one value's partners the first is the least
        return F.get(F.transform(F.slice(F.filter(values, disagrees), 1, 1), pair), F.lit(0))

    return F.array_min(F.filter(F.transform(values, partner), lambda p: p.isNotNull()))


def first_pairs(values: DataFrame, key: str = "question_id") -> DataFrame:
    """key, unit, a, b: ``first_pair`` of each group of values, for groups that have one.

    values: key and the fields of ``first_pair``, a row each. A group is an answer, whose values are
    bounded by a generator's longest reply; they are sent once, as one array.
    """
    fields = ["pos", "at", *(c for c in values.columns if c not in (key, "pos", "at"))]
    grouped = values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))
    return once(grouped.where(F.size("all") > 1), pair=first_pair(F.col("all"))).where("pair is not null").select(key, "pair.unit", "pair.a", "pair.b")


def values_of(claims: Column, shown: Column) -> Column:
    """The values of an answer's verified claims, as ``first_pair`` takes them.

    claims: array of structs with pos, text, citations, quotes. shown: array of shown chunks with
    distinct ids. A claim's subject is its text and the headings of the chunks that it cites.
    """
    chunk = lambda i: F.get(F.filter(shown, lambda s: s["chunkId"] == i), F.lit(0))

    def of_claim(c: Column) -> Column:
        headings = F.transform(c["citations"], lambda i: chunk(i)["sectionHeading"])
        words = content_words(F.concat_ws(" ", c["text"], F.array_join(headings, " ")))

        def of_quote(q: Column, n: Column) -> Column:
            own = chunk(q["chunkId"])
            value = lambda m, k: F.struct(
                c["pos"].alias("pos"), F.struct(n.alias("q"), k.alias("m")).alias("at"), *[own[x].alias(x) for x in ("docId", "docTitle", "version", "effectiveDate")],
                m["magnitude"].alias("magnitude"), m["units"].alias("units"), m["text"].alias("value"), c["citations"].alias("citations"),
                q["chunkId"].alias("chunkId"), q["quote"].alias("quote"), words.alias("words"),
            )
            return F.when(own.isNotNull(), F.transform(measurements(q["quote"]), value))

        return F.flatten(F.filter(F.transform(c["quotes"], of_quote), lambda v: v.isNotNull()))

    return F.flatten(F.transform(claims, of_claim))


def detect(verified: DataFrame, shown: DataFrame) -> DataFrame:
    """question_id, unit, a, b: the first contradiction of each question, if it has one.

    verified: question_id, pos, text, citations, quotes. shown: question_id, rank and the chunk
    columns; of a repeated chunk id the first row counts.
    """
    from plumbline.operators.verify import first_of_each

    chunk = F.struct("rank", "chunkId", "docId", "docTitle", "version", "effectiveDate", "sectionHeading")
    seen = shown.groupBy("question_id").agg(F.array_sort(F.collect_list(chunk)).alias("shown"))
    said = verified.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "citations", "quotes"))).alias("claims"))
    rows = once(said.join(seen, "question_id", "left"), first=first_of_each(F.col("shown")))
    rows = once(rows, all=values_of(F.col("claims"), F.col("first")))
    return once(rows, pair=first_pair(F.col("all"))).where("pair is not null").select("question_id", "pair.unit", "pair.a", "pair.b")


def describe_position(p: str):
    """One side of a contradiction in words; names its chunk ids."""
    c = lambda k: F.col(f"{p}.{k}")
    return F.concat(
        F.lit('"'), c("value"), F.lit('" in '), c("docTitle"), F.lit(" ("), c("docId"), F.lit("), version "), c("version"), F.lit(", effective "),
        c("effectiveDate"), F.lit("; cited as "), F.array_join(c("citations"), ", "), F.lit("; quoted from "), c("chunkId"), F.lit(": "), json_quote(c("quote")),
    )
