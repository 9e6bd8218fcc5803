"""Scalar functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.policy import STOPWORDS

#: White space and line ends as ECMAScript's trim takes them.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with more columns, unnested from an array of one struct.

    The optimizer copies an expression into every later use of its column and into filters it
    moves below; it doesn't do so across an unnesting. For expressions with many uses.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def with_first_repeat(df: DataFrame, **places: str) -> DataFrame:
    """``df`` with the place, from 0, of the first element of an array column that is equal to an earlier one, or null.

    places: new column = name of the array. Values are sorted with their places and neighbours are
    compared, so a long array costs no more than its sort. Nulls are no repeats.
    """
    for name, array in places.items():
        df = once(df, _sorted=F.array_sort(F.transform(array, lambda k, i: F.struct(k.alias("k"), i.alias("i")))))
        later = lambda p, j: F.when((j > 0) & (F.get("_sorted", j - 1)["k"] == p["k"]), p["i"])
        df = once(df, **{name: F.array_min(F.transform("_sorted", later))}).drop("_sorted")
    return df


def slugify(c: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, SPACE + r"+\z", "")


def trim(c: Column) -> Column:
    return trim_end(F.regexp_replace(c, r"\A" + SPACE + "+", ""))


def is_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A" + SPACE + r"*\z"), F.lit(True))


def json_quote(c: Column) -> Column:
    """The text as a JSON string literal; null for null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1))


def snippet(c: Column, limit: int = 80) -> Column:
    return json_quote(F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII text."""
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    codes = F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order; null if a length differs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, a2: Column | None = None, b2: Column | None = None) -> Column:
    """Cosine of two double vectors: 0 if either has no length, an error if their sizes differ.

    a2, b2: their squared lengths, where they are known already.
    """
    na, nb = dot(a, a) if a2 is None else a2, dot(b, b) if b2 is None else b2
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.concat_ws(" ", F.lit("vectors of sizes"), F.size(a), F.size(b))).cast("double"))
        .when((na == 0) | (nb == 0), F.lit(0.0))
        .otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))
    )


def normalise_magnitude(c: Column) -> Column:
    return F.translate(c, "$%,", "")


#: Fixed value: a number, with currency or percent sign, and the one or two words after it.
MEASUREMENT = r"(\$?\d+(?:,\d{3})*(?:\.\d+)?%?)[ \t]+([A-Za-z]+)(?:[ \t]+([A-Za-z]+))?"


def measurements(c: Column) -> Column:
    """array<struct<magnitude, text, units>> of the measurements in a text that have a unit."""
    found = F.regexp_extract_all(c, F.lit(MEASUREMENT), F.lit(0))
    # blanks stand nowhere but between a number and its words
    parted = F.transform(found, lambda m: F.struct(m.alias("text"), F.split(F.lower(m), "[ \t]+").alias("parts")))

    def one(m: Column) -> Column:
        first, second = m["parts"][1], F.get(m["parts"], F.lit(2))
        more = second.isNotNull() & ~second.isin(STOPWORDS)
        units = F.array(F.when(~first.isin(STOPWORDS), first), F.when(more, second), F.when(more, F.concat_ws(" ", first, second)))
        return F.struct(normalise_magnitude(m["parts"][0]).alias("magnitude"), m["text"].alias("text"), F.array_compact(units).alias("units"))

    return F.filter(F.transform(parted, one), lambda m: F.size(m["units"]) > 0)


#: Fixed value: a word of three or more characters that are not all digits.
WORD = "(?<![a-z0-9])(?![0-9]+(?![a-z0-9]))[a-z0-9]{3,}"


def content_words(c: Column) -> Column:
    """Distinct words of three or more characters that are no stopwords and not all digits."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOPWORDS)))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact value."""
    return F.regexp_replace(F.format_number(c, digits), ",", "")


def usd(c: Column) -> Column:
    """Dollars with six decimals; amounts that would read as zero in exponent form with two decimals."""
    six = fixed(c, 6)
    power = F.floor(F.log10(F.abs(c))).cast("int")
    # as many decimals as show three digits, rounded from the exact value; a carry makes them four
    digits = F.regexp_replace(F.call_function("format_number", F.abs(c), 2 - power), "^[0.,]+", "")
    carried = F.length(digits) > 3
    shown = F.concat(
        F.when(c < 0, "-").otherwise(""), F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2), F.lit("e"),
        (power + carried.cast("int")).cast("string"),
    )
    return F.concat(F.lit("$"), F.when((c != 0) & six.isin("0.000000", "-0.000000"), shown).otherwise(six))


def pad_right(c: Column, width: Column) -> Column:
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(width - F.length(c), F.lit(0)).cast("int")))


def pad_left(c: Column, width: Column) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(width - F.length(c), F.lit(0)).cast("int")), c)
