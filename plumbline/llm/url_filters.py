"""URL verdicts from path rules and a block list kept as a Bloom filter cascade, in built-in functions only.

The cascade's first level is a Bloom filter of the listed keys. The keys of the corpus that are
not listed but pass it make up the second level, the listed keys that pass the second make up
the third, and so on until nothing passes wrongly. Since the levels were built against every
distinct key of the corpus, the number of levels a key passes tells exactly whether it is
listed: an odd number means listed.

A level is an array of 64-bit words. Its size is known from the counted keys before it is built
and bounded by about ``max_bits``: the keys are cut by a hash into as many parts as that takes, each with
a cascade of its own. A single cascade is read by scalar subqueries, so probing needs no join. Of
several, a row meets the words of its part by a join on the part's number: by a broadcast while
all of them are small enough for it, which is known, else by a salted join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_parts, stored, table

#: (host, path prefix, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Bits of one level of a part, about: 1 MB. Bytes of the levels of all parts that are broadcast at most.
MAX_BITS, BROADCAST_BYTES = 2**23, 2**26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule for the host or a parent of it and a prefix of the path, or nulls."""
    rule = verdict = None
    for at, prefix, say in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule = F.when(fits, at + prefix) if rule is None else rule.when(fits, at + prefix)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


@dataclass
class Cascade:
    """Levels as (table of part and words, number of bits, hashes), a row for each part."""

    parts: int = 1
    levels: list[tuple[DataFrame, int, int]] = field(default_factory=list)

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(self.parts)).cast("int")

    @staticmethod
    def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]

    def with_words(self, rows: DataFrame, key: Column, levels=None) -> DataFrame:
        """``rows`` with the words of each key's part, where there are several; a row without a key has none."""
        chosen = list(range(len(self.levels)) if levels is None else levels)
        if self.parts == 1 or not chosen:
            return rows
        words = None
        for i in chosen:
            own = self.levels[i][0].select(F.col("part").alias("_part"), F.col("words").alias(f"_words{i}"))
            words = own if words is None else words.join(own, "_part")
        rows = rows.withColumn("_part", self.part(key))
        if self.parts * sum(self.levels[i][1] for i in chosen) // 8 <= BROADCAST_BYTES:
            return rows.join(F.broadcast(words), "_part", "left")
        # the parts are few: each is met in several places, and a row goes to one of them
        salts = -(-4 * shuffle_parts(rows.sparkSession) // self.parts)
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
        words = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return rows.join(words, ["_part", "_salt"], "left")

    def passes(self, key: Column, level: int) -> Column:
        """Whether a key passes a level, for rows ``with_words``."""
        table, bits, hashes = self.levels[level]
        words = table.select("words").scalar() if self.parts == 1 else F.col(f"_words{level}")
        out = F.lit(True)
        for at in self.positions(key, level, bits, hashes):
            out = out & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
        return out

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed, for rows ``with_words``."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _words(keys: DataFrame, level: int, bits: int, hashes: int, parts: int) -> DataFrame:
    """A row for each part with the level's bits of its keys (part, key) as an array of longs."""
    at = keys.select("part", F.explode(F.array(*Cascade.positions(F.col("key"), level, bits, hashes))).alias("at"))
    ones = at.select("part", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    size = -(-bits // 64)
    none = keys.sparkSession.range(size * parts).select(F.floor(F.col("id") / size).cast("int").alias("part"), (F.col("id") % size).alias("word"), F.lit(0).cast("long").alias("bits"))
    full = ones.unionByName(none).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    rows = full.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
    return rows.select("part", F.transform("all", lambda x: x["bits"]).alias("words"))


def build_cascade(keys: DataFrame, first_rate: float = 1 / 64, rate: float = 1 / 16, max_bits: int = MAX_BITS) -> Cascade:
    """A cascade over ``keys`` (``key`` string, ``is_listed`` boolean), which is every key of the corpus.

    Keys may repeat; a key with any listed row is listed, null keys are left out. Without listed
    keys there are no levels and nothing is listed.
    """
    spark = keys.sparkSession
    folder = shared_dir(spark, "cascade")
    keys = stored(keys.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("is_listed").alias("is_listed")), f"{folder}/keys")
    hashes = [max(1, round(-math.log2(r))) for r in (first_rate, rate)]
    n = keys.where("is_listed").count()
    out = Cascade(parts=max(1, math.ceil(n * hashes[0] / math.log(2) / max_bits)))
    alive = keys.withColumn("part", out.part(F.col("key")))
    while True:
        level = len(out.levels)
        own = F.col("is_listed") == (level % 2 == 0)  # whether this level encodes a key
        most = alive.where(own).groupBy("part").count().agg(F.max("count")).first()[0] or 0
        if not most:
            return out
        k = hashes[min(level, 1)]
        bits = max(64, math.ceil(most * k / math.log(2)))
        out.levels.append((stored(_words(alive.where(own), level, bits, k, out.parts), f"{folder}/level{level}"), bits, k))
        # those that pass wrongly, and the keys that must be told from them
        rest = out.with_words(alive, F.col("key"), [level]).where(own | out.passes(F.col("key"), level)).select("key", "is_listed", "part")
        alive = rest if out.parts == 1 else stored(rest, f"{folder}/alive{level}")


def judge_urls(pages: DataFrame, is_listed, rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (``page_id``, ``url``).

    ``is_listed``: a host column -> whether the block list has it. A url without a fitting rule is
    blocked if its host is listed. Null urls and urls without ``://`` have an empty host and path,
    which no rule and no list has: allow. Null ids and repeated rows stay; urls of any length are
    judged whole; other columns are not looked at; an empty table gives no rows.
    """
    url = F.col("url")
    rows = pages.select(pages["page_id"], host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = rows.where("host != ''").select(F.col("host").alias("key")).distinct()
    cascade = build_cascade(hosts.withColumn("is_listed", is_listed(F.col("key"))), max_bits=max_bits)
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    listed = (F.col("host") != "") & F.coalesce(cascade.listed(F.col("host")), F.lit(False))
    return cascade.with_words(rows, F.col("host")).select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(said, F.when(listed, "block").otherwise("allow")).alias("verdict"),
    )


def stand_in_list(host: Column) -> Column:
    """The query's block list. No list is shipped, so a quarter of all hosts stands in, by their SHA-256."""
    return F.substring(F.sha2(host, 256), 1, 1).isin("0", "1", "2", "3")


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), stand_in_list)


QUERIES = {"op7_url_cascade": op7_url_cascade}
ORACLE_SQL = {
    "op7_url_cascade": f"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '{SPLIT}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{SPLIT}', 2), '') AS path
  FROM pages),
rules(dom, prefix, say) AS (VALUES {", ".join(str(r) for r in RULES)}),
fit AS (
  SELECT page_id, host, path, dom || prefix AS rule, say,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(dom || prefix) DESC) AS n
  FROM (SELECT DISTINCT * FROM p) d JOIN rules
    ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, prefix))
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.say, CASE WHEN p.host <> '' AND substr(sha256(p.host), 1, 1) IN ('0', '1', '2', '3')
                         THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON fit.page_id IS NOT DISTINCT FROM p.page_id AND fit.host = p.host AND fit.path = p.path AND fit.n = 1
"""
}
