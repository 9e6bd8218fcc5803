"""Every registered query of the engine's own operators, with its SQL equivalent.

The operators' roles are played by the driver's tables: conversations become documents with
sections, embeddings an index and questions (ids divisible by 20), documents carry claims with
every kind of defect, order lines carry measurements, events a usage ledger and labels ground
truth. Each query runs over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as fn
from plumbline.operators import answer, calibrate, contradict, evaluate, generation, report, retrieve, usage, verify
from plumbline.operators import quotes as quotes_in
from plumbline.policy import GATE, MIN_SUBJECT_OVERLAP, REJECTION_KINDS, SIMILARITY_FLOOR, STOPWORDS
from plumbline.sources import corpus, models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"

# Scalar functions


@_query("""
WITH t AS (SELECT 'part' AS origin, p_partkey AS id, p_name AS x FROM part UNION ALL SELECT 'pages', page_id, url FROM pages)
SELECT origin, id, regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM t
""")
def slugify(spark, d):
    part = _table(spark, d, "part").select(F.lit("part").alias("origin"), _long("p_partkey").alias("id"), F.col("p_name").alias("x"))
    pages = _table(spark, d, "pages").select(F.lit("pages").alias("origin"), _long("page_id").alias("id"), F.col("url").alias("x"))
    return part.unionByName(pages).select("origin", "id", fn.slugify(F.col("x")).alias("slug"))


@_query("""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(9) || chr(10) WHEN 1 THEN chr(160) || ' ' WHEN 2 THEN chr(65279) || chr(8195) ELSE '' END AS p, text FROM documents),
u AS (SELECT doc_id, regexp_replace(regexp_replace(p || text || p, '^[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ''),
  '[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+$', '') AS s FROM t)
SELECT doc_id, length(s) AS n, md5(s) AS digest, s = '' AS blank FROM u
""")
def js_trim(spark, d):
    pad = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(char(9), char(10)) WHEN 1 THEN concat(char(160), ' ') WHEN 2 THEN '\\uFEFF\\u2003' ELSE '' END")
    padded = F.concat(pad, F.col("text"), pad)
    rows = _table(spark, d, "documents").select("doc_id", padded.alias("p")).select("doc_id", "p", fn.trim(F.col("p")).alias("s"))
    return rows.select("doc_id", _long(F.length("s")).alias("n"), F.md5(F.col("s").cast("binary")).alias("digest"), fn.is_blank(F.col("p")).alias("blank"))


@_query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos::BIGINT AS pos, length(line)::BIGINT AS n,
       coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM l
""")
def line_offsets(spark, d):
    docs = _table(spark, d, "documents").select(_text("doc_id").alias("name"), F.col("text").alias("source"))
    return corpus.with_lines(docs).select(_long("name").alias("doc_id"), "pos", _long(F.length("line")).alias("n"), "start")


@_query(f"""
WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
  lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x) AND NOT regexp_full_match(x, '[0-9]+')))) AS ws FROM documents)
SELECT doc_id, len(ws)::BIGINT AS n, md5(array_to_string(ws, ' ')) AS digest FROM w
""")
def content_words(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", F.array_sort(fn.content_words(F.col("text"))).alias("ws"))
    return rows.select("doc_id", _long(F.size("ws")).alias("n"), F.md5(F.array_join("ws", " ").cast("binary")).alias("digest"))


_MEASURED = f"""
m AS (SELECT key, pos, unnest(range(len(a))) AS i, a, b, c, w FROM (
  SELECT key, pos, regexp_extract_all(t, '{fn.MEASUREMENT}', 0) AS a, regexp_extract_all(t, '{fn.MEASUREMENT}', 1) AS b,
         regexp_extract_all(t, '{fn.MEASUREMENT}', 2) AS c, regexp_extract_all(t, '{fn.MEASUREMENT}', 3) AS w FROM src)),
g AS (SELECT key, pos, i, a[i + 1] AS value, b[i + 1] AS number, lower(c[i + 1]) AS one, coalesce(lower(w[i + 1]), '') AS two FROM m),
u AS (SELECT key, pos, i, value, replace(replace(replace(number, '$', ''), '%', ''), ',', '') AS magnitude,
  list_filter([CASE WHEN NOT list_contains({_STOP}, one) THEN one END, CASE WHEN two <> '' AND NOT list_contains({_STOP}, two) THEN two END,
               CASE WHEN two <> '' AND NOT list_contains({_STOP}, two) THEN one || ' ' || two END], lambda x: x IS NOT NULL) AS units FROM g)
"""


@_query(f"""
WITH src AS (SELECT doc_id AS key, 0 AS pos, text AS t FROM documents), {_MEASURED}
SELECT key AS doc_id, (row_number() OVER (PARTITION BY key ORDER BY i) - 1)::BIGINT AS pos, magnitude, value, array_to_string(units, '|') AS units
FROM u WHERE len(units) > 0
""")
def measurements(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", F.posexplode(fn.measurements(F.col("text"))).alias("pos", "m"))
    return rows.select("doc_id", _long("pos").alias("pos"), "m.magnitude", F.col("m.text").alias("value"), F.array_join("m.units", "|").alias("units"))


_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT), lambda h, x: (xor(h, x) * 16777619) % 4294967296, 2166136261::UBIGINT)"


@_query(f"SELECT p_partkey, {_FNV.format('p_name')}::BIGINT AS h FROM part")
def fnv1a(spark, d):
    return _table(spark, d, "part").select("p_partkey", fn.fnv1a(F.col("p_name")).alias("h"))


@_query(f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(list_transform(w, lambda x: '1:' || x)) AS term FROM t
      UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: '2:' || w[i] || ' ' || w[i + 1])) FROM t),
n AS (SELECT doc_id, term, count(*) AS n FROM e GROUP BY ALL),
h AS (SELECT term, ({_FNV.format("term")} % 512)::BIGINT AS bucket FROM (SELECT DISTINCT term FROM n))
SELECT doc_id, bucket, sum(n)::DOUBLE AS weight FROM n JOIN h USING (term) GROUP BY ALL
""")
def hash_embed(spark, d):
    return models.hash_embedding(_table(spark, d, "documents"), "doc_id", "text")


@_query("""
SELECT doc_id, md5(to_json(CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END)::VARCHAR) AS digest FROM documents
""")
def snippets(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.md5(fn.snippet(F.col("text")).cast("binary")).alias("digest"))


@_query("""
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value / 1e4 WHEN 2 THEN value / 3e10 ELSE 0 END AS x FROM events),
s AS (SELECT event_id, x, printf('%.6f', x) AS six, printf('%.2e', x) AS ex FROM t)
SELECT event_id, '$' || CASE WHEN x <> 0 AND six IN ('0.000000', '-0.000000') THEN regexp_replace(ex, 'e([+-])0(\\d)', 'e\\1\\2') ELSE six END AS usd FROM s
""")
def format_usd(spark, d):
    x = F.expr("CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value / 1e4 WHEN 2 THEN value / 3e10 ELSE 0D END")
    return _table(spark, d, "events").select("event_id", fn.usd(x).alias("usd"))


# Corpus


def _conversation_documents(spark, d) -> DataFrame:
    """One document with frontmatter for each conversation, one section for each turn."""
    turns = _table(spark, d, "conversations")
    part = F.struct("turn", F.concat(F.lit("## Turn "), _text("turn"), F.lit(" "), "role", F.lit("\n\n"), "text", F.lit("\n")).alias("s"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["s"]), "\n")
    name = F.concat(F.lit("conv-"), _text("conv_id"))
    head = F.concat(F.lit("---\nid: "), name, F.lit("\ntitle: Conversation "), _text("conv_id"), F.lit("\ndocType: talk\neffectiveDate: 2024-01-01\nversion: 1.0\n---\n"))
    return rows.select("conv_id", F.concat(name, F.lit(".md")).alias("name"), head.alias("head"), body.alias("body"))


@_query("""
SELECT 'conv-' || conv_id || '#turn-' || turn || '-' || lower(role) AS "chunkId", 'conv-' || conv_id AS "docId", 'Conversation ' || conv_id AS "docTitle",
       'Turn ' || turn || ' ' || role AS "sectionHeading", '1.0' AS version, text FROM conversations
""")
def h2_chunks(spark, d):
    docs = _conversation_documents(spark, d).select("name", F.concat("head", F.lit("\n"), "body").alias("source"))
    return corpus.sections(corpus.parse(docs)).select("chunkId", "docId", "docTitle", "sectionHeading", "version", "text")


@_query("""
WITH c AS (SELECT conv_id, turn, 'conv-' || conv_id || '#turn-' || turn || '-' || lower(role) AS "chunkId" FROM conversations)
SELECT "chunkId", row_number() OVER (ORDER BY 'conv-' || conv_id || '.md', turn) - 1 AS ord FROM c
""")
def document_order(spark, d):
    docs = _conversation_documents(spark, d).select("name", F.concat("head", F.lit("\n"), "body").alias("source"))
    return corpus.in_document_order(corpus.sections(corpus.parse(docs))).select("chunkId", "ord")


_ERRORS = (
    "missing-frontmatter", "unterminated-frontmatter", "malformed-frontmatter-line", "unknown-key", "duplicate-key", "missing-key",
    "id-filename-mismatch", "preamble-text", "no-sections", "empty-slug", "slug-collision", "empty-section",
)


@_query(f"""
SELECT DISTINCT 'conv-' || conv_id AS name, CASE conv_id % 13 {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_ERRORS))} END AS error FROM conversations
""")
def chunk_errors(spark, d):
    docs = _conversation_documents(spark, d)
    head, body, n = F.col("head"), F.col("body"), F.col("conv_id") % 13
    source = (
        F.when(n == 0, F.concat(F.lit("\n"), head, body))
        .when(n == 1, F.concat(F.regexp_replace(head, "---\n$", ""), body))
        .when(n == 2, F.concat(F.regexp_replace(head, "version: 1.0", "version:  "), body))
        .when(n == 3, F.concat(F.regexp_replace(head, "version: 1.0", "version: 1.0\nauthor: x"), body))
        .when(n == 4, F.concat(F.regexp_replace(head, "version: 1.0", "version: 1.0\nversion: 2.0"), body))
        .when(n == 5, F.concat(F.regexp_replace(head, "version: 1.0\n", ""), body))
        .when(n == 6, F.concat(F.regexp_replace(head, "id: conv", "id: other"), body))
        .when(n == 7, F.concat(head, F.lit("before\n"), body))
        .when(n == 8, F.concat(head, F.lit("\n")))
        .when(n == 9, F.concat(head, body, F.lit("\n## ++\n\nx\n")))
        .when(n == 10, F.concat(head, body, F.lit("\n## Again\n\nx\n## again!\n\ny\n")))
        .when(n == 11, F.concat(head, body, F.lit("\n## Nothing\n \n")))
        .otherwise(F.concat(head, body))
    )
    return corpus.parse(docs.select("name", source.alias("source"))).select(F.regexp_replace("name", r"\.md$", "").alias("name"), "error")


# Retrieval


def _index(spark, d) -> DataFrame:
    """The embeddings as chunks."""
    v = _table(spark, d, "embeddings")
    name = F.concat(F.lit("v"), _text("vec_id"))
    chunk = F.concat(name, F.lit("#label-"), _text("label"))
    return v.select(
        chunk.alias("chunk_id"), chunk.alias("chunkId"), name.alias("docId"), F.concat(F.lit("Vector "), _text("vec_id")).alias("docTitle"),
        F.lit("vector").alias("docType"), F.lit("2024-01-01").alias("effectiveDate"), F.lit("1.0").alias("version"),
        F.concat(F.lit("Label "), _text("label")).alias("sectionHeading"),
        F.concat(F.lit("The group of the store holds "), _text("vec_id"), F.lit(" items.")).alias("text"),
        F.col("embedding").cast("array<double>").alias("vector"), "vec_id", "label",
    )


def _questions(spark, d) -> DataFrame:
    v = _table(spark, d, "embeddings").where("vec_id % 20 = 0")
    return v.select(
        _long("vec_id").alias("question_id"), F.concat(F.lit("What is like vector "), _text("vec_id"), F.lit("?")).alias("question"),
        F.col("embedding").cast("array<double>").alias("query"), "label",
    )


#: A vector is no hit of the question that it is.
_APART = ("question_id", "vec_id")


def _hits(spark, d, k=6) -> DataFrame:
    """Top hits of each question; a question's own vector would be its best hit, so it is left out first."""
    return retrieve.search(_questions(spark, d), _index(spark, d), k, _APART)


_SCORES = """
q AS (SELECT vec_id AS question_id, label AS q_label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT question_id, q_label, vec_id, label, 'v' || vec_id || '#label-' || label AS chunk_id, list_cosine_similarity(e, embedding::DOUBLE[]) AS score
      FROM q, embeddings),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE vec_id <> question_id) WHERE rank <= 6)
"""


@_query(f"WITH {_SCORES} SELECT question_id, chunk_id, round(score, 6) AS score FROM s")
def cosine_pairs(spark, d):
    return retrieve.pair_scores(_questions(spark, d), _index(spark, d), 6)


@_query("""
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS own, 0.0::DOUBLE AS none FROM embeddings
""")
def cosine_zero_guard(spark, d):
    v = F.col("embedding").cast("array<double>")
    x = F.transform(v, lambda e: F.when(F.col("vec_id") % 7 == 0, F.lit(0.0)).otherwise(e))
    return _table(spark, d, "embeddings").select(
        "vec_id", F.round(fn.cosine(x, v), 6).alias("own"), fn.cosine(v, F.transform(v, lambda e: F.lit(0.0))).alias("none")
    )


@_query("SELECT min(len(embedding))::BIGINT AS low, max(len(embedding))::BIGINT AS high, count(*) AS n FROM embeddings")
def index_dimension_check(spark, d):
    index = _index(spark, d)
    retrieve.check_dimension(index)
    return index.agg(_long(F.min(F.size("vector"))).alias("low"), _long(F.max(F.size("vector"))).alias("high"), F.count("*").alias("n"))


@_query(f"WITH {_SCORES} SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM h")
def cosine_topk(spark, d):
    return _hits(spark, d).select("question_id", "chunk_id", F.round("score", 6).alias("score"), _long("rank").alias("rank"))


@_query(f"WITH {_SCORES} SELECT question_id, chunk_id, rank FROM h")
def cosine_topk_blocks(spark, d):
    found = retrieve.search_blocks(_questions(spark, d), _index(spark, d), 6, 1000, _APART)
    return found.select("question_id", "chunk_id", _long("rank").alias("rank"))


@_query(f"WITH {_SCORES} SELECT question_id, chunk_id, rank, score >= {SIMILARITY_FLOOR} AS above FROM h")
def threshold_partition(spark, d):
    return retrieve.partition_by_floor(_hits(spark, d)).select("question_id", "chunk_id", _long("rank").alias("rank"), "above")


def _shown(spark, d, floor) -> DataFrame:
    hits = retrieve.partition_by_floor(_hits(spark, d), floor)
    full = hits.join(_index(spark, d).drop("vector"), "chunk_id").join(_questions(spark, d).select("question_id", "question"), "question_id")
    return retrieve.shown_chunks(full)


@_query(f"""
WITH {_SCORES},
b AS (SELECT question_id, rank, count(*) OVER (PARTITION BY question_id) AS n, vec_id, label, chunk_id, score FROM h WHERE score >= 0.3)
SELECT question_id, md5('Question: What is like vector ' || question_id || '?' || chr(10) || chr(10) || 'Retrieved chunks (' || max(n) || '). Cite by the exact chunkId shown.'
  || chr(10) || chr(10) || string_agg('--- chunk ' || rank || ' of ' || n || ' ---' || chr(10) || 'chunkId: ' || chunk_id || chr(10) || 'document: Vector ' || vec_id
  || ' (vector, version 1.0, effective 2024-01-01)' || chr(10) || 'section: Label ' || label || chr(10) || 'similarity: ' || printf('%.4f', score) || chr(10) || 'text:' || chr(10)
  || 'The group of the store holds ' || vec_id || ' items.', chr(10) || chr(10) ORDER BY rank)) AS digest
FROM b GROUP BY question_id
""")
def prompt_render(spark, d):
    prompts = generation.render_prompts(_shown(spark, d, 0.3))
    return prompts.select("question_id", F.md5(F.col("user").cast("binary")).alias("digest"))


# Claims


def _raw_claims(spark, d) -> DataFrame:
    """A generator's response for each document, with a defect by doc_id % 12 in its claim."""
    docs = _table(spark, d, "documents").select(_long("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    first, second, third = (F.concat(F.lit("d"), _text("doc_id"), F.lit(f"#{s}")) for s in ("all", "end", "none"))
    good = F.substring("text", 1, 30)
    n = F.col("doc_id") % 12
    quote = lambda c, q: F.struct(c.alias("chunkId"), q.alias("quote"))
    cites = (
        F.when(n == 3, F.array().cast("array<string>")).when(n == 4, F.array(first, first)).when(n.isin(5, 11), F.array(first, second))
        .when(n == 9, F.array(third)).otherwise(F.array(first))
    )
    quotes = (
        F.when(n == 7, F.array(quote(first, F.lit(" ")))).when(n == 8, F.array(quote(first, F.lit("End")), quote(second, F.lit("End"))))
        .when(n == 9, F.array(quote(third, F.lit("x")))).when(n == 10, F.array(quote(first, F.concat(good, F.lit("~~"))))).otherwise(F.array(quote(first, good)))
    )
    claim = F.struct(
        F.when(n == 2, F.lit(" \n")).otherwise(F.concat(F.lit("claim "), _text("doc_id"))).alias("text"),
        F.when(n == 1, "guess").when(n.isin(4, 6, 11), "inferred").otherwise("stated").alias("status"),
        cites.alias("citations"), quotes.alias("supportingQuotes"),
    )
    return docs.select("doc_id", "text", "lang", F.to_json(F.struct(F.array(claim).alias("claims"))).alias("raw"))


def _verdicts(spark, d) -> DataFrame:
    raw = _raw_claims(spark, d)
    claims = generation.claim_rows(generation.parse_claims(raw.select(F.col("doc_id").alias("question_id"), "raw")))
    chunk = lambda rank, s, t: F.struct(F.lit(rank).alias("rank"), F.concat(F.lit("d"), _text("doc_id"), F.lit(f"#{s}")).alias("chunkId"), t.alias("text"))
    both = F.array(chunk(1, "all", F.col("text")), chunk(2, "end", F.concat(F.lit("End of "), _text("doc_id"))))
    shown = raw.select(F.col("doc_id").alias("question_id"), F.inline(both))
    return verify.verify(claims, shown)


_BLANK = "regexp_full_match(left(coalesce(text, ''), 30), '[\\s\\x{A0}\\x{FEFF}]*')"
_KIND = f"""CASE doc_id % 12 WHEN 1 THEN 'malformed-claim' WHEN 2 THEN 'empty-claim-text' WHEN 3 THEN 'empty-citations' WHEN 4 THEN 'duplicate-citation'
  WHEN 5 THEN 'stated-claim-multiple-citations' WHEN 6 THEN 'inferred-claim-single-citation' WHEN 7 THEN 'empty-quote' WHEN 8 THEN 'quote-for-uncited-chunk'
  WHEN 9 THEN 'chunk-not-retrieved' WHEN 10 THEN 'quote-not-in-chunk' WHEN 11 THEN CASE WHEN {_BLANK} THEN 'empty-quote' ELSE 'citation-without-quote' END
  ELSE CASE WHEN {_BLANK} THEN 'empty-quote' END END"""
_CHUNK = """CASE WHEN kind IN ('duplicate-citation', 'empty-quote', 'quote-not-in-chunk') THEN 'd' || doc_id || '#all'
  WHEN kind IN ('quote-for-uncited-chunk', 'citation-without-quote') THEN 'd' || doc_id || '#end' WHEN kind = 'chunk-not-retrieved' THEN 'd' || doc_id || '#none' END"""
_SHAPES = "('" + "', '".join(REJECTION_KINDS[:8]) + "')"


@_query(f"WITH k AS (SELECT doc_id, {_KIND} AS kind FROM documents) SELECT doc_id, kind, {_CHUNK} AS chunk FROM k")
def verify_first_reason(spark, d):
    return _verdicts(spark, d).select(F.col("question_id").alias("doc_id"), F.col("reason.kind").alias("kind"), F.col("reason.chunkId").alias("chunk"))


_SAID = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in verify.PHRASES.items()) + " END"


@_query(f"""
WITH k AS (SELECT doc_id, {_KIND} AS kind FROM documents)
SELECT doc_id, CASE WHEN kind = 'malformed-claim' THEN 'a claim ' ELSE 'the claim ' || to_json(CASE WHEN doc_id % 12 = 2 THEN ' ' || chr(10) ELSE 'claim ' || doc_id END) || ' ' END
  || {_SAID} || coalesce(': ' || {_CHUNK}, '') AS message FROM k WHERE kind IS NOT NULL
""")
def verify_messages(spark, d):
    return _verdicts(spark, d).where("reason is not null").select(F.col("question_id").alias("doc_id"), F.col("reason.message").alias("message"))


@_query(f"WITH k AS (SELECT doc_id, {_KIND} AS kind FROM documents) SELECT doc_id, CASE WHEN kind IN {_SHAPES} THEN kind END AS kind FROM k")
def verify_shape(spark, d):
    raw = _raw_claims(spark, d).select(F.col("doc_id").alias("question_id"), "raw")
    return generation.claim_rows(generation.parse_claims(raw)).select(F.col("question_id").alias("doc_id"), verify.shape_problem()["kind"].alias("kind"))


@_query(f"WITH k AS (SELECT doc_id, {_KIND} AS kind FROM documents) SELECT doc_id, kind FROM k WHERE kind IS NULL OR kind NOT IN {_SHAPES}")
def verify_content(spark, d):
    rows = _verdicts(spark, d).where(verify.shape_problem().isNull())
    return rows.select(F.col("question_id").alias("doc_id"), F.col("reason.kind").alias("kind"))


@_query(f"""
WITH k AS (SELECT lang, {_KIND} AS kind FROM documents)
SELECT lang, count(*) AS total, count(*) FILTER (kind IS NULL) AS verified, count(kind) AS rejected,
       {", ".join(f"count(*) FILTER (kind = '{k}') AS {k.replace('-', '_')}" for k in REJECTION_KINDS)}
FROM k GROUP BY lang
""")
def rejection_summary(spark, d):
    lang = _table(spark, d, "documents").select(_long("doc_id").alias("question_id"), "lang")
    rows = verify.summarise(_verdicts(spark, d).join(lang, "question_id"), "lang")
    return rows.select(*[F.col(f"`{c}`").alias(c.replace("-", "_")) for c in rows.columns])


@_query("SELECT doc_id, 'd' || doc_id || '#none' AS chunk FROM documents WHERE doc_id % 12 = 9")
def citations_not_retrieved(spark, d):
    claims = _verdicts(spark, d).where("well_formed").select(F.col("question_id").alias("doc_id"), F.explode("citations").alias("chunk"))
    shown = _table(spark, d, "documents").select(_long("doc_id").alias("doc_id"), F.explode(F.array(*[F.concat(F.lit("d"), _text("doc_id"), F.lit(s)) for s in ("#all", "#end")])).alias("chunk"))
    return claims.join(shown, ["doc_id", "chunk"], "left_anti")


@_query("SELECT item_id, count(doc_id) AS n, coalesce(min(doc_id), -1) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def quote_containment(spark, d):
    quotes = _table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = quotes_in.containing(_table(spark, d, "documents").select("doc_id", "text"), quotes)
    found = found.groupBy("item_id").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("first_doc"))
    return quotes.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_doc", F.lit(-1)).alias("first_doc"))


@_query("SELECT doc_id, 'd' || doc_id || '#end' AS missing FROM documents WHERE doc_id % 12 IN (5, 11)")
def citation_coverage(spark, d):
    rows = _verdicts(spark, d).where("well_formed")
    bare = F.array_except("citations", F.transform("quotes", lambda q: q["chunkId"]))
    return rows.where(F.size(bare) > 0).select(F.col("question_id").alias("doc_id"), F.array_join(bare, ",").alias("missing"))


@_query("""
SELECT doc_id, doc_id % 9 NOT IN (2, 3, 4, 5, 6, 8) AS ok, CASE WHEN doc_id % 9 IN (0, 1) THEN 1 WHEN doc_id % 9 = 7 THEN 0 ELSE -1 END::BIGINT AS n FROM documents
""")
def parse_claims(spark, d):
    n, raw = F.col("doc_id") % 9, F.col("raw")
    changed = (
        F.when(n == 1, F.concat(F.lit(" ```json\n"), raw, F.lit("\n``` "))).when(n == 2, F.concat(raw, F.lit(" trailing"))).when(n == 3, F.lit("  \n"))
        .when(n == 4, F.concat(F.lit("["), raw, F.lit("]"))).when(n == 5, F.regexp_replace(raw, '"claims":', '"claim":')).when(n == 6, F.lit('{"claims": {}}'))
        .when(n == 7, F.lit('{"claims": []}')).when(n == 8, F.regexp_replace(raw, '"', "'")).otherwise(raw)
    )
    rows = generation.parse_claims(_raw_claims(spark, d).select(F.col("doc_id").alias("question_id"), changed.alias("raw")))
    return rows.select(F.col("question_id").alias("doc_id"), F.col("problem").isNull().alias("ok"), F.coalesce(_long(F.size("claims")), F.lit(-1)).alias("n"))


@_query("""
WITH t AS (SELECT doc_id, 'see d' || doc_id || '#part-one, d' || (doc_id % 7) || '#b; d' || doc_id || '#part-one. ' || coalesce(text, '') AS detail FROM documents),
i AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(detail, '[a-z0-9]+(?:-[a-z0-9]+)*#[a-z0-9]+(?:-[a-z0-9]+)*'))) AS ids FROM t)
SELECT doc_id, array_to_string(ids, ',') AS chunk_ids, array_to_string(list_sort(list_distinct(list_transform(ids, lambda x: split_part(x, '#', 1)))), ',') AS doc_ids FROM i
""")
def evidence_ids(spark, d):
    doc = _text("doc_id")
    detail = F.concat(F.lit("see d"), doc, F.lit("#part-one, d"), _text(F.col("doc_id") % 7), F.lit("#b; d"), doc, F.lit("#part-one. "), F.coalesce("text", F.lit("")))
    rows = _table(spark, d, "documents").select("doc_id", detail.alias("detail"), F.lit(None).cast("array<struct<citations:array<string>>>").alias("claims"))
    chunks, docs = evaluate.evidence(F.col("claims"), F.col("detail"))
    return rows.withColumn("c", chunks).withColumn("d", docs).select("doc_id", F.array_join("c", ",").alias("chunk_ids"), F.array_join("d", ",").alias("doc_ids"))


# Contradictions

_LINE = "l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos"


@_query(f"""
WITH l AS (SELECT {_LINE}, l_suppkey, l_quantity::BIGINT::VARCHAR AS q,
  CASE l_partkey % 3 WHEN 0 THEN 'units' WHEN 1 THEN 'boxes' ELSE 'pallets' END AS w, CASE WHEN l_partkey % 5 = 0 THEN ['short', 'note'] ELSE ['delivery', 'batch', 'note'] END AS words FROM lineitem),
p AS (SELECT a.l_orderkey, a.pos AS i, b.pos AS j, a.q AS qa, b.q AS qb, a.l_suppkey AS da, b.l_suppkey AS db, CASE WHEN a.w = b.w THEN a.w ELSE 'shipped' END AS unit,
        row_number() OVER (PARTITION BY a.l_orderkey ORDER BY a.pos, b.pos) AS n
      FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.pos < b.pos AND a.l_suppkey <> b.l_suppkey AND a.q <> b.q
      WHERE len(list_intersect(a.words, b.words)) >= {MIN_SUBJECT_OVERLAP})
SELECT l_orderkey, unit, i::BIGINT AS i, j::BIGINT AS j, da AS doc_a, db AS doc_b, qa AS magnitude_a, qb AS magnitude_b FROM p WHERE n = 1
""")
def contradiction_first(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    unit = F.when(F.col("l_partkey") % 3 == 0, "units").when(F.col("l_partkey") % 3 == 1, "boxes").otherwise("pallets")
    quote = F.concat(_text(_long("l_quantity")), F.lit(" "), unit, F.lit(" shipped"))
    subject = F.when(F.col("l_partkey") % 5 == 0, "A short note").otherwise("The delivery batch note")
    lines = _table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("pos"), _long("l_suppkey").alias("docId"), quote.alias("quote"), subject.alias("subject"))
    words = fn.content_words(F.col("subject")).alias("words")
    values = lines.select("l_orderkey", "pos", "docId", words, F.posexplode(fn.measurements(F.col("quote"))).alias("at", "m"))
    found = contradict.first_pairs(values.select("l_orderkey", "pos", "docId", "words", "at", "m.magnitude", "m.units"), "l_orderkey")
    return found.select(
        "l_orderkey", "unit", _long("a.pos").alias("i"), _long("b.pos").alias("j"), F.col("a.docId").alias("doc_a"), F.col("b.docId").alias("doc_b"),
        F.col("a.magnitude").alias("magnitude_a"), F.col("b.magnitude").alias("magnitude_b"),
    )


# Answering


def stand_in_generator(system: str, user: str) -> str:
    """Answers from the prompt alone; the question's number decides which way it goes wrong."""
    import json
    import re

    number = int(re.search(r"like vector (\d+)\?", user)[1])
    chunks = re.findall(r"chunkId: (\S+)\n(?:.*\n){3}text:\n(.*)", user)
    way = number // 20 % 5
    if way == 0:
        return '{"claims": []}'
    if way == 1:
        return "I do not know."
    take = chunks[:2] if way == 3 else chunks[:1]
    claims = [
        {
            "text": f"The group of the store holds what {c} says.",
            "status": "stated",
            "citations": [c],
            "supportingQuotes": [{"chunkId": c, "quote": t if way != 2 else t.upper()}],
        }
        for c, t in take
    ]
    return "```json\n" + json.dumps({"claims": claims}) + "\n```"


def _answers(spark, d, floor) -> DataFrame:
    # an own vector as the best hit would make every question answerable
    return answer.answer_questions(_questions(spark, d), _index(spark, d), stand_in_generator, floor=floor, apart=_APART)


def _decision_sql(floor: float, select: str) -> str:
    return f"""
WITH {_SCORES},
r AS (SELECT question_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE vec_id <> question_id),
a AS (SELECT question_id, count(*) FILTER (score >= {floor} AND rank <= 6) AS n, question_id // 20 % 5 AS way FROM r GROUP BY question_id),
x AS (SELECT question_id, n, CASE WHEN n = 0 THEN 'no-relevant-documents' WHEN way IN (0, 1) THEN 'no-claims-produced' WHEN way = 2 THEN 'claims-failed-verification'
        WHEN way = 3 AND n > 1 THEN 'contradictory-sources' END AS reason FROM a)
{select}"""


_DECIDED = "SELECT question_id, CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS kind, reason, CASE WHEN reason IS NULL THEN 1 ELSE 0 END::BIGINT AS n_claims FROM x"


def _decision(spark, d, floor):
    return _answers(spark, d, floor).select("question_id", "kind", "reason", F.coalesce(_long(F.size("claims")), F.lit(0)).alias("n_claims"))


@_query(_decision_sql(SIMILARITY_FLOOR, _DECIDED))
def answer_decision(spark, d):
    return _decision(spark, d, SIMILARITY_FLOOR)


@_query(_decision_sql(0.35, _DECIDED))
def answer_decision_low_floor(spark, d):
    return _decision(spark, d, 0.35)


@_query(_decision_sql(0.35, """,
g AS (SELECT *, 'The group of the store holds ' || vec_id || ' items.' AS t, 'The group of the store holds what ' || chunk_id || ' says.' AS claim FROM
  (SELECT question_id, vec_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE vec_id <> question_id) WHERE rank <= 6),
p AS (SELECT question_id, rank, '"' || vec_id || ' items" in Vector ' || vec_id || ' (v' || vec_id || '), version 1.0, effective 2024-01-01; cited as ' || chunk_id
        || '; quoted from ' || chunk_id || ': "' || t || '"' AS said FROM g),
b AS (SELECT question_id, max(CASE WHEN rank = 1 THEN printf('%.4f', score) || ', of ' || chunk_id END) AS best, string_agg(chunk_id, ', ' ORDER BY rank) FILTER (score >= 0.35) AS ids,
        max(CASE WHEN rank = 1 THEN '[quote-not-in-chunk] the claim "' || claim || '" quotes what the chunk does not contain: ' || chunk_id END) AS dropped FROM g GROUP BY question_id)
SELECT x.question_id, reason, CASE reason
  WHEN 'no-relevant-documents' THEN 'nothing reached the floor of 0.3500 for "What is like vector ' || x.question_id || '?"; the best score was ' || best || '; the generator was not asked'
  WHEN 'no-claims-produced' THEN CASE WHEN x.question_id // 20 % 5 = 0 THEN 'the generator returned no claims' ELSE 'the response is no valid JSON; raw response: "I do not know."' END || '; shown: ' || ids
  WHEN 'claims-failed-verification' THEN 'all claims failed verification: ' || dropped
  WHEN 'contradictory-sources' THEN 'two documents disagree, in items. First: ' || p1.said || '. Second: ' || p2.said END AS detail
FROM x JOIN b USING (question_id) LEFT JOIN p p1 ON p1.question_id = x.question_id AND p1.rank = 1 LEFT JOIN p p2 ON p2.question_id = x.question_id AND p2.rank = 2
WHERE reason IS NOT NULL"""))
def answer_details(spark, d):
    return _answers(spark, d, 0.35).where("kind = 'refused'").select("question_id", "reason", "detail")


@_query(_decision_sql(0.35, "SELECT question_id FROM x WHERE n > 0"))
def generator_gate(spark, d):
    return models.generate(generation.render_prompts(_shown(spark, d, 0.35)), stand_in_generator).select("question_id")


# Scoring

_TRUTH = """
t AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'refused-no-documents' WHEN quality = 0 THEN 'refused-contradiction' ELSE 'answered' END AS category, doc_id % 3 = 0 AS refused FROM labels),
f AS (SELECT doc_id, category, CASE WHEN category = 'refused-no-documents' AND NOT refused THEN 'hallucinated-answer'
  WHEN category = 'refused-contradiction' AND NOT refused THEN 'resolved-contradiction' WHEN category = 'refused-contradiction' AND doc_id % 2 = 0 THEN 'missing-contradiction-source'
  WHEN category = 'answered' AND refused THEN 'over-refusal' WHEN category = 'answered' AND doc_id % 5 = 0 THEN 'missing-citation' END AS failure FROM t),
v AS (SELECT *, failure IN ('hallucinated-answer', 'resolved-contradiction') AS headline FROM f)
"""


def _scores(spark, d) -> DataFrame:
    rows = _table(spark, d, "labels")
    doc = _text("doc_id")
    ids = lambda *s: F.array(*[F.concat(F.lit(a), doc, F.lit(b)) for a, b in s])
    outcome = F.when(F.col("toxic") == 1, "refused-no-documents").when(F.col("quality") == 0, "refused-contradiction").otherwise("answered")
    questions = rows.select(
        _long("doc_id").alias("pos"), _long("doc_id").alias("question_id"), F.concat(F.lit("q"), doc).alias("id"), F.concat(F.lit("Question "), doc).alias("question"), outcome.alias("outcome"),
        F.when(F.col("doc_id") % 5 == 0, ids(("d", "#a"), ("d", "#c"))).otherwise(ids(("d", "#a"))).alias("expectedChunkIds"), ids(("d", ""), ("e", "")).alias("contradictionDocIds"),
    )
    refused = F.col("doc_id") % 3 == 0
    detail = F.concat(F.lit("see d"), doc, F.lit("#a"), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit(" and e"), doc, F.lit("#b"))).otherwise(""))
    claims = F.array(F.struct(ids(("d", "#a"), ("d", "#b")).alias("citations")))
    results = rows.select(
        _long("doc_id").alias("question_id"), F.lit("").alias("question"), F.when(refused, "refused").otherwise("answered").alias("kind"),
        F.when(refused, "no-claims-produced").alias("reason"), F.when(refused, detail).alias("detail"), F.when(~refused, claims).alias("claims"),
        F.when(~refused, F.array().cast("array<string>")).alias("rejected"),
    )
    return evaluate.score(questions, results)


@_query(f"WITH {_TRUTH} SELECT 'q' || doc_id AS id, category, failure IS NULL AS passed, failure, coalesce(headline, false) AS headline FROM v")
def score_questions(spark, d):
    return _scores(spark, d).select("id", "category", "passed", "failure", "headline")


_CITED = "['d' || doc_id || '#a', 'd' || doc_id || '#b']"


@_query(f"""
WITH {_TRUTH},
e AS (SELECT *, CASE WHEN category = 'answered' THEN list_distinct(['d' || doc_id || '#a', CASE WHEN doc_id % 5 = 0 THEN 'd' || doc_id || '#c' ELSE 'd' || doc_id || '#a' END])
        WHEN category = 'refused-contradiction' THEN ['d' || doc_id, 'e' || doc_id] ELSE [] END AS wanted,
      CASE WHEN category = 'refused-contradiction' THEN CASE WHEN refused AND doc_id % 2 = 1 THEN ['d' || doc_id, 'e' || doc_id] ELSE ['d' || doc_id] END
        WHEN refused THEN CASE WHEN doc_id % 2 = 1 THEN ['d' || doc_id || '#a', 'e' || doc_id || '#b'] ELSE ['d' || doc_id || '#a'] END ELSE {_CITED} END AS named FROM (SELECT *, doc_id % 3 = 0 AS refused FROM v)),
m AS (SELECT *, array_to_string(list_sort(list_filter(wanted, lambda x: NOT list_contains(named, x))), ', ') AS missing,
      CASE WHEN refused THEN '' ELSE array_to_string(list_sort(list_filter(named, lambda x: NOT list_contains(wanted, x))), ', ') END AS extra FROM e)
SELECT 'q' || doc_id AS id, missing, extra, CASE WHEN failure IS NOT NULL THEN failure || ' in q' || doc_id || ' (wanted: ' || category || '; got: ' ||
  CASE WHEN refused THEN 'refused: no-claims-produced' ELSE 'answered; claims: 1' END || CASE WHEN missing <> '' THEN '; missing: ' || missing ELSE '' END
  || CASE WHEN extra <> '' THEN '; extra: ' || extra ELSE '' END || ')' END AS message FROM m
""")
def score_evidence(spark, d):
    return _scores(spark, d).select("id", F.array_join("missing", ", ").alias("missing"), F.array_join("extra", ", ").alias("extra"), "message")


@_query(f"WITH {_TRUTH} SELECT row_number() OVER (ORDER BY headline DESC, doc_id) AS ord, 'q' || doc_id AS id, failure FROM v WHERE failure IS NOT NULL")
def violations_ordered(spark, d):
    return evaluate.violations(_scores(spark, d)).select(_long("ord").alias("ord"), "id", "failure")


_GATED = f"""
p(category, label, threshold) AS (VALUES {", ".join(f"('{c}', '{label}', {share})" for c, (label, share) in GATE.items())}),
g AS (SELECT category, label, threshold::DOUBLE AS threshold, count(doc_id) AS total, count(*) FILTER (doc_id IS NOT NULL AND failure IS NULL) AS passed FROM p LEFT JOIN v USING (category) GROUP BY ALL),
c AS (SELECT *, CASE WHEN total = 0 THEN 1.0 ELSE passed / total END::DOUBLE AS rate FROM g)
"""


@_query(f"WITH {_TRUTH}, {_GATED} SELECT category, label, threshold, total, passed, round(rate, 6) AS rate, rate >= threshold AS met FROM c")
def gate_categories(spark, d):
    return evaluate.gate(_scores(spark, d)).select("category", "label", "threshold", "total", "passed", F.round("rate", 6).alias("rate"), "met")


@_query(f"WITH {_TRUTH}, {_GATED} SELECT bool_and(rate >= threshold) AS passed, sum(total)::BIGINT AS total_questions, sum(passed)::BIGINT AS total_passed FROM c")
def gate_verdict(spark, d):
    return evaluate.verdict(evaluate.gate(_scores(spark, d)))


@_query(f"""
WITH {_TRUTH},
r AS (SELECT doc_id, CASE WHEN failure IS NULL THEN 'PASS' WHEN headline THEN 'HEADLINE' ELSE 'FAIL' END AS st, 'q' || doc_id AS id,
        CASE category WHEN 'answered' THEN 'answerable' WHEN 'refused-contradiction' THEN 'must-refuse (contradiction)' ELSE 'must-refuse (no documents)' END AS cat FROM v),
w AS (SELECT greatest(6, max(length(st))) AS a, greatest(8, max(length(id))) AS b, greatest(8, max(length(cat))) AS c FROM r)
SELECT doc_id AS pos, rpad(st, a::INT, ' ') || '  ' || rpad(id, b::INT, ' ') || '  ' || cat AS line FROM r, w
""")
def results_table(spark, d):
    return report.results_rows(_scores(spark, d)).select("pos", F.col("head").alias("line"))


# Calibration


def _samples(spark, d) -> calibrate.Grid:
    """A chunk is expected by the questions with its label; a vector is no sample of the question that it is."""
    outcome = F.when(F.col("label") >= 8, calibrate.REFUSE).otherwise("answered")
    asked = _questions(spark, d).select("question_id", "query", outcome.alias("outcome"), F.array("label").alias("expected"))
    return calibrate.Grid(asked, _index(spark, d).where("vec_id is not null"), "label", _APART, 6)


_SAMPLES = f"""WITH {_SCORES},
c AS (SELECT question_id, CASE WHEN q_label >= 8 THEN 'refused-no-documents' ELSE 'answered' END AS outcome, chunk_id, round(score, 6) AS score,
             q_label < 8 AND q_label = label AS correct FROM s WHERE vec_id <> question_id)
"""


@_query(_SAMPLES + "SELECT question_id, outcome, chunk_id, score, correct FROM c")
def calibration_samples(spark, d):
    return calibrate.samples(_samples(spark, d))


@_query(_SAMPLES + """SELECT correct, count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score), 6) AS mean, quantile_disc(score, 0.5) AS median,
quantile_disc(score, 0.05) AS p05, quantile_disc(score, 0.95) AS p95 FROM c GROUP BY correct""")
def score_distribution(spark, d):
    return calibrate.distribution_of(_samples(spark, d)).withColumn("mean", F.round("mean", 6))


@_query(_SAMPLES + """, x AS (SELECT min(score) FILTER (correct) AS a, max(score) FILTER (NOT correct) AS b, max(score) FILTER (outcome = 'refused-no-documents') AS r FROM c)
SELECT a AS lowest_correct, b AS highest_wrong, r AS highest_must_refuse, a > b AS separable, a > r AS must_refuse_separable,
       round(CASE WHEN a > b THEN (a + b) / 2 END, 6) AS suggested_floor, round(CASE WHEN a > r THEN (a + r) / 2 END, 6) AS suggested_must_refuse_floor FROM x""")
def separation(spark, d):
    row = calibrate.separation(calibrate.decisive_of(_samples(spark, d)))
    return row.withColumns({k: F.round(k, 6) for k in ("suggested_floor", "suggested_must_refuse_floor")})


@_query(_SAMPLES + "SELECT question_id, chunk_id, score FROM c WHERE correct ORDER BY score, question_id, chunk_id LIMIT 3")
def boundary_lowest_correct(spark, d):
    return calibrate.boundary_lowest_correct(calibrate.decisive_of(_samples(spark, d))).select("question_id", "chunk_id", "score")


@_query(_SAMPLES + "SELECT question_id, chunk_id, score FROM c WHERE NOT correct ORDER BY score DESC, question_id, chunk_id LIMIT 5")
def boundary_highest_wrong(spark, d):
    return calibrate.boundary_highest_wrong(calibrate.decisive_of(_samples(spark, d))).select("question_id", "chunk_id", "score")


@_query(_SAMPLES + """SELECT question_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS n
FROM c WHERE outcome = 'refused-no-documents') WHERE n = 1""")
def must_refuse_ceiling(spark, d):
    return calibrate.must_refuse_ceiling(calibrate.decisive_of(_samples(spark, d))).select("question_id", "chunk_id", "score")


# Usage


def _snapshots(spark, d) -> DataFrame:
    """Cumulative counters of each user's events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tokens = F.floor(F.abs("value")).cast("long")
    e = _table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), "user_id", "ts", "event_id", tokens.alias("embedding_tokens"), (tokens * 2).alias("input_tokens"),
        (tokens % 7).alias("output_tokens"), (F.col("event_id") % 100).alias("latency_ms"),
    )
    sums = [F.sum(c).over(order).alias(c) for c in usage.COUNTERS]
    return e.select("run_id", F.row_number().over(order).cast("long").alias("pos"), *sums)


_EVENTS = "e AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, floor(abs(value))::BIGINT AS n, (event_id % 100)::BIGINT AS ms FROM events)"
_COST = "round({0} / 1e6 * 0.06 + {1} / 1e6 * 5 + {2} / 1e6 * 25, 9)"


@_query(f"WITH {_EVENTS} SELECT run_id, pos, n AS embedding_tokens, n * 2 AS input_tokens, n % 7 AS output_tokens, ms AS latency_ms, {_COST.format('n', 'n * 2', 'n % 7')} AS cost_usd FROM e")
def usage_deltas(spark, d):
    return usage.deltas(_snapshots(spark, d)).withColumn("cost_usd", F.round("cost_usd", 9))


@_query(f"""WITH {_EVENTS}, t AS (SELECT run_id, sum(n)::BIGINT AS embedding_tokens, sum(n * 2)::BIGINT AS input_tokens, sum(n % 7)::BIGINT AS output_tokens, sum(ms)::BIGINT AS latency_ms FROM e GROUP BY run_id)
SELECT *, {_COST.format('embedding_tokens', 'input_tokens', 'output_tokens')} AS cost_usd FROM t""")
def usage_totals(spark, d):
    return usage.totals(usage.deltas(_snapshots(spark, d)).drop("cost_usd")).withColumn("cost_usd", F.round("cost_usd", 9))


@_query("SELECT event_id, round(abs(value) / 1e6 * 0.06, 12) AS embedding_usd, round(abs(value) / 1e6 * 5 + event_id / 1e6 * 25, 9) AS generation_usd FROM events")
def usage_cost(spark, d):
    v = F.abs("value")
    return _table(spark, d, "events").select(
        "event_id", F.round(usage.embedding_cost(v), 12).alias("embedding_usd"), F.round(usage.generation_cost(v, F.col("event_id")), 9).alias("generation_usd")
    )


# Question sets

_SET_ERRORS = (
    "not-json", "not-an-object", "missing-corpus-dir", "missing-questions-array", "missing-questions-array", "malformed-question", "malformed-question",
    "duplicate-id", "unknown-outcome", "malformed-chunk-id", "missing-expected-chunk-ids", "missing-contradiction-doc-ids",
)


@_query(f"SELECT doc_id AS set_id, CASE doc_id % 13 {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate(_SET_ERRORS))} END AS error, CASE WHEN doc_id % 13 = 12 THEN 2 ELSE 0 END::BIGINT AS n FROM documents")
def question_set_validate(spark, d):
    n, doc = F.col("doc_id") % 13, _text("doc_id")
    q = lambda i, outcome, expected, sides, extra="": F.concat(
        F.lit('{"id": "'), i, F.lit('", "question": "What?", "rationale": "Because.", "outcome": "'), outcome, F.lit('", "expectedChunkIds": '), expected,
        F.lit(', "contradictionDocIds": '), sides, F.lit(extra + "}"),
    )
    first = q(
        F.concat(F.lit("q"), doc), F.when(n == 8, "maybe").when(n == 11, "refused-contradiction").otherwise("answered"),
        F.when(n == 9, F.lit('["nohash"]')).when(n == 10, F.lit("[]")).otherwise(F.lit('["a#b"]')), F.lit('["a"]'),
    )
    second = q(F.when(n == 7, F.concat(F.lit("q"), doc)).otherwise("other"), F.lit("refused-no-documents"), F.lit("[]"), F.lit("[]"))
    entries = F.when(n == 5, F.lit("7")).when(n == 6, F.regexp_replace(first, '"What\\?"', "5")).otherwise(first)
    body = F.concat(F.lit('{"corpusDir": "'), F.when(n == 2, " ").otherwise("docs"), F.lit('", "questions": ['), F.when(n == 3, "").otherwise(F.concat(entries, F.lit(", "), second)), F.lit("]}"))
    source = F.when(n == 0, F.concat(body, F.lit("}"))).when(n == 1, F.concat(F.lit("["), body, F.lit("]"))).when(n == 4, F.lit('{"corpusDir": "docs"}')).otherwise(body)
    rows = evaluate.validate_question_sets(_table(spark, d, "documents").select(_long("doc_id").alias("set_id"), source.alias("source")))
    return rows.select("set_id", "error", F.coalesce(_long(F.size("questions")), F.lit(0)).alias("n"))

# Precedence: several defects at a time. The SQL lists those that are there with their ranks and takes the least.


def _ranked(defects: list[tuple[str, str]]) -> str:
    """SQL: the kind of the first of (kind, condition) whose condition holds."""
    listed = ", ".join(f"CASE WHEN {when} THEN {{'rank': {i}, 'kind': '{kind}'}} END" for i, (kind, when) in enumerate(defects))
    return f"list_min(list_filter([{listed}], lambda x: x IS NOT NULL)).kind"


_CLAIM_DEFECTS = _ranked([
    ("malformed-claim", "m = 0"), ("empty-claim-text", "b = 0"), ("empty-citations", "c = 1"), ("duplicate-citation", "c = 2"), ("stated-claim-multiple-citations", "c = 3"),
    ("inferred-claim-single-citation", "c = 4"), ("empty-quote", "q IN (1, 6)"), ("quote-for-uncited-chunk", "q IN (2, 7)"), ("chunk-not-retrieved", "c = 5"), ("quote-not-in-chunk", "q = 3"),
    ("citation-without-quote", "q = 4 OR c = 6"),
])


@_query(f"""
WITH d AS (SELECT doc_id, doc_id % 4 AS m, doc_id // 4 % 4 AS b, doc_id // 16 % 7 AS c, doc_id // 112 % 8 AS q FROM documents),
k AS (SELECT *, {_CLAIM_DEFECTS} AS kind FROM d)
SELECT doc_id, kind FROM k
""")
def verify_precedence(spark, d):
    docs = _table(spark, d, "documents").select(_long("doc_id").alias("doc_id"))
    m, b, c, q = (F.floor(F.col("doc_id") / n) % k for n, k in ((1, 4), (4, 4), (16, 7), (112, 8)))
    end, all_, other = (F.concat(F.lit("d"), _text("doc_id"), F.lit(f"#{s}")) for s in ("end", "all", "none"))
    cited = F.when(c == 5, other).otherwise(end)
    cites = (
        F.when(c == 1, F.array().cast("array<string>")).when(c == 2, F.array(end, end)).when(c.isin(3, 6), F.array(end, all_)).otherwise(F.array(cited))
    )
    quote = lambda i, t: F.struct(i.alias("chunkId"), F.lit(t).alias("quote"))
    foreign = F.concat(F.lit("x"), other)
    # 6 and 7: two bad quotes, of which the first in order counts; an uncited and blank one is blank
    quotes = (
        F.when(q == 1, F.array(quote(cited, " "))).when(q == 2, F.array(quote(foreign, "End"))).when(q == 3, F.array(quote(cited, "end~~")))
        .when(q == 4, F.array().cast("array<struct<chunkId:string,quote:string>>")).when(q == 6, F.array(quote(foreign, "\t"), quote(foreign, "x")))
        .when(q == 7, F.array(quote(foreign, "End"), quote(cited, ""))).otherwise(F.array(quote(cited, "End")))
    )
    claim = F.struct(
        F.when(b == 0, "\n ").otherwise("claim").alias("text"), F.when(m == 0, "guess").when(c.isin(2, 4, 6), "inferred").otherwise("stated").alias("status"),
        cites.alias("citations"), quotes.alias("supportingQuotes"),
    )
    raw = docs.select(F.col("doc_id").alias("question_id"), F.to_json(F.struct(F.array(claim).alias("claims"))).alias("raw"))
    chunk = lambda rank, i: F.struct(F.lit(rank).alias("rank"), i.alias("chunkId"), F.concat(F.lit("End of "), _text("doc_id")).alias("text"))
    shown = docs.select(F.col("doc_id").alias("question_id"), F.inline(F.array(chunk(1, end), chunk(2, all_))))
    found = verify.verify(generation.claim_rows(generation.parse_claims(raw)), shown)
    return found.select(F.col("question_id").alias("doc_id"), F.col("reason.kind").alias("kind"))


_DOCUMENT_DEFECTS = _ranked([
    ("missing-frontmatter", "f = 1"), ("unterminated-frontmatter", "f = 2"), ("malformed-frontmatter-line", "f IN (3, 9)"), ("unknown-key", "f IN (4, 7)"), ("duplicate-key", "f IN (5, 8)"),
    ("missing-key", "f = 6"), ("id-filename-mismatch", "i = 1"), ("preamble-text", "p = 1"), ("no-sections", "s = 1"), ("empty-slug", "s IN (2, 5)"), ("empty-section", "s = 3"), ("slug-collision", "s = 4"),
])


@_query(f"""
WITH d AS (SELECT DISTINCT conv_id, conv_id % 10 AS f, conv_id // 10 % 2 AS p, conv_id // 20 % 6 AS s, conv_id // 120 % 2 AS i FROM conversations)
SELECT 'conv-' || conv_id AS name, {_DOCUMENT_DEFECTS} AS error FROM d
""")
def chunk_error_precedence(spark, d):
    docs = _conversation_documents(spark, d)
    f, p, s, i = (F.floor(F.col("conv_id") / n) % k for n, k in ((1, 10), (10, 2), (20, 6), (120, 2)))
    version = lambda to: F.regexp_replace("head", "version: 1.0\n", to)
    head = (
        F.when(f == 1, F.concat(F.lit("\n"), version("version 1.0\n"))).when(f == 2, F.regexp_replace(version("bad: line\n"), "---\n$", "")).when(f == 3, version("version:  \nversion: 1\n"))
        .when(f == 4, version("author: x\nno key\n")).when(f == 5, version("title: again\nauthor: x\n")).when(f == 6, version("")).when(f == 7, version("author: x\ntitle: again\n"))
        .when(f == 8, version("version: 1\nversion: 2\n= 3\n")).when(f == 9, version("= 3\n")).otherwise(F.col("head"))
    )
    head = F.when(i == 1, F.regexp_replace(head, "id: conv", "id: other")).otherwise(head)
    body = F.when(s == 1, F.lit("")).otherwise(F.col("body"))
    more = (
        F.when(s == 2, "\n## ++\n\nx\n## Late\n\n").when(s == 3, "\n## Late\n\n## ++\n\nx\n").when(s == 4, "\n## Again\n\nx\n## again!\n\n")
        .when(s == 5, "\n## ++\n\n## ++\n\n").otherwise("")
    )
    source = F.concat(head, F.when(p == 1, "before\n").otherwise(""), body, more)
    return corpus.parse(docs.select("name", source.alias("source"))).select(F.regexp_replace("name", r"\.md$", "").alias("name"), "error")


_SET_DEFECTS = _ranked([
    ("not-json", "a = 4"), ("missing-corpus-dir", "a IN (1, 3)"), ("missing-questions-array", "a = 2"), ("malformed-question", "e IN (2, 6)"), ("unknown-outcome", "e IN (1, 5)"),
    ("malformed-chunk-id", "e = 3"), ("missing-expected-chunk-ids", "e = 4"), ("duplicate-id", "g IN (2, 3)"), ("missing-contradiction-doc-ids", "g = 1"),
])


@_query(f"""
WITH d AS (SELECT doc_id, doc_id % 5 AS a, doc_id // 5 % 7 AS e, doc_id // 35 % 4 AS g FROM documents)
SELECT doc_id AS set_id, {_SET_DEFECTS} AS error FROM d
""")
def question_set_precedence(spark, d):
    a, e, g = (F.floor(F.col("doc_id") / n) % k for n, k in ((1, 5), (5, 7), (35, 4)))
    entry = lambda i, question, outcome, expected, sides: F.concat(
        F.lit('{"id": "'), i, F.lit('", "question": '), question, F.lit(', "rationale": "Because.", "outcome": "'), outcome,
        F.lit('", "expectedChunkIds": '), expected, F.lit(', "contradictionDocIds": '), sides, F.lit("}"),
    )
    first = entry(
        F.when(e == 6, " ").otherwise("q"), F.when(e == 2, "5").otherwise('"What?"'), F.when(e.isin(1, 2, 5, 6), "maybe").otherwise("answered"),
        F.when(e.isin(3, 5), '["nohash"]').when(e == 4, "[]").otherwise('["a#b"]'), F.lit('["a"]'),
    )
    second = entry(
        F.when(g.isin(2, 3), "q").otherwise("other"), F.when(g == 2, "5").otherwise('"Why?"'), F.when(g == 3, "maybe").otherwise("refused-contradiction"),
        F.lit("[]"), F.when(g == 1, '["a"]').when(g == 2, '["a", 5]').otherwise('["a", "b"]'),
    )
    listed = F.when(a.isin(2, 3), "").otherwise(F.concat(first, F.lit(", "), second))
    source = F.concat(F.lit('{"corpusDir": '), F.when(a.isin(1, 3), '" "').otherwise('"docs"'), F.lit(', "questions": ['), listed, F.lit("]}"), F.when(a == 4, "}").otherwise(""))
    rows = evaluate.validate_question_sets(_table(spark, d, "documents").select(_long("doc_id").alias("set_id"), source.alias("source")))
    return rows.select("set_id", "error")
