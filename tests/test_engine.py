"""Operators on small invented documents: sources, errors, verification, answers, the gate, the command line."""

import contextlib
import http.server
import json
import math
import os
import re
import subprocess
import sys
import threading
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import cli, replay
from plumbline.functions import text as fn
from plumbline.operators import answer, calibrate, contradict, evaluate, generation, grid, report, retrieve, usage, verify
from plumbline.operators import quotes as quotes_in
from plumbline.plans import catalogue
from plumbline.sources import corpus, environment, ledger, models, shared

DOC = "---\nid: {0}\ntitle: {1}\ndocType: policy\neffectiveDate: 2024-01-01\nversion: 1.0\n---\n"
CORPUS = {
    "lamp-returns": ("Lamp returns", "## Return window\n\nA lamp can be returned for a refund within 14 calendar days of delivery.\n\n## Fees\n\nReturned lamps cost 5 euros of handling.\n"),
    "store-handbook": ("Store handbook", "## Return window\n\nA lamp can be returned for a refund within 30 calendar days of delivery.\n\n## Opening\n\nThe store opens at nine.\n"),
    "wire-care": ("Wire care", "## Cleaning\n\nClean copper wire with vinegar.\r\nRinse it twice.\n"),
}


@pytest.fixture()
def folder(tmp_path):
    for name, (title, body) in CORPUS.items():
        (tmp_path / f"{name}.md").write_bytes((DOC.format(name, title) + "\n" + body).encode())
    return str(tmp_path)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_sections_are_byte_exact(spark, folder):
    rows = {r["chunkId"]: r for r in corpus.load_corpus(spark, folder).collect()}
    assert len(rows) == 5
    assert rows["wire-care#cleaning"]["text"] == "Clean copper wire with vinegar.\r\nRinse it twice."
    assert rows["lamp-returns#fees"]["docTitle"] == "Lamp returns"


@pytest.mark.parametrize("name", ["note.txt", "_hidden.md"])
def test_scan(spark, folder, tmp_path, name):
    (tmp_path / name).write_text("no frontmatter")
    with pytest.raises(corpus.ChunkError) as e:
        corpus.load_corpus(spark, folder).count()
    assert e.value.kind == ("non-markdown-entry" if name.endswith("txt") else "missing-frontmatter")


def test_a_scan_is_made_by_executors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FILES_PER_TASK", 4)
    for i in range(11):
        (tmp_path / f"{'_.'[i] if i < 2 else ''}d {i}%.md").write_bytes(f"\ufeff{i}\r\nü".encode() + b"\xff")
    rows = corpus.read_files(spark, str(tmp_path))
    assert {r["name"]: r["source"] for r in rows.collect()} == {f"{'_.'[i] if i < 2 else ''}d {i}%.md": f"\ufeff{i}\r\nü\ufffd" for i in range(11)}
    assert rows.rdd.getNumPartitions() == 3 and "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "sub.md").mkdir()
    with pytest.raises(corpus.ChunkError, match="sub.md: non-markdown-entry"):
        corpus.read_files(spark, str(tmp_path))


def test_one_document(spark, folder):
    assert [r["chunkId"] for r in corpus.load_document(spark, f"{folder}/wire-care.md").collect()] == ["wire-care#cleaning"]


def test_empty_folder(spark, tmp_path):
    assert corpus.load_corpus(spark, str(tmp_path)).count() == 0


def test_headings(spark):
    source = DOC.format("a", "A") + "## One\n### still one\n##\tstill\n```\n## Two\n```\nx"
    rows = corpus.sections(corpus.parse(spark.createDataFrame([("a.md", source)], "name string, source string"))).orderBy("pos").collect()
    assert [(r["sectionHeading"], r["text"]) for r in rows] == [("One", "### still one\n##\tstill\n```"), ("Two", "```\nx")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$1,200.50 per month", [("1200.50", "$1,200.50 per month", ["month", "per month"])]),
        ("14 calendar days", [("14", "14 calendar days", ["calendar", "days", "calendar days"])]),
        ("3 of the", []),
        ("540-day plan", []),
        ("5% discount", [("5", "5% discount", ["discount"])]),
        ("", []),
    ],
)
def test_measurements(spark, text, want):
    got = value(spark, fn.measurements(F.lit(text)))
    assert [(m["magnitude"], m["text"], m["units"]) for m in got] == want


def test_scalars(spark):
    assert value(spark, fn.slugify(F.lit("  Returns & Refunds! "))) == "returns-refunds"
    assert value(spark, fn.trim(F.concat(F.lit("\t\n x"), F.expr("char(160)")))) == "x"
    assert value(spark, fn.fnv1a(F.lit("a"))) == 3826002220
    assert value(spark, fn.snippet(F.lit('a"b' + "c" * 90), 5)) == '"a\\"bcc…"'
    assert value(spark, fn.usd(F.lit(0.0))) == "$0.000000"
    assert value(spark, fn.usd(F.lit(6e-8))) == "$6.00e-8"
    assert value(spark, fn.fixed(F.lit(1.005), 2)) == "1.00"
    v = lambda *x: F.array(*[F.lit(float(e)) for e in x])
    assert value(spark, fn.cosine(v(1, 0), v(-2, 0))) == -1.0
    assert value(spark, fn.cosine(v(0, 0), v(1, 1))) == 0.0
    with pytest.raises(Exception, match="sizes"):
        value(spark, fn.cosine(v(1), v(1, 1)))


def plain_hash_vector(text):
    tokens = [t for t in re.split("[^a-z0-9]+", text.lower()) if t]
    out = {}
    for term in [*(f"1:{t}" for t in tokens), *(f"2:{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))]:
        bucket = models.fnv1a_of(term.encode()) % 512
        out[bucket] = out.get(bucket, 0.0) + 1
    return out


def test_a_very_long_token_is_hashed_in_no_time():
    began = time.monotonic()
    text = "x" * 1_000_000 + " y"
    at, bucket, weight = models.hash_weights([text.encode(), b"a b"])
    assert {(i, b): w for i, b, w in zip(at.tolist(), bucket.tolist(), weight.tolist(), strict=True)} == {(n, b): w for n, t in enumerate([text, "a b"]) for b, w in plain_hash_vector(t).items()}
    assert time.monotonic() - began < 3


def test_hash_embedding_against_a_plain_one(spark):
    texts = ["Zone c, zone C! and more", "", None, "a", "İK é漢x9", "word " * 3000, "Zone c, zone C! and more", "x" * 5000 + " y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").selectExpr("*", "1 AS bucket", "2 AS text")
    got = {}
    for r in models.hash_embedding(rows, "k", "t").collect():
        got.setdefault(r["k"], {})[r["bucket"]] = r["weight"]
    for i, t in enumerate(texts):
        assert got.get(i, {}) == plain_hash_vector(t or "") == {i: w for i, w in enumerate(models.hash_vector(t or "")) if w}
    assert models.hash_embedding(rows.limit(0), "k", "t").count() == 0
    assert models.fnv1a_of(b"a") == 3826002220


class Service(http.server.BaseHTTPRequestHandler):
    """A local stand-in for an embedding and a message service; the path says how it goes wrong."""

    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        self.seen.append((self.path, self.headers["authorization"], self.headers["x-own"], body))
        if self.path == "/slow":
            time.sleep(2)
        status = 500 if self.path == "/broken" else 200
        if "messages" in body:
            stop = {"/refuse": "refusal", "/long": "max_tokens"}.get(self.path, "end_turn")
            reply = {"content": [{"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}], "stop_reason": stop, "usage": {"input_tokens": 5, "output_tokens": "x"}}
        else:
            data = [{"index": i, "embedding": [float(len(x)), 1.0]} for i, x in enumerate(body["input"])]
            reply = {"data": data[::-1][(self.path == "/short") :], "usage": {"total_tokens": 9}}
        raw = b"no json" if self.path == "/garbled" else json.dumps(reply).encode()
        if self.path == "/broken":
            raw = str(self.headers).encode()  # a service that echoes the key
        with contextlib.suppress(OSError):  # the client may have gone
            self.send_response(status)
            self.end_headers()
            self.wfile.write(raw)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def settings(prefix, url, **more):
    return {f"{prefix}_URL": url, f"{prefix}_KEY": "key-123", f"{prefix}_MODEL": "m", f"{prefix}_HEADERS": '{"x-own": "1"}', f"{prefix}_TIMEOUT": "1", **more}


def test_embedding_over_http(spark, service):
    make = lambda path: models.http_embedder(settings("PLUMBLINE_EMBEDDING", service + path))
    vectors, used = make("/")(["a", "bcd"], "query"), make("/").with_usage(["a"], "document")[1]
    assert vectors == [[1.0, 1.0], [3.0, 1.0]] and (used["tokens"], used["calls"]) == (9, 1)
    assert Service.seen[0] == ("/", "Bearer key-123", "1", {"input": ["a", "bcd"], "model": "m", "input_type": "query"})
    assert "key-123" not in repr(make("/"))
    n = len(Service.seen)
    assert make("/")([], "query") == [] and len(Service.seen) == n
    for path, kind, status in (("/broken", "http-status", 500), ("/garbled", "malformed-response", None), ("/short", "vector-count-mismatch", None), ("/slow", "transport", None)):
        with pytest.raises(models.EmbeddingError) as e:
            make(path)(["a", "b"], "query")
        assert (e.value.kind, e.value.status) == (kind, status) and "key-123" not in str(e.value)
    with pytest.raises(models.EmbeddingError) as e:
        models.http_embedder(settings("PLUMBLINE_EMBEDDING", "http://127.0.0.1:9/"))(["a"], "query")
    assert e.value.kind == "transport"
    with pytest.raises(ValueError, match="PLUMBLINE_EMBEDDING_KEY is set but empty"):
        models.http_embedder(settings("PLUMBLINE_EMBEDDING", "u", PLUMBLINE_EMBEDDING_KEY=" "))
    rows = spark.createDataFrame([(i, "x" * i) for i in range(1, 6)], "id long, t string")
    assert {r["id"]: r["vector"] for r in models.embed(rows, "t", make("/"), "document").collect()} == {i: [float(i), 1.0] for i in range(1, 6)}


def test_generation_over_http(service):
    make = lambda path: models.http_generator(settings("PLUMBLINE_GENERATION", service + path))
    text, used = make("/").with_usage("sys", "usr")
    assert text == "ab" and (used["input"], used["output"]) == (5, 0)
    assert Service.seen[-1][3] == {"model": "m", "max_tokens": 16_000, "system": "sys", "messages": [{"role": "user", "content": "usr"}]}
    for path, kind, status in (("/refuse", "model-refusal", None), ("/long", "truncated", None), ("/broken", "transport", 500), ("/garbled", "transport", None), ("/slow", "transport", None)):
        with pytest.raises(models.GenerationError) as e:
            make(path)("s", "u")
        assert (e.value.kind, e.value.status) == (kind, status) and "key-123" not in str(e.value)


def test_the_prompt_names_every_check():
    assert all(f"- {phrase}\n" in generation.SYSTEM_PROMPT for phrase in verify.PHRASES.values())


@pytest.mark.parametrize(("named", "master", "want"), [("file:/shared", "spark://host:7077", "file:/shared/plumbline-x-"), (None, "local[4]", "file:/"), (None, "spark://host:7077", None), (None, "local-cluster[2,1,512]", None)])
def test_shared_folder(spark, named, master, want):
    sc = SimpleNamespace(master=master, _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc)
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: named))
    if want:
        assert shared.shared_dir(session, "x").startswith(want)
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session, "x")


def test_scratch_folders_are_removed(spark):
    rows = spark.range(3)
    with shared.scratch(spark) as outer:
        shared.stored(rows, shared.shared_dir(spark, "a"))
        with shared.scratch(spark) as inner:
            kept = shared.stored(rows, shared.shared_dir(spark, "b"))
            assert kept.count() == 3 and len(inner) == 1
        gone, there = (f.removeprefix("file:") for f in (inner[0], outer[0]))
        assert not os.path.exists(gone) and os.path.exists(there)
    assert not os.path.exists(there)


def test_document_order(spark, folder):
    rows = corpus.load_corpus(spark, folder).orderBy("ord").collect()
    assert [(r["ord"], r["chunkId"]) for r in rows] == list(
        enumerate(["lamp-returns#return-window", "lamp-returns#fees", "store-handbook#return-window", "store-handbook#opening", "wire-care#cleaning"])
    )


def test_embedding_response():
    good = {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1.5]}], "usage": {"total_tokens": 7}}
    assert models.read_embedding_response(good, 2) == ([[1.5], [2.0]], 7)
    assert models.read_embedding_response({"data": [{"index": 0, "embedding": []}], "usage": {"total_tokens": 5.0}}, 1) == ([[]], 5)
    for bad in ([], [{"index": 0, "embedding": [1]}] * 2, [{"index": 0, "embedding": [float("nan")]}, {"index": 1, "embedding": [1]}]):
        with pytest.raises(models.EmbeddingError):
            models.read_embedding_response({"data": bad}, 2)
    assert models.HttpEmbedder(lambda body: 1 / 0, "m")([], "document") == []


def test_generator_errors():
    make = lambda *r: models.MessageGenerator(lambda request: r, "m")
    assert make("end", ["a", "b"], {})("s", "u") == "ab"
    for stop, blocks, kind in (("refusal", ["x"], "model-refusal"), ("max_tokens", ["x"], "truncated"), ("end", [" "], "empty-response")):
        with pytest.raises(models.GenerationError) as e:
            make(stop, blocks, {})("s", "u")
        assert e.value.kind == kind
    with pytest.raises(models.GenerationError) as e:
        models.MessageGenerator(lambda request: (_ for _ in ()).throw(RuntimeError("key-123")), "m")("s", "u")
    assert "key-123" not in str(e.value) and e.value.kind == "transport"


def verdicts(spark, claims, shown):
    raw = spark.createDataFrame([(1, json.dumps({"claims": claims}))], "question_id long, raw string")
    rows = spark.createDataFrame([(1, i, c, t) for i, (c, t) in enumerate(shown)], "question_id long, rank int, chunkId string, text string")
    found = verify.verify(generation.claim_rows(generation.parse_claims(raw)), rows).orderBy("pos").collect()
    return [(r["reason"]["kind"], r["reason"]["chunkId"]) if r["reason"] else None for r in found]


def claim(text="x", status="stated", citations=("a#b",), quotes=(("a#b", "words"),)):
    return {"text": text, "status": status, "citations": list(citations), "supportingQuotes": [{"chunkId": c, "quote": q} for c, q in quotes]}


def test_verification(spark):
    shown = [("a#b", "some words here"), ("c#d", "other"), ("a#b", "a later text of the same id")]
    cases = [
        (claim(), None),
        (5, ("malformed-claim", None)),
        (claim() | {"text": 5}, ("malformed-claim", None)),
        (claim(text=" \t"), ("empty-claim-text", None)),
        (claim(citations=()), ("empty-citations", None)),
        (claim(status="inferred", citations=("a#b", "c#d", "c#d")), ("duplicate-citation", "c#d")),
        (claim(citations=("a#b", "c#d")), ("stated-claim-multiple-citations", None)),
        (claim(status="inferred"), ("inferred-claim-single-citation", None)),
        # the first bad quote counts, not the first kind
        (claim(quotes=(("z#z", "q"), ("", "q"))), ("quote-for-uncited-chunk", "z#z")),
        (claim(quotes=((" ", "q"), ("z#z", "q"))), ("empty-quote", None)),
        (claim(quotes=(("a#b", " "),)), ("empty-quote", "a#b")),
        (claim(citations=("n#n",), quotes=()), ("chunk-not-retrieved", "n#n")),
        (claim(quotes=(("a#b", "Words"),)), ("quote-not-in-chunk", "a#b")),
        (claim(quotes=(("a#b", "later"),)), ("quote-not-in-chunk", "a#b")),
        (claim(quotes=()), ("citation-without-quote", "a#b")),
    ]
    assert verdicts(spark, [c for c, _ in cases], shown) == [want for _, want in cases]


def test_rows_with_their_claims_are_verified_like_claims_in_rows(spark):
    shown = [(1, "a#b", "some words here"), (2, "c#d", "other"), (3, "a#b", "a later text of the same id")]
    claims = [claim(), claim(text=" "), claim(citations=("n#n",), quotes=()), claim(quotes=(("a#b", "later"),)), claim(quotes=(("z#z", "q"), ("", "q"))), claim(text=None), claim(quotes=())]
    raw = spark.createDataFrame([(1, json.dumps({"claims": claims})), (2, json.dumps({"claims": []}))], "question_id long, raw string")
    flat = spark.createDataFrame([(1, *s) for s in shown], "question_id long, rank int, chunkId string, text string")
    want = [r["reason"] for r in verify.verify(generation.claim_rows(generation.parse_claims(raw)), flat).orderBy("pos").collect()]
    rows = generation.parse_claims(raw).withColumn("claims", F.transform("claims", generation.typed_claim))
    rows = rows.withColumn("shown", F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(c).alias("chunkId"), F.lit(t).alias("text")) for r, c, t in shown]))
    got = {r["question_id"]: r["claims"] for r in verify.verify_row(rows.withColumn("shown", verify.first_of_each(F.col("shown"))), "claims", "shown").collect()}
    assert [c["reason"] for c in got[1]] == want and [w and w["kind"] for w in want].count(None) == 1 and got[2] == []


@pytest.mark.parametrize(
    ("raw", "ok"),
    [
        ('{"claims": []}', True), ('```json\n{"claims": [1]}\n```', True), ('{"claims": []} more', False), ("", False), (None, False), ("[]", False),
        ("{'claims': []}", False), ('{"claims": 3}', False), ('x\n```\n{"claims": []}\n```', False), ("null", False),
    ],
)
def test_strict_parse(spark, raw, ok):
    row = generation.parse_claims(spark.createDataFrame([(1, raw)], "question_id long, raw string")).first()
    assert (row["problem"] is None) == ok


def contradiction(spark, *claims):
    shown = [(1, 1, "a#x", "a", "A", "1", "2024", "Lamp returns"), (1, 2, "b#x", "b", "B", "1", "2024", "Lamp returns"), (1, 3, "a#y", "a", "A", "1", "2024", "Wire")]
    shown = spark.createDataFrame(shown, "question_id long, rank int, chunkId string, docId string, docTitle string, version string, effectiveDate string, sectionHeading string")
    rows = [(1, i, text, [c], [(c, q)]) for i, (text, c, q) in enumerate(claims)]
    schema = "question_id long, pos int, text string, citations array<string>, quotes array<struct<chunkId:string,quote:string>>"
    return contradict.detect(spark.createDataFrame(rows, schema), shown).first()


def test_contradictions(spark):
    found = contradiction(spark, ("lamp return window", "a#x", "within 14 calendar days"), ("lamp return window", "b#x", "within 30 days"))
    assert (found["unit"], found["a"]["value"], found["b"]["value"]) == ("days", "14 calendar days", "30 days")
    for known_limit in (
        [("lamp return window", "a#x", "14 days"), ("lamp return window", "a#y", "30 days")],  # one document
        [("lamp return window", "a#x", "14 days"), ("lamp return window", "b#x", "14 days")],  # equal
        [("lamp return window", "a#x", "14 days"), ("lamp return window", "b#x", "30 euros")],  # other units
        [("lamp return window 14 days 30 days", "a#x", "14 days")],  # one claim
    ):
        assert contradiction(spark, *known_limit) is None


def test_first_pair_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key in range(60):
        for pos in range(rng.integers(1, 7)):
            for at in range(rng.integers(1, 3)):
                rows.append((key, pos, at, f"d{rng.integers(3)}", str(rng.integers(3)), [["days"], ["days", "weeks"], ["euros"]][rng.integers(3)], [["lamp", "return"], ["lamp", "return", "window"], ["wire"]][rng.integers(3)]))
    schema = "key long, pos int, at int, docId string, magnitude string, units array<string>, words array<string>"
    got = {r["key"]: (r["a"]["pos"], r["b"]["pos"], r["a"]["at"], r["b"]["at"], r["unit"]) for r in contradict.first_pairs(spark.createDataFrame(rows, schema), "key").collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[3] != b[3] and a[4] != b[4] and len(set(a[6]) & set(b[6])) >= 2 and (both := [u for u in a[5] if u in b[5]]):
                want[a[0]] = min(want.get(a[0], (99,)), (a[1], b[1], a[2], b[2], both[0]))
    assert got == want and len(want) > 20


def test_contradictions_are_found_with_one_shuffle(spark, tmp_path):
    rows = [(1, 1, 1, 1, 5.0, 1.0), (1, 1, 2, 2, 7.0, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.contradiction_first(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and found.count() == 1


def grounded(system, user):
    import re

    found = re.findall(r"chunkId: (\S+)\n(?:.*\n){3}text:\n(.*)", user)
    claims = [{"text": f"The returned lamp: {t}", "status": "stated", "citations": [c], "supportingQuotes": [{"chunkId": c, "quote": t}]} for c, t in found]
    return json.dumps({"claims": claims})


def tripwire(system, user):
    raise AssertionError("the generator must not be asked")


def ask(spark, folder, questions, generator, floor=0.3):
    index = models.embed(corpus.load_corpus(spark, folder).drop("pos"), "text", models.hash_embedder, "document").withColumn("chunk_id", F.col("chunkId"))
    rows = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
    asked = models.embed(rows, "question", models.hash_embedder, "query").withColumnRenamed("vector", "query")
    return {r["question_id"]: r for r in answer.answer_questions(asked, index, generator, floor=floor).collect()}


def test_answers(spark, folder):
    got = ask(spark, folder, ["Clean copper wire with vinegar", "A lamp can be returned for a refund within how many days"], grounded)
    assert got[0]["kind"] == "answered" and got[0]["claims"][0]["citations"] == ["wire-care#cleaning"]
    assert got[1]["reason"] == "contradictory-sources"
    assert {"lamp-returns#return-window", "store-handbook#return-window"} <= set(__import__("re").findall(evaluate.CHUNK_ID, got[1]["detail"]))


class Counted:
    """A generator and an embedder that write down every call in a file."""

    model = "counted"

    def __init__(self, path, wrong=None):
        self.path, self.wrong = str(path), wrong

    def told(self, what):
        with open(self.path, "a") as f:
            f.write(json.dumps(what) + "\n")

    def calls(self):
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            return [json.loads(x) for x in f]

    def with_usage(self, a, b):
        self.told(a if isinstance(a, list) else b)
        if isinstance(a, list):
            return [[float(len(t)), 1.0] for t in a], {"tokens": 10 * len(a), "ms": 2}
        if self.wrong and self.wrong in b:
            raise models.GenerationError("model-refusal", "generation stopped: refusal", usage={"input": 7, "output": 1, "ms": 3})
        return f"reply to {b}", {"input": 5, "output": 2, "ms": 1}


def prompts(spark, texts):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "question_id long, system string, user string")


def test_prompts_are_asked_once(spark, tmp_path):
    service, folder = Counted(tmp_path / "calls"), f"file://{tmp_path}/ledger"
    first = models.generate(prompts(spark, ["a", "b", "a", ""]), service, folder)
    got = {r["question_id"]: r for r in first.collect()}
    first.count()
    assert sorted(service.calls()) == ["", "a", "b"] and got[2]["raw"] == "reply to a" and len(got) == 4
    assert sum(r["input_tokens"] for r in got.values()) == 15  # a prompt that stands twice was paid once
    again = models.generate(prompts(spark, ["b", "c"]), service, folder).collect()
    assert sorted(service.calls()) == ["", "a", "b", "c"] and sum(r["input_tokens"] for r in again) == 5
    assert {r["raw"] for r in again} == {"reply to b", "reply to c"}
    assert models.generate(prompts(spark, []), service, folder).collect() == []
    other = Counted(tmp_path / "other")
    other.model = "another model"
    assert models.generate(prompts(spark, ["a"]), other, folder).count() == 1 and other.calls() == ["a"]


def test_a_refused_reply_stands_with_what_it_used(spark, tmp_path):
    service, folder = Counted(tmp_path / "calls", wrong="bad"), f"file://{tmp_path}/ledger"
    for _ in range(2):
        with pytest.raises(ledger.CallFailed, match="refusal") as e:
            models.generate(prompts(spark, ["good", "bad"]), service, folder)
        assert e.value.kind == "model-refusal"
    assert sorted(service.calls()) == ["bad", "good"]
    used = {r["problem"]: (r["calls"], r["input_tokens"], r["output_tokens"]) for r in models.generation_usage(spark, folder).collect()}
    assert used == {None: (1, 5, 2), "model-refusal": (1, 7, 1)}


def test_usage_of_a_reply_that_is_then_refused():
    for stop, blocks in (("refusal", ["x"]), ("max_tokens", ["x"]), ("end", [" "])):
        with pytest.raises(models.GenerationError) as e:
            models.MessageGenerator(lambda request, r=(stop, blocks): (*r, {"input_tokens": 3, "output_tokens": 4}), "m")("s", "u")
        assert (e.value.usage["input"], e.value.usage["output"]) == (3, 4)


def test_a_broken_connection_is_asked_again(spark, tmp_path):
    folder, down = f"file://{tmp_path}/ledger", tmp_path / "down"
    down.write_text("")

    def service(system, user):
        if os.path.exists(down):
            raise models.GenerationError("transport", "the request failed with status 503", 503)
        return "fine"

    with pytest.raises(ledger.CallFailed, match="503"):
        models.generate(prompts(spark, ["a"]), service, folder)
    down.unlink()
    assert models.generate(prompts(spark, ["a"]), service, folder).first()["raw"] == "fine"


def test_texts_are_embedded_once_in_calls_of_bounded_size(spark, tmp_path):
    service, folder = Counted(tmp_path / "calls"), f"file://{tmp_path}/ledger"
    texts = [f"text {i % 40}" for i in range(60)] + ["long " * 50, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").selectExpr("*", "1 AS tokens")
    run = lambda: models.embed_with_usage(rows, "t", service, "document", folder, texts_per_call=8, characters_per_call=100)
    got = run().collect()
    assert {r["id"]: r["vector"] for r in got} == {i: [float(len(t or "")), 1.0] for i, t in enumerate(texts)}
    calls = service.calls()
    assert sorted(t for c in calls for t in c) == sorted({t or "" for t in texts})
    assert max(map(len, calls)) <= 8 and all(sum(map(len, c)) <= 100 or len(c) == 1 for c in calls)
    assert sum(r["embedding_tokens"] for r in got) == 420 and sum(r["embedding_ms"] > 0 for r in got) == len(calls)
    assert sum(r["embedding_tokens"] for r in run().collect()) == 0 and service.calls() == calls  # the second run sends no text
    models.embed(rows.limit(1), "t", service, "query", folder).count()
    assert service.calls()[len(calls) :] == [["text 0"]]  # another kind of vector


KILLED = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from plumbline.sources import models
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").getOrCreate()
models.PROMPTS_PER_APPEND = 1

def service(system, user):
    with open({calls!r}, "a") as f:
        f.write(user + "\\n")
    with open({calls!r}) as f:
        n = sum(1 for _ in f)
    if user == "p7" and not os.path.exists({mark!r}):
        open({mark!r}, "w").close()
        os._exit(1)  # the worker dies in the middle of its task
    return "reply " + user

rows = spark.createDataFrame([(i, "s", f"p{{i}}") for i in range(12)], "question_id long, system string, user string")
got = models.generate(rows, service, {ledger!r})
assert {{r["raw"] for r in got.collect()}} == {{f"reply p{{i}}" for i in range(12)}}
"""


def test_a_killed_task_asks_only_what_it_has_no_reply_to(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = KILLED.format(repo=repo, calls=str(tmp_path / "calls"), mark=str(tmp_path / "mark"), ledger=f"file://{tmp_path}/ledger")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": repo})
    assert done.returncode == 0, done.stderr[-2000:]
    asked = (tmp_path / "calls").read_text().split()
    # the call during which it died got no reply, so it is the one that is made again
    assert os.path.exists(tmp_path / "mark") and sorted(asked) == sorted([*(f"p{i}" for i in range(12)), "p7"])


def test_nothing_above_the_floor_asks_no_generator(spark, folder):
    got = ask(spark, folder, ["quantum zebra"], tripwire)
    assert got[0]["reason"] == "no-relevant-documents" and len(got[0]["near_misses"]) == 5


def test_a_failing_generator_is_no_refusal(spark, folder):
    with pytest.raises(ledger.CallFailed, match="the call failed: AssertionError"):
        ask(spark, folder, ["Clean copper wire with vinegar"], tripwire)


def test_unusable_responses(spark, folder):
    q = ["Clean copper wire with vinegar"]
    assert ask(spark, folder, q, lambda s, u: "no json")[0]["reason"] == "no-claims-produced"
    assert ask(spark, folder, q, lambda s, u: '{"claims": []}')[0]["reason"] == "no-claims-produced"
    assert ask(spark, folder, q, lambda s, u: '{"claims": [1]}')[0]["reason"] == "claims-failed-verification"


def test_search_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, query array<double>")
    i = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 0.0])], "chunk_id string, vector array<double>")
    assert [(r["chunk_id"], r["rank"]) for r in retrieve.search(q, i, 9).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert retrieve.search(q, i, 0).count() == 0 and retrieve.search_blocks(q, i, 0).count() == 0
    assert [r["chunk_id"] for r in retrieve.search_blocks(q, i, 2).orderBy("rank").collect()] == ["a", "b"]
    assert retrieve.check_dimension(i) == 2 and retrieve.check_dimension(i.limit(0)) == 0
    with pytest.raises(ValueError, match="different"):
        retrieve.check_dimension(i.unionByName(spark.createDataFrame([("d", [1.0])], i.schema)))


def test_questions_are_searched_among_questions(spark, tmp_path):
    """Vectors 0 and 20 are questions and near each other; the own vector is no hit."""
    rows = [(0, [1.0, 0.0, 0.0], 1), (20, [1.0, 0.1, 0.0], 1), (40, [0.0, 0.0, 1.0], 2), (3, [0.0, 1.0, 0.0], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["question_id"] for r in catalogue.generator_gate(spark, str(tmp_path)).collect()} == {0, 20}
    for query in (catalogue.answer_decision, catalogue.answer_decision_low_floor):
        got = {r["question_id"]: r["reason"] for r in query(spark, str(tmp_path)).collect()}
        assert got == {0: "no-claims-produced", 20: "no-claims-produced", 40: "no-relevant-documents"}


def test_evidence_late_in_a_text(spark, tmp_path):
    rows = [(1, "x " * 500 + "as late-doc#last-part says"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["chunk_ids"], r["doc_ids"]) for r in catalogue.evidence_ids(spark, str(tmp_path)).collect()}
    assert got == {1: ("d1#b,d1#part-one,late-doc#last-part", "d1,late-doc"), 2: ("d2#b,d2#part-one", "d2")}


def test_more_questions_than_a_broadcast_holds(spark, monkeypatch):
    q = spark.range(50).select(F.col("id").alias("question_id"), F.array(F.cos("id"), F.sin("id")).alias("query"))
    i = spark.range(30).select(F.concat(F.lit("c"), F.col("id")).alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("vector"))
    want, best = sorted(retrieve.pair_scores(q, i).collect()), sorted(retrieve.search(q, i, 3).collect())
    monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", 20)
    pairs = retrieve.pair_scores(q, i)
    assert "CartesianProduct" in pairs._jdf.queryExecution().toString()
    assert len(want) == 1500 and sorted(pairs.collect()) == want
    assert sorted(retrieve.search(q, i, 3).collect()) == best


def test_quotes_are_found_wherever_they_stand(spark, monkeypatch):
    words = [f"w{i % 17}{chr(97 + i % 5)}" for i in range(90)]
    docs = [(1, " ".join(words)), (1, "other"), (2, "x" + "\n".join(words) + "y"), (3, " ".join(words[3:70])), (4, None), (None, " ".join(words)), (5, ""), (6, "a b"), (7, "w1b")]
    quotes = [" ".join(words[5:30]), "w1b", "4e w5a w6b w7", " ".join(words[60:80]), "\n".join(words[1:9]), "", None, "no such words are in any of them", "b", words[5] + "  " + words[6] + " x y z"]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS quote").drop("quote", "h")
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string")
    want = sorted((i, k) for i, t in docs for k, x in enumerate(quotes) if i is not None and t is not None and x is not None and x in t)
    assert len(want) > 20
    for size in (quotes_in.BLOCK_QUOTES, 4):  # in one block, and in several
        monkeypatch.setattr(quotes_in, "BLOCK_QUOTES", size)
        assert sorted(tuple(r) for r in quotes_in.containing(d, q).collect()) == want
    assert quotes_in.containing(d.limit(0), q).count() == quotes_in.containing(d, q.limit(0)).count() == 0


def test_quotes_of_common_words_and_shared_anchors():
    common = ["of the " * n for n in (1, 2, 5, 40)] + ["the of the of", "of", "x" * 24, "x" * 25 + "y", "ab" * 30, "é漢 " * 12]
    quoted = common + [f"of the same of the same of the {i} of the same" for i in range(200)]
    texts = ["of the " * 60, "the of the of the 7 of", "x" * 80 + "y", "abab" * 20, "says of the same of the same of the 7 of the same, too", "", "é漢 " * 13, "q"]
    for length in (1, 3, 24):
        finder = quotes_in._Finder(quoted, length)
        for t in texts:
            assert finder.inside(t) == [i for i, q in enumerate(quoted) if q in t]
    shared = quotes_in._Finder(quoted).automaton
    assert max(len(own) for _, own in shared.values()) < 120  # the parts with a number are not shared


def test_more_quotes_than_a_broadcast_holds(spark, tmp_path):
    spark.createDataFrame([(1, "says quote 7. and quote 10001."), (2, "quote 7."), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    quotes = spark.range(10_003).select(F.col("id").alias("item_id"), F.concat(F.lit("quote "), F.col("id"), F.lit(".")).alias("text"))
    quotes.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: (r["n"], r["first_doc"]) for r in catalogue.quote_containment(spark, str(tmp_path)).collect()}
    assert len(got) == 10_003 and {k: v for k, v in got.items() if v[0]} == {7: (2, 1), 10001: (1, 1)}


def test_percentiles_by_counting(spark):
    rng = np.random.default_rng(4)
    sizes = [s * 10.0**k for k in range(-300, 300) for s in (1.0, -1.0)]
    for values in ([], [0.1] * 7 + [0.2], rng.normal(size=997).tolist(), [1e308, -1e308, 0.0, 5e-324, -5e-324, 1e-300], sizes):
        rows = spark.createDataFrame([(True, float(v)) for v in values], "correct boolean, score double")
        got = calibrate.distribution(rows).where("correct").first()
        assert got["n"] == len(values)
        want = sorted(map(float, values))
        for k, share in calibrate.SHARES.items():
            assert got[k] == want[max(1, math.ceil(share * len(want))) - 1] if values else math.isnan(got[k])
    wrong = calibrate.distribution(spark.createDataFrame([(False, 2.0), (False, None)], "correct boolean, score double")).where("not correct").first()
    assert (wrong["n"], wrong["median"], wrong["p95"]) == (1, 2.0, 2.0)


def test_a_million_distinct_scores(spark):
    rows = spark.range(1_000_000).select((F.col("id") % 2 == 0).alias("correct"), (F.sin(F.col("id") * 0.37) + F.col("id") / 1e9).alias("score"))
    got = {r["correct"]: r for r in calibrate.distribution(rows).collect()}
    for side in (True, False):
        want = np.sort([r["score"] for r in rows.where(F.col("correct") == side).select("score").collect()])
        assert [got[side][k] for k in calibrate.SHARES] == [want[math.ceil(s * len(want)) - 1] for s in calibrate.SHARES.values()]


def test_decisive_samples_decide_as_all_do(spark):
    rng = np.random.default_rng(6)
    outcomes = ["answered", "refused-no-documents", "refused-contradiction"]
    rows = [(q, outcomes[q % 3], f"c{c}", float(rng.integers(0, 30)) / 30, bool(q % 3 != 1 and rng.random() < 0.2)) for q in range(12) for c in range(60)]
    samples = spark.createDataFrame(rows, "question_id long, outcome string, chunk_id string, score double, correct boolean").repartition(5)
    few = calibrate.decisive(samples)
    assert few.count() <= 5 * (3 + 5 + 4)
    for f in (calibrate.separation, calibrate.boundary_lowest_correct, calibrate.boundary_highest_wrong, calibrate.must_refuse_ceiling):
        assert sorted(map(str, f(few).collect())) == sorted(map(str, f(samples).collect()))
    assert calibrate.decisive(samples.limit(0)).count() == 0
    assert calibrate.separation(calibrate.decisive(samples.limit(0))).first()["lowest_correct"] is None


def test_first_repeats(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "b"],), (["a", None, None],), ([],), (None,), (["x", "y", "y", "x"],)], "k array<string>")
    assert [r["at"] for r in fn.with_first_repeat(rows, at="k").collect()] == [2, None, None, None, 2]


def test_long_documents_and_question_sets_take_seconds(spark):
    source = DOC.format("a", "A") + "".join(f"## S {i}\n\nx\n" for i in range(100_000))
    began = time.monotonic()
    for more, error in (("", None), ("## s 7\n\ny\n", "slug-collision")):
        row = corpus.parse(spark.createDataFrame([("a.md", source + more)], "name string, source string")).select("error", F.size("sections").alias("n")).first()
        assert (row["error"], row["n"]) == (error, 100_000 + bool(more))
    q = {"question": "What?", "outcome": "answered", "expectedChunkIds": ["a#b"], "rationale": "r"}
    for last, error in (("x", None), ("5", "duplicate-id")):
        body = json.dumps({"corpusDir": "c", "questions": [q | {"id": str(i)} for i in range(10_000)] + [q | {"id": last}]})
        assert evaluate.validate_question_sets(spark.createDataFrame([(1, body)], "set_id long, source string")).first()["error"] == error
    assert time.monotonic() - began < 60


def test_lines_without_a_shuffle(spark):
    docs = spark.createDataFrame([("a", "x\r\n\n漢😀y\nz"), ("b", ""), ("c", None)], "name string, source string")
    rows = corpus.with_lines(docs)
    assert [tuple(r) for r in rows.collect()] == [("a", 0, 0, "x\r"), ("a", 1, 3, ""), ("a", 2, 4, "漢😀y"), ("a", 3, 8, "z"), ("b", 0, 0, "")]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_gate_of_nothing_passes(spark):
    scores = spark.createDataFrame([], "category string, passed boolean")
    assert evaluate.verdict(evaluate.gate(scores)).first()["passed"]


def test_usage(spark):
    rows = [("r", 0, 10, 0, 0, 5), ("r", 1, 15, 100, 10, 9)]
    d = usage.deltas(spark.createDataFrame(rows, "run_id string, pos long, embedding_tokens long, input_tokens long, output_tokens long, latency_ms long"))
    assert [tuple(r)[2:6] for r in d.orderBy("pos").collect()] == [(10, 0, 0, 5), (5, 100, 10, 4)]
    total = usage.totals(d.drop("cost_usd")).first().asDict()
    assert total["cost_usd"] == pytest.approx(15e-6 * 0.06 + 100e-6 * 5 + 10e-6 * 25)
    steps = [r.asDict() | {"label": f"q{r['pos']}"} for r in d.collect()]
    assert "TOTAL" in report.usage_report(steps, total)


def test_environment():
    env = environment.parse_dotenv("# c\nexport A='x # y'\nB = \"\"\nC=1\nbad line\n")
    assert env == {"A": "x # y", "B": "", "C": "1"}
    assert environment.parse_dotenv("my.key-1=a\u2028b\r\nexport  B = 'c'\n=x\n  # d=e\nC=") == {"my.key-1": "a\u2028b", "B": "c", "C": ""}
    assert environment.merge_environment({"A": " ", "C": "2"}, env) == {"A": "x # y", "B": "", "C": "2"}
    values, problems = environment.resolve_keys(["A", "B", "Z"], env)
    assert values == {"A": "x # y"} and len(problems) == 2
    assert environment.resolve_model("B", env, "m") == "m"


class Metered:
    """A generator and an embedder that tell what they use."""

    def __call__(self, system, user):
        return grounded(system, user)

    def with_usage(self, a, b):
        if isinstance(a, list):
            return models.hash_embedder(a, b), {"tokens": 10 * len(a), "ms": 3}
        return grounded(a, b), {"input": 100, "output": 20, "ms": 7}


def test_metered_run_scores_like_a_plain_one(spark, folder, tmp_path):
    path = tmp_path.parent / f"{tmp_path.name}-m.json"
    path.write_text(json.dumps(QUESTIONS))
    found = {}
    for name, embedder, generator in (("plain", None, grounded), ("metered", Metered(), Metered())):
        to, out = tmp_path.parent / f"{tmp_path.name}-{name}", []
        o = cli.Options([], str(path), folder, str(to), str(tmp_path / "none"), {}, embedder, generator, spark, out.append, floor=0.3)
        assert cli.main(o) == 0
        found[name] = json.loads((to / "eval-latest.json").read_text())
    assert found["plain"]["usage"] is None and found["plain"]["questions"] == found["metered"]["questions"]
    total = found["metered"]["usage"]["totals"]
    assert found["metered"]["usage"]["pricing"]["asOf"] == report.PRICES_AS_OF
    assert (total["embedding_tokens"], total["input_tokens"], total["output_tokens"]) == (80, 200, 40)  # one question is below the floor


QUESTIONS = {
    "corpusDir": "corpus",
    "questions": [
        {"id": "care", "question": "Clean copper wire with vinegar", "outcome": "answered", "expectedChunkIds": ["wire-care#cleaning"], "rationale": "r"},
        {"id": "window", "question": "A lamp can be returned for a refund within how many days", "outcome": "refused-contradiction", "contradictionDocIds": ["lamp-returns", "store-handbook"], "rationale": "r"},
        {"id": "zebra", "question": "quantum zebra", "outcome": "refused-no-documents", "rationale": "r"},
    ],
}


@pytest.mark.parametrize(("generator", "code"), [(grounded, 0), (lambda s, u: '{"claims": []}', 1), (tripwire, 2)])
def test_command_line(spark, folder, tmp_path, generator, code):
    path, out = tmp_path / "questions.json", []
    path.write_text(json.dumps(QUESTIONS))
    results = tmp_path.parent / f"{tmp_path.name}-results"
    options = dict(questions=str(path), corpus=folder, artifacts=str(results), env={}, dotenv=str(tmp_path / "none"), spark=spark, out=out.append, floor=0.3)
    path2 = tmp_path.parent / f"{tmp_path.name}-q.json"
    path.rename(path2)  # the corpus folder takes documents only
    options["questions"] = str(path2)
    assert cli.main(cli.Options([], generator=generator, **options)) == code
    assert (results / "eval-latest.json").exists() == (code < 2)
    if code == 0:
        told = json.loads((results / "eval-latest.json").read_text())
        assert told["verdict"] == "PASS" and told["policy"]["headlineRule"] and told["policy"]["categories"]["answered"]["threshold"] == 0.8
        assert set(told["run"]) == {"generatedAt", "embedder", "generator", "corpusDir", "chunkCount", "k", "threshold"}
        assert cli.main(cli.Options(["--calibrate"], **options)) == 0 and out[-1].startswith("calibration")
        told = json.loads((results / "calibration-latest.json").read_text())
        assert set(told) == {"schemaVersion", "run", "correct", "wrong", "separation", "boundary", "mustRefuse", "currentThreshold", "thresholdNote", "usage"}
        assert told["correct"]["n"] + told["wrong"]["n"] == 15 and told["mustRefuse"]["ceiling"] == told["separation"]["highest_must_refuse"] and told["usage"] is None
    assert cli.main(cli.Options(["--what"], **options)) == 2
    assert cli.main(cli.Options([], **options)) == 2  # no generator is named
    assert cli.main(cli.Options(["--help"], **options)) == 0


def test_wrap_and_difference():
    assert replay.wrap("a bb  ccc\n dddd", 6) == "a bb\nccc\ndddd" and replay.wrap("x" * 9, 4, "  ") == "  " + "x" * 9 and replay.wrap(" ") == ""
    assert replay.difference("same", "same") is None
    told = replay.difference("one two", "one tWo").split("\n")
    assert told == ["expected one two", "     got one tWo", " " * len("expected one t") + "^ character 5"]
    assert replay.difference("ab", "abc").endswith("character 2")
    out = []
    checks = replay.Checks(out.append)
    assert checks.equal({"b": 1, "a": [2]}, {"a": [2], "b": 1}, "same") and not checks.equal(1, 2, "other") and not checks.that(False, "no")
    assert checks.failures == 2 and out[0] == "  [ok] same" and out[1] == "  [FAIL] other"


def test_replay(spark, folder, tmp_path):
    index = models.embed(corpus.load_corpus(spark, folder).drop("pos", "ord"), "text", models.hash_embedder, "document").withColumn("chunk_id", F.col("chunkId"))
    asked = models.embed(spark.createDataFrame([(1, "Clean copper wire with vinegar")], "question_id long, question string"), "question", models.hash_embedder, "query").withColumnRenamed("vector", "query")
    out, response = [], {"claims": [claim("Vinegar cleans.", citations=("wire-care#cleaning",), quotes=(("wire-care#cleaning", "vinegar"),)), claim("No.", citations=("x#y",), quotes=())]}
    path = tmp_path.parent / f"{tmp_path.name}-f.json"
    path.write_text(json.dumps({"$provenance": {"kind": "hand-written"}, "response": response}))
    checks = replay.Checks(out.append)
    row = replay.replay(asked, index, str(path), {"kind": "answered", "reason": None}, checks, floor=0.3)
    assert checks.failures == 0 and len(row["claims"]) == 1 and row["rejected"][0]["reason"]["kind"] == "chunk-not-retrieved"


def test_fixture_files(tmp_path):
    p = tmp_path / "f.json"
    p.write_text(json.dumps({"$provenance": {}, "response": {"claims": []}}))
    assert report.load_fixture(str(p)) == {"claims": []}
    p.write_text(json.dumps({"response": {}}))
    with pytest.raises(ValueError, match="recorded"):
        report.load_fixture(str(p))


ODD = [[0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [1.0, None, 2.0], None, [1e200, 1.0, -1e200], [3e-170, 1e-170, 0.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, 0.0, 0.0], [0.6, 0.8, 0.0]]


def odd_sides(spark):
    rng = np.random.default_rng(9)
    some = [[float(x) for x in np.round(rng.normal(size=3), 1)] for _ in range(40)]
    q = [(i, v, ("answered", calibrate.REFUSE, None)[i % 3], [i % 4, None, 9] if i % 5 else None) for i, v in enumerate(ODD + some[:25])]
    c = [(f"c{i}", v, i % 4 if i % 7 else None, i) for i, v in enumerate(ODD + some)]
    asked = spark.createDataFrame(q, "question_id long, query array<double>, outcome string, expected array<int>")
    return asked, spark.createDataFrame(c, "chunk_id string, vector array<double>, key int, own long")


@pytest.mark.parametrize("digits", [None, 6, 1])
def test_scores_of_tiles_are_those_of_the_definition(spark, monkeypatch, digits):
    monkeypatch.setattr(grid, "CHUNKS", 7)
    asked, index = odd_sides(spark)
    score = fn.cosine(F.col("query"), F.col("vector"))
    want = asked.crossJoin(index).select("question_id", "chunk_id", (score if digits is None else F.round(score, digits)).alias("score"))
    want = sorted(repr(tuple(r)) for r in want.collect())
    assert "nan" in str(want) and "None" in str(want)
    assert sorted(repr(tuple(r)) for r in retrieve.pair_scores(asked, index, digits).collect()) == want
    monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", 10)
    monkeypatch.setattr(grid, "BLOCK", 16)
    assert sorted(repr(tuple(r)) for r in retrieve.pair_scores(asked, index, digits).collect()) == want


def test_rounding_is_that_of_spark(spark):
    halves = [(2 * k + 1) / 2e6 for k in (0, 1, 17, 123456, 499999, 999998)]
    values = [s * v for h in halves for v in (h, np.nextafter(h, 0), np.nextafter(h, 1)) for s in (1.0, -1.0)] + [0.0, -0.0, 1.0, -1e-9, float("nan")]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    want = [r["v"] for r in rows.select("i", F.round("v", 6).alias("v")).orderBy("i").collect()]
    assert list(map(repr, grid.half_up(np.array(values), 6).tolist())) == list(map(repr, want))


def test_vectors_of_two_sizes_are_an_error(spark):
    sides = [spark.createDataFrame([("a", v)], f"{a} string, {b} array<double>") for a, b, v in (("question_id", "query", [1.0]), ("chunk_id", "vector", [1.0, 2.0]))]
    with pytest.raises(Exception, match="vectors of sizes 1 2"):
        retrieve.pair_scores(*sides).collect()


def test_an_index_in_one_file_is_dealt_out_by_its_pairs(spark, monkeypatch):
    q = spark.range(50).select(F.col("id").alias("question_id"), F.array(F.cos("id")).alias("query"))
    i = spark.range(0, 400, 1, 1).select(F.col("id").alias("chunk_id"), F.array(F.sin("id")).alias("vector"))
    monkeypatch.setattr(grid, "PAIRS", 5000)
    pairs = retrieve.pair_scores(q, i)
    assert pairs.count() == 20_000 and pairs.rdd.getNumPartitions() == 4


def same(*frames):
    a, b = (sorted(repr(sorted(r.asDict().items())) for r in f.collect()) for f in frames)
    assert a == b


@pytest.mark.parametrize("digits", [None, 6, 1])
def test_calibration_of_a_grid_is_that_of_its_rows(spark, monkeypatch, digits):
    asked, index = odd_sides(spark)
    truth = asked.select("question_id", "outcome", "expected")
    expected = F.array_contains("expected", F.substring("chunk_id", 2, 9).cast("int") % 4) & (F.substring("chunk_id", 2, 9).cast("int") % 7 != 0)
    scores = retrieve.pair_scores(asked, index, digits).where("score is not null and 'c' || question_id <> chunk_id")
    rows = calibrate.label(scores, truth, expected)
    for tile, most in ((256, 10_000), (6, 10_000), (5, 10)):
        monkeypatch.setattr(grid, "CHUNKS", tile)
        monkeypatch.setattr(grid, "BLOCK", 16)
        monkeypatch.setattr(calibrate, "HELD", 30)
        monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", most)
        pairs = calibrate.Grid(asked, index, "key", ("question_id", "own"), digits)
        same(calibrate.samples(pairs), rows)
        few = calibrate.decisive_of(pairs)
        for f in (calibrate.separation, calibrate.boundary_lowest_correct, calibrate.boundary_highest_wrong, calibrate.must_refuse_ceiling):
            same(f(few), f(rows))
    got = {r["correct"]: r for r in calibrate.distribution_of(pairs).collect()}
    for r in calibrate.distribution(rows).collect():
        assert got[r["correct"]]["n"] == r["n"] > 100
        own = sorted((x["score"] for x in rows.where(F.col("correct") == r["correct"]).collect()), key=lambda x: (math.isnan(x), x))
        for k, share in calibrate.SHARES.items():
            assert repr(got[r["correct"]][k]) == repr(r[k]) == repr(own[math.ceil(share * len(own)) - 1])
        assert repr(got[r["correct"]]["max"]) == repr(own[-1]) and got[r["correct"]]["min"] == r["min"] == own[0]


def test_calibration_of_nothing(spark):
    asked, index = odd_sides(spark)
    for pairs in (calibrate.Grid(asked.limit(0), index, "key"), calibrate.Grid(asked, index.limit(0), "key")):
        assert calibrate.samples(pairs).count() == calibrate.decisive_of(pairs).count() == 0
        assert [(r["n"], math.isnan(r["mean"])) for r in calibrate.distribution_of(pairs).collect()] == [(0, True), (0, True)]


def test_rows_by_score_are_all_pairs_once(monkeypatch):
    import pyarrow as pa

    for name, to in (("QUESTIONS", 16), ("CHUNKS", 7), ("GATHERED", 500), ("SENT", 64)):
        monkeypatch.setattr(grid, name, to)
    vectors = ODD + np.round(np.random.default_rng(1).normal(size=(60, 3)), 1).tolist()
    kind = pa.list_(pa.float64())
    asked = pa.table({"question_id": range(35), "query": pa.array(vectors[:35], kind)})
    index = pa.table({"chunk_id": [f"c{i}" for i in range(70)], "vector": pa.array(vectors, kind)})
    parts, want = [], []
    for tile in grid.Blocks(asked, 1).tiles(iter([index[:40], index[40:]])):
        keep = np.add.outer(np.arange(tile.chunks.num_rows), np.arange(tile.questions.num_rows)) % 3 > 0
        j, i, score, known = grid.scored(tile, keep)
        parts.append((tile, j, i, score, known, i % 2 == 0))
        ids = [tile.questions["question_id"].take(pa.array(i)).to_pylist(), tile.chunks["chunk_id"].take(pa.array(j)).to_pylist()]
        want += zip(*ids, (float(x) if k else None for x, k in zip(score, known, strict=True)), (i % 2 == 0).tolist(), strict=True)
    row = lambda q, c, j, i, s, f: list(zip(q["question_id"].take(pa.array(i)).to_pylist(), c["chunk_id"].take(pa.array(j)).to_pylist(), s.to_pylist(), f.tolist(), strict=True))
    got = list(grid.by_score(iter(parts), row))
    assert len(got) > 20 and max(map(len, got)) == 64
    assert sorted(map(repr, sum(got, []))) == sorted(map(repr, want))
    assert [x[:2] for x in want if x[2] is None] and not list(grid.by_score(iter(()), row))


def shuffled_bytes(df) -> int:
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        p = nodes.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            nodes.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            nodes.append(p.plan())
        elif p.nodeName() == "Exchange":
            total += p.metrics().apply("shuffleBytesWritten").value()
        nodes += [p.children().apply(k) for k in range(p.children().size())]
    return total


def test_blocks_that_meet_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 100)
    few = []
    for n in (500, 1000):
        vector = lambda k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: F.sin(x * F.col("id") + k))
        q = spark.range(n).select(F.col("id").alias("question_id"), vector(1).alias("query"))
        i = spark.range(2 * n).select(F.col("id").alias("chunk_id"), vector(2).alias("vector"))

        def count(few, chunks):
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"n": [sum(few.num_rows * c.num_rows for c in chunks)]})

        pairs = grid.over(q, i, count, "n long", 100)
        few.append(shuffled_bytes(pairs))
        assert sum(r["n"] for r in pairs.collect()) == 2 * n * n
    assert 0 < few[1] < 2.5 * few[0]


@pytest.fixture(scope="module")
def many_vectors(tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    to, x = tmp_path_factory.mktemp("many"), np.random.default_rng(3).normal(size=(24_000, 64)).astype("float32")
    table = {"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32())), "label": (np.arange(len(x)) * 7 % 10).astype("int32")}
    pq.write_table(pa.table(table), to / "embeddings.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["cosine_pairs", "calibration_samples", "score_distribution", "boundary_highest_wrong", "boundary_lowest_correct", "must_refuse_ceiling", "separation"])
def test_29_million_pairs_take_seconds(spark, many_vectors, name):
    began = time.monotonic()
    catalogue.QUERIES[name](spark, many_vectors).write.format("noop").mode("overwrite").save()
    assert time.monotonic() - began < 40


@pytest.mark.parametrize("name", ["calibration_samples", "cosine_pairs"])
def test_all_pairs_take_few_bytes(spark, tmp_path, name):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(4).normal(size=(10_000, 64)).astype("float32")
    table = {"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32())), "label": (np.arange(len(x)) * 7 % 10).astype("int32")}
    pq.write_table(pa.table(table), tmp_path / "embeddings.parquet")
    catalogue.QUERIES[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 6.5 * 500 * len(x)


def test_texts_of_claims_are_read_once(spark):
    rng = np.random.default_rng(2)
    pieces = ["12", "$1,234.50", "5%", " ", "  ", "\t", "\n", "of", "The", "boxes", "Units", "x", "per", "a1b2", "007", "12ab", "Kg", "é", "-", "1.5", "any"]
    texts = ["".join(rng.choice(pieces, size=rng.integers(0, 14))) for _ in range(3000)] + ["12 boxes shipped", "12 the boxes", "12 the of", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fn.measurements(F.col("t")).alias("m"), fn.content_words(F.col("t")).alias("w"))
    got = {r["i"]: r for r in rows.collect()}
    stop, some = set(fn.STOPWORDS), 0
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["m"] is None and got[i]["w"] is None
            continue
        want = []
        for m in re.finditer(fn.MEASUREMENT, t, re.ASCII):
            first, second = m[2].lower(), (m[3] or "").lower()
            two = [second, f"{first} {second}"] if second and second not in stop else []
            if units := [u for u in [first] if u not in stop] + two:
                want.append((re.sub("[$%,]", "", m[1]), m[0], units))
        assert [tuple(m) for m in got[i]["m"]] == want
        assert got[i]["w"] == list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) >= 3 and w not in stop and not w.isdigit()))
        some += len(want)
    assert some > 100
    for f in (fn.measurements, fn.content_words):
        plan = spark.range(1).select(f(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1 and "rlike" not in plan.lower()
