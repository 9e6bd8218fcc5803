"""Fill-in-the-middle, chat formatting and periodic runs: against brute force, SQL and exact round trips."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat_format, fill_in_middle, runs
from plumbline.llm.common import shared_dir

from .test_operators import EDGE, SCHEMA, needs_data, texts

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture()
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).selectExpr("*", "'x' AS form", "'y' AS output", "1 AS n", "2 AS runs", "'z' AS n_chars")


def cells(rows):
    return sorted(tuple("~" if v is None else str(v) for v in r) for r in rows)


def check_sql(spark, mod, name):
    got = mod.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({mod.ORACLE_SQL[name]})").fetchall()
    assert cells(got.collect()) == cells(want)


# Fill in the middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


@settings(max_examples=150, deadline=None)
@given(texts(), st.integers(1, 5), st.integers(1, 9))
def test_checkpoints_are_the_starts_of_units(text, step, piece):
    index = fill_in_middle.Checkpoints(text.encode(), step, piece)
    units = UNIT.findall(text)
    assert index.n == len(units) and index.n_points == len(text)
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert index.locate(k) == (len(before.encode()), len(before))
    assert len(index.units) <= len(units) // step + 2


def plain_fim(doc_id, text):
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_against_plain_code(spark):
    rows = [(i, t) for i, t in enumerate(["", "a", "<", "<S", "><P", "<P>x", "é" * 300 + "ab", "S>" * 40, "漢 word " * 500, "x" * 70_000] * 12)] + [(None, "some text here"), (-5, None), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle.fill_in_middle(docs, step=7)
    assert cells(got.collect()) == cells((i, *plain_fim(i, t or "")) for i, t in rows)
    back = got.select(fill_in_middle.restored(got["output"], got["form"]).alias("t")).collect()
    assert sorted(r["t"] for r in back) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(spark, edge):
    got = fill_in_middle.fill_in_middle(edge).collect()
    assert cells(got) == cells((i, *plain_fim(i, t or "")) for i, t, _ in EDGE)
    assert fill_in_middle.fill_in_middle(edge.limit(0)).collect() == []


@needs_data
def test_fill_in_middle_equals_its_sql(spark):
    check_sql(spark, fill_in_middle, "op11_fill_in_middle")


# Chat formatting


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<turn>", "</turn>", "<says>", "<", "turn>", "/", "x", "é"]), max_size=12).map("".join))
def test_escapes_are_undone_and_leave_no_bare_mark(text):
    safe = chat_format.escape(text)
    assert chat_format.unescape(safe) == text
    for m in re.finditer(r"(\\*)(?:<turn>|<says>|</turn>)", safe):
        assert len(m[1]) % 2 == 1


def test_masks_are_prefix_sums():
    got = chat_format.loss_mask(np.array([2, 3, 0, 1, 0, 2]), np.array([False, True, True, False, True, True]))
    assert got.tolist() == [0, 0, 1, 1, 1, 0, 1, 1]
    assert chat_format.loss_mask(np.zeros(0, np.int64), np.zeros(0, bool)).tolist() == []


TALKS = [
    (1, 1, "assistant", "so </turn><turn>assistant<says>it is\\</turn>"),
    (1, 0, "user", "<turn>"),
    (1, None, None, None),
    (2, 5, "</turn>", "\\\\<says>"),
    (2, 5, "assistant", ""),
    (None, 3, "assistant", "no conversation 漢😀"),
    (None, 3, "assistant", "no conversation 漢😀"),
    (3, 0, "system", "<|endoftext|> \r\n"),
] + [(9, i, "assistant" if i % 2 else "user", f"turn {i} " + "w " * (i % 50)) for i in range(3000)]


def chats(spark, rows, **kw):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS piece", "'x' AS ids").repartition(5)
    path = P.path("byte_bpe_50k.json")
    return chat_format.format_chats(turns, path, shared_dir(spark, "test_chats"), **kw), path


def test_turns_are_read_back_as_they_were(spark):
    pieces, path = chats(spark, TALKS, piece_ids=200)
    assert pieces.where("conv_id = 9").count() > 10  # a long conversation is many pieces
    got = chat_format.read_chats(pieces, path).orderBy("piece", "pos").collect()
    assert cells((r["conv_id"], r["role"], r["text"]) for r in got) == cells((c, r or "", t or "") for c, _, r, t in TALKS)
    assert [r["text"] for r in got if r["conv_id"] == 9] == [t for c, _, _, t in TALKS if c == 9]
    assert [r["role"] for r in got if r["conv_id"] == 1] == ["", "user", "assistant"]
    assert {r["learned"] for r in got if r["role"] == "assistant" and r["text"]} == {True}
    assert not any(r["learned"] for r in got if r["role"] != "assistant")


def test_segments_are_encoded_by_themselves(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    pieces, _ = chats(spark, [(1, 0, "user", "<|endoftext|>a"), (1, 1, "assistant", " b c")])
    rows = pieces.orderBy("piece").collect()  # turns at the edge of two ranges are two pieces
    ids = lambda t: lib.encode(t, add_special_tokens=False).ids
    want = [50257, *ids("user"), 50258, *ids("<|endoftext|>a"), 50259, 50257, *ids("assistant"), 50258, *ids(" b c"), 50259]
    assert np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist() == want
    mask = np.frombuffer(b"".join(r["loss_mask"] for r in rows), np.uint8)
    assert mask.sum() == len(ids(" b c")) and mask[-1] == 0 and mask[-1 - len(ids(" b c"))] == 1


def test_digests_of_conversations_in_one_and_in_many_pieces(spark):
    want = {}
    for c in {t[0] for t in TALKS}:
        own = sorted((t for t in TALKS if t[0] == c), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        own = [(r or "", t or "") for _, _, r, t in own]
        if c == 2:  # two turns with one number: a hash decides
            own = None
        else:
            said = "".join(t for r, t in own if r == "assistant")
            shown = sum(len(chat_format.escape(r)) + len(chat_format.escape(t)) + 19 for r, t in own)
            want[c] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(said), sha(said), shown)
    for piece_ids in (100, 10**6):
        pieces, path = chats(spark, TALKS, piece_ids=piece_ids)
        got = {r[0]: tuple(r[1:]) for r in chat_format.digests(pieces, path).collect()}
        assert got.pop(2)[0] == 2
        assert got == want
    pieces, path = chats(spark, TALKS[:0])
    assert chat_format.digests(pieces, path).collect() == [] and chat_format.read_chats(pieces, path).collect() == []


def test_a_broken_template_is_an_error():
    vocabulary = [b"a"]
    ids = np.array([1, 0, 2, 0, 3], "<u4")
    mask = bytes([0, 0, 0, 1, 0])
    assert list(chat_format.read_turns(ids.tobytes(), mask, vocabulary)) == [("a", "a", True, 21)]
    for bad_ids, bad_mask in ((ids[:-1], mask[:-1]), (ids[[0, 1, 3, 2, 4]], mask), (ids, bytes([0, 1, 0, 1, 0]))):
        with pytest.raises(ValueError):
            list(chat_format.read_turns(bad_ids.tobytes(), bad_mask, vocabulary))


@needs_data
def test_chat_format_equals_its_sql(spark):
    check_sql(spark, chat_format, "op12_chat_format")


# Periodic runs


def brute_runs(w, low):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= low and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


words = st.one_of(st.lists(st.integers(0, 2), max_size=40), st.tuples(st.lists(st.integers(0, 3), max_size=6), st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 6)).map(lambda t: t[0] + t[1] * t[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(words, min_size=1, max_size=5), st.sampled_from([2, 12]))
def test_runs_against_brute_force(many, low):
    got = runs.find_runs([np.array(w, np.int64) for w in many], low)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(w, low) for w in many]


def test_runs_of_long_texts():
    (got,) = runs.find_runs([np.zeros(50_000, np.int64)])
    assert got.tolist() == [[0, 50_000, 1]]
    w = np.arange(30_000) % 7001
    (got,) = runs.find_runs([w])
    assert got.tolist() == [[0, 30_000, 7001]]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest_row(doc_id, text):
    w = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute_runs(w, 12)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@needs_data
def test_periodic_runs_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 1500]
    got = {r["doc_id"]: tuple(r) for r in runs.op13_periodic_runs(spark, DATA).collect()}
    assert len(docs) > 150 and {i: got[i] for i, _ in docs} == {i: digest_row(i, t) for i, t in docs}
    assert sum(got[i][1] > 0 for i, _ in docs) > 10


def test_periodic_runs_edges(spark, edge):
    got = runs.periodic_runs(edge).collect()
    by_text = {t: r for r, (_, t, _) in zip(got, EDGE, strict=True)}
    assert [r["doc_id"] for r in got] == [i for i, _, _ in EDGE]
    assert by_text["word " * 30_000]["collapsed"] == "word" and [tuple(r) for r in by_text["word " * 30_000]["runs"]] == [(0, 30_000, 1)]
    assert by_text[None]["runs"] == [] and by_text[None]["collapsed"] == "" and by_text["   \n\t "]["n_words"] == 0
    assert runs.periodic_runs(edge.limit(0)).collect() == []
    small = runs.periodic_runs(spark.createDataFrame([(1, "a b " * 6 + "c"), (1, "a b " * 6 + "c"), (2, "a b " * 5)], "doc_id long, text string")).collect()
    assert [(r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in small] == [(13, [(0, 12, 2)], "a b c")] * 2 + [(10, [], "a b " * 4 + "a b")]


def test_small_groups_give_the_same_runs(spark, monkeypatch):
    w = [[(i * i + k) % 5 for i in range(60)] for k in range(20)]
    all_at_once = runs.find_runs([np.array(x) for x in w])
    assert [r.tolist() for r in all_at_once] == [runs.find_runs([np.array(x)])[0].tolist() for x in w]
    assert [b - a for a, b in runs._groups([[1] * n for n in (3, 9, 1, 1, 5)], 5)] == [1, 1, 2, 1]
