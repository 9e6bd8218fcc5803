"""The training-data operators: against brute force, exact round trips, held-out accuracy, and edge cases."""

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import (
    byte_bpe,
    components,
    embedding_dedup,
    ngram_join,
    order_minhash,
    packing,
    pii,
    secret_scans,
    token_files,
    tokenization,
    toxicity,
    url_filters,
)
from plumbline.llm.common import shared_dir

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")

#: Nulls, empty and very long texts, repeated rows, shared ids, and columns with names the operators use inside.
EDGE = [
    (None, None, 1),
    (1, "", 2),
    (1, "", 2),
    (2, "Call +1 (202) 555-0143 or mail a.b@mail.example.com, 10.0.0.255", 3),
    (3, "word " * 30_000, 4),
    (None, "token = 'abcdefghijkl' and more words of text here", 5),
    (5, "   \n\t ", 6),
    (6, "漢字" * 3000 + " ﬁ İ Σας", 7),
    (7, "You are an idiot, you moron. " * 3, 8),
]
SCHEMA = "doc_id long, text string, key long"


@pytest.fixture()
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumnsRenamed({"key": "component"}).selectExpr("*", "1 AS dst", "'x' AS path", "2 AS part", "3 AS n")


@pytest.fixture()
def empty(edge):
    return edge.limit(0)


def texts():
    part = st.sampled_from(["the ", "Don't", " 's", "\n", "  ", "é²", "漢", "Σ", "\t", "12", "%%%", "<|endoftext|>", "<|startoftext|>", "a_b", "\x1c", "ǅ", "x" * 40, " K", "😀"])
    return st.lists(st.one_of(part, st.text(max_size=5)), max_size=12).map("".join).filter(lambda t: "\ud800" > max(t, default="a") or not any(0xD800 <= ord(c) < 0xE000 for c in t))


def library(name, specials=False):
    """specials: the file as it is loaded; else with the switch that the files' description sets."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    if not specials:
        t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


BYTE, WORD = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
BYTE_SPECIALS, WORD_SPECIALS = library("byte_bpe_50k.json", True), library("word_bpe_49k.json", True)


def test_byte_merges_are_in_id_order():
    assert tokenization.encoder("byte", P.path("byte_bpe_50k.json")).check()


def test_every_piece_of_the_byte_vocabulary_is_reached():
    enc = tokenization.ByteBpe(P.path("byte_bpe_50k.json"))
    whole = [t.decode() for t in enc.ranks if _utf8(t)][:: 7]
    assert [np.frombuffer(r, "<u4").tolist() for r in enc.encode(whole)] == [BYTE(t) for t in whole]


def _utf8(raw):
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


@settings(max_examples=150, deadline=None)
@given(texts())
def test_encoders_equal_the_library(text):
    for kind, name, want, loaded in (("byte", "byte_bpe_50k.json", BYTE, BYTE_SPECIALS), ("word", "word_bpe_49k.json", WORD, WORD_SPECIALS)):
        for specials, ids in ((False, want), (True, loaded)):
            got = tokenization.encoder(kind, P.path(name), specials=specials).encode([text])[0]
            assert np.frombuffer(got, "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", " <|startoftext|> a<|endoftext|>", "Don't <|endoftext|> 's", "x  <|endoftext|>  y", "漢<|startoftext|>é"])
def test_special_tokens_in_texts(text):
    for kind, name, plain, loaded in (("byte", "byte_bpe_50k.json", BYTE, BYTE_SPECIALS), ("word", "word_bpe_49k.json", WORD, WORD_SPECIALS)):
        ids = [np.frombuffer(tokenization.encoder(kind, P.path(name), specials=s).encode([text])[0], "<u4").tolist() for s in (False, True)]
        assert ids == [plain(text), loaded(text)]
        assert kind == "byte" and "<|endoftext|>" not in text or ids[0] != ids[1]


@settings(max_examples=150, deadline=None)
@given(texts())
def test_byte_codec_equals_tiktoken_and_round_trips(text):
    import tiktoken

    global _tik
    if "_tik" not in globals():
        _tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    c = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    raw = c.encode([text])[0]
    assert np.frombuffer(raw, "<u4").tolist() == _tik.encode_ordinary(text)
    assert c.decode(raw) == text.encode()


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError, match="gaps"):
        byte_bpe.model_bytes({b"a": 0, b"b": 2})


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 20)), max_size=60))
def test_bins_keep_every_limit(items):
    rows = np.array([(a, 1, b) for a, b in items], dtype=np.int64).reshape(-1, 3)
    limits = np.array([50, 6, 20])
    bins = packing.pack_vectors(rows, limits)
    assert sorted(itertools.chain(*bins)) == list(range(len(rows)))
    assert all((rows[b].sum(axis=0) <= limits).all() for b in bins)
    # a bin is left only when nothing that comes later fits
    for i, b in enumerate(bins):
        room = limits - rows[b].sum(axis=0)
        assert not any((rows[j] <= room).all() for later in bins[i + 1 :] for j in later)


def check_packing(rows, limits=(packing.MAX_TOKENS, packing.MAX_SEGMENTS, packing.MAX_LOSS)):
    """Gapless sequences within all limits; returns what each holds of tokens, segments and loss-bearing tokens."""
    per_sequence = {}
    for r in rows:
        per_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["loss_tokens"]))
    held = []
    for own in per_sequence.values():
        at = 0
        for offset, length, loss in sorted(own):
            assert offset == at and 0 <= loss < length
            at += length
        held.append((at, len(own), sum(p[2] for p in own)))
        assert all(a <= b for a, b in zip(held[-1], limits, strict=True))
    return held


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(0, 320), st.integers(1, 40), st.integers(0, 40))
def test_cuts_are_as_long_as_the_limits_allow(n, prompt, max_tokens, max_loss):
    at = 0
    for start, length, loss in packing.cuts(n, prompt, max_tokens, max_loss):
        bears = lambda k: sum(i >= prompt and i > start for i in range(start, start + k))  # noqa: B023, E731
        assert start == at and loss == bears(length) <= max_loss and 0 < length <= max_tokens
        assert start + length == n or length == max_tokens or bears(length + 1) > max_loss
        at += length
    assert at == n


def test_each_limit_closes_sequences(spark):
    """With the query's own limits: a sequence is full of tokens, of segments or of loss-bearing tokens, with room in the others."""
    path = P.path("byte_bpe_50k.json")
    line = lambda n: " ".join(["word"] * n)
    # 341 tokens of which 42 bear loss; 5 with 3; 335 with 334
    for text, closed in ((line(299) + "\n" + line(40), 0), ("a\nb c", 1), (line(334), 2)):
        rows = packing.pack_documents(spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").coalesce(1), path).collect()
        (item,) = {(r["length"], 1, r["loss_tokens"]) for r in rows}
        held = sorted(check_packing(rows))
        limits = (packing.MAX_TOKENS, packing.MAX_SEGMENTS, packing.MAX_LOSS)
        fits = [h + i <= m for h, i, m in zip(held[-1], item, limits, strict=True)]
        assert fits == [k != closed for k in range(3)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the test tables are not here")
def test_little_padding(spark):
    held = check_packing(packing.op1_pack_sequences(spark, "/root/testdata/sf0.1").collect())
    padding = 1 - sum(t for t, _, _ in held) / (packing.MAX_TOKENS * len(held))
    print(f"padding {padding:.4f}, full of segments {sum(n == packing.MAX_SEGMENTS for _, n, _ in held)}, of loss {sum(s == packing.MAX_LOSS for _, _, s in held)}, of {len(held)}")
    assert padding < 0.03


def test_packing_edges(spark, edge, empty):
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack_documents(edge, path).collect()
    check_packing(rows)
    want = sorted((str(i), len(BYTE(t or "")) + 1) for i, t, _ in EDGE)
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["doc_tokens"]), 0)
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert sum(got.values()) == sum(n for _, n in want)
    for r in rows:
        if r["doc_id"] == 2:
            ids = np.array(BYTE(EDGE[3][1]) + [0], "<u4")[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_of_conversations(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(1, 400), rng.randint(0, 300)) for i in range(500)] + [(500, 2000, 1), (501, None, None)]
    limits = (512, 4, 300)
    rows = packing.pack_examples(spark.createDataFrame(data, "example_id long, tokens long, loss_tokens long"), limits, window=100).collect()
    assert sorted(r["example_id"] for r in rows) == list(range(502))
    by = {i: (t or 0, n or 0) for i, t, n in data}
    bins = {}
    for r in rows:
        if r["example_id"] == 500:
            assert r["sequence_id"] is None
        else:
            bins.setdefault(r["sequence_id"], []).append(by[r["example_id"]])
    assert all(sum(t for t, _ in b) <= 512 and len(b) <= 4 and sum(n for _, n in b) <= 300 for b in bins.values())


@needs_data
def test_op1_over_its_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = packing.op1_pack_sequences(spark, DATA).collect()
    check_packing(rows)
    own = {}
    for r in rows:
        ids = BYTE(docs[r["doc_id"]]) + [0]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        own.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, text in docs.items():
        at = 0
        for start, length in sorted(own[i]):
            assert start == at
            at += length
        assert at == len(BYTE(text)) + 1


# Token files


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=200))
def test_perfect_hash_is_minimal(keys):
    prints = token_files.mix64(np.array(keys, dtype=np.int64).view(np.uint64))
    slots = token_files.PerfectHash.build(prints).slots(prints)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_index_tells_absent_keys():
    keys = np.arange(0, 10_000, 2)
    index = token_files.ShardIndex.build(keys, 0, np.arange(len(keys) + 1))
    first, run = index.find(np.arange(10_000))
    assert (run[::2] == 1).all() and (first[::2] == np.arange(5000)).all() and not run[1::2].any()


def test_token_files(spark, edge, empty):
    path = P.path("word_bpe_49k.json")
    for id_bytes, shards in ((2, 3), (4, 1)):
        m = token_files.write_shards(edge, shared_dir(spark, "t"), "word", path, end_id=2, shards=shards, id_bytes=id_bytes)
        assert token_files.read_manifest(m["folder"])["ids"] == m["ids"]
        got = sorted(((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in token_files.read_records(edge.select("doc_id"), m).collect()))
        at, want = 0, []
        order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0))
        assert [g[3] for g in got] == [r[0] for r in order]
        digests = {}
        for i, t, _ in EDGE:
            ids = [*WORD(t or ""), 2]
            digests.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        for start, n, crc, i in got:
            assert start == at and (n, crc) in digests[i]
            at += n
            want.append(n)
        assert at == m["ids"]
    none = token_files.write_shards(empty, shared_dir(spark, "t"), "word", path, end_id=2)
    assert none["shards"] == [] and token_files.read_records(empty.select("doc_id"), none).count() == 0
    missing = spark.createDataFrame([(99,)], "doc_id long")
    assert token_files.read_records(missing, m).count() == 0


def test_one_key_does_not_fill_a_shard(spark):
    rows = spark.createDataFrame([(7 if i % 3 else i, "same text" if i % 3 else str(i)) for i in range(3000)], "doc_id long, text string").repartition(4)
    m = token_files.write_shards(rows, shared_dir(spark, "t"), "word", P.path("word_bpe_49k.json"), end_id=2, shards=6)
    assert max(s["records"] for s in m["shards"]) < 1000
    got = token_files.read_records(rows.select("doc_id"), m).collect()
    assert len(got) == 3000 and sum(r["doc_id"] == 7 for r in got) == 2000
    assert sorted(r["start"] for r in got) == np.cumsum([0, *(r["n_tokens"] for r in sorted(got, key=lambda r: r["start"]))]).tolist()[:-1]


@needs_data
def test_op2_over_its_table(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = sorted(token_files.op2_token_shards(spark, DATA).collect(), key=lambda r: r["doc_id"])
    at = 0
    for (i, t), r in zip(docs, got, strict=True):
        ids = [*WORD(t), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_round_trip_edges(spark, edge, empty):
    rows = byte_bpe.round_trip(edge, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = sorted((len(BYTE(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for _, t, _ in EDGE)
    assert sorted((r["n_tokens"], r["decoded_sha256"]) for r in rows) == want
    assert byte_bpe.round_trip(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# Embeddings


def brute_links(x, threshold=0.9):
    n = [np.linalg.norm(v) for v in x]
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if x[i] @ x[j] / (n[i] * n[j]) >= threshold}


def coded(x):
    return embedding_dedup.quantise(embedding_dedup.unit(x))


@pytest.mark.parametrize("near", [0.05, 0.3])
def test_the_screen_is_sure_of_links_only_and_leaves_none_out(near):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16))
    x = centers[rng.integers(0, 20, 700)] + near * rng.normal(size=(700, 16))
    for left, right, want in (
        (coded(x), None, brute_links(x)),
        (coded(x[:300]), coded(x[300:]), {(a, b - 300) for a, b in brute_links(x) if a < 300 <= b}),
    ):
        sure, unsure = set(), set()
        for lo, (i, j), (a, b) in embedding_dedup.screen(left, right):
            sure |= set(zip(i.tolist(), j.tolist(), strict=True))
            unsure |= set(zip((a + lo).tolist(), b.tolist(), strict=True))
        assert sure <= want <= sure | unsure


def test_the_screen_passes_few_pairs():
    x = np.random.default_rng(3).normal(size=(3000, 64))
    x[1000:2000] = x[:1000] + 0.01 * x[2000:]
    passed = sum(len(a) + len(i) for _, (i, _), (a, _) in embedding_dedup.screen(coded(x), None))
    assert 1000 <= passed <= 1200


def test_quantisation_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.standard_cauchy(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embedding_dedup.quantise(x)
    s, e = s.astype(float), e.astype(float)
    approx = (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T
    assert (np.abs(x @ x.T - approx) <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()


def test_forest():
    rng = np.random.default_rng(4)
    f, parent = embedding_dedup.Forest(200), list(range(200))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for _ in range(6):
        i, j = rng.integers(0, 200, (2, 25))
        f.add(i, j)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert f.label.tolist() == [find(a) for a in range(200)]


@pytest.mark.parametrize("tile", [7, 1000])
def test_links_against_brute_force(spark, tile):
    """Links near the threshold, a crowd of near copies, and lengths from 1e-170 to 1e200."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    x = np.concatenate([base[rng.integers(0, 12, 60)] + 0.35 * rng.normal(size=(60, 8)), base[:1] + 0.02 * rng.normal(size=(20, 8))])
    want = brute_links(x)
    scale = np.where(np.arange(80) % 3 == 0, 1e200, np.where(np.arange(80) % 3 == 1, 1e-170, 1.0))
    rows = [(i, (v * c).tolist()) for i, (v, c) in enumerate(zip(x, scale, strict=True))]
    got = embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=tile).collect()
    parent = list(range(80))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in sorted(want):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert len(want) > 200
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum(i in p for p in want), find(i), find(i) == i)


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [2.0, 0.1]), (1, [0.0, 0.0]), (2, None), (4, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
        (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (13, [-1e200, 1e-170]), (14, [5e-324, 2e-323]), (None, [1.0, 0.01]), (12, [0.0, -1.0]), (12, [0.0, -1.0]),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "'a' AS key", "1 AS size")
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_embeddings(df, tile=2).collect()))
    want = {5: (3, 3), 3: (3, 3), 9: (3, 3), -1: (3, 3), 12: (1, 12), 11: (1, 11), 13: (1, 11)}
    for i, n, c, kept in got:
        assert (n, c) == want.get(i, (0, i))
        assert kept == (i == c) or i == -1
    assert len(got) == len(data)
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (None, 3)]
    parent = {v: v for e in edges for v in e if v is not None}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[v] == find(v) for v in got)
    assert {v for v in parent if any(v in e and e[0] != e[1] and None not in e for e in edges)} == set(got)


def test_ties_between_equal_items_go_to_the_first():
    bins = packing.pack_vectors(np.array([[5, 1, 2]] * 5 + [[5, 1, 1]] * 2), np.array([10, 16, 100]))
    assert sorted(sum(bins, [])) == list(range(7)) and all(len(b) <= 2 for b in bins)
    first = [b for b in bins if set(b) <= set(range(5))]
    assert first[0] == [0, 1] and [b[0] for b in first] == sorted(b[0] for b in first)


# Personal data and secrets


def brute_spans(text, patterns):
    out = [(m.start(), order, kind, m.end()) for order, (kind, p, keep) in enumerate(patterns) for m in re.finditer(p, text) if keep(m)]
    return [(a, kind, b) for a, _, kind, b in sorted(out)]


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]
_words = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")) + ")"
SECRETS = [
    ("assign", _words.replace("[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]") + r"""["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", lambda m: len(m["v"]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "22", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "b-", "%", "255", "300.", "\n", "é"]), max_size=30).map("".join))
def test_base_personal_data(text):
    assert pii.base_spans(text) == brute_spans(text, PII)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKen", "api_key", "APIkey", "secret", "=", ":", " ", "'", '"', "AKIA", "A1B2", "abcdef0123", "Z", "ſecret", "9", "AKIA" * 6, "\n", "xyz/+", "é"]), max_size=14).map("".join))
def test_base_secrets(text):
    assert [s for s in secret_scans.find_secrets(text) if s[1] in secret_scans.BASE] == brute_spans(text, SECRETS)


def test_very_long_runs_are_read_once():
    runs = ["1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1" + " " * 300_000, "a@" * 100_000, "1 " * 150_000]
    runs += ["Anna " * 60_000, "A" * 300_000, "Ab-" * 100_000, "1 Ab Cd Ef " * 30_000, "Mr. " * 60_000, "dot at " * 40_000]
    for text in runs:
        pii.candidates(text)
        secret_scans.find_secrets(text)


def test_estimation_recovers_the_labelers():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.8, 0.9, 0.7]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, 0, np.where((rng.random(len(truth)) < r) == truth, 1, 2)) for r in right], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = pii.estimate(patterns, counts.astype(float))
    assert ((p[inverse.ravel()] > 0.5) == truth).mean() > 0.94


def naive_em(votes, rounds=200):
    """The same two-class model over single candidates, with loops and dictionaries."""
    p = [(sum(v == 1 for v in row) + 1) / (sum(v > 0 for v in row) + 2) for row in votes]
    for _ in range(rounds):
        prior = (sum(p) + 1) / (len(p) + 2)
        table = {}
        for j in range(len(votes[0])):
            for y in (0, 1):
                mass = [1.0, 1.0, 1.0]
                for row, q in zip(votes, p, strict=True):
                    mass[row[j]] += q if y else 1 - q
                for v in range(3):
                    table[j, y, v] = mass[v] / sum(mass)
        new = []
        for row in votes:
            like = [1 - prior, prior]
            for j, v in enumerate(row):
                like = [like[y] * table[j, y, v] for y in (0, 1)]
            new.append(like[1] / sum(like))
        done = max(abs(x - y) for x, y in zip(new, p, strict=True)) < 1e-9
        p = new if not done else p
        if done:
            break
    return p


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2)] * 4), min_size=1, max_size=40))
def test_estimation_against_a_naive_one(votes):
    patterns, inverse, counts = np.unique(np.array(votes), axis=0, return_inverse=True, return_counts=True)
    got = pii.estimate(patterns, counts.astype(float))[inverse.ravel()]
    assert np.allclose(got, naive_em(votes), atol=1e-6)


def test_the_logistic_fit_is_the_optimum():
    rng = np.random.default_rng(9)
    x, target, weight = rng.integers(0, 2, (300, 7)).astype(float), rng.random(300), rng.random(300) * 5
    beta = pii.fit_logistic(x, target, weight, ridge=0.5)
    z = np.hstack([np.ones((300, 1)), x])
    p = 1 / (1 + np.exp(-z @ beta))
    assert np.abs(z.T @ (weight * (target - p)) - 0.5 * beta).max() < 1e-6


ALL = pii.Classifier(99.0, (0.0,) * len(pii.ORDER), tuple((0.0,) * n for n in pii.FEATURES.values()))
PERSONAL = [
    "Dear John Smith, your new address is 12 Baker Street, London. Regards, Mary Jones",
    "Frau Müller wohnt in der Hauptstraße 5, 10115 Berlin, und Herr Hans Peter Klein in Hamburg",
    "Je m'appelle Claire Dubois, 14 rue de la Paix, 75002 Paris, contact: call (212) 555-0101",
    "Me llamo María García. Dirección: Calle de Alcalá 45, Madrid, cuenta ES91 2100 0418 4502 0005 1332",
    "order no. 555-123-4567 of version 3, chapter 078-05-1120, Thomas Jefferson University, Martin Martin Martin",
    "The Apache License. General Public License. SSN 078-05-1120, write to jane at example dot com",
]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (PERSONAL[0], [("name", "John Smith"), ("street", "12 Baker Street"), ("name", "Mary Jones")]),
        (PERSONAL[1], [("name", "Müller"), ("street", "Hauptstraße 5"), ("name", "Hans Peter Klein")]),
        (PERSONAL[2], [("name", "Claire Dubois"), ("street", "14 rue de la Paix"), ("phone_plain", "(212) 555-0101")]),
        (PERSONAL[3], [("name", "María García"), ("street", "Calle de Alcalá 45"), ("iban", "ES91 2100 0418 4502 0005 1332")]),
        ("The Apache License. General Public License. Der Der Der Und", []),
    ],
)
def test_wide_candidates(text, want):
    assert sorted((a, k, text[a:b]) for k, a, b, *_ in pii.candidates(text)[1]) == sorted((text.index(x), k, x) for k, x in want)


def test_labelers_look_things_up_in_the_given_lists():
    own = pii.Gazetteers(given_names=frozenset(["Zyx"]))
    assert not pii.candidates("then Zyx Wvu came")[1] and [c[0] for c in pii.candidates("then Zyx Wvu came", own)[1]] == ["name"]


def test_all_spans_against_a_plain_computation(spark):
    """Votes, weighing, classifier and spans of whole texts, computed one candidate at a time."""
    texts = [t for k, t in enumerate(PERSONAL) for _ in range(k + 1)] + [t for _, t, _ in EDGE] + ["mail x.y@z.org or +49 (30) 1234567 from 10.0.0.1"] * 3
    found = [pii.candidates(t or "")[1] for t in texts]
    flat = [c for own in found for c in own]
    p = naive_em([[c[3] // 3**i % 3 for i in range(len(pii.LABELERS))] for c in flat])
    mean = {}
    for c, q in zip(flat, p, strict=True):
        mean.setdefault((c[0], c[4]), []).append(q)
    keys = sorted(mean)
    rows = []
    for kind, look in keys:
        row = [float(kind == k) for k in pii.ORDER]
        rest, digits = look, []
        for n in reversed(pii.FEATURES.values()):
            rest, v = divmod(rest, n)
            digits.insert(0, [float(v == i) for i in range(n)])
        rows.append(row + [x for d in digits for x in d])
    beta = pii.fit_logistic(np.array(rows), np.array([np.mean(mean[k]) for k in keys]), np.array([np.log1p(len(mean[k])) for k in keys]))
    score = dict(zip(keys, (beta[0] + np.array(rows) @ beta[1:]).tolist(), strict=True))
    assert min(abs(v) for v in score.values()) > 1e-6
    order = list(pii.ORDER)
    want = sorted(
        ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, order.index(k), b, k) for k, a, b, _, look in own if k in pii.BASE or score[k, look] >= 0)) for own in found
    )
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["spans"] for r in pii.detect(df).collect()) == want
    learned = pii.fit(pii.extract(df))
    assert all(learned.accepts(k, look) == (k in pii.BASE or score[k, look] >= 0) for k, look in keys)
    assert sorted(r["text"] or "" for r in pii.redact(df).collect()) == sorted(pii.mask_text(t or "", learned) for t in texts)


def test_near_misses_are_candidates_that_labelers_vote_against():
    text = "mail root@localhost, host 300.1.2.3, card 4111 1111 1111 1112, phone +123 4567, real a@b.com"
    base, found = pii.candidates(text)
    assert [text[a:b] for a, _, b in base] == ["a@b.com"]
    assert {c[0]: text[c[1] : c[2]] for c in found if c[0] not in pii.BASE} == {
        "email_like": "root@localhost", "ip_like": "300.1.2.3", "card_like": "4111 1111 1111 1112", "phone_like": "+123 4567"
    }
    assert all(2 in [c[3] // 3**i % 3 for i in range(5)] for c in found if c[0] in pii.NEAR)
    # a number inside a base or a wider span is no near miss of its own
    assert not [c for c in pii.candidates("IBAN DE89 3704 0044 0532 0130 00, +1 (202) 555-0143")[1] if c[0] in pii.NEAR]


def test_classifier_sees_nothing_that_labelers_vote_by():
    """Another checksum, list or context changes votes, not what the classifier sees."""
    for a, b in (("4111 1111 1111 1112", "4111 1111 1111 1113"), ("see (212) 555-0101", "see (012) 555-0101")):
        (x,), (y,) = ([c for c in pii.candidates(f"then {t} came")[1]] for t in (a, b))
        assert x[3] != y[3] or x[0] == "card_like"
        assert x[4] == y[4]
    near, far = (pii.candidates(f"{w} his own thing is (212) 555-0101 now")[1][0] for w in ("call", "order"))
    assert near[3] != far[3] and near[4] == far[4]


def planted_personal(rng, n):
    """Texts with personal data and look-alikes, and the spans that are personal."""
    pick = lambda x: x[rng.integers(len(x))]
    d = lambda k, low=0: "".join(str(rng.integers(low if i == 0 else 0, 10)) for i in range(k))
    given, family = ["Anna", "Peter", "María", "John", "Claire"], ["Berg", "Miller", "Garza", "Stone", "Dubois"]

    def iban():
        body = f"{d(4, 1)}{d(4)}{d(4)}{d(4)}{d(2)}"
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        s = f"DE{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def bad_card():
        while pii.luhn(s := d(16, 1)):
            pass
        return s

    yes = [
        ("name", lambda: ("my name is ", f"{pick(given)} {pick(family)}")), ("phone_plain", lambda: ("call me at ", f"({rng.integers(2, 10)}{d(2)}) {rng.integers(2, 10)}{d(2)}-{d(4)}")),
        ("iban", lambda: ("my account is ", iban())), ("email_words", lambda: ("write to ", f"{pick(given).lower()}{d(2)} at example dot com")),
        ("id_number", lambda: ("my social number ", f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}")),
    ]
    no = [
        lambda: ("order ", bad_card()), lambda: ("version ", f"{rng.integers(256, 999)}.{d(1)}.{d(2)}.{d(1)}"), lambda: ("commit of ", f"user{d(1)}@host{d(1)}"),
        lambda: ("build ", f"+{d(3, 1)} {d(4)}"), lambda: ("invoice ", bad_card()), lambda: ("serial ", f"+{d(1, 1)}-{d(6)}"),
    ]
    for _ in range(n):
        text, spans = "it is said here that ", []
        for _ in range(3):
            kind, (lead, raw) = (k := pick(yes))[0], k[1]()
            if rng.random() < 0.5:
                kind, (lead, raw) = None, pick(no)()
            text += lead
            if kind:
                spans.append(f"{kind}:{len(text)}:{len(text) + len(raw)}")
            text += raw + " and then some words without anything in them follow here so that nothing is near, "
        yield text, spans


def test_planted_personal_data_is_told_from_look_alikes(spark):
    rows = list(planted_personal(np.random.default_rng(3), 600))
    got = pii.detect(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    found = {(r["doc_id"], s) for r in got for s in r["spans"].split(",") if s and s.split(":")[0] not in pii.BASE}
    want = {(i, s) for i, (_, spans) in enumerate(rows) for s in spans}
    assert len(want) > 700 and len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found)
    others = [c for t, _ in rows for c in pii.candidates(t)[1] if c[0] in pii.NEAR]
    assert len(others) > 600  # look-alikes that were candidates and were turned down


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "double", "int"])
def test_redaction_with_any_kind_of_length(spark, kind):
    rows = spark.createDataFrame([(1, "mail a@b.com now"), (2, "nothing"), (3, None)], "doc_id long, text string").selectExpr("*", f"cast(7 AS {kind}) AS n_chars")
    got = {r["doc_id"]: (r["text"], str(r["n_chars"])) for r in pii.redact(rows).collect()}
    if kind == "string":
        assert got[1] == ("mail [EMAIL] now", "7")
    else:
        assert got[1][0] == "mail [EMAIL] now" and float(got[1][1]) == 16 and float(got[2][1]) == 7


def test_gazetteers_from_a_file(tmp_path):
    path = tmp_path / "lists.json"
    path.write_text('{"given_names": ["Zyx"], "places": ["Wvu Town"]}')
    own = pii.Gazetteers.read(str(path))
    assert own.given_names == {"Zyx"} and own.mail_ends == pii.GAZETTEERS.mail_ends
    assert [c[0] for c in pii.candidates("then Zyx Wvu came", own)[1]] == ["name"]


def test_pii_edges(spark, edge, empty):
    rows = pii.detect(edge).collect()
    assert len(rows) == len(EDGE)
    own = next(r for r in rows if r["doc_id"] == 2)
    assert (own["n_email"], own["n_ip"], own["n_card"], own["n_phone"]) == (1, 1, 0, 1) and own["spans"].startswith("phone:5:")
    assert all(r["spans"] == "" for r in rows if r["doc_id"] in (1, 3, 5, 6, 7))
    assert pii.detect(empty).count() == 0
    done = {r["doc_id"]: r["text"] for r in pii.redact(edge).where("doc_id = 2").collect()}
    assert done[2] == "Call [PHONE] or mail [EMAIL], [IP]"
    assert pii.redact(edge).columns == edge.columns and pii.redact(empty).count() == 0


@pytest.mark.parametrize(
    "text", ["Write to JOHN AT EXAMPLE DOT COM now", "write to john at example Dot com now", "write to john at example\ndot com now", "write to john at example dot\tcom now"]
)
def test_spelled_out_addresses(spark, text):
    want = ("email_words", 9, len(text) - 4)
    assert [c[:3] for c in pii.candidates(text)[1]] == [want]
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(c["kind"], c["start"], c["stop"]) for c in pii.extract(rows).first()["candidates"]] == [want]
    assert pii.mask_text(text, ALL) == text[:9] + "[EMAIL_WORDS]" + text[-4:]


@needs_data
def test_op5_over_its_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in pii.op5_weak_pii(spark, DATA).collect():
        want = brute_spans(docs[r["doc_id"]], PII)
        assert r["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, k, b in want} <= set(r["spans"].split(",")) | {""}


def test_ledger_scans_only_what_is_new(spark, edge, empty, monkeypatch):
    ledger = shared_dir(spark, "ledger")
    rows = secret_scans.scan(edge, ledger).collect()
    assert len(rows) == len(EDGE) and sum(r["n_assign"] for r in rows) == 1
    blobs = len({t or "" for _, t, _ in EDGE})
    assert secret_scans.read_ledger(spark, ledger).count() == blobs
    more = edge.unionByName(edge.limit(1).selectExpr("77L AS doc_id", "'AKIA' || repeat('A', 14) AS text", "component", "dst", "path", "part", "n"))
    again = secret_scans.scan(more, ledger).collect()
    assert len(again) == len(EDGE) + 1 and sum(r["n_access"] for r in again) == 1
    assert secret_scans.read_ledger(spark, ledger).count() == blobs + 1
    for small in (0, 3):  # the other ways to fetch texts
        monkeypatch.setattr(secret_scans, "SMALL", small)
        other = secret_scans.scan(more, shared_dir(spark, "ledger")).collect()
        assert sorted(map(str, other)) == sorted(map(str, again))
    assert secret_scans.scan(empty, ledger).count() == 0


METHOD = [
    ("pem", "-----BEGIN RSA PRIVATE KEY-----"), ("jwt", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"), ("code_host", "ghp_" + "a1B2" * 9), ("chat", "xoxb-0123456789-abc"),
    ("api", "AIza" + "aB3_-" * 7), ("url_login", "://user:secret1@"),
]


@pytest.mark.parametrize(("kind", "secret"), METHOD)
def test_secrets_of_the_method(kind, secret):
    for text in (secret, f"see {secret} here", f"é漢 {secret}", secret + " " + secret):
        own = [s for s in secret_scans.find_secrets(text) if s[1] == kind]
        assert own == [(m.start(), kind, m.end()) for m in re.finditer(re.escape(secret), text)]
    assert not [s for s in secret_scans.find_secrets(secret[:-8]) if s[1] == kind]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*(s for _, s in METHOD), "AKIA", "eyJ", "ghp_", "://", "a:b@", "-----BEGIN ", "PRIVATE KEY-----", "xoxb-", " ", "\n", "0123456789abcdef", "é"]), max_size=8).map("".join))
def test_all_secret_spans_against_plain_searches(text):
    base = [(a, kind, b) for a, kind, b in brute_spans(text, SECRETS)]
    more = [(m.start(), kind, m.end()) for kind, p in secret_scans.EXTRA.items() for m in re.finditer(p.pattern, text)]
    order = list(secret_scans.ORDER)
    assert secret_scans.find_secrets(text) == sorted(base + more, key=lambda s: (s[0], order.index(s[1]), s[2]))


def test_a_pair_that_is_twice_in_the_ledger_counts_once(spark, edge):
    ledger = shared_dir(spark, "ledger")
    want = sorted(map(str, secret_scans.scan(edge, ledger).collect()))
    spark.read.schema(secret_scans.ROW).parquet(ledger).write.mode("append").parquet(ledger)  # as a second scan at the same time
    files = len(spark.read.parquet(ledger).inputFiles())
    assert sorted(map(str, secret_scans.scan(edge, ledger).collect())) == want
    assert len(spark.read.parquet(ledger).inputFiles()) == files  # a scan of nothing new adds no file


@needs_data
def test_op9_over_its_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in secret_scans.op9_secret_ledger(spark, DATA).collect():
        want = brute_spans(docs[r["doc_id"]], SECRETS)
        assert r["base_sha256"] == hashlib.sha256(secret_scans.joined(want).encode()).hexdigest()


# Fingerprints


def test_fingerprints_follow_edits(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    s = order_minhash.Sketcher()
    base = s.sketch(" ".join(words))
    one = s.sketch(" ".join([*words[:300], "changed", *words[301:]]))
    moved = s.sketch(" ".join([*words[300:], *words[:300]]))
    assert order_minhash.likeness(base, base) == 1
    assert order_minhash.likeness(base, one) > 0.9
    assert 0.3 < order_minhash.likeness(base, moved) < 0.75  # the same content in another order
    assert order_minhash.likeness(base, s.sketch(" ".join(reversed(words)))) < 0.05
    many = ["a", "b"] * 20_000
    assert (s.sketch(" ".join(many)) == s.sketch(" ".join(many))).all()


def plain_sketch(text):
    """Order MinHash one sketch and one element at a time, with integers; only the hash functions are the operator's."""
    m32, m64 = 2**32 - 1, 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & m64
        x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & m64
        return x ^ (x >> 33)

    def word(w):
        raw = w.encode()
        return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], len(raw)) | 1

    words = []
    for w in text.split():
        words += [w] if len(w) <= order_minhash.LONG else [w[i : i + order_minhash.PIECE] for i in range(0, len(w), order_minhash.PIECE)]
    k = order_minhash.K
    spans = [words[i : i + k] for i in range(max(1, len(words) - k + 1))] if words else []
    weights = [int(w) for w in order_minhash._weights]
    kmers = [mix(sum(word(w) * c for w, c in zip(s, weights, strict=False)) & m64) for s in spans]
    seen, elements = {}, []
    for h in kmers:
        n = seen[h] = seen.get(h, -1) + 1
        elements.append(h if not n else mix((h + n * 0x9E3779B97F4A7C15) & m64))
    out = []
    for x, y in zip(order_minhash._xor.ravel().tolist(), order_minhash._mul.ravel().tolist(), strict=True):
        def value(e, x=x, y=y):
            v = ((e >> 32 ^ x) * y) & m32
            return ((v ^ (v >> 15)) * 0x846CA68B) & m32

        chosen = sorted(sorted(range(len(elements)), key=lambda i: (value(elements[i]), i))[: order_minhash.LENGTH])
        h = len(chosen)
        for i in chosen:
            h = mix(((h * 0x9E3779B97F4A7C15) + kmers[i]) & m64)
        out.append((h >> 32) | 1 if chosen else 0)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cd", "é", "漢字" * 30, "x" * 33, "word", "The"]), max_size=40).map(" ".join))
def test_sketches_against_a_plain_one(text):
    assert order_minhash.Sketcher().sketch(text).tolist() == plain_sketch(text)


def test_a_long_sketch_against_a_plain_one():
    rng = random.Random(12)
    text = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(20_000))  # several blocks of columns
    assert order_minhash.Sketcher().sketch(text).tolist() == plain_sketch(text)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_edited_texts(spark, edge, empty, parts):
    rows = order_minhash.fingerprint_edits(edge, parts).collect()
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    assert order_minhash.fingerprint_edits(empty, parts).count() == 0


@needs_data
def test_op6_over_its_table(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = sorted(order_minhash.op6_order_minhash(spark, DATA).collect(), key=lambda r: r["doc_id"])
    s = order_minhash.Sketcher()
    for k, ((i, t), r) in enumerate(zip(docs, got, strict=True)):
        after, h = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        a, b, c = (s.sketch(x) for x in (t, edited, after))
        assert (r["doc_id"], r["edited_sha256"]) == (i, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.tobytes().hex(), b.tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (order_minhash.likeness(a, b), order_minhash.likeness(a, c))


# URLs


@pytest.mark.parametrize(("max_bits", "room"), [(url_filters.MAX_BITS, 2**26), (64, 2**26), (64, 0)])
def test_urls(spark, monkeypatch, max_bits, room):
    """In one cascade, and in several by a hash of the host: broadcast, and by a salted join."""
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", room)
    urls = [
        None, "", "no scheme", "http://A.ORG", "http://a.org/", "https://x.Example.org/es/1?q", "http://example.org/en/1#x", "http://example.org/en/2", "http://com/fr/", "http://a.com/de/x",
        "http://badexample.org/es/", "http://É.net/x", "ftp://net", "http://h.net?x://y", "http://h.net/a", "http://h.net/a", "://", "http://k.net#/fr/",
    ] + [f"http://host{i}.net/p" for i in range(300)] + ["http://" + "a." * 30_000 + "org/" + "x/" * 50_000 + "?" + "q" * 100_000, "http://" + "b" * 200_000]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS level")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(rows, url_filters.stand_in_list, max_bits=max_bits).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups() if rest is not None else ("", "")
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fit = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        listed = host != "" and hashlib.sha256(host.encode()).hexdigest()[0] in "0123"
        want = max(fit)[1:] if fit else (None, "block" if listed else "allow")
        assert got[i] == (host, path, *want), u
    assert url_filters.judge_urls(rows.limit(0), url_filters.stand_in_list).count() == 0


def test_cascade_without_listed_keys(spark):
    rows = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    from pyspark.sql import functions as F

    assert url_filters.judge_urls(rows, lambda h: F.lit(False)).first()["verdict"] == "allow"
    assert url_filters.judge_urls(rows, lambda h: F.lit(True)).first()["verdict"] == "block"


# Toxicity


def test_trees_and_calibration():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.2)).astype(float)
    m = toxicity.Trained(x[:3000], y[:3000])
    s = m.score(x[3000:])
    assert ((s > 0.5) == (y[3000:] > 0)).mean() > 0.97
    assert (np.diff(m.calibrated(np.linspace(-5, 5, 99))) >= 0).all()


def plain_trees(x, y, rounds, depth, rate, cuts):
    """Boosting by trying every feature and cut on every node's own rows."""
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best, parts = 1e-9, (rows, rows[:0])
                for j, own in enumerate(cuts):
                    for c in own:
                        a, b = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                        gain = sum(s * g[r].sum() ** 2 / (h[r].sum() + 1) for s, r in ((1, a), (1, b), (-1, rows)))
                        if gain > best + 1e-12:
                            best, parts = gain, (a, b)
                below += parts
            nodes = below
        for rows in nodes:
            score[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
    return score


def test_trees_against_every_split():
    from plumbline.llm import boosting

    rng = np.random.default_rng(13)
    x = rng.integers(0, 6, (150, 4)).astype(float) + np.array([0, 10, 20, 30])
    y = (rng.random(150) < 1 / (1 + np.exp(-(x[:, 0] - 2.5) * (x[:, 1] - 12.3)))).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(4)]
    got = boosting.fit_trees(x, y, rounds=6, depth=2, rate=0.3).raw(x)
    assert np.allclose(got, plain_trees(x, y, 6, 2, 0.3, cuts))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=30))
def test_isotonic_fit_against_its_definition(rows):
    """The fitted value is the largest over beginnings of the smallest over ends of the mean between them."""
    from plumbline.llm import boosting

    at = sorted({a for a, _ in rows})
    labels = [[b for a, b in rows if a == x] for x in at]
    mean = lambda i, j: (lambda v: sum(v) / len(v))([b for own in labels[i : j + 1] for b in own])
    want = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    fit = boosting.fit_isotonic(np.array([a for a, _ in rows], float), np.array([b for _, b in rows], float))
    levels = sorted(set(np.round(want, 12)))
    assert np.allclose(fit.to, levels)
    centre = [np.mean([a for a, own, w in zip(at, labels, want, strict=True) for _ in own if round(w, 12) == v]) for v in levels]
    assert np.allclose(fit.at, centre)


def plain_features(text):
    words = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in text.lower().split()]
    hits = [i for i, w in enumerate(words) if w in toxicity.LEXICON]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    gaps = [min(abs(i - j) for j in you) for i in hits] if you else []
    letters = max(1, sum(c.isascii() and c.isalpha() or ord(c) >= 127 for c in text))
    upper = [c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text]
    n = len(words)
    return {
        "words": np.log1p(n), "hits": len(hits), "hit_rate": len(hits) / n, "hit_chars": sum(len(words[i]) for i in hits) / len(text), "distinct_hits": len({words[i] for i in hits}),
        "second": len(you), "second_rate": len(you) / n, "near_hits": sum(g <= toxicity.NEAR for g in gaps), "nearest": min([1000, *gaps]), "upper_rate": sum(upper) / letters,
        "shout_rate": sum(a and b for a, b in zip(upper, upper[1:], strict=False)) / (len(text) - 1) if len(text) > 1 else 0, "bang_rate": text.count("!") / len(text),
        "question_rate": text.count("?") / len(text), "digit_rate": sum(c in "0123456789" for c in text) / len(text), "stretched_rate": sum(bool(re.search(r"([^\W\d_])\1\1", w)) for w in words) / n,
    }


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["you", "idiot", "Idiot!", "MORON", "the", "dein", "1d10t", "so", "stuuupid", "?", "!!", "é", "é漢", "A B", "12", "\n", "word,"]), min_size=1, max_size=25).map(" ".join))
def test_features_against_plain_ones(text):
    if text.split():
        got = dict(zip(toxicity.NAMES, toxicity.Reader({}, 0, 0)(text), strict=True))
        for k, v in plain_features(text).items():
            assert got[k] == pytest.approx(v), k


@needs_data
def test_held_out_labels_change_no_score(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert turned.join(labels.withColumnRenamed("toxic", "was"), "doc_id").where("toxic != was").count() > 5
    a, b = (sorted(map(tuple, toxicity.score_documents(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0), (7, 1), (7, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.score_documents(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert all(r["score"] == 0 for r in toxicity.score_documents(edge, labels.limit(0)).collect())
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.drop_toxic(edge, labels.limit(0)).count() == len(EDGE)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the test tables are not here")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    rank, pos = rows["score"].rank(), rows["toxic"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.97
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.95


# N-gram join


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(b)] = find(a)
    low = {}
    for k, (i, s) in enumerate(sets):
        if i is not None and s:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((str(i), len(s), str(low.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets)))


@pytest.mark.parametrize(
    ("rounds", "hubs", "crowd", "small", "batch", "bucket", "subs", "few"),
    [(ngram_join.ROUNDS, ngram_join.HUBS, ngram_join.CROWD, ngram_join.SMALL, ngram_join.BATCH, ngram_join.BUCKET, 1, 0), (2, 1, 2, 0, 50, 20, 3, ngram_join.FEW_PAIRS)],
)
def test_ngram_join_against_brute_force(spark, monkeypatch, rounds, hubs, crowd, small, batch, bucket, subs, few):
    for name, value in (("FEW_PAIRS", few), ("ROUNDS", rounds), ("HUBS", hubs), ("CROWD", crowd), ("SMALL", small), ("BATCH", batch), ("BUCKET", bucket)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, t) for i, t, _ in EDGE]
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            if rng.random() < 0.5:
                w += passage
            rows.append((len(rows) + 100, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    for _ in range(40):  # chains: each document is near the one before only
        prior = rows[-1][1].split()
        k = rng.randrange(len(prior))
        rows.append((len(rows) + 100, " ".join([*prior[:k], "x" + str(len(rows)), *prior[k + 1 :]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "'k' AS key", "1 AS id", "2 AS h")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.link_documents(df, parts=5, subs=subs).collect())
    assert got == brute_components(rows)
    assert ngram_join.link_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [1, 7, 10**6])
def test_steps_on_pairs_hold_whole_classes(monkeypatch, batch):
    """However few pairs are held at once and however the rows are cut into batches, the sums are the same."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "BATCH", batch)
    rng = random.Random(11)
    rows = [(x, 20, [y, y + 1], [20, 20], [rng.randint(0, 3), 9], [rng.randint(0, 9), rng.randint(0, 9)]) for x in sorted(rng.choices(range(12), k=60)) for y in [rng.randint(20, 24)]]
    names = ["x", "nx", "ys", "ns", "cs"]
    comp = {}
    rows = [(x, nx, ys, ns, [comp.setdefault(y, c) for y, c in zip(ys, cs, strict=True)], n) for x, nx, ys, ns, cs, n in rows]
    total = {}
    for x, _, ys, _, _, n in rows:
        for y, k in zip(ys, n, strict=True):
            total[x, y] = total.get((x, y), 0) + k

    def batches(last):
        for lo in range(0, 60, 13):
            cols = list(zip(*rows[lo : lo + 13], strict=True))
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*names, last])

    found = {(r["x"], r["y"]) for b in ngram_join._summed(batches("parts")) for r in b.to_pylist()}
    linked = {}
    for (x, y), n in sorted(total.items()):
        if 7 * n >= 3 * 40:
            linked.setdefault((x, comp[y]), y)
    assert found == {(x, y) for (x, _), y in linked.items()}
    chosen = {(r["x"], y) for b in ngram_join._chosen(batches("ms")) for r in b.to_pylist() for y in r["ys"]}
    assert chosen == {k for k, n in total.items() if n >= ngram_join._inside(np.int64(20), np.int64(20))}
    cells = [(h, a, b, side, h * 1000 + a * 100 + b * 10 + 10_000 * side + i, 20, h * 7 + i + 50 * side, 1 + i % 2) for h in range(4) for a in range(2) for b in range(2) for side in (0, 1) for i in range(3)]
    fields = ["h", "a", "b", "side", "cid", "n", "component", "members"]
    cut = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cells[lo : lo + 5], strict=True)], names=fields) for lo in range(0, len(cells), 5)]
    got = sorted((r["x"], y, m) for b in ngram_join._match(cut) for r in b.to_pylist() for y, m in zip(r["ys"], r["ms"], strict=True))
    want = sorted((p[4], q[4], 1) for p in cells for q in cells if p[:3] == q[:3] and p[3] == 0 and q[3] == 1 and (p[7], p[6]) < (q[7], q[6]))
    assert got == want


def test_a_fragment_is_counted_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(14)
    own = rng.integers(0, 40, (5, 300)).astype("<u2")
    own[rng.random(own.shape) < 0.1] = ngram_join._NOBODY
    low = rng.integers(0, 600, (5, 300)).astype("<u4")
    names = [np.arange(40, dtype="<i8") * 3 + i for i in range(5)]
    rows = [(0, 0, 2, names[i].tobytes(), low[i].tobytes(), own[i].tobytes()) for i in range(5)]
    want = None
    for piece in (10**6, 700, 10):
        monkeypatch.setattr(ngram_join, "PIECE", piece)
        (found,) = ngram_join._count(3)([ngram_join._blocks(rows[:2]), ngram_join._blocks(rows[2:])])
        assert found.column("dst").to_pylist() == [0, 1, 2]
        blocks = pa.RecordBatch.from_arrays([found.column("names"), found.column("counts")], names=["names", "counts"])
        monkeypatch.setattr(ngram_join, "SUMMED_AT_ONCE", piece)
        twice = list(ngram_join._sums([blocks, blocks]))  # as of two fragments
        got = {r["id"]: r["shared"] // 2 for b in twice for r in b.to_pylist()}
        want = want or got
        assert got == want and len(got) > 100
    held = {}
    for i in range(5):
        for value, o in zip(low[i].tolist(), own[i].tolist(), strict=True):
            held.setdefault(value, []).append(-1 if o == ngram_join._NOBODY else int(names[i][o]))
    plain = {}
    for own in held.values():
        if len(set(own)) > 1:
            for o in own:
                if o >= 0:
                    plain[o] = plain.get(o, 0) + 1
    assert got == plain and isinstance(found, pa.RecordBatch)
    nobody = np.full(3, ngram_join._NOBODY, "<u2").tobytes()
    assert list(ngram_join._count(1)([ngram_join._blocks([(0, 0, 2, b"", low[0][:3].tobytes(), nobody)])])) == []


def test_fragments_follow_the_bytes(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "é" * 500)] * 10, "doc_id long, text string")  # 10,000 bytes
    assert ngram_join.fragments(rows) == (4, 1) and ngram_join.fragments(rows.limit(0)) == (4, 1)
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", 1000)
    assert ngram_join.fragments(rows) == (10, 1)
    monkeypatch.setattr(ngram_join, "MAX_PARTS", 5)
    assert ngram_join.fragments(rows) == (5, 2)
    monkeypatch.setattr(ngram_join, "MAX_FRAGMENTS", 7)
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", 1)
    assert ngram_join.fragments(rows) == (5, 2)


@needs_data
def test_op10_over_its_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.op10_ngram_join(spark, DATA).collect())
    assert got == brute_components(docs)


def test_one_of_each_group_stays(spark, edge, empty):
    rows = [
        (1, "a b c d e f", 9), (1, "a b c d e f", 8), (None, "a b c d e f", 7), (None, "z y", 1), (None, "z y", 2), (3, "", 1), (3, "", 1), (None, None, 5),
        (5, "q w e r t y u", 1), (5, "other text here now ok yes", 2), (6, "q w e r t y u", 3), (7, "all of these words are mine", 4),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in ngram_join.keep_one(df).collect())
    assert got == sorted(
        [("1", "a b c d e f"), ("None", "z y"), ("3", ""), ("3", ""), ("None", "None"), ("5", "q w e r t y u"), ("5", "other text here now ok yes"), ("7", "all of these words are mine")]
    )
    assert ngram_join.keep_one(edge).columns == edge.columns and ngram_join.keep_one(empty).count() == 0
    assert sorted(len(r["text"] or "") for r in ngram_join.keep_one(edge).collect()) == sorted(len(t or "") for _, t, _ in EDGE)  # whole texts, and none is a copy


# Registration and the pipeline


def test_registry():
    from plumbline import llm

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.QUERIES) == list(range(1, 11))
    assert set(llm.ORACLES) <= set(llm.QUERIES)


@needs_data
@pytest.mark.parametrize("name", ["op4_int8_links", "op7_url_cascade", "op10_ngram_join"])
def test_queries_with_sql(spark, name):
    import duckdb

    from plumbline import llm

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    want = con.execute(llm.ORACLES[name]).df()
    got = llm.QUERIES[name](spark, DATA).select(*want.columns).toPandas()
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
    assert plain(got) == plain(want)


@needs_data
def test_pipeline(spark):
    import corpus_pipeline as c

    docs = c.table(spark, DATA, "documents")
    columns, seen = docs.columns, {}
    for name, stage in c.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = c.stored(stage(spark, docs, DATA), shared_dir(spark, name))
        if name != "packing":
            assert out.columns == columns
            after = {r["doc_id"]: r for r in out.collect()}
            assert set(after) <= set(before)
        if name == "toxicity":
            rejected = {r["doc_id"] for r in toxicity.score_documents(docs, c.table(spark, DATA, "labels")).where("predicted = 1").collect()}
            assert set(before) - set(after) == rejected and after == {i: r for i, r in before.items() if i in after}
        elif name == "ngram_jaccard":
            groups = brute_components([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {int(i) for i, _, g in groups if i == g}
        elif name == "pii":
            assert set(after) == set(before)
            for i, r in after.items():
                assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
                if not pii.candidates(before[i]["text"])[1]:
                    assert r == before[i]
        else:
            check_packing(out.collect())
            assert {r["doc_id"] for r in out.collect()} == set(before)
        seen[name], docs = out.count(), out
    assert c.run(spark, DATA).count() == seen["packing"]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0


def test_list_lengths_in_a_fresh_interpreter():
    """A worker that only unpickled a function has loaded no more of pyarrow than the module asks for."""
    code = (
        "import pyarrow as pa; from plumbline.llm.ngram_join import _needed, _overlaps; "
        "rows = pa.RecordBatch.from_pydict({'x': [1], 'nx': [5], 'ys': [[2, 3]], 'ns': [[5, 5]], 'cs': [[2, 3]], 'bucket': [0]}); "
        "print(next(_needed([rows])).column(0).to_pylist()); "
        "none = pa.array([None], pa.binary()); "
        "print(_overlaps(pa.table({'cell': [0], 'x': [1], 'nx': [5], 'ys': [[2]], 'ns': [[5]], 'cs': [[2]], 'cids': none, 'sizes': none, 'hashes': none})).num_rows)"
    )
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split("\n")[:2] == ["[1, 2, 3]", "0"]
