"""The two seams where Python is needed: embedding and generation, as callables of the user.

An embedder maps (list of texts, kind) to vectors of one length, in order; a generator maps
(system prompt, user prompt) to a text. Executors call them and append the replies to a ledger
(``sources.ledger``), so one text is embedded once and one prompt asked once, also by a task that
runs again, and a run that is given the ledger of another asks only for what that lacks.
``http_embedder`` and ``http_generator`` are such callables over HTTP, from settings.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.policy import HASH_DIMENSIONS
from plumbline.sources.environment import resolve_keys
from plumbline.sources.ledger import ask_once, read
from plumbline.sources.shared import shared_dir

Embed = Callable[[list[str], str], Sequence[Sequence[float]]]
Generate = Callable[[str, str], str]


class EmbeddingError(RuntimeError):
    """kind: transport, http-status, malformed-response or vector-count-mismatch."""

    def __init__(self, kind: str, message: str, status: int | None = None):
        super().__init__(message)
        self.kind, self.status = kind, status

    def __reduce__(self):
        return type(self), (self.kind, str(self), self.status)


class GenerationError(RuntimeError):
    """kind: transport, model-refusal, truncated or empty-response. usage: what a reply used that is then refused."""

    def __init__(self, kind: str, message: str, status: int | None = None, usage: dict | None = None):
        super().__init__(message)
        self.kind, self.status, self.usage = kind, status, usage or {}

    def __reduce__(self):
        return type(self), (self.kind, str(self), self.status, self.usage)


class TransportError(RuntimeError):
    """A request that got no answer. It names neither the request nor its headers, which hold a key."""


@dataclass
class JsonPost:
    """POST of a JSON body; returns (status, parsed body), the body None where it is no JSON.

    The key goes into the bearer header and nowhere else; further headers are the service's own.
    ``timeout`` (seconds) bounds connecting and each read. A plain object, so that executors get it
    as it is.
    """

    url: str
    key: str = field(repr=False)
    headers: dict[str, str] = field(default_factory=dict, repr=False)
    timeout: float = 60.0

    def __call__(self, body: dict) -> tuple[int, object]:
        head = {"authorization": f"Bearer {self.key}", "content-type": "application/json", **self.headers}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), head, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                status, raw = answer.status, answer.read()
        except urllib.error.HTTPError as e:  # its body is not ours and may echo the request
            return e.code, None
        except (OSError, http.client.HTTPException, ValueError):
            raise TransportError("the request could not be completed") from None
        try:
            return status, json.loads(raw)
        except ValueError:
            return status, None


def read_embedding_response(body: object, n: int) -> tuple[list[list[float]], int]:
    """Vectors in input order and the used tokens, from a provider's ``{"data": [...], "usage": ...}``.

    Entries are put in order by their index; a missing, repeated or foreign index, a wrong count
    and a value that is no finite number are errors. A missing usage counts as 0.
    """
    data = body.get("data") if isinstance(body, dict) else None
    if not isinstance(data, list):
        raise EmbeddingError("malformed-response", "the response has no list of embeddings")
    if len(data) != n:
        raise EmbeddingError("vector-count-mismatch", f"expected {n} embeddings, got {len(data)}")
    out: list[list[float] | None] = [None] * n
    for entry in data:
        i, vector = (entry.get("index"), entry.get("embedding")) if isinstance(entry, dict) else (None, None)
        if not isinstance(i, int) or isinstance(i, bool) or not 0 <= i < n or out[i] is not None:
            raise EmbeddingError("malformed-response", "an index is missing, repeated or out of range")
        good = isinstance(vector, list) and all(isinstance(x, int | float) and not isinstance(x, bool) and np.isfinite(x) for x in vector)
        if not good:
            raise EmbeddingError("malformed-response", f"embedding {i} is not a list of finite numbers")
        out[i] = [float(x) for x in vector]
    usage = body.get("usage")
    tokens = usage.get("total_tokens") if isinstance(usage, dict) else None
    return out, _count(tokens)


def _count(v: object) -> int:
    """A number of tokens from a reply: 5 and 5.0 are 5; anything else counts as 0."""
    return int(v) if isinstance(v, int | float) and not isinstance(v, bool) and np.isfinite(v) else 0


@dataclass
class HttpEmbedder:
    """Embedder over HTTP; ``post`` (a JsonPost, say) sends a JSON body and returns (status, parsed body)."""

    post: Callable[[dict], tuple[int, object]]
    model: str

    def __call__(self, texts: list[str], kind: str) -> list[list[float]]:
        return self.with_usage(texts, kind)[0]

    def with_usage(self, texts: list[str], kind: str) -> tuple[list[list[float]], dict]:
        """Vectors and a ledger row; no call for no texts; usage counts on success only."""
        if not texts:
            return [], {"tokens": 0, "calls": 0, "ms": 0}
        began = time.monotonic()
        try:
            status, body = self.post({"input": texts, "model": self.model, "input_type": kind})
        except TransportError:
            raise EmbeddingError("transport", "the embedding request could not be completed") from None
        if not 200 <= status < 300:
            raise EmbeddingError("http-status", f"the embedding service answered with status {status} to {len(texts)} texts", status)
        vectors, tokens = read_embedding_response(body, len(texts))
        return vectors, {"tokens": tokens, "calls": 1, "ms": round((time.monotonic() - began) * 1000)}


@dataclass
class MessageService:
    """``send`` of a MessageGenerator over HTTP: one user message, the reply's text blocks and what was used."""

    post: Callable[[dict], tuple[int, object]]

    def __call__(self, request: dict) -> tuple[str, list[str], dict]:
        body = {k: request[k] for k in ("model", "max_tokens", "system")} | {"messages": [{"role": "user", "content": request["user"]}]}
        status, reply = self.post(body)
        if not 200 <= status < 300:
            raise GenerationError("transport", f"the request failed with status {status}", status)
        if not isinstance(reply, dict) or not isinstance(reply.get("content"), list):
            raise GenerationError("transport", "the reply has no content")
        blocks = [b["text"] for b in reply["content"] if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)]
        usage = reply.get("usage") if isinstance(reply.get("usage"), dict) else {}
        return reply.get("stop_reason") or "", blocks, {k: _count(usage.get(k)) for k in ("input_tokens", "output_tokens")}


@dataclass
class MessageGenerator:
    """Generator over a message service; ``send`` maps a request to (stop reason, text blocks, usage)."""

    send: Callable[[dict], tuple[str, list[str], dict]]
    model: str
    max_tokens: int = 16_000
    together: int = 8  # calls of one task at a time

    def __call__(self, system: str, user: str) -> str:
        return self.with_usage(system, user)[0]

    def with_usage(self, system: str, user: str) -> tuple[str, dict]:
        began = time.monotonic()
        try:
            stop, blocks, usage = self.send({"model": self.model, "max_tokens": self.max_tokens, "system": system, "user": user})
        except Exception as e:  # the message may hold a key: only the status goes on
            status = getattr(e, "status", None)
            raise GenerationError("transport", f"the request failed with status {status or 'unknown'}", status) from None
        row = {"input": usage.get("input_tokens", 0), "output": usage.get("output_tokens", 0), "ms": round((time.monotonic() - began) * 1000)}
        if stop in ("refusal", "max_tokens"):
            raise GenerationError("model-refusal" if stop == "refusal" else "truncated", f"generation stopped: {stop}", usage=row)
        text = "".join(blocks)
        if not text.strip():
            raise GenerationError("empty-response", "the model returned no text", usage=row)
        return text, row


def _service(prefix: str, env: Mapping[str, str]) -> tuple[JsonPost, str]:
    names = [f"{prefix}_URL", f"{prefix}_KEY", f"{prefix}_MODEL"]
    values, problems = resolve_keys(names, env)
    if problems:
        raise ValueError("; ".join(problems))
    url, key, model = (values[n] for n in names)
    headers = json.loads((env.get(f"{prefix}_HEADERS") or "").strip() or "{}")
    return JsonPost(url, key, headers, float((env.get(f"{prefix}_TIMEOUT") or "").strip() or 60)), model


def http_embedder(env: Mapping[str, str]) -> HttpEmbedder:
    """From PLUMBLINE_EMBEDDING_URL, _KEY and _MODEL, and perhaps _HEADERS (a JSON object) and _TIMEOUT (seconds)."""
    return HttpEmbedder(*_service("PLUMBLINE_EMBEDDING", env))


def http_generator(env: Mapping[str, str]) -> MessageGenerator:
    """From PLUMBLINE_GENERATION_URL, _KEY and _MODEL, and perhaps _HEADERS (a JSON object) and _TIMEOUT (seconds)."""
    post, model = _service("PLUMBLINE_GENERATION", env)
    return MessageGenerator(MessageService(post), model)


def model_name(part) -> str | None:
    """Of an embedder or generator: its model, or what it is called; never a key."""
    return part and (getattr(part, "model", None) or getattr(part, "__name__", None) or type(part).__name__)


#: Texts and characters of one embedding call at most, and prompts whose replies are appended together.
TEXTS_PER_CALL, CHARACTERS_PER_CALL, PROMPTS_PER_APPEND = 128, 200_000, 16
_VECTORS = pa.schema([("vector", pa.list_(pa.float64())), ("tokens", pa.int64()), ("ms", pa.int64())])
_REPLIES = pa.schema([("raw", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("ms", pa.int64())])


def _failure(e: Exception) -> dict:
    """An error as a row; an unknown one is only named, since its message may hold a key."""
    known = isinstance(e, EmbeddingError | GenerationError)
    return {"problem": e.kind if known else "error", "message": str(e) if known else f"the call failed: {type(e).__name__}"}


def _with_replies(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """``keyed`` (with _key) with _reply, a struct of the reply's columns."""
    return keyed.join(found.select(F.col("key").alias("_key"), F.struct("*").alias("_reply")), "_key")


def _used(column: str) -> Column:
    """What a call used, on one row of its key and only if this run made it."""
    one = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1))) == 1
    return F.when(one & F.col("_reply.new"), F.col(f"_reply.{column}")).otherwise(0)


def embed_with_usage(rows: DataFrame, text: str, embedder: Embed, kind: str, ledger: str | None = None, texts_per_call: int = TEXTS_PER_CALL, characters_per_call: int = CHARACTERS_PER_CALL) -> DataFrame:
    """``rows`` with ``vector`` (array of doubles), and the tokens and ms of each call of this run on one of its rows, 0 on the others.

    Each distinct text (null as empty) is sent once, for a model and kind of it, in calls of at
    most so many texts and characters; one longer text is a call of its own. ledger: the folder of
    vectors to read and add to (default: a fresh one in the shared folder). An embedder without
    ``with_usage`` counts as using nothing; one that is ``free`` has no ledger and runs where the rows are.
    """
    if getattr(embedder, "free", False):
        zero = F.lit(0).cast("long")
        return _embed_in_place(rows, text, embedder, kind).withColumns({"embedding_tokens": zero, "embedding_ms": zero})

    def call(requests: list[dict]) -> list[dict]:
        texts = [r["text"] for r in requests]
        try:
            told = getattr(embedder, "with_usage", None)
            vectors, used = told(texts, kind) if told else (embedder(texts, kind), {})
            if len(vectors) != len(texts):
                raise EmbeddingError("vector-count-mismatch", f"expected {len(texts)} embeddings, got {len(vectors)}")
            out = [{"vector": list(map(float, v)), "tokens": 0, "ms": 0} for v in vectors]
            out[0] |= {k: used.get(k, 0) for k in ("tokens", "ms")}
            return out
        except Exception as e:
            return [_failure(e) for _ in texts]

    said = F.coalesce(F.col(text), F.lit(""))
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\n", F.lit(model_name(embedder)), F.lit(kind), said), 256))
    folder = ledger or shared_dir(rows.sparkSession, "vectors")
    found = ask_once(keyed.select(F.col("_key").alias("key"), said.alias("text")), folder, _VECTORS, call, texts_per_call, characters_per_call, "text")
    joined = _with_replies(keyed, found)
    return joined.select(*rows.columns, "_reply.vector", _used("tokens").alias("embedding_tokens"), _used("ms").alias("embedding_ms"))


def embed(rows: DataFrame, text: str, embedder: Embed, kind: str, ledger: str | None = None, **limits) -> DataFrame:
    """``rows`` with ``vector``, see ``embed_with_usage``."""
    return embed_with_usage(rows, text, embedder, kind, ledger, **limits).drop("embedding_tokens", "embedding_ms")


def _embed_in_place(rows: DataFrame, text: str, embedder: Embed, kind: str) -> DataFrame:
    import pyspark.sql.types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf[text].tolist()]
            yield pdf.assign(vector=[list(map(float, v)) for v in (embedder(texts, kind) if texts else [])])

    return rows.mapInPandas(run, schema)


def generate(prompts: DataFrame, generator: Generate, ledger: str | None = None) -> DataFrame:
    """question_id, raw, input_tokens, output_tokens and generation_ms of each prompt (question_id, system, user).

    Each distinct prompt is asked once for a model, several at a time if the generator has
    ``together``. ledger: the folder of replies to read and add to (default: a fresh one in the
    shared folder). A reply that is refused, cut or empty fails the run, and its row in the ledger
    has what it used (``generation_usage``); so does any other failure. What an earlier run used
    counts as 0 here, as does a generator without ``with_usage``.
    """
    together = getattr(generator, "together", 1)

    def one(request: dict) -> dict:
        try:
            told = getattr(generator, "with_usage", None)
            raw, used = told(request["system"], request["user"]) if told else (generator(request["system"], request["user"]), {})
            row = {"raw": raw}
        except Exception as e:
            row, used = _failure(e), getattr(e, "usage", {})
        return row | {"input_tokens": used.get("input", 0), "output_tokens": used.get("output", 0), "ms": used.get("ms", 0)}

    def call(requests: list[dict]) -> list[dict]:
        if together < 2 or len(requests) < 2:
            return [one(r) for r in requests]
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(together) as pool:
            return list(pool.map(one, requests))

    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("system", "user")]
    keyed = prompts.withColumn("_key", F.sha2(F.concat_ws("\n", F.lit(model_name(generator)), F.sha2(parts[0], 256), parts[1]), 256))
    folder = ledger or shared_dir(prompts.sparkSession, "replies")
    found = ask_once(keyed.select(F.col("_key").alias("key"), "system", "user"), folder, _REPLIES, call, PROMPTS_PER_APPEND)
    used = [_used(c).alias(to) for c, to in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("ms", "generation_ms"))]
    return _with_replies(keyed.select("question_id", "_key"), found).select("question_id", "_reply.raw", *used)


def generation_usage(spark: SparkSession, ledger: str) -> DataFrame:
    """problem, calls, input_tokens, output_tokens and ms of all calls in a ledger of replies; problem is null for good ones."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "ms")]
    return read(spark, ledger, _REPLIES).groupBy("problem").agg(F.count("*").alias("calls"), *sums)


def fnv1a_of(raw: bytes) -> int:
    """32-bit FNV-1a."""
    h = 2166136261
    for c in raw:
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h


_PRIME, _MASK = np.uint64(16777619), np.uint64(0xFFFFFFFF)
#: FNV-1a after the mark of a token, and after that of a pair of neighbours.
_ONE, _TWO = np.uint64(fnv1a_of(b"1:")), np.uint64(fnv1a_of(b"2:"))


def _hash_on(state: np.ndarray, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """FNV-1a states after the bytes of a token each, all tokens' k-th bytes at once; the last few long tokens one by one."""
    state, live = state.copy(), np.flatnonzero(length > 0)
    k = 0
    while len(live) > 32:
        state[live] = ((state[live] ^ raw[start[live] + k]) * _PRIME) & _MASK
        k += 1
        live = live[length[live] > k]
    for i in live.tolist():
        h = int(state[i])
        for c in raw[start[i] + k : start[i] + length[i]].tolist():
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
        state[i] = h
    return state


def hash_weights(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket, weight) of lower-case UTF-8 texts, in order.

    Term frequencies of tokens (runs of a-z and 0-9) and of neighbours, by FNV-1a modulo 512.
    """
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    word = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, length = edges[::2], edges[1::2] - edges[::2]
    text = np.searchsorted(np.cumsum([1 + len(t) for t in texts]), start, "right")
    big = raw.astype(np.uint64)
    one = _hash_on(np.full(len(start), _ONE), big, start, length)
    first = np.flatnonzero(text[1:] == text[:-1])
    two = _hash_on(np.full(len(first), _TWO), big, start[first], length[first])
    two = _hash_on(((two ^ np.uint64(32)) * _PRIME) & _MASK, big, start[first + 1], length[first + 1])
    at = np.concatenate([text, text[first]]) * HASH_DIMENSIONS + (np.concatenate([one, two]) % np.uint64(HASH_DIMENSIONS)).astype(np.int64)
    found, n = np.unique(at, return_counts=True)
    return found // HASH_DIMENSIONS, found % HASH_DIMENSIONS, n.astype(float)


def hash_embedding(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, weight of the offline lexical embedder for every row, without a shuffle.

    Whole batches of texts are hashed at once; a null or empty text has no buckets. Lower-casing
    is the JVM's.
    """
    import pyspark.sql.types as T

    rows = rows.select(F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("bucket", T.LongType()), T.StructField("weight", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                at, bucket, weight = hash_weights([t.as_buffer().to_pybytes() for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(bucket), pa.array(weight)], names=[key, "bucket", "weight"])

    return rows.mapInArrow(run, schema)


def hash_vector(text: str) -> list[float]:
    """The offline embedder for the callable seam."""
    out = np.zeros(HASH_DIMENSIONS)
    _, bucket, weight = hash_weights([text.lower().encode("utf-8", "surrogatepass")])
    out[bucket] = weight
    return out.tolist()


def hash_embedder(texts: list[str], kind: str) -> list[list[float]]:
    return [hash_vector(t) for t in texts]


hash_embedder.free = True
