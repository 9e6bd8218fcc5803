"""Binary token shards with a minimal perfect hash index from document key to payload.

A shard is two files. ``shard-N.bin`` is nothing but token ids, little-endian unsigned 16- or
32-bit, documents one after the other in ascending key order. ``shard-N.idx`` holds the record
starts, the hash function and its slot table: for each key the 64-bit fingerprint, the first
record and how many records follow under that key. ``manifest.json`` lists the shards in order
with their key ranges and sizes, so that a key costs one search among the shards, one hash and
one read.

The hash function is built level by level: each level is a bit field in which a key owns its bit
if no other key hashes there; the others go on to the next level. A key's slot is the number of
set bits before its own, so n keys have the slots 0 to n-1.

Executors write below a shared folder through Arrow's file systems (file, hdfs, s3, gs). A task
writes under a name of its own attempt and renames at the end, so retries and speculative copies
leave whole files only.
"""

from __future__ import annotations

import io
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, parts_for, shared_dir, shuffle_parts, table
from .tokenization import encoder

LEVELS = 48
MAGIC = b"TOKIDX1\n"
#: Bytes of text that make up a shard, about.
SHARD_BYTES = 2**28
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers: fingerprints of integer keys never collide."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit fingerprints."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, late: np.ndarray):
        self.words, self.sizes, self.late = words, sizes, late
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        self.base = np.concatenate(([0], np.cumsum(sizes)))

    @classmethod
    def build(cls, prints: np.ndarray) -> PerfectHash:
        fields, sizes, rest = [], [], prints
        for level in range(LEVELS):
            if not len(rest):
                break
            m = -(-2 * len(rest) // 64) * 64
            at = cls._at(rest, level, m)
            n = np.bincount(at, minlength=m)
            fields.append(np.packbits(n == 1, bitorder="little").view(np.uint64))
            sizes.append(m)
            rest = rest[n[at] != 1]
        words = np.concatenate(fields) if fields else np.zeros(0, np.uint64)
        return cls(words, np.array(sizes, dtype=np.int64), np.sort(rest))

    @staticmethod
    def _at(prints: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix64(prints ^ np.uint64(level * 0x2545F4914F6CDD1D % 2**64)) % np.uint64(m)).astype(np.int64)

    def slots(self, prints: np.ndarray) -> np.ndarray:
        """Slot of each fingerprint; one that was not built in gets some slot or -1."""
        out = np.full(len(prints), -1, dtype=np.int64)
        todo = np.arange(len(prints))
        for level, m in enumerate(self.sizes.tolist()):
            at = self._at(prints[todo], level, m) + self.base[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            own = (self.words[word] >> bit) & np.uint64(1) == 1
            before = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[own]] = (self.rank[word] + np.bitwise_count(before))[own]
            todo = todo[~own]
        if len(self.late) and len(todo):
            k = np.minimum(np.searchsorted(self.late, prints[todo]), len(self.late) - 1)
            out[todo] = np.where(self.late[k] == prints[todo], self.rank[-1] + k, -1)
        return out


class ShardIndex:
    """Index of one shard: key -> records, by fingerprint check."""

    def __init__(self, starts, nulls, hashed, prints, first, run):
        self.starts, self.nulls, self.hashed = starts, nulls, hashed
        self.prints, self.first, self.run = prints, first, run

    @classmethod
    def build(cls, keys: np.ndarray, nulls: int, starts: np.ndarray) -> ShardIndex:
        """keys: ascending, of the records after the ``nulls`` ones without key."""
        distinct, first, run = np.unique(keys, return_index=True, return_counts=True)
        prints = mix64(distinct.view(np.uint64))
        hashed = PerfectHash.build(prints)
        slot = hashed.slots(prints)
        table = [np.empty_like(x) for x in (prints, first, run)]
        for to, x in zip(table, (prints, first + nulls, run), strict=True):
            to[slot] = x
        return cls(starts, nulls, hashed, *table)

    def save(self, out) -> None:
        out.write(MAGIC)
        h = self.hashed
        for x in (self.starts, np.array([self.nulls]), h.words, h.sizes, h.late, self.prints, self.first, self.run):
            buf = io.BytesIO()
            np.save(buf, x)
            out.write(buf.getvalue())

    @classmethod
    def load(cls, raw: bytes) -> ShardIndex:
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard index")
        buf = io.BytesIO(raw[len(MAGIC) :])
        starts, nulls, words, sizes, late, prints, first, run = (np.load(buf) for _ in range(8))
        return cls(starts, int(nulls[0]), PerfectHash(words, sizes, late), prints, first, run)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records where it is absent."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        prints = mix64(keys.view(np.uint64))
        slot = self.hashed.slots(prints)
        there = (slot >= 0) & (self.prints[slot] == prints)
        return self.first[slot], np.where(there, self.run[slot], 0)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(
    docs: DataFrame, folder: str, kind: str, path: str, end_id: int, shards: int | None = None, id_bytes: int = 2, specials: bool = False
) -> dict:
    """Encode ``docs`` (``doc_id``, ``text``) and write shards below ``folder``; returns the manifest.

    Rows go to shards by ranges of doc_id, nulls first, as many as the session's partitions or as the
    counted bytes ask for; rows with the same doc_id are ordered by
    a hash of their text, which also splits a doc_id that many rows share, and repeated rows, which
    may change places, are split by where they came from. Null text is empty: a
    record of the end id alone. An empty table gives a manifest without shards; texts of any
    length are written whole, and other columns are not looked at. ``specials``: whether strings
    of special tokens in a text give their ids, see ``tokenization``.
    """
    dtype = f"<u{id_bytes}"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        fs, root = _fs(folder)
        name = f"{root}/shard-{part:06d}"
        enc, end = encoder(kind, path, dtype, specials), np.array([end_id], dtype=dtype).tobytes()
        narrow = kind == "byte" and id_bytes < 4  # the byte encoder's ids are 32 bits wide
        keys, lengths, nulls, out = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{name}.bin.{attempt}")
            ids, texts = batch.column(0), batch.column(1)
            nulls += ids.null_count
            keys.append(ids.drop_null().to_numpy(zero_copy_only=False))
            for lo in range(0, batch.num_rows, 500):
                found = enc.encode(texts[lo : lo + 500].to_pylist())
                if narrow:
                    found = [np.frombuffer(raw, "<u4").astype(dtype).tobytes() for raw in found]
                for raw in found:
                    out.write(raw + end)
                lengths.append(np.array([len(raw) // id_bytes + 1 for raw in found], np.int64))
        if out is None:
            return
        out.close()
        keys, lengths = np.concatenate(keys), np.concatenate(lengths)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        with fs.open_output_stream(f"{name}.idx.{attempt}") as f:
            ShardIndex.build(keys, nulls, starts).save(f)
        for end_name in ("bin", "idx"):
            fs.move(f"{name}.{end_name}.{attempt}", f"{name}.{end_name}")
        low, high = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        row = {"shard": part, "records": len(lengths), "nulls": nulls, "ids": int(starts[-1]), "low": low, "high": high}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.int64()) for k in row]))

    rows = id_and_text(docs)
    stats = (
        rows
        .withColumns({"tie": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
        .repartitionByRange(shards or parts_for(rows, SHARD_BYTES), F.col("doc_id").asc_nulls_first(), "tie", "at")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
        .mapInArrow(run, "shard long, records long, nulls long, ids long, low long, high long")
    )
    rows, start = [], 0
    for r in sorted(stats.collect(), key=lambda r: r["shard"]):  # a row for each shard
        rows.append(r.asDict() | {"start": start})
        start += r["ids"]
    manifest = {"folder": folder, "dtype": dtype, "ids": start, "shards": rows}
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, root = _fs(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _route(shards: list[dict]):
    """Key -> numbers of the shards whose range holds it (several only for a key split by ties)."""
    keyed = [s for s in shards if s["low"] is not None]
    low, high = (np.array([s[k] for s in keyed], dtype=np.int64) for k in ("low", "high"))
    at = np.array([s["shard"] for s in keyed], dtype=np.int64)

    def route(keys: np.ndarray):
        return np.searchsorted(high, keys, "left"), np.searchsorted(low, keys, "right"), at

    return route


def read_records(keys: DataFrame, manifest: dict) -> DataFrame:
    """Records of the given keys (first column, long) by keyed access: RECORDS.

    Each key gives all its records; a key that is not in the files gives none. A null key gives
    the records that were written without key. Repeated keys are looked up once.
    """
    shards, dtype, folder = manifest["shards"], manifest["dtype"], manifest["folder"]
    width = np.dtype(dtype).itemsize

    def routed(batches):
        route = _route(shards)
        for batch in batches:
            col = batch.column(0)
            ks = col.drop_null().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            first, last, at = route(ks)
            n = np.maximum(last - first, 0)
            which = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key, shard = pa.array(np.repeat(ks, n)), pa.array(at[which], pa.int64())
            if col.null_count:
                own = [s["shard"] for s in shards if s["nulls"]]
                key = pa.concat_arrays([key, pa.nulls(len(own), pa.int64())])
                shard = pa.concat_arrays([shard, pa.array(own, pa.int64())])
            yield pa.RecordBatch.from_arrays([key, shard], names=["key", "shard"])

    def fetched(batches):
        fs, root = _fs(folder)
        start = {s["shard"]: s["start"] for s in shards}
        now = index = data = None
        for batch in batches:
            key, shard = batch.column(0), batch.column(1).to_numpy()
            for s in np.unique(shard).tolist():
                if s != now:
                    if data is not None:
                        data.close()
                    now, data = s, fs.open_input_file(f"{root}/shard-{s:06d}.bin")
                    with fs.open_input_stream(f"{root}/shard-{s:06d}.idx") as f:
                        index = ShardIndex.load(f.read())
                own = key.filter(pa.array(shard == s))
                ks = own.drop_null().to_numpy(zero_copy_only=False)
                first, run = index.find(ks)
                cols = [[], [], [], []]
                todo = zip(ks.tolist(), first.tolist(), run.tolist(), strict=True)
                for k, f, n in [*todo, *([(None, 0, index.nulls)] if own.null_count else [])]:
                    for r in range(f, f + n):
                        a, b = int(index.starts[r]), int(index.starts[r + 1])
                        ids = np.frombuffer(data.read_at((b - a) * width, a * width), dtype)
                        for c, v in zip(cols, (k, start[s] + a, b - a, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            c.append(v)
                arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array([s] * len(cols[0]), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RECORDS.split(", ")])

    spark = keys.sparkSession
    return (
        keys.select(keys[keys.columns[0]].cast("long").alias("key"))
        .mapInArrow(routed, "key long, shard long")
        .distinct()
        .repartitionByRange(max(shuffle_parts(spark), len(shards)), "shard", "key")
        .sortWithinPartitions("shard", "key")
        .mapInArrow(fetched, RECORDS)
    )


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write in ascending doc_id order, and read every record back through the index."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "tokens")
    manifest = write_shards(docs, folder, "word", public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_records(docs.select("doc_id"), manifest)


QUERIES = {"op2_token_shards": op2_token_shards}
ORACLE_SQL: dict[str, str] = {}
