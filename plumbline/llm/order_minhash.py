"""Order MinHash fingerprints: sketches that follow the edit distance, not only the shared content.

A text's k-mers of words are numbered by occurrence, so repeats are different elements. For each
of ``SKETCHES`` hash functions the ``LENGTH`` elements with the smallest hashes are selected and
put back into text order; the hash of that tuple of k-mers is one entry of the fingerprint. Two
entries agree when the same k-mers were selected in the same order, so the share of agreeing
entries falls with moved text as well as with changed text.

The query compares every text with its edited form, which takes the beginning of the next
document. Rows are put into ranges of doc_id whose bounds are ids of the table, so the first row
of each range is known and is sent to the range before it, too. Each range is then read in order
once, and texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, parts_for, table

K, LENGTH, SKETCHES = 2, 2, 64
#: Words longer than this are cut into pieces of PIECE code points, for scripts without spaces.
LONG, PIECE = 32, 8
COLUMNS = 8192
MEMO = 150_000
#: Bytes of text that make up a range of documents, about, and ranges at most: their bounds are part of the plan.
RANGE_BYTES, MAX_RANGES = 2**28, 10_000
ROWS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)

_rng = np.random.Generator(np.random.PCG64(20240229))
_xor = _rng.integers(0, 2**32, SKETCHES, dtype=np.uint32)[:, None]
_mul = (_rng.integers(0, 2**32, SKETCHES, dtype=np.uint32) | np.uint32(1))[:, None]
_weights = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash(word: str) -> int:
    raw = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], len(raw)) | 1


class _Words(dict):
    """Word -> 64-bit hash; 0 for a long word."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = 0 if len(word) > LONG else _hash(word)
        return h


class Sketcher:
    def __init__(self):
        self.words = _Words()

    def kmers(self, text: str) -> np.ndarray:
        """Hashes of the k-mers in text order; of a shorter text one for the whole, of an empty one none."""
        tokens = text.split()
        h = np.fromiter(map(self.words.__getitem__, tokens), np.uint64, len(tokens))
        if len(h) and not h.all():
            cut = []
            for t in tokens:
                cut += [t] if len(t) <= LONG else [t[i : i + PIECE] for i in range(0, len(t), PIECE)]
            h = np.fromiter(map(self.words.__getitem__, cut), np.uint64, len(cut))
        if not len(h):
            return h
        n = max(1, len(h) - K + 1)
        out = np.zeros(n, np.uint64)
        for i, w in enumerate(_weights[: len(h)]):
            out += h[i : i + n] * w
        return _mix(out)

    def sketch(self, text: str) -> np.ndarray:
        """The fingerprint: SKETCHES 32-bit entries, all 0 for a text without words."""
        kmers = self.kmers(text)
        n = len(kmers)
        if not n:
            return np.zeros(SKETCHES, np.uint32)
        element = kmers
        order = np.sort(kmers)
        if (order[1:] == order[:-1]).any():  # number the occurrences
            by = np.argsort(kmers, kind="stable")
            s = kmers[by]
            first = np.concatenate(([True], s[1:] != s[:-1]))
            starts = np.flatnonzero(first)
            occurrence = np.empty(n, np.uint64)
            occurrence[by] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            again = occurrence > 0
            element = kmers.copy()
            element[again] = _mix(kmers[again] + occurrence[again] * np.uint64(0x9E3779B97F4A7C15))
        u = (element >> np.uint64(32)).astype(np.uint32)
        found, rows = [], np.arange(SKETCHES)
        for lo in range(0, n, COLUMNS):
            v = (u[None, lo : lo + COLUMNS] ^ _xor) * _mul
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x846CA68B)
            for _ in range(min(LENGTH, v.shape[1])):
                at = v.argmin(axis=1)
                found.append((v[rows, at], at + lo))
                v[rows, at] = 0xFFFFFFFF
        if len(found) > LENGTH:  # the smallest of all blocks, ties to the left
            value = np.stack([f[0] for f in found], axis=1).astype(np.uint64)
            place = np.stack([f[1] for f in found], axis=1)
            key = value << np.uint64(32) | place.astype(np.uint64)
            best = np.take_along_axis(place, np.argsort(key, axis=1)[:, :LENGTH], axis=1)
        else:
            best = np.stack([f[1] for f in found], axis=1)
        best.sort(axis=1)
        out = np.full(SKETCHES, best.shape[1], np.uint64)
        for j in range(best.shape[1]):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + kmers[best[:, j]])
        return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds that are not above the id, by bisection; 0 for a null id."""
    if not bounds:
        return F.lit(0)
    low = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(bounds)) & (F.get(low, at + step - 1) <= doc_id), at + step
        ).otherwise(at),
    )


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """ROWS for every row of ``docs`` (``doc_id``, ``text``).

    Null text counts as empty. The order is by doc_id, null ids first, rows with the same id by
    their text; the next of the last row is the first one (of a single row, itself). A text
    without words has the fingerprint of nothing: its likeness to another such text is 1, to any
    other text 0. Texts of any length are taken whole, other columns are not looked at, and an
    empty table gives no rows.
    """
    rows = id_and_text(docs)
    n = max(1, min(parts or parts_for(rows, RANGE_BYTES), MAX_RANGES))
    fractions = [i / n for i in range(1, n)] or [0.5]
    stats = rows.agg(
        F.min("doc_id").alias("low"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
        F.percentile_approx("doc_id", fractions, 10_000).alias("at"),
    ).first()
    # every bound is an id of the table, and no range is empty
    bounds = sorted({b for b in (stats["at"] or []) if n > 1 and (stats["nulls"] or b > stats["low"])})
    part = _range_of(F.col("doc_id"), bounds)
    first = F.col("doc_id").isNull() if stats["nulls"] else F.coalesce(F.col("doc_id") == stats["low"], F.lit(False))
    starts = F.array_contains(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("doc_id")) if bounds else F.lit(False)
    last = len(bounds)
    to = F.array_compact(
        F.array(
            F.struct(F.col("part"), F.lit(False).alias("tail")),
            F.when(F.coalesce(starts, F.lit(False)), F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("tail"))),
            F.when(first, F.struct(F.lit(last).alias("part"), F.lit(True).alias("tail"))),
        )
    )
    dealt = rows.withColumn("part", part).withColumn("to", F.explode(to)).select("doc_id", "text", "to.part", "to.tail")

    def run(batches):
        sketch, held, out = Sketcher(), None, []

        def row(now, then):
            doc_id, text, own = now
            h = len(text) // 2
            edited = text[: len(text) - h] + then[1][:h]
            changed = sketch.sketch(edited)
            return (
                doc_id,
                len(text),
                hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                own.tobytes().hex(),
                changed.tobytes().hex(),
                likeness(own, changed),
                likeness(own, then[2]),
            )

        def batch_of(found):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in ROWS.split(", ")]
            )

        done = False
        for batch in batches:
            for i in range(batch.num_rows):
                if done:  # further rows that start the next range
                    break
                text = batch.column(1)[i].as_py()
                now = (batch.column(0)[i].as_py(), text, sketch.sketch(text))
                if held is not None:
                    out.append(row(held, now))
                done = batch.column(2)[i].as_py()
                held = now
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return (
        dealt.repartitionById(last + 1, F.col("part").cast("int"))
        .sortWithinPartitions("tail", "doc_id", "text")
        .select("doc_id", "text", "tail")
        .mapInArrow(run, ROWS)
    )


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op6_order_minhash": op6_order_minhash}
ORACLE_SQL: dict[str, str] = {}
