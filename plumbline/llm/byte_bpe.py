"""Byte-level BPE through sentencepiece: the model file is written straight from a rank file.

Every byte is mapped to a printable character, so each piece of the vocabulary is a string
without white space; its score is minus its rank, which makes sentencepiece's merge order the
rank order with ties to the left. There is no normalization, no dummy prefix and no white-space
escaping. Ids are the ranks; the obligatory unknown piece comes after them and never occurs.

Texts are split by the vocabulary's pattern and every match is encoded by itself. A match that
is a piece as a whole is that piece, as the rank encoder has it. Decoding maps ids to pieces and
characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, table
from .tokenization import MEMO, byte_decoder

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
UNKNOWN = "⁇"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= 2**64 - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model with the pieces in rank order."""
    to_char = {b: c for c, b in byte_decoder().items()}
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = bytearray()
    for rank, token in enumerate(order):
        piece = "".join(map(to_char.__getitem__, token)).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, len(order))
    trainer += b"".join(_field(k, -1) for k in (41, 42, 43)) + _field(45, UNKNOWN.encode())
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.whole = {t.decode("utf-8", "surrogateescape"): struct.pack("<I", i) for t, i in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(pattern).findall
        to_char = {b: c for c, b in byte_decoder().items()}
        self.table = {b: ord(c) for b, c in to_char.items()}
        back = byte_decoder()
        self.pieces = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(ranks))]
        self.memo: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = []
        for w in set(words).difference(self.memo):
            if w in self.whole:
                self.memo[w] = self.whole[w]
            else:
                new.append(w)
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in new]
        for w, ids in zip(new, self.model.encode(mapped, num_threads=1), strict=True):
            self.memo[w] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for lo in range(0, len(texts), 200):
            split = [self.split(t) for t in texts[lo : lo + 200]]
            self._learn([w for ws in split for w in ws])
            out += [b"".join(map(self.memo.__getitem__, ws)) for ws in split]
        return out

    def decode(self, raw: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(raw).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text; digests of ids and decoded bytes per row (DIGESTS).

    Null text is empty (0 tokens, the digests of nothing); null ids and repeated rows stay; texts
    of any length are encoded whole; other columns are not looked at; an empty table gives no rows.
    """

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 200):
                raws = c.encode(texts[lo : lo + 200].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[lo : lo + 200],
                        pa.array([len(r) // 4 for r in raws], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()),
                        pa.array([hashlib.sha256(c.decode(r)).hexdigest() for r in raws], pa.string()),
                    ],
                    names=[x.split()[0] for x in DIGESTS.split(", ")],
                )

    return id_and_text(docs).mapInArrow(run, DIGESTS)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
