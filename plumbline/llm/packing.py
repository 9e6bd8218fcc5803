"""Vector bin packing of token sequences under several limits at once.

A bin (one training sequence) has three capacities: tokens, segments and loss-bearing tokens.
The loss-bearing tokens of a document are those after its prompt, its first line; a model reads a
prompt but doesn't learn it, so sequences of prompts waste training steps as padding does.
The dot-product heuristic fills the open bin with the item whose demand vector has the largest
dot product with the bin's remaining capacity, both in shares of the limits, among those that
fit in every dimension; when none fits the next bin is opened.

Packing happens inside each input partition, in windows of at most ``window`` items, so it needs
no shuffle, holds a bounded number of items, and a lost task is redone from its input split.
What a window leaves in its last bin goes into the next window, so only the last bin of a
partition is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table
from .tokenization import encoder

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS, WINDOW = 1024, 16, 1000, 4096

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long"
)


def pack_vectors(items: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of row numbers of ``items`` (n x d, each within ``limits``), by the dot-product heuristic.

    Equal vectors are one candidate with a queue of rows, so a step costs as much as there are
    distinct vectors. Ties go to the lexicographically smallest vector, then the lowest row.
    """
    if not len(items):
        return []
    kinds, inverse = np.unique(items, axis=0, return_inverse=True)
    order = np.argsort(inverse.ravel(), kind="stable")
    count = np.bincount(inverse.ravel(), minlength=len(kinds))
    taken = np.concatenate(([0], np.cumsum(count)[:-1]))
    share = kinds / limits
    bins, left = [], len(items)
    while left:
        rest, own = limits.astype(np.int64).copy(), []
        while left:
            fits = (count > 0) & (kinds <= rest).all(axis=1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, share @ (rest / limits), -1.0)))
            n = 1
            own += order[taken[k] : taken[k] + n].tolist()
            taken[k] += n
            count[k] -= n
            rest -= kinds[k]
            left -= n
        bins.append(own)
        if count.min() == 0 and (count == 0).mean() > 0.5:  # forget the kinds that are used up
            keep = count > 0
            kinds, share, count, taken = kinds[keep], share[keep], count[keep], taken[keep]
    return bins


class _Packer:
    """Packs pieces as they come, to rows of (piece, sequence number, offset, loss-bearing tokens)."""

    def __init__(self, limits: tuple[int, int, int], window: int):
        self.limits, self.window, self.waiting, self.bins = np.array(limits), window, [], 0

    def add(self, piece: tuple, loss: int) -> Iterator[tuple]:
        """piece[2] is its length. A piece that fills the tokens or the loss-bearing ones is a sequence of its own."""
        if piece[2] == self.limits[0] or loss == self.limits[2] > 0:
            yield (*piece, self.bins, 0, loss)
            self.bins += 1
            return
        self.waiting.append((piece, loss))
        if len(self.waiting) >= self.window:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        items = np.array([(p[2], 1, loss) for p, loss in self.waiting], dtype=np.int64).reshape(-1, 3)
        packed = pack_vectors(items, self.limits)
        kept = [] if last or len(packed) < 2 else packed.pop()
        for own in packed:
            at = 0
            for i in own:
                piece, loss = self.waiting[i]
                yield (*piece, self.bins, at, loss)
                at += piece[2]
            self.bins += 1
        self.waiting = [self.waiting[i] for i in kept]


def cuts(n: int, prompt: int, max_tokens: int, max_loss: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, loss-bearing tokens) of the pieces of a document of n tokens, each as long as the limits allow.

    The first ``prompt`` tokens bear no loss, nor does the first token of a piece, which has
    nothing before it.
    """
    start = 0
    while start < n:
        masked = max(prompt - start, 1)
        length = min(n - start, max_tokens, max_loss + masked)
        yield start, length, length - min(masked, length)
        start += length


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    window: int = WINDOW,
    specials: bool = False,
) -> DataFrame:
    """One row per piece of each document (``doc_id``, ``text``) with its place in a sequence.

    A document is its ids by the byte-level file at ``path`` and then ``end_id``. Its prompt is
    the tokens inside its first line; a text without a line break has none. It is cut into pieces
    that keep the limits on tokens and loss-bearing tokens, and pieces are packed under all three.
    ``specials``: whether strings of special tokens in a text give their ids, see ``tokenization``.
    Null text counts as empty (one piece holding the end id), null ids and repeated rows stay
    rows of their own, a text of any length is cut into as many pieces as it takes, other columns
    are not looked at, and an empty table gives an empty result.
    """
    limits = (max_tokens, max_segments, max_loss)

    def run(batches):
        from pyspark import TaskContext

        enc, packer = encoder("byte", path, specials=specials), _Packer(limits, window)
        base, end = (TaskContext.get().partitionId() << 36), np.array([end_id], dtype="<u4").tobytes()

        def rows(found):
            cols = list(zip(*found, strict=True))
            cols[5] = [base + s for s in cols[5]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in PIECES.split(", ")]
            )

        def prompt(text, raw):
            line = text.find("\n")
            return enc.inside(raw, len(text[:line].encode())) if line > 0 else 0

        for batch in batches:
            out = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 500):
                own = texts[lo : lo + 500].to_pylist()
                for doc_id, text, raw in zip(ids[lo : lo + 500], own, enc.encode(own), strict=True):
                    first = prompt(text, raw)
                    raw += end
                    n = len(raw) // 4
                    for start, length, loss in cuts(n, first, max_tokens, max_loss):
                        out += packer.add((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n), loss)
            if out:
                yield rows(out)
        if out := list(packer.flush(True)):
            yield rows(out)

    return id_and_text(docs).mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, limits: tuple[int, int, int], window: int = WINDOW) -> DataFrame:
    """Pack whole examples (``example_id`` long, ``tokens`` long, ``loss_tokens`` long), never cut.

    Returns example_id, sequence_id, offset. Null counts are 0. An example beyond a limit by
    itself can be in no sequence: it is kept with a null sequence_id and offset.
    """

    def run(batches):
        from pyspark import TaskContext

        base, packer = TaskContext.get().partitionId() << 36, _Packer(limits, window)

        def rows(found):
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["example_id", "sequence_id", "offset"])

        def placed(found):
            return [(p[0], base + s, at) for (*p, s, at, _) in found]

        for batch in batches:
            out = []
            for example, tokens, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if tokens > limits[0] or loss > limits[2] or limits[1] < 1:
                    out.append((example, None, None))
                else:
                    packer.waiting.append(((example, 0, tokens), loss))
                    if len(packer.waiting) >= window:
                        out += placed(packer.flush(False))
            yield rows(out)
        yield rows(placed(packer.flush(True)))

    zero = F.lit(0).cast("long")
    return examples.select(
        examples["example_id"].cast("long").alias("example_id"),
        F.coalesce(examples["tokens"].cast("long"), zero).alias("tokens"),
        F.coalesce(examples["loss_tokens"].cast("long"), zero).alias("loss_tokens"),
    ).mapInArrow(run, "example_id long, sequence_id long, offset long")


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_pack_sequences": op1_pack_sequences}
ORACLE_SQL: dict[str, str] = {}
