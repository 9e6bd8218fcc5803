"""Which documents contain which quotes, as they are."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.shared import shared_dir, stored

#: Code points of an anchor; quotes and their UTF-8 bytes that make a block.
ANCHOR, BLOCK_QUOTES, BLOCK_BYTES = 24, 50_000, 2**25


class _Finder:
    """Finds a block of quotes in texts in one pass, by an automaton over one short part of each, its anchor.

    A quote's anchor is the part of its length, among those at multiples of half of it, that is in
    the fewest quotes, so that a hit leads to few of them. Where an anchor is found, the quotes
    behind it are compared with the text around it. Quotes up to the length are their own anchors.
    """

    def __init__(self, quotes: list[str], length: int = ANCHOR):
        import ahocorasick

        self.quotes, self.everywhere = quotes, [i for i, q in enumerate(quotes) if not q]
        places = [range(0, max(1, len(q) - length + 1), max(1, length // 2)) for q in quotes]
        shared = Counter(part for q, at in zip(quotes, places, strict=True) for part in {q[a : a + length] for a in at})
        behind: dict[str, list[tuple[int, int]]] = {}
        for i, (q, at) in enumerate(zip(quotes, places, strict=True)):
            if q:
                a = min(at, key=lambda a: (shared[q[a : a + length]], a))
                behind.setdefault(q[a : a + length], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for part, own in behind.items():
            self.automaton.add_word(part, (len(part), own))
        if behind:
            self.automaton.make_automaton()

    def inside(self, text: str) -> list[int]:
        """Numbers of the quotes that a text contains, each once."""
        found = set(self.everywhere)
        if len(self.automaton):
            for end, (length, own) in self.automaton.iter(text):
                for i, a in own:
                    start = end + 1 - length - a
                    if start >= 0 and i not in found and text.startswith(self.quotes[i], start):
                        found.add(i)
        return sorted(found)


def _containing(docs: DataFrame, quotes: pa.Table) -> DataFrame:
    ids, texts = quotes.column("item_id").combine_chunks(), quotes.column("quote").to_pylist()
    kinds = [docs.schema["doc_id"].dataType, T.StructType.fromDDL("x long")[0].dataType]
    schema = T.StructType([T.StructField("doc_id", kinds[0]), T.StructField("at", kinds[1])])

    def run(batches):
        finder = _Finder(texts)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [(k, i) for k, text in enumerate(part.column(1).to_pylist()) for i in finder.inside(text)]
                if found:
                    row, quote = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(quote, pa.int64())], names=["doc_id", "at"])

    found = docs.mapInArrow(run, schema)
    names = docs.sparkSession.createDataFrame(pa.table({"at": pa.array(range(len(ids)), pa.int64()), "item_id": ids}))
    return found.join(F.broadcast(names), "at").select("doc_id", "item_id")


def containing(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, item_id for every row of ``docs`` (doc_id, text) and every quote (item_id, quote) that its text contains as it is.

    Texts are read once for each block of at most BLOCK_QUOTES quotes or about BLOCK_BYTES, which go
    to every task; they are neither split nor shuffled. The quotes are counted first. Where they are several
    blocks, each one's pairs are written to the shared folder before the next is looked at. The
    empty quote is in every text. Null ids, texts and quotes are in no pair, an empty side gives none.
    """
    spark = docs.sparkSession
    quotes = quotes.where("item_id is not null and quote is not null").select("item_id", "quote")
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    n, size = quotes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("quote")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_QUOTES), -(-size // BLOCK_BYTES))
    if blocks == 1:
        return _containing(docs, quotes.toArrow())
    folder = shared_dir(spark, "containing")
    dealt = stored(quotes.withColumn("block", F.pmod(F.xxhash64("item_id", "quote"), F.lit(blocks))), f"{folder}/quotes")
    out = None
    for b in range(blocks):
        pairs = stored(_containing(docs, dealt.where(F.col("block") == b).select("item_id", "quote").toArrow()), f"{folder}/pairs-{b}")
        out = pairs if out is None else out.unionByName(pairs)
    return out
