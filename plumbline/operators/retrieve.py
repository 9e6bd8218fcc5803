"""Index, brute-force search, and the similarity floor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import grid
from plumbline.policy import DEFAULT_K, SIMILARITY_FLOOR

#: Questions that are sent to every task; more are met block by block.
BROADCAST_QUERIES = 10_000


def check_dimension(index: DataFrame) -> int:
    """The one length of the index's vectors, 0 for an empty index; an error if they differ."""
    low, high = index.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != high:
        raise ValueError(f"vectors of different lengths: {low} and {high}")
    return low or 0


def pair_scores(questions: DataFrame, index: DataFrame, digits: int | None = None) -> DataFrame:
    """Every (question_id, chunk_id) with its cosine; the index is streamed past the questions, or past blocks of them.

    questions: question_id, query. index: chunk_id, vector. digits: scores are rounded half up to so
    many decimals. This is the definition: sums run in index order, as those of ``cosine`` do, for
    any number of questions.
    """
    asked, rows = questions.select("question_id", "query"), index.select("chunk_id", "vector")
    kinds = [(c, df.schema[c].dataType.simpleString()) for df, c in ((asked, "question_id"), (rows, "chunk_id"))]

    def row(few: pa.Table, chunks: pa.Table, j, i, score, _):
        ids = [grid.whole(few.column("question_id")).take(pa.array(i)), grid.whole(chunks.column("chunk_id")).take(pa.array(j))]
        return pa.RecordBatch.from_arrays([*ids, score], names=["question_id", "chunk_id", "score"])

    def work(few: pa.Table, chunks):
        yield from grid.by_score(((tile, *grid.scored(tile)) for tile in grid.Blocks(few, digits).tiles(chunks)), row)

    return grid.over(asked, rows, work, ", ".join(f"{c} {t}" for c, t in kinds) + ", score double", BROADCAST_QUERIES)


#: Products of a tile of questions and chunks that are held at once.
TILE = 4_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows; an error if they differ. A null component is NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = set(pc.list_value_length(column).unique().to_pylist())
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)[:2]}")
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared lengths of rows, summed in index order."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * x[:, k]
    return out


def _unit(x: np.ndarray, squares: np.ndarray) -> np.ndarray:
    n = np.sqrt(squares)[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class _Best:
    """The k best chunks of each question of a block, from tiles of an index one after the other.

    A tile is a ball around the mean of its unit vectors; questions whose k-th best score is
    beyond what the ball can reach skip it. Of the others a matrix product picks the chunks that
    may be among the best, with room for its rounding, and only these get their score by the
    definition, summed in index order. So scores, order and ties are those of ``pair_scores``.
    """

    def __init__(self, ids: pa.Array, vectors: pa.Array, apart: pa.Array | None, k: int):
        self.ids, self.k, self.q = ids, k, _matrix(vectors)
        self.square = _squares(self.q)
        self.unit = _unit(self.q, self.square)
        self.slack = 1e-15 * (self.q.shape[1] + 16)
        self.apart: dict = {}
        for i, v in enumerate(apart.to_pylist() if apart is not None else []):
            self.apart.setdefault(v, []).append(i)
        self.kth = np.full(len(ids), -np.inf)
        self.rows: pa.Table | None = None
        self.skipped = 0

    def add(self, chunk_ids: pa.Array, vectors: pa.Array, apart: pa.Array | None) -> None:
        step = max(16, TILE // max(1, len(self.ids)))
        for lo in range(0, len(chunk_ids), step):
            own = slice(lo, lo + step)
            self._tile(chunk_ids[own], _matrix(vectors[own]), apart[own].to_pylist() if apart is not None else [])

    def _tile(self, chunk_ids: pa.Array, c: np.ndarray, apart: list) -> None:
        if not len(self.ids) or not len(c):
            return
        if c.shape[1] != self.q.shape[1]:
            raise ValueError(f"vectors of sizes {self.q.shape[1]} {c.shape[1]}")
        square = _squares(c)
        unit = _unit(c, square)
        centre = unit.mean(axis=0)
        reach = self.unit @ centre + np.sqrt(((unit - centre) ** 2).sum(axis=1).max()) + 2 * self.slack
        near = np.flatnonzero(~(reach < self.kth))  # a NaN decides nothing
        self.skipped += len(self.ids) - len(near)
        if not len(near):
            return
        s = self.unit[near] @ unit.T
        s[np.isnan(s)] = -np.inf
        if self.apart:
            place = {int(i): r for r, i in enumerate(near.tolist())}
            for j, v in enumerate(apart):
                for i in self.apart.get(v, ()):
                    if i in place:
                        s[place[i], j] = -np.inf
        low = self.kth[near]
        if s.shape[1] > self.k:
            low = np.maximum(low, np.partition(s, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((s >= (low - 2 * self.slack)[:, None]) & (s > -np.inf))
        if not len(row):
            return
        row = near[row]
        total = np.zeros(len(row))
        for k in range(c.shape[1]):
            total += self.q[row, k] * c[col, k]
        length = np.sqrt(self.square[row]) * np.sqrt(square[col])
        score = np.divide(total, length, out=np.zeros_like(total), where=length > 0)
        new = pa.table({"row": row, "score": score, "id": chunk_ids.take(pa.array(col))})
        self._keep(new if self.rows is None else pa.concat_tables([self.rows, new]))

    def _keep(self, rows: pa.Table) -> None:
        rows = rows.take(pc.sort_indices(rows, [("row", "ascending"), ("score", "descending"), ("id", "ascending")]))
        row = rows.column("row").to_numpy()
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        rows = rows.filter(pa.array(place < self.k))
        full = place == self.k - 1
        self.kth[row[full]] = rows.column("score").to_numpy()[(place[place < self.k] == self.k - 1)]
        self.rows = rows.combine_chunks()

    def found(self) -> pa.Table:
        """question_id, chunk_id, score."""
        if self.rows is None:
            return None
        row = self.rows.column("row").combine_chunks()
        return pa.table({"question_id": self.ids.take(row), "chunk_id": self.rows.column("id"), "score": self.rows.column("score")})


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """Lists of bests of one question merged into its k best, with ``rank`` from 1, ties by chunk_id."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "chunk_id")))
    rows = best.groupBy("question_id").agg(F.slice(listed, 1, k).alias("all")).select("question_id", F.posexplode("all").alias("rank", "hit"))
    return rows.select("question_id", "hit.chunk_id", (-F.col("hit.o")).alias("score"), (F.col("rank") + 1).alias("rank"))


def _sides(questions: DataFrame, index: DataFrame, apart: tuple[str, str] | None) -> tuple[DataFrame, DataFrame, str]:
    """What a search reads of both sides, and the schema of its lists."""
    more = ([F.col(apart[0]).alias("apart")], [F.col(apart[1]).alias("apart")]) if apart else ([], [])
    asked = questions.where("query is not null").select("question_id", F.col("query").cast("array<double>").alias("query"), *more[0])
    rows = index.where("vector is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), *more[1])
    kinds = [(to, df.schema[c].dataType.simpleString()) for df, c, to in ((asked, "question_id", "question_id"), (rows, "chunk_id", "chunk_id"))]
    return asked, rows, ", ".join(f"{c} {t}" for c, t in kinds) + ", score double"


def _column(batch, name: str):
    """A column of a batch or table as one array, null if it has none of the name."""
    if name not in batch.schema.names:
        return None
    c = batch.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def search(questions: DataFrame, index: DataFrame, k: int = DEFAULT_K, apart: tuple[str, str] | None = None, n: int | None = None) -> DataFrame:
    """question_id, chunk_id, score, rank: the k best chunks of each question, ties by chunk_id; none for k <= 0.

    questions: question_id, query. index: chunk_id, vector. A vector that is null is no hit and
    asks nothing, nor is one with a null or NaN; a vector without length scores 0; vectors of
    different sizes are an error. apart: a column of questions and one of the index; a pair with
    equal values there is no hit. n: how many questions there are, where that is known.

    Up to BROADCAST_QUERIES questions, which are counted first, go to every task, and each task
    keeps k chunks of each while it reads its part of the index (``_Best``). More are met in blocks.
    """
    asked, rows, schema = _sides(questions, index, apart)
    if k <= 0:
        return questions.sparkSession.createDataFrame([], schema + ", rank int")
    n = asked.count() if n is None else n
    if n > BROADCAST_QUERIES:
        return search_blocks(questions, index, k, apart=apart)
    few = asked.toArrow().combine_chunks()

    def run(batches):
        best = _Best(_column(few, "question_id"), _column(few, "query"), _column(few, "apart"), k)
        for batch in batches:
            best.add(batch.column("chunk_id"), batch.column("vector"), _column(batch, "apart"))
        found = best.found()
        yield from found.to_batches() if found is not None else ()

    return _ranked(rows.mapInArrow(run, schema), k)


def search_blocks(questions: DataFrame, index: DataFrame, k: int = DEFAULT_K, block: int = 4096, apart: tuple[str, str] | None = None) -> DataFrame:
    """``search`` for any number of questions: every block of questions meets every block of the index in a task of its own."""
    asked, rows, schema = _sides(questions, index, apart)
    if k <= 0:
        return search(questions, index, k, apart)
    nq, nc = max(1, -(-asked.count() // block)), max(1, -(-rows.count() // block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.pmod(F.xxhash64("question_id"), F.lit(nq)).cast("int").alias("i"), each(nc).alias("j"), "*")
    right = rows.select(each(nq).alias("i"), F.pmod(F.xxhash64("chunk_id"), F.lit(nc)).cast("int").alias("j"), "*")

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        best = _Best(_column(q, "question_id"), _column(q, "query"), _column(q, "apart"), k)
        if q.num_rows and c.num_rows:
            best.add(_column(c, "chunk_id"), _column(c, "vector"), _column(c, "apart"))
        found = best.found()
        kinds = [("question_id", q.schema.field("question_id").type), ("chunk_id", c.schema.field("chunk_id").type), ("score", pa.float64())]
        return found if found is not None else pa.schema(kinds).empty_table()

    return _ranked(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(tile, schema), k)


def partition_by_floor(hits: DataFrame, floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """``hits`` with ``above``: the score reaches the floor. Both sides stay, in rank order."""
    return hits.withColumn("above", F.col("score") >= F.lit(floor))


def shown_chunks(hits: DataFrame) -> DataFrame:
    """What the generator sees: the hits above the floor."""
    return hits.where("above")
