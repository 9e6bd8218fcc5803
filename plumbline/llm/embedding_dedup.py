"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one class. Classes are dealt into blocks of about ``TILE`` by a hash; every
pair of blocks is one task group, so each pair of classes meets exactly once. Unit vectors are
quantised once to int8 with a scale of their own, and only codes, scales and errors travel to the
tiles. A tile of integer products (exact in single precision, as they stay below 2**24) times the
scales is the cosine up to the error bound

    |x.y - q(x).q(y)| <= |e(x)| + (1 + |e(x)|) * |e(y)|,   e(x) = x - q(x),

for unit x and y. Pairs that are below the threshold even with the error are done with, pairs
above it even with the error are links, and only the pairs between are recomputed from the given
vectors in double precision: a second step fetches those vectors, and no others, for the tiles
that need them.

A tile returns, per class, how many vectors it links to and the root of its tree in the tile's
links, and the undecided pairs as compressed bits, never pairs as rows: the output is bounded by
the tile even where everything links to everything. The trees are put together by connected
components.

All pairs of blocks are needed for exact results, so the work and the shuffled bytes grow with
the square of the number of distinct vectors over ``TILE``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table
from .components import connected_components

TILE, THRESHOLD = 8192, 0.9
#: Rows of a tile that are multiplied at once, and what single precision may add to a bound.
ROWS, SLACK = 512, 1e-5

#: kind of rows a tile returns: links of a class (cid, links, root), or the undecided pairs of a strip (lo, bits).
FOUND = "dim int, i int, j int, cid long, links long, root long, lo int, bits binary"
_FOUND = pa.schema(
    [("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("lo", pa.int32()), ("bits", pa.binary())]
)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length. Scaled first by a power of two, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def exact_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, in double precision."""
    x, y = (np.ldexp(a, -np.frexp(np.abs(a).max(axis=1))[1][:, None]) for a in (x, y))
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, error norm) of unit vectors; scale and error are single precision, the error rounded up."""
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    codes = np.clip(np.rint(unit / scale[:, None].astype(float)), -127, 127).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None].astype(float), axis=1) * (1 + 1e-9) + 1e-12
    return codes, scale, np.nextafter(error.astype(np.float32), np.float32(np.inf))


class Forest:
    """Connected numbers out of n, grown by links, as the smallest number of each tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """By hooking and pointer jumping."""
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        self.label = label


def screen(x, y, threshold: float = THRESHOLD):
    """(first row, sure, unsure) for strips of a tile: which pairs link whatever the error is, and which may.

    x, y: (codes, scale, error); y is None for the pairs of x alone, of which those with i < j are given.
    """
    (qx, sx, ex), (qy, sy, ey) = x, x if y is None else y
    right = qy.astype(np.float32).T.copy()
    sx, ex, sy, ey = (v.astype(np.float64) for v in (sx, ex, sy, ey))
    # per row the lowest integer product that may reach the threshold against any column
    least = (threshold - SLACK - ex - (1 + ex) * ey.max(initial=0.0)) / (sx * sy.max(initial=0.0))
    for lo in range(0, len(qx), ROWS):
        products = qx[lo : lo + ROWS].astype(np.float32) @ right
        may = products >= least[lo : lo + ROWS, None]
        if y is None:
            may &= np.arange(lo, lo + len(may))[:, None] < np.arange(len(qy))[None, :]
        i, j = np.nonzero(may)
        about = products[i, j] * sx[lo + i] * sy[j]
        error = ex[lo + i] + (1 + ex[lo + i]) * ey[j] + SLACK
        sure, unsure = about - error >= threshold, np.abs(about - threshold) < error
        yield lo, (i[sure] + lo, j[sure]), (i[unsure], j[unsure])


def _pack(group: pa.Table) -> pa.Table:
    """One row for a block: places, class sizes, codes, scales and errors as bytes."""
    flat = lambda c: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    vectors = flat(group.column("vector").combine_chunks()).flatten().to_numpy(zero_copy_only=False)
    codes, scale, error = quantise(unit(vectors.reshape(group.num_rows, -1)))
    first = group.slice(0, 1)
    parts = (group.column("place").to_numpy().astype("<i4"), group.column("size").to_numpy().astype("<i8"), codes, scale, error)
    names = ("places", "sizes", "codes", "scales", "errors")
    return pa.table({"dim": first.column("dim"), "block": first.column("block")} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(names, parts, strict=True)})


PACKED = "dim int, block int, places binary, sizes binary, codes binary, scales binary, errors binary"


def _found(cids: np.ndarray, links: np.ndarray, forest: Forest, key: tuple, strips=()) -> pa.Table:
    at = np.flatnonzero(links)
    n, m = len(at), len(strips)
    column = lambda v, kind: pa.array([v] * (n + m), kind)
    some = lambda v, kind: pa.concat_arrays([pa.array(v, kind), pa.nulls(m, kind)])
    rest = lambda k, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array([s[k] for s in strips], kind)])
    return pa.Table.from_arrays(
        [
            *(column(v, pa.int32()) for v in key),
            some(cids[at], pa.int64()), some(links[at].astype(np.int64), pa.int64()), some(cids[forest.label[at]], pa.int64()),
            rest(0, pa.int32()), rest(1, pa.binary()),
        ],
        schema=_FOUND,
    )


def _cids(block: int, places: np.ndarray) -> np.ndarray:
    return (np.int64(block) << 32) + places.astype(np.int64)


def _tile(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        if not rows or len(rows) == 1 and rows[0]["i"] != rows[0]["j"]:  # the other block is empty
            return _FOUND.empty_table()
        key = tuple(rows[0][k] for k in ("dim", "i", "j"))
        read = lambda r: (np.frombuffer(r["codes"], np.int8).reshape(-1, key[0]), *(np.frombuffer(r[k], "<f4") for k in ("scales", "errors")))
        size = np.concatenate([np.frombuffer(r["sizes"], "<i8") for r in rows])
        cids = np.concatenate([_cids(r["block"], np.frombuffer(r["places"], "<i4")) for r in rows])
        own = [read(r) for r in rows]
        after = len(own[0][0]) if len(own) > 1 else 0
        width, forest, links, strips = len(own[-1][0]), Forest(len(cids)), np.zeros(len(cids), np.int64), []
        for lo, (i, j), (a, b) in screen(own[0], own[1] if after else None, threshold):
            j = j + after
            links += np.bincount(i, size[j], len(cids)).astype(np.int64) + np.bincount(j, size[i], len(cids)).astype(np.int64)
            forest.add(i, j)
            if len(a):
                bits = np.zeros((min(ROWS, len(own[0][0]) - lo), width), bool)
                bits[a, b] = True
                strips.append((lo, zlib.compress(np.packbits(bits).tobytes(), 1)))
        # classes in one tree through sure links would have the same root, so it names each linked class
        return _found(cids, links, forest, key, strips)

    return run


def _pairs(lo: int, bits: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and columns of a strip's undecided pairs."""
    flat = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8)))
    return flat // width + lo, flat % width


def _asked(batches):
    """(dim, i, j, lo, bits, left and right places) -> the classes each tile needs the vectors of."""
    for batch in batches:
        for r in batch.to_pylist():
            left, right = (np.frombuffer(r[k], "<i4") for k in ("left", "right"))
            a, b = _pairs(r["lo"], r["bits"], len(right))
            cids = np.union1d(_cids(r["i"], left[np.unique(a)]), _cids(r["j"], right[np.unique(b)]))
            key = [pa.array([r[k]] * len(cids), pa.int32()) for k in ("dim", "i", "j")]
            yield pa.RecordBatch.from_arrays([*key, pa.array(cids)], names=["dim", "i", "j", "cid"])


def _decide(threshold: float):
    """The undecided pairs of a tile, from the given vectors."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.filter(group.column("vector").is_valid())
        strips = group.filter(group.column("bits").is_valid()).to_pylist()
        if not strips:
            return _FOUND.empty_table()
        key = tuple(strips[0][k] for k in ("dim", "i", "j"))
        order = np.argsort(rows.column("cid").to_numpy(), kind="stable")
        cids, size = rows.column("cid").to_numpy()[order], rows.column("size").to_numpy()[order]
        x = rows.column("vector").combine_chunks()
        x = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False).reshape(-1, key[0])[order]
        forest, links = Forest(len(cids)), np.zeros(len(cids), np.int64)
        for r in strips:
            left, right = (np.frombuffer(r[k], "<i4") for k in ("left", "right"))
            a, b = _pairs(r["lo"], r["bits"], len(right))
            i, j = np.searchsorted(cids, _cids(r["i"], left[a])), np.searchsorted(cids, _cids(r["j"], right[b]))
            for k in range(0, len(i), 100_000):
                own = exact_cosines(x[i[k : k + 100_000]], x[j[k : k + 100_000]]) >= threshold
                u, v = i[k : k + 100_000][own], j[k : k + 100_000][own]
                links += np.bincount(u, size[v], len(cids)).astype(np.int64) + np.bincount(v, size[u], len(cids)).astype(np.int64)
                forest.add(u, v)
        return _found(cids, links, forest, key)

    return run


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (``vec_id``, ``embedding``).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing:
    0 links, a component of their own. Vectors of different lengths don't link. Rows with equal
    vectors link with each other; repeated rows are rows of their own. Of a component with null
    ids the smallest other id counts. Components may be as large or small as doubles can be. An
    empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    work = shared_dir(spark, "embeddings")
    v = F.col("vector")
    usable = (
        v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector")
    )
    rows = rows.withColumn("key", F.when(usable, F.sha2(F.concat_ws(",", v.cast("array<string>")), 256)))
    classes = stored(
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("low"), F.count("*").alias("size"), F.any_value("vector").alias("vector")),
        f"{work}/classes",
    )
    blocks = max(1, -(-classes.count() // tile))
    place = F.row_number().over(Window.partitionBy("block").orderBy("key")) - 1  # a block holds about ``tile`` classes
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("place", place)
    dealt = stored(
        dealt.select("*", F.size("vector").alias("dim"), (F.shiftleft(F.col("block").cast("long"), 32) + F.col("place")).alias("cid")), f"{work}/dealt"
    )
    packed = stored(
        dealt.select("dim", "block", "place", "size", "vector").groupBy("dim", "block").applyInArrow(_pack, PACKED), f"{work}/blocks"
    )
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns(
        {"i": F.least("block", "other"), "j": F.greatest("block", "other")}
    )
    found = stored(pairs.groupBy("dim", "i", "j").applyInArrow(_tile(threshold), FOUND), f"{work}/found")

    side = lambda k, to: packed.select("dim", F.col("block").alias(k), F.col("places").alias(to))
    strips = found.where("bits is not null").select("dim", "i", "j", "lo", "bits")
    strips = stored(strips.join(side("i", "left"), ["dim", "i"]).join(side("j", "right"), ["dim", "j"]).select("dim", "i", "j", "lo", "bits", "left", "right"), f"{work}/strips")
    asked = strips.mapInArrow(_asked, "dim int, i int, j int, cid long").distinct()
    given = asked.join(dealt.select("cid", "size", "vector"), "cid")
    both = strips.unionByName(given, allowMissingColumns=True)
    more = stored(both.groupBy("dim", "i", "j").applyInArrow(_decide(threshold), FOUND), f"{work}/decided")

    found = found.where("cid is not null").unionByName(more).select("cid", "links", "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = dealt.select("cid", "key", "low", "size").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    info = stored(
        named.join(stored(lowest, f"{work}/lowest"), "component").join(links, "cid", "left").select(
            "key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
        ),
        f"{work}/info",
    )
    own = F.coalesce("component_id", "vec_id")
    # rows without a usable vector must not meet in one task
    return rows.select("vec_id", "key").where("key is not null").join(info, "key").select(
        "vec_id", "n_links", own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept")
    ).unionByName(
        rows.where("key is null").select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    )


def op4_int8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_int8_links": op4_int8_links}
ORACLE_SQL = {
    "op4_int8_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, to_id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT id, b FROM reach JOIN link ON a = to_id),
comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON id = vec_id LEFT JOIN n ON a = vec_id
"""
}
