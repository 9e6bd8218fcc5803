"""Exact Jaccard self-join on word n-grams by vertical partitioning.

A document's set is its distinct shingles of five words, as 64-bit hashes; documents with equal
sets are one class. The global order of shingles is cut into fragments by hash range. Work is
done per fragment, on the segments of all sets in it, and per-set or per-pair results of the
fragments are summed:

1. *Shared counts.* Each fragment finds the shingles that at least two classes hold and counts
   them per class. Summed over fragments, a class with fewer shared shingles than three quarters
   of its set can link with nothing and is dropped. This leaves few classes in usual corpora,
   and lines or passages that many documents share don't keep a class by themselves.
2. *Frequencies.* The remaining classes' shingles are counted exactly per fragment; by the order
   (frequency, hash) the prefix of a set is so long that two sets that link share a shingle of
   their prefixes. Frequent shingles come last, so they seldom are in a prefix.
3. *Candidates*, without all pairs of a group: in two rounds (one, if few pairs are left after
   it), every class with a few hubs of its prefix shingles. The links found make components; then, only for shingles whose classes are in
   several components, all pairs across components that share as many prefix shingles as sets that
   link must. A link between two classes is thus found, or both are in one component by other
   links already.
4. *Overlaps.* The candidates' segments are intersected per fragment, and the partial overlaps
   are summed per pair and compared with the threshold in integers.

Segments travel as packed binary blocks, a row for each batch and fragment, and counts as blocks
of classes, so rows and their cost don't grow with single shingles or with the fragments of a
class. In a batch a shingle is sent once, however many of its
documents hold it.

How many fragments there are follows from the counted bytes of the texts, so a fragment does not
grow with the corpus. Beyond MAX_PARTS partitions several fragments go to one partition, sorted,
and are worked on one after the other. Pairs are put into buckets by a hub they share, the
members of large groups by a hash as well, so that a bucket holds a bounded number of shingles,
few of them sent to several buckets. The steps on pairs read sorted rows and hold those of one
class or one cell.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, shared_dir, shuffle_parts, small_batches, stored, table
from .components import connected_components

WORDS = 5
#: Classes fetched by a broadcast list of ids; more are fetched by a shuffled join.
SMALL = 200_000
#: Shingles a batch may hold before it is sent, and pairs that are held at once.
BATCH = 1_000_000
#: Bytes of text whose shingles make up one fragment. A class's number goes to every fragment that has some of
#: its shingles, so small ones cost disk: of 8 MB, 4.1 times the input at 30 GB. As many fragments at most as let a batch have some
#: shingles for each, beyond which they grow (200 MB of text at 100 TB); partitions they are dealt to.
FRAGMENT_BYTES, MAX_FRAGMENTS, MAX_PARTS = 2**26, 2**19, 2**16
#: Partitions that sum the classes' counts at most, and counts that are merged at once in each.
MAX_SUMS, SUMMED_AT_ONCE = 2**12, 4_000_000
#: Shingles of a fragment that are sorted at once.
PIECE = 2_000_000
#: Fragments in which candidate pairs are verified, and shingles of a bucket of pairs that meet in each.
FRAGMENTS, BUCKET = 4, 250_000
#: Rounds of joining classes by hubs, and the hubs of a shingle in each. The round after them is exact.
ROUNDS, HUBS = 2, 6
#: Pairs of classes of a shared shingle, by their count, that the exact round takes on without a further hub round.
FEW_PAIRS = 10_000_000
#: Classes of one shingle that meet in one task at most.
CROWD = 20_000
MEMO = 200_000
_odd = np.random.Generator(np.random.PCG64(20240313)).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NOBODY = 0xFFFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (UTF-8): A-Z lower-cased, words between ASCII white space.

    Of fewer than five words the whole sequence is one shingle; without words there is none.
    """
    words = raw.lower().split()  # of bytes: ASCII letters and white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    m = max(1, n - WORDS + 1)
    out = np.full(m, min(n, WORDS), np.uint64)
    for i in range(min(n, WORDS)):
        out += h[i : i + m] * _odd[i]
    return np.unique(_mix(out))


def set_key(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def _fragment(hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of each hash's fragment; ascending hashes have ascending fragments."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _slices(hashes: np.ndarray, n: int):
    """(fragment, from, to) of the fragments that ascending hashes fall into."""
    f = _fragment(hashes, n)
    at = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1]))) if len(f) else np.zeros(0, np.int64)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(f)], strict=True):
        yield int(f[a]), a, b


BLOCK = "dst int, sub int, kind int, a binary, b binary, c binary"
_BLOCK = pa.schema([("dst", pa.int32()), ("sub", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
#: A document with its set's size, key and number, or a block of numbers and counts.
MARKS = "doc_id long, n long, key string, id long, dst int, names binary, counts binary"
_MARKS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.string()), ("id", pa.int64()), ("dst", pa.int32()), ("names", pa.binary()), ("counts", pa.binary())])


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOCK, strict=True)], schema=_BLOCK)


def _runs(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _size(parts: int, subs: int) -> int:
    """Shingles of a batch: so many that a fragment's block has some of them."""
    return min(8 * BATCH, max(BATCH, 16 * parts * subs))


def _in_turn(batches):
    """The batches of sorted rows (dst, sub, ...), those of each fragment by themselves; to be read in this order."""

    def cut():
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            for a, b in zip(at := _runs(key).tolist(), [*at[1:], len(key)], strict=True):
                yield int(key[a]), batch.slice(a, b - a)

    for _, own in itertools.groupby(cut(), lambda x: x[0]):
        yield (batch for _, batch in own)


def _dealt(blocks: DataFrame, parts: int, subs: int) -> DataFrame:
    """Blocks in the partitions of their fragments; sorted if a partition has several."""
    out = blocks.repartitionById(parts, F.col("dst"))
    return out.sortWithinPartitions("dst", "sub") if subs > 1 else out


def _mark(parts: int, subs: int):
    """Step 1, first half: batches of (doc_id, text) to blocks for the fragments."""

    def send(docs, sets, number):
        """kind 0: documents; kind 1: shared shingles counted here; kind 2: a segment."""
        ids = np.array([d or 0 for d, _, _ in docs], "<i8").tobytes()
        nulls = np.array([d is None for d, _, _ in docs], np.uint8).tobytes()
        rest = b"".join(k + n.to_bytes(8, "little") for _, k, n in docs)
        rows = [(number % parts, 0, 0, ids, nulls, rest)]
        keys = list(sets)
        if keys:
            names = np.frombuffer(b"".join(k[:8] for k in keys), "<u8")
            hashes = np.concatenate([sets[k] for k in keys])
            owner = np.repeat(np.arange(len(keys)), [len(sets[k]) for k in keys])
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            at = _runs(hashes)
            length = np.diff(np.append(at, len(hashes)))
            several = np.repeat(length > 1, length)
            shared = np.bincount(owner[several], minlength=len(keys)).astype("<i8")
            rows.append((number % parts, 0, 1, names.tobytes(), shared.tobytes(), b""))
            who = np.where(length == 1, owner[at], _NOBODY).astype("<u2")
            one = hashes[at]
            low = (one & np.uint64(0xFFFFFFFF)).astype("<u4")
            for f, a, b in _slices(one, parts * subs):
                used, local = np.unique(who[a:b], return_inverse=True)
                local = np.where(who[a:b] == _NOBODY, _NOBODY, local).astype("<u2")
                rows.append((f // subs, f % subs, 2, names[used[used != _NOBODY]].tobytes(), low[a:b].tobytes(), local.tobytes()))
        return _blocks(rows)

    def run(batches):
        from pyspark import TaskContext

        number, limit = TaskContext.get().partitionId(), _size(parts, subs)
        docs, sets, size = [], {}, 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                own = shingles(texts[i].as_buffer().to_pybytes())
                key = set_key(own)
                docs.append((ids[i].as_py(), key, len(own)))
                if len(own) and key not in sets:
                    sets[key] = own
                    size += len(own)
                if size >= limit or len(docs) >= 50_000:
                    yield send(docs, sets, number)
                    docs, sets, size, number = [], {}, 0, number + 1
        if docs:
            yield send(docs, sets, number)

    return run


def _count(sums: int):
    """Step 1, second half: the blocks of fragments to MARKS: documents, and shared shingles of classes in blocks."""

    def run(batches):
        for own in _in_turn(batches):
            yield from _count_one(own, sums)

    return run


def _count_one(batches, sums: int):
    names, blocks, base, counted = [], [], 0, []
    for batch in batches:
        for kind, a, b, c in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
            kind, a, b, c = kind.as_py(), a.as_py(), b.as_py(), c.as_py()
            if kind == 0:
                n = len(b)
                rest = np.frombuffer(c, np.uint8).reshape(n, 24)
                keys = rest[:, :16].tobytes().hex()
                size = rest[:, 16:].copy().view("<i8").ravel()
                first = rest[:, :8].copy().view("<i8").ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(a, "<i8"), mask=np.frombuffer(b, np.uint8).astype(bool)),
                        pa.array(size),
                        pa.array([keys[32 * i : 32 * i + 32] for i in range(n)], pa.string()),
                        pa.array(first),
                        *(pa.nulls(n, f.type) for f in list(_MARKS)[4:]),
                    ],
                    schema=_MARKS,
                )
            elif kind == 1:
                counted.append((np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")))
            else:
                blocks.append((np.frombuffer(b, "<u4"), np.frombuffer(c, "<u2"), base))
                names.append(np.frombuffer(a, "<i8"))
                base += len(names[-1])
    if base:
        counted.append(_counts(names, blocks))
    if counted:
        yield from _shared(*_added(counted), sums)


def _counts(names: list[np.ndarray], blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the classes in a fragment's blocks, and how many of their shingles there others hold, too."""
    names, which = np.unique(np.concatenate(names), return_inverse=True)
    shared = np.zeros(len(names), np.int64)
    pieces = -(-sum(len(low) for low, _, _ in blocks) // PIECE)
    for piece in range(pieces):
        lows, owners = [], []
        for low, own, start in blocks:
            if pieces > 1:
                mine = low % np.uint32(pieces) == piece
                low, own = low[mine], own[mine]
            nobody = own == _NOBODY
            lows.append(low)
            owners.append(np.where(nobody, -1, which[np.where(nobody, 0, own.astype(np.int64) + start)]))
        low, owner = np.concatenate(lows), np.concatenate(owners)
        if not len(low):
            continue
        order = np.argsort(low, kind="stable")
        low, owner = low[order], owner[order]
        at = _runs(low)
        length = np.diff(np.append(at, len(low)))
        # held by two classes, or by some that another batch has counted among its own
        mixed = (length > 1) & (np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at))
        own = owner[np.repeat(mixed, length)]
        shared += np.bincount(own[own >= 0], minlength=len(names))
    return names, shared


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts with each number once, ascending, its counts summed."""
    names, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    names, which = np.unique(names, return_inverse=True)
    return names, np.bincount(which, counts, len(names)).astype("<i8")


def _shared(names: np.ndarray, counts: np.ndarray, sums: int):
    """Numbers and counts above zero as blocks for the partitions that sum them."""
    names, counts = names[counts > 0], counts[counts > 0]
    to = names % sums
    order = np.argsort(to, kind="stable")
    names, counts, to = names[order], counts[order], to[order]
    at = _runs(to)
    if not len(at):
        return
    ends = np.append(at[1:], len(to)).tolist()
    packed = ([c[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)] for c in (names, counts))
    nothing = [pa.nulls(len(at), f.type) for f in list(_MARKS)[:4]]
    yield pa.RecordBatch.from_arrays([*nothing, pa.array(to[at], pa.int32()), *(pa.array(c, pa.binary()) for c in packed)], schema=_MARKS)


def _sums(batches):
    """Blocks of numbers and counts, all those of a number in one task -> (id, shared)."""
    held, size = [], 0
    for batch in batches:
        for names, counts in zip(*(batch.column(k) for k in range(2)), strict=True):
            held.append((np.frombuffer(names.as_py(), "<i8"), np.frombuffer(counts.as_py(), "<i8")))
            size += len(held[-1][0])
            if size >= SUMMED_AT_ONCE:
                held = [_added(held)]
                size = 0
    if held:
        names, counts = _added(held)
        for lo in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in (names, counts)], names=["id", "shared"])


def _sets(batches):
    """(key, n, hashes) of (text) batches."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            found = [shingles(x.as_buffer().to_pybytes()) for x in batch.column(0)[lo : lo + 500]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([set_key(s).hex() for s in found], pa.string()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([s.tobytes() for s in found], pa.binary()),
                ],
                names=["key", "n", "hashes"],
            )


def _segments(parts: int, subs: int):
    """Step 2: (cid, n, hashes) batches to blocks of segments."""

    def send(rows):
        cids = np.array([r[0] for r in rows], "<i8")
        sizes = np.array([r[1] for r in rows], "<i8")
        hashes = np.concatenate([r[2] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        out = []
        for f, a, b in _slices(hashes, parts * subs):
            used, local = np.unique(owner[a:b], return_inverse=True)
            head = np.stack([cids[used], sizes[used]]).tobytes()
            out.append((f // subs, f % subs, 0, head, hashes[a:b].tobytes(), local.astype("<u4").tobytes()))
        return _blocks(out)

    def run(batches):
        rows, size, limit = [], 0, _size(parts, subs)
        for batch in batches:
            for cid, n, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                rows.append((cid.as_py(), n.as_py(), np.frombuffer(raw.as_buffer(), "<u8")))
                size += len(rows[-1][2])
                if size >= limit:
                    yield send(rows)
                    rows, size = [], 0
        if rows:
            yield send(rows)

    return run


def _frequencies(parts: int, subs: int):
    """Of each fragment the shingles that several classes hold, with their frequencies, as blocks by class."""

    def one(batches):
        heads, hashes, owners, base = [], [], [], 0
        for batch in batches:
            for a, b, c in zip(*(batch.column(k) for k in (3, 4, 5)), strict=True):
                heads.append(np.frombuffer(a.as_py(), "<i8").reshape(2, -1))
                hashes.append(np.frombuffer(b.as_py(), "<u8"))
                owners.append(np.frombuffer(c.as_py(), "<u4").astype(np.int64) + base)
                base += heads[-1].shape[1]
        head, value, owner = np.concatenate(heads, axis=1), np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        at = _runs(value)
        length = np.diff(np.append(at, len(value)))
        df = np.repeat(length, length)
        keep = df > 1
        value, owner, df = value[keep], owner[keep], df[keep].astype("<u4")
        to = head[0, owner] % (parts * subs)
        order = np.argsort(to, kind="stable")
        value, owner, df, to = value[order], owner[order], df[order], to[order]
        at = _runs(to)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(to)], strict=True):
            used, local = np.unique(owner[a:b], return_inverse=True)
            who = local.astype("<u4").tobytes() + df[a:b].tobytes()
            f = int(to[a])
            yield _blocks([(f // subs, f % subs, 0, head[:, used].tobytes(), value[a:b].tobytes(), who)])

    def run(batches):
        for own in _in_turn(batches):
            yield from one(own)

    return run


def _prefixes(batches):
    """Blocks of some classes, from all fragments -> (h, cid, n) for the shared shingles of their prefixes."""
    for own in _in_turn(batches):
        yield from _prefixes_one(own)


def _prefixes_one(batches):
    heads, hashes, whos, base = [], [], [], 0
    for batch in batches:
        for a, b, c in zip(*(batch.column(k) for k in (3, 4, 5)), strict=True):
            heads.append(np.frombuffer(a.as_py(), "<i8").reshape(2, -1))
            hashes.append(np.frombuffer(b.as_py(), "<u8"))
            who = np.frombuffer(c.as_py(), "<u4").reshape(2, -1).astype(np.int64)
            whos.append(np.stack([who[0] + base, who[1]]))
            base += heads[-1].shape[1]
    (cids, sizes), value, (owner, df) = np.concatenate(heads, axis=1), np.concatenate(hashes), np.concatenate(whos, axis=1)
    cid, first, dense = np.unique(cids, return_index=True, return_inverse=True)
    n, owner = sizes[first], dense[owner]
    # shingles that no other class holds come first and need not be sent
    left = n - (3 * n + 3) // 4 + 1 - (n - np.bincount(owner, minlength=len(cid)))
    order = np.lexsort((value, df, owner))
    value, owner = value[order], owner[order]
    at = _runs(owner)
    rank = np.arange(len(owner)) - np.repeat(at, np.diff(np.append(at, len(owner))))
    keep = rank < left[owner]
    value, owner = value[keep], owner[keep]
    for lo in range(0, len(value), 200_000):
        own = owner[lo : lo + 200_000]
        cols = [value[lo : lo + 200_000].view("<i8"), cid[own], n[own]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h", "cid", "n"])


#: A class and those it may link with: their ids, sizes and components.
PAIRS = "x long, nx long, ys array<long>, ns array<long>, cs array<long>"
CELL = f"cell long, {PAIRS}, cids binary, sizes binary, hashes binary"
_LONGS = pa.list_(pa.int64())
_PAIRS = [("x", pa.int64()), ("nx", pa.int64()), ("ys", _LONGS), ("ns", _LONGS), ("cs", _LONGS)]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive slices of values that end at ``ends``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.int64()))


def _flat(column) -> np.ndarray:
    """All values of a column of lists, one after the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _unpack(rows) -> tuple[np.ndarray, ...]:
    """(row number, y, ny, component) of every pair of rows with the PAIRS columns."""
    n = pc.list_value_length(rows.column("ys")).to_numpy(zero_copy_only=False).astype(np.int64)
    return (np.repeat(np.arange(rows.num_rows), n), *(_flat(rows.column(k)) for k in ("ys", "ns", "cs")))


def _by_class(x, nx, columns) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Pairs in order of x -> one row for each x with lists of the other columns."""
    at = _runs(x)
    ends = np.append(at[1:], len(x)) if len(x) else np.zeros(0, np.int64)
    return x[at], nx[at], [_lists(c, ends) for c in columns]


def _cells(batches):
    """Step 4: (cid, bucket, hashes) batches to blocks of segments, a row for each batch and cell."""

    def send(cells):
        cols = [[], [], [], []]
        for cell, own in sorted(cells.items()):
            cids, sizes = (np.array(c, "<i8").tobytes() for c in zip(*((c, len(h)) for c, h in own), strict=True))
            for col, v in zip(cols, (cell, cids, sizes, np.concatenate([h for _, h in own]).tobytes()), strict=True):
                col.append(v)
        n = len(cols[0])
        arrays = [pa.array(cols[0], pa.int64()), *(pa.nulls(n, t) for _, t in _PAIRS), *(pa.array(c, pa.binary()) for c in cols[1:])]
        return pa.RecordBatch.from_arrays(arrays, names=["cell", *(k for k, _ in _PAIRS), "cids", "sizes", "hashes"])

    cells, size = {}, 0
    for batch in batches:
        for cid, bucket, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
            hashes = np.frombuffer(raw.as_buffer(), "<u8")
            for f, a, b in _slices(hashes, FRAGMENTS):
                cells.setdefault(bucket.as_py() * FRAGMENTS + f, []).append((cid.as_py(), hashes[a:b]))
            size += len(hashes)
            if size >= BATCH:
                yield send(cells)
                cells, size = {}, 0
    if cells:
        yield send(cells)


def _overlaps(group: pa.Table) -> pa.Table:
    """Partial overlaps of a cell's pairs (rows without blocks) from its segments (rows with)."""
    is_pair = group.column("hashes").is_null()
    pairs, blocks = group.filter(is_pair), group.filter(pc.invert(is_pair))
    row, y, ny, comp = _unpack(pairs)
    x, nx = (pairs.column(k).to_numpy()[row] for k in ("x", "nx"))
    total = np.zeros(len(x), np.int64)
    if blocks.num_rows and len(x):
        read = lambda k, t: np.concatenate([np.frombuffer(r.as_buffer(), t) for r in blocks.column(k)])
        cid, length = read("cids", "<i8"), read("sizes", "<i8")
        _, token = np.unique(read("hashes", "<u8"), return_inverse=True)
        width = int(token.max()) + 1
        order = np.argsort(cid, kind="stable")
        cid_sorted = cid[order]
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        pool = np.sort(np.repeat(np.arange(len(cid)), length) * width + token)

        def place(who):
            k = np.minimum(np.searchsorted(cid_sorted, who), len(cid_sorted) - 1)
            return np.where(cid_sorted[k] == who, order[k], -1)

        a, b = place(x), place(y)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        swap = length[a[both]] > length[b[both]]
        a, b = np.where(swap, b[both], a[both]), np.where(swap, a[both], b[both])
        steps = np.cumsum(length[a]) // 1_000_000
        for k in np.unique(steps):
            own = np.flatnonzero(steps == k)
            n = length[a[own]]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            want = np.repeat(b[own], n) * width + token[np.repeat(start[a[own]], n) + inside]
            at = np.minimum(np.searchsorted(pool, want), len(pool) - 1)
            total[both[own]] = np.bincount(np.repeat(np.arange(len(own)), n), pool[at] == want, len(own)).astype(np.int64)
    keep = np.flatnonzero(total > 0)
    keep = keep[np.argsort(x[keep], kind="stable")]
    xs, nxs, lists = _by_class(x[keep], nx[keep], (y[keep], ny[keep], comp[keep], total[keep]))
    return pa.table({"x": xs, "nx": nxs, **dict(zip(("ys", "ns", "cs", "parts"), lists, strict=True))})


def _classes(batches):
    """Rows of batches sorted by x as tables of whole classes with about BATCH pairs."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, n = batch.column("x").to_numpy(), pc.list_value_length(batch.column("ys")).to_numpy(zero_copy_only=False)
        at = _runs(x)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(x)], strict=True):
            if held and size >= BATCH and x[a] != last:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size, last = size + int(n[a:b].sum()), x[a]
    if held:
        yield pa.Table.from_batches(held)


def _summed(batches):
    """Partial overlaps, sorted by x -> (x, y) of the links; one for each component of y."""
    for rows in _classes(batches):
        row, y, ny, comp = _unpack(rows)
        x, nx, part = rows.column("x").to_numpy()[row], rows.column("nx").to_numpy()[row], _flat(rows.column("parts"))
        order = np.lexsort((y, x))
        x, y, nx, ny, comp, part = (c[order] for c in (x, y, nx, ny, comp, part))
        at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        shared = np.add.reduceat(part, at)
        at = at[7 * shared >= 3 * (nx[at] + ny[at])]
        x, y, comp = x[at], y[at], comp[at]
        order = np.lexsort((y, comp, x))
        x, y, comp = x[order], y[order], comp[order]
        first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (comp[1:] != comp[:-1])))) if len(x) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first])], names=["x", "y"])


def _needed(batches):
    """The classes each bucket needs the segments of, once for each batch."""
    for batch in batches:
        row, y, _, _ = _unpack(batch)
        x, bucket = batch.column("x").to_numpy(), batch.column("bucket").to_numpy()
        pairs = np.unique(np.stack([np.concatenate([x, y]), np.concatenate([bucket, bucket[row]])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["cid", "bucket"])


def _in_buckets(pairs: DataFrame, path: str) -> DataFrame:
    """``pairs`` with ``bucket``: of about BUCKET * FRAGMENTS shingles, and as many numbers of pairs.

    Classes that look for the same ones go together, by the smallest of these. A group beyond a
    bucket's size is cut by a hash.
    """
    room = FRAGMENTS * BUCKET
    pairs = pairs.withColumns({"hub": F.array_min("ys"), "weight": F.col("nx") + 4 * F.size("ys")})
    groups = stored(pairs.groupBy("hub").agg(F.sum("weight").alias("weight")), f"{path}_groups")
    buckets = max(1, -(-int(groups.agg(F.sum("weight")).first()[0] or 0) // room))
    large = groups.where(F.col("weight") > room).select("hub", F.ceil(F.col("weight") / room).alias("cuts"))
    cut = F.pmod(F.xxhash64("x"), F.coalesce("cuts", F.lit(1)))
    return pairs.join(large, "hub", "left").withColumn("bucket", F.pmod(F.xxhash64("hub", cut), F.lit(buckets))).drop("hub", "weight", "cuts")


def verified(pairs: DataFrame, sets: DataFrame, parts: int, path: str) -> DataFrame:
    """(x, y) of links among the ``pairs`` (PAIRS): of a class with each component, one of those there are.

    sets: cid, n, hashes.
    """
    dealt = _in_buckets(pairs, path)
    need = dealt.mapInArrow(_needed, "cid long, bucket long").distinct()
    segments = sets.select("cid", "hashes").join(need, "cid").select("cid", "bucket", "hashes").mapInArrow(_cells, CELL)
    cells = F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda f: F.col("bucket") * FRAGMENTS + f)
    none = [F.lit(None).cast("binary").alias(k) for k in ("cids", "sizes", "hashes")]
    asked = dealt.select(F.explode(cells).alias("cell"), *(k for k, _ in _PAIRS), *none)
    sums = segments.unionByName(asked).groupBy("cell").applyInArrow(_overlaps, f"{PAIRS}, parts array<long>")
    return stored(sums.repartition(parts, "x").sortWithinPartitions("x").mapInArrow(_summed, "x long, y long"), path)


def _inside(nx, ny):
    """How many shared shingles of two sets that link are in both their prefixes at least.

    Sets that link share at least o = ceil(3/7 (nx + ny)) shingles, so each has at most n - o others.
    The c-th shared shingle is then at place c - 1 + n - o at the latest, which is inside the prefix
    of length p for c <= p - (n - o).
    """
    need = -(-3 * (nx + ny) // 7)
    return np.minimum(nx - (3 * nx + 3) // 4 + 1 - (nx - need), ny - (3 * ny + 3) // 4 + 1 - (ny - need))


def _hub_pairs(named: DataFrame, r: int, path: str) -> DataFrame:
    """PAIRS: each class with HUBS others that it shares most prefix shingles with, among the hubs of these.

    named: h, cid, n, component and its number of members. The hubs of a shingle are the classes
    that come first in HUBS orders by a hash, other ones each round r, so those of a group of
    copies are the same for most of its shingles. The pairs grow with the classes.
    """
    firsts = [F.min(F.struct(F.xxhash64("cid", F.lit(HUBS * r + k)).alias("o"), "cid", "n", "component", "members")) for k in range(HUBS)]
    hubs = named.groupBy("h").agg(F.count("*").alias("k"), *[f.alias(f"h{k}") for k, f in enumerate(firsts)]).where("k > 1")
    ids = F.array_distinct(F.array(*[F.struct(f"h{k}.cid", f"h{k}.n", f"h{k}.component", f"h{k}.members") for k in range(HUBS)]))
    hubs = hubs.select("h", F.explode(ids).alias("hub")).select(
        "h", F.col("hub.cid").alias("y"), F.col("hub.n").alias("ny"), F.col("hub.component").alias("other"), F.col("hub.members").alias("others")
    )
    fits = 4 * F.least("n", "ny") >= 3 * F.greatest("n", "ny")
    # a class of the smaller component looks for one of the larger
    apart = F.expr("members < others or members = others and component < other")
    pairs = named.join(stored(hubs, path), "h").where(apart & fits).groupBy(F.col("cid").alias("x"), F.col("n").alias("nx"), "y", "ny", "other").agg(F.count("*").alias("m"))
    best = Window.partitionBy("x").orderBy(F.desc("m"), "y")
    pairs = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= HUBS)
    lists = pairs.groupBy("x", "nx").agg(F.collect_list(F.struct("y", "ny", "other")).alias("all"))
    return lists.select("x", "nx", *[F.col(f"all.{k}").alias(to) for k, to in (("y", "ys"), ("ny", "ns"), ("other", "cs"))])


def _match(batches):
    """(h, a, b, side, cid, n, component, members) of whole cells -> PAIRS and the shared prefix shingles ``ms``.

    In a cell every x of a smaller component meets every y of a larger one; counts are summed
    before they are sent.
    """

    def send(found):
        x, nx, y, ny, comp = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((y, x))
        x, nx, y, ny, comp = (c[order] for c in (x, nx, y, ny, comp))
        at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        m = np.diff(np.append(at, len(x)))
        xs, nxs, lists = _by_class(x[at], nx[at], (y[at], ny[at], comp[at], m))
        return pa.RecordBatch.from_arrays([pa.array(xs), pa.array(nxs), *lists], names=["x", "nx", "ys", "ns", "cs", "ms"])

    found, size = [], 0
    for cell in _whole_cells(batches):
        _, _, _, side, cid, n, comp, members = (cell.column(k).to_numpy() for k in range(8))
        mid, hi = int(np.searchsorted(side, 1)), len(side)
        step = max(1, BATCH // max(1, hi - mid))
        for start in range(0, mid, step):
            xs, ys = slice(start, min(start + step, mid)), slice(mid, hi)
            less = members[xs, None] < members[None, ys]
            less |= (members[xs, None] == members[None, ys]) & (comp[xs, None] < comp[None, ys])
            less &= 4 * np.minimum(n[xs, None], n[None, ys]) >= 3 * np.maximum(n[xs, None], n[None, ys])
            i, j = np.nonzero(less)
            i, j = i + start, j + mid
            found.append((cid[i], n[i], cid[j], n[j], comp[j]))
            size += len(i)
            if size >= BATCH:
                yield send(found)
                found, size = [], 0
    if size:
        yield send(found)


def _whole_cells(batches):
    """Tables of the rows of one cell (h, a, b) each, from batches sorted by cell and side."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True):
            if held and tuple(key[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(key[lo])
    if held:
        yield pa.Table.from_batches(held)


def _chosen(batches):
    """Counts, sorted by x -> PAIRS with enough shared prefix shingles."""
    for table in _classes(batches):
        row, y, ny, comp = _unpack(table)
        x, nx, m = table.column("x").to_numpy()[row], table.column("nx").to_numpy()[row], _flat(table.column("ms"))
        order = np.lexsort((y, x))
        x, nx, y, ny, comp, m = (c[order] for c in (x, nx, y, ny, comp, m))
        at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        m = np.add.reduceat(m, at)
        at = at[m >= _inside(nx[at], ny[at])]
        xs, nxs, lists = _by_class(x[at], nx[at], (y[at], ny[at], comp[at]))
        yield pa.RecordBatch.from_arrays([pa.array(xs), pa.array(nxs), *lists], names=[k for k, _ in _PAIRS])


def _across(named: DataFrame, parts: int) -> DataFrame:
    """PAIRS: every pair of classes of different components that shares as many prefix shingles as links do.

    named: h, cid, n, component, members, k (the classes with that shingle). The classes of a
    shingle are cut into groups of at most CROWD by a hash, and every two groups are one cell.
    """
    named = named.withColumn("s", F.ceil(F.col("k") / CROWD))
    salt, each = F.pmod(F.xxhash64("cid"), F.col("s")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))
    rest = ["cid", "n", "component", "members"]
    x = named.select("h", salt.alias("a"), each.alias("b"), F.lit(0).alias("side"), *rest)
    y = named.select("h", each.alias("a"), salt.alias("b"), F.lit(1).alias("side"), *rest)
    cells = x.unionByName(y.select(*x.columns)).repartition(parts, "h", "a", "b").sortWithinPartitions("h", "a", "b", "side", "cid")
    matched = cells.mapInArrow(_match, f"{PAIRS}, ms array<long>")
    return matched.repartition(parts, "x").sortWithinPartitions("x").mapInArrow(_chosen, PAIRS)


def fragments(rows: DataFrame) -> tuple[int, int]:
    """(partitions, fragments in each) for texts of these bytes, which are counted."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(-(-size // FRAGMENT_BYTES), MAX_FRAGMENTS)
    parts = max(shuffle_parts(rows.sparkSession), min(n, MAX_PARTS))
    return parts, max(1, -(-n // parts))


def link_rows(docs: DataFrame, parts: int | None = None, subs: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, key, component for every row of ``docs``; see link_documents.

    key: of the row's set; component: a name of its group, null for a row without a set.
    """
    with small_batches(docs.sparkSession):
        return _link_rows(docs, parts, subs)


def _link_rows(docs: DataFrame, parts: int | None, subs: int | None) -> DataFrame:
    spark = docs.sparkSession
    work = shared_dir(spark, "ngrams")
    rows = id_and_text(docs)
    parts, subs = (parts, subs or 1) if parts else fragments(rows)
    sums = min(max(shuffle_parts(spark), parts // 16), MAX_SUMS)
    marks = stored(_dealt(rows.mapInArrow(_mark(parts, subs), BLOCK), parts, subs).mapInArrow(_count(sums), MARKS), f"{work}/marks")
    members = marks.where("key is not null").select("doc_id", "n", "key", "id")
    blocks = marks.where("key is null").select("names", "counts", "dst").repartitionById(sums, F.col("dst"))
    shared = blocks.mapInArrow(_sums, "id long, shared long")
    classes = members.where("n > 0").groupBy("key").agg(
        F.min("id").alias("id"), F.min("n").alias("n"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("doc"), F.min("doc_id").alias("low")
    )
    alive = stored(classes.join(shared, "id").where(4 * F.col("shared") >= 3 * F.col("n")).select("key", "doc"), f"{work}/alive")
    texts = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(2**63))))
    wanted = alive.select("doc")
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL else wanted.hint("merge")
    found = texts.join(wanted, "doc", "left_semi").select("text").mapInArrow(_sets, "key string, n long, hashes binary")
    # an id with several texts brings others along, repeated rows bring copies
    found = stored(found.join(alive.select("key"), "key", "left_semi").withColumn("cid", F.monotonically_increasing_id()), f"{work}/found")
    first = stored(found.groupBy("key").agg(F.min("cid").alias("cid")), f"{work}/cids")
    sets = found
    if found.count() > first.count():
        sets = stored(found.join(first.select("cid"), "cid", "left_semi"), f"{work}/sets")

    by_fragment = _dealt(sets.select("cid", "n", "hashes").mapInArrow(_segments(parts, subs), BLOCK), parts, subs)
    by_class = _dealt(by_fragment.mapInArrow(_frequencies(parts, subs), BLOCK), parts, subs)
    prefixes = stored(by_class.mapInArrow(_prefixes, "h long, cid long, n long"), f"{work}/prefixes")
    comps, named = None, prefixes.withColumns({"component": F.col("cid"), "members": F.lit(1).cast("long")})
    for r in range(ROUNDS):
        near = stored(_hub_pairs(named, r, f"{work}/hubs{r}"), f"{work}/near{r}")
        good = verified(near, sets, parts, f"{work}/links{r}")
        links = good.select(F.col("x").alias("u"), F.col("y").alias("v"))
        if r:  # the components so far are stars, which say as much as the links that made them
            links = links.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v")))
        comps = stored(connected_components(links), f"{work}/components{r}")
        sized = stored(comps.join(comps.groupBy("component").agg(F.count("*").alias("members")), "component"), f"{work}/sized{r}")
        # only shingles whose classes are in several components can join any
        own = prefixes if r == 0 else named.select("h", "cid", "n")
        own = own.join(sized.select(F.col("node").alias("cid"), "component", "members"), "cid", "left")
        own = stored(
            own.withColumns({"component": F.coalesce("component", "cid"), "members": F.coalesce("members", F.lit(1))}), f"{work}/named{r}"
        )
        mixed = own.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("k")).where("a < b").select("h", "k")
        mixed = stored(mixed, f"{work}/mixed{r}")
        named = stored(own.join(mixed, "h"), f"{work}/left{r}")
        if (mixed.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0) <= FEW_PAIRS:
            break
    across = stored(_across(named, parts), f"{work}/across")
    more = verified(across, sets, parts, f"{work}/more_links")
    stars = comps.select(F.col("node").alias("u"), F.col("component").alias("v"))
    comps = connected_components(stars.unionByName(more.select(F.col("x").alias("u"), F.col("y").alias("v"))))

    linked = first.join(comps.select(F.col("node").alias("cid"), "component"), "cid").select("key", "component")
    own = stored(
        classes.select("key", "low").join(linked, "key", "left").withColumn(
            "component", F.coalesce(F.col("component").cast("string"), F.col("key"))
        ),
        f"{work}/classes",
    )
    lowest = stored(own.groupBy("component").agg(F.min("low").alias("component_id")), f"{work}/lowest")
    info = stored(own.join(lowest, "component").select("key", "component_id", "component"), f"{work}/info")
    names = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "key", "component"]
    alone = members.where("n = 0").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("string")})
    return members.where("n > 0").join(info, "key").select(names).unionByName(alone.select(names))


def link_documents(docs: DataFrame, parts: int | None = None, subs: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (``doc_id``, ``text``).

    Two documents link when their sets' Jaccard similarity is at least 3/4, compared in integers.
    Null and empty texts and texts of white space have no set and link with nothing: their
    component is their own id. Rows with the same id and repeated rows are rows of their own; of
    a component with null ids the smallest other id counts (null if there is none). Texts of any
    length are taken whole, other columns are not looked at, and an empty table gives no rows.
    parts, subs: partitions, and fragments in each, instead of as many as the texts' bytes ask for.
    """
    return link_rows(docs, parts, subs).select("doc_id", "n_shingles", "component_id")


def _with_key(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row`` with the key of each row's set, null for an empty set."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            found = [shingles(x.as_buffer().to_pybytes()) for x in batch.column(1)]
            keys = pa.array([set_key(s).hex() if len(s) else None for s in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys], names=["row", "key"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("key", T.StringType())]))


def keep_one(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest doc_id.

    Rows without a set all stay. Texts are not shuffled where the ids to drop are few enough to
    broadcast. Rows whose id is null or not theirs alone are told apart by their sets: of such
    rows in one group one stays. Null and empty texts have no set, texts of any length are
    compared whole, all columns of a row stay with it, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = shared_dir(spark, "keep")
    rows = stored(link_rows(docs, parts), f"{work}/rows")
    per_id = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.max("n_shingles").alias("n"))
    shared = stored(per_id.where("doc_id is null or k > 1").select("doc_id"), f"{work}/shared")
    drop = rows.where("doc_id != component_id").select("doc_id").distinct()
    n_shared = shared.count()
    if n_shared:
        drop = drop.unionByName(shared.where("doc_id is not null")).distinct()
    drop = stored(drop.withColumnRenamed("doc_id", "dropped"), f"{work}/drop")
    gone = F.broadcast(drop) if drop.count() <= SMALL else drop.hint("merge")
    kept = docs.join(gone, docs["doc_id"] == gone["dropped"], "left_anti")
    if not n_shared:
        return kept
    kept = kept.where(kept["doc_id"].isNotNull())
    ids = shared.withColumnRenamed("doc_id", "dropped")
    odd = docs.join(ids, docs["doc_id"].eqNullSafe(ids["dropped"]), "left_semi")
    keyed = stored(_with_key(odd), f"{work}/odd").withColumn("at", F.monotonically_increasing_id())
    # a group's document is among these rows if its smallest id is, or if all its ids are null
    best = rows.where("component is not null").groupBy("component", "component_id").agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("key"))).alias("key")
    )
    best = best.join(ids, best["component_id"].eqNullSafe(ids["dropped"]), "left_semi").select("component_id", "key")
    mine = keyed.join(best, (keyed["key"] == best["key"]) & keyed["row.doc_id"].eqNullSafe(best["component_id"])).groupBy(
        best["component_id"], best["key"]
    ).agg(F.min_by("row", "at").alias("row"))
    chosen = mine.select("row").unionByName(keyed.where("key is null").select("row"))
    return kept.unionByName(chosen.select("row.*"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLE_SQL = {
    "op10_ngram_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (nx + ny - c)),
reach(id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, y FROM reach JOIN link ON x = to_id),
comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN comp ON id = doc_id
"""
}
