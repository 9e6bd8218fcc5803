"""Periodic runs of words in whole texts, by Crochemore's partition refinement.

A run is a stretch of words with smallest period q (words q apart are equal), at least twice and
at least MIN_LENGTH words long, that no neighbouring word extends. Positions are put into classes
of equal factors of length 1, 2, 3 and so on. Going from one length to the next, a class splits by
the classes of the following positions; of the parts that a class fell into, all but one largest
are looked at again (smaller half), so a position is looked at O(log n) times. Each class
is a linked list in text order. Neighbours in a class at a distance equal to the length are a
square with a primitive root, and squares of one period at consecutive positions are one run.

The texts of a group are refined together: words are numbered by text, and a unique mark ends each
text, so no class has positions of two texts and a factor that would pass the end is unlike any
other. All splits of one length are done at once in numpy. The distance of a position to its
neighbour only grows, so each new distance is logged with the length from which it holds, and
squares are read from the log in the end. A text whose small parts have all become single
positions goes on by itself with a few list operations for each.

Work stays inside the input partitions; nothing is shuffled. Memory follows the words of a group
(WORDS_AT_ONCE, or one longer text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import once

from .common import id_and_text, table, utf8

MIN_LENGTH, WORDS_AT_ONCE = 12, 100_000
RUN = "struct<start:long,length:long,period:long>"
ROW = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start and its length, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where one of the sorted keys changes, the beginning included."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class _Classes:
    """Classes of positions: slots of one class are consecutive, and its members are linked in text order."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        _, self.of = np.unique(values, return_inverse=True)
        self.slots = np.argsort(self.of, kind="stable")
        self.slot = np.empty(n, np.int64)
        self.slot[self.slots] = np.arange(n)
        k = int(self.of.max()) + 1 if n else 0
        self.size, self.first = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        self.size[:k] = np.bincount(self.of, minlength=k)
        self.first[:k] = np.cumsum(self.size[:k]) - self.size[:k]
        self.classes, self.out = k, np.zeros(n, bool)
        self.after, self.before = np.full(n + 1, n), np.full(n + 1, -1)  # n: none; the last place takes writes to none
        self.log: list[tuple[np.ndarray, np.ndarray, int]] = []
        same = np.flatnonzero(self.of[self.slots[1:]] == self.of[self.slots[:-1]])
        self._link(self.slots[same], self.slots[same + 1], 1)

    def _link(self, left: np.ndarray, right: np.ndarray, length: int) -> None:
        """right follows left from this length on; right may be none."""
        self.after[left], self.before[right] = right, left
        self.log.append((left, right - left, length))

    def refine(self, active: np.ndarray, length: int) -> np.ndarray:
        """From factors of length - 1 to those of ``length``; takes and gives the positions of all small parts."""
        n = len(self.of)
        x = active[active > 0] - 1
        x = x[self.size[self.of[x]] > 1]
        if not len(x):
            return x
        own, then = self.of[x], self.of[x + 1]
        order = np.lexsort((x, then, own))
        x, own, then = x[order], own[order], then[order]
        part = _edges(own, then)
        count = np.diff(np.append(part, len(x)))
        whole = own[part]  # the class that a part leaves
        group = _edges(whole)
        moved = np.add.reduceat(count, group)
        rest = self.size[whole[group]] - moved
        # where nothing stays behind, the largest part does
        members = np.diff(np.append(group, len(part)))
        of_group = np.repeat(np.arange(len(group)), members)
        ranked = np.lexsort((-count, of_group))
        largest = ranked[group]
        goes = np.ones(len(part), bool)
        goes[largest[rest == 0]] = False
        # all but one largest of the parts are looked at next
        small = goes.copy()
        small[largest[(rest > 0) & (count[largest] > rest)]] = False
        behind = group[(rest > 0) & (count[largest] > rest)]
        chosen = [x[_spread(part[small], count[small])]]

        part, count = part[goes], count[goes]
        if len(part):
            x, own = x[_spread(part, count)], own[_spread(part, count)]
            self._leave(x, own, length)
            self._place(x, own, part, count)
            first = np.cumsum(count) - count
            last = np.zeros(len(x), bool)
            last[first + count - 1] = True
            following = np.append(x[1:], n)
            self.before[x[first]] = -1
            self._link(x, np.where(last, n, following), length)
        if len(behind):
            c = whole[behind]
            chosen.append(self.slots[_spread(self.first[c], self.size[c])])
        return np.concatenate(chosen)

    def _leave(self, x: np.ndarray, own: np.ndarray, length: int) -> None:
        """Take positions out of the lists of their classes."""
        n = len(self.of)
        order = np.lexsort((x, own))
        x = x[order]
        new = np.ones(len(x), bool)
        new[1:] = self.after[x[:-1]] != x[1:]
        starts = np.flatnonzero(new)
        left, right = self.before[x[starts]], self.after[x[np.append(starts[1:], len(x)) - 1]]
        has = left >= 0
        self.before[right[~has]] = -1
        self._link(left[has], right[has], length)
        self.before[n] = -1

    def _place(self, x: np.ndarray, own: np.ndarray, part: np.ndarray, count: np.ndarray) -> None:
        """Move positions to the last slots of their class, which become classes of their own."""
        group = _edges(own)
        moved = np.diff(np.append(group, len(own)))
        c = own[group]
        tail = self.first[c] + self.size[c] - moved
        slots = _spread(tail, moved)
        self.out[x] = True
        sitting = self.slots[slots]
        stay = sitting[~self.out[sitting]]  # in the tail, but not moved; as many as are moved from before it, class by class
        come = x[self.slot[x] < np.repeat(tail, moved)]
        free = self.slot[come]
        self.slots[free], self.slot[stay] = stay, free
        self.slots[slots], self.slot[x] = x, slots
        self.out[x] = False
        self.size[c] -= moved
        new = self.classes + np.arange(len(count))
        self.classes += len(count)
        self.size[new], self.first[new] = count, slots[np.cumsum(count) - count]
        self.of[x] = np.repeat(new, count)


def _refine_one_by_one(of: np.ndarray, after: np.ndarray, before: np.ndarray, active: list[int], length: int) -> np.ndarray:
    """The rest of the log, rows of (position, gap, length), of a text all of whose small parts are single positions.

    They stay so: a single position takes one other out of its class. So a few list operations do for each.
    """
    n = len(of)
    _, own, size = np.unique(of, return_inverse=True, return_counts=True)
    of, size, after, before = own.tolist(), [*size.tolist(), 1], after.tolist(), before.tolist()
    alone, log = len(size) - 1, []
    while active:
        length += 1
        taken = []
        for y in active:
            x = y - 1
            if x < 0 or size[of[x]] < 2:
                continue
            size[of[x]] -= 1
            of[x] = alone
            p, q = before[x], after[x]
            if p >= 0:
                after[p] = q
                log.append((p, q - p, length))
            if q < n:
                before[q] = p
            log.append((x, n - x, length))
            taken.append(x)
        active = taken
    return np.array(log, np.int64).reshape(-1, 3)


def squares(values: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of all squares with primitive roots, by period and position.

    values: the texts one after the other, each with a unique value as its end; base: where each begins.
    """
    n = len(values)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes = _Classes(values)
    active, length, rest = np.arange(n), 1, []
    ends = np.append(base[1:], n)
    while len(active):
        length += 1
        active = classes.refine(active, length)
        if length & (length - 1) == 0 and len(active):  # at 2, 4, 8 ...: texts that can go on by themselves
            text = np.searchsorted(base, active, "right") - 1
            alone = np.ones(len(base), bool)
            alone[text[classes.size[classes.of[active]] > 1]] = False
            mine = alone[text]
            own, left = np.sort(active[mine]), active[~mine]
            text = np.searchsorted(base, own, "right") - 1
            cut = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(own) else np.zeros(0, np.int64)
            for a, z in zip(cut.tolist(), np.append(cut, len(own))[1:].tolist(), strict=True):
                lo, hi = int(base[text[a]]), int(ends[text[a]])
                after = np.minimum(classes.after[lo:hi], hi) - lo
                before = np.maximum(classes.before[lo:hi] - lo, -1)
                found = _refine_one_by_one(classes.of[lo:hi], after, before, (own[a:z] - lo).tolist(), length)
                found[found[:, 0] + found[:, 1] == hi - lo, 1] = n  # no neighbour
                rest.append(found + [lo, 0, 0])
            active = left
    log = [(p, g, np.full(len(p), k)) for p, g, k in classes.log] + [tuple(r.T) for r in rest]
    at, gap, since = (np.concatenate(c) for c in zip(*log, strict=True))
    order = np.lexsort((np.arange(len(at)), at))
    at, gap, since = at[order], gap[order], since[order]
    until = np.append(since[1:], n + 1)
    until[np.append(at[1:] != at[:-1], True)] = n + 1
    found = (since <= gap) & (gap < until) & (at + gap < n)
    at, gap = at[found], gap[found]
    order = np.lexsort((at, gap))
    return at[order], gap[order]


def find_runs(texts: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For each list of word numbers its runs, rows of (start, length, period) by start and then period."""
    n = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(n + 1) - n - 1
    values, top = np.zeros(int((n + 1).sum()), np.int64), 0
    for t, b in zip(texts, base.tolist(), strict=True):
        values[b : b + len(t)] = t + top
        top += int(t.max()) + 1 if len(t) else 0
        values[b + len(t)] = top
        top += 1
    at, period = squares(values, base)
    first = np.ones(len(at), bool)
    first[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(first)
    last = np.append(first, len(at))[1:] - 1
    start, period = at[first], period[first]
    length = at[last] - start + 2 * period
    long = length >= min_length
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    rows = np.stack([start, length, period], axis=1)[order]
    own = np.searchsorted(base, rows[:, 0], "right") - 1
    rows[:, 0] -= base[own]
    cut = np.searchsorted(own, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _groups(texts: list[list[bytes]], room: int):
    lo, size = 0, 0
    for i, words in enumerate(texts):
        if i > lo and size + len(words) > room:
            yield lo, i
            lo, size = i, 0
        size += len(words)
    if lo < len(texts):
        yield lo, len(texts)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed for every row of ``docs`` (``doc_id``, ``text``).

    Words lie between ASCII white space. collapsed: the words that no run holds after its first
    period, joined by one space. Null and empty texts and texts of white space have no words, no
    runs (an empty array) and an empty collapsed text. Null ids, repeated ids and repeated rows
    stay rows of their own. A text of any length is taken whole, other columns are not looked at,
    and an empty table gives no rows.
    """

    def rows(ids, texts):
        numbered = []
        for words in texts:
            names: dict[bytes, int] = {}
            numbered.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
        found = find_runs(numbered, min_length)
        short = [w if not len(r) else [w[i] for i in np.flatnonzero(kept(len(w), r)).tolist()] for w, r in zip(texts, found, strict=True)]
        flat = np.concatenate(found)
        runs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN))
        ends = np.cumsum([len(r) for r in found])
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(w) for w in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), runs),
                pa.array([b" ".join(w) for w in short], pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                texts = [raw.split() for raw in utf8(part.column(1))]
                for a, b in _groups(texts, WORDS_AT_ONCE):
                    yield rows(part.column(0)[a:b], texts[a:b])

    return id_and_text(docs).mapInArrow(run, ROW)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text of ``docs``; a tenth of the texts, by a checksum of the id, repeat a stretch from some word on.

    With h the CRC-32 of the id in decimal, g = h // 10 and n words: where h % 10 = 0 and n > 0,
    word i >= a becomes word a + (i - a) % p for a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    rows = id_and_text(docs)
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = once(rows.withColumn("g", F.floor(h / 10)), words=words)
    rows = rows.withColumn("k", F.size("words"))
    a = F.when(F.col("k") > 0, F.col("g") % F.col("k"))
    rows = once(rows, a=a.cast("long"))
    p = 1 + F.floor((F.col("k") - F.col("a")) / (3 + F.col("g") % 8))
    rows = once(rows, p=p.cast("long"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("k") > 0, made).otherwise(F.col("text")).alias("text"))


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    # greatest length, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = once(rows, best=best)
    length, period = F.col("best.l"), -F.col("best.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), _digest(lines).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
