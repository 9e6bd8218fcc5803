"""Fill-in-the-middle transformation of whole texts, with cuts found by a sparse checkpoint index.

A text is counted in units: a run of A-Z and a-z, or one other character. Counting reads the
UTF-8 bytes piece by piece and records, every STEP units, where the unit begins in bytes and in
code points. A cut after so many units is found by a binary search over these checkpoints and a
scan of fewer than STEP units from there. So the index of a text holds a STEP-th of its units at
most, and no list of its tokens is ever made.

The cuts, the form and the order follow from a hash of the document's id, so a task that is run
again makes the same rows. Work stays inside the input partitions; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table, utf8

#: Units between two checkpoints, and bytes of a text that are counted at once.
STEP, PIECE = 128, 2**20
#: Marks of prefix, suffix and middle; hundredths of the texts that stay plain, and of the others that have the suffix first.
MARKS, PLAIN, SUFFIX_FIRST = ("<P>", "<S>", "<M>"), 10, 20
ROW = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_unit = re.compile(rb"[A-Za-z]+|[^\x80-\xbf][\x80-\xbf]*").match


class Checkpoints:
    """Where every ``step``-th unit of a UTF-8 text begins: parallel lists of units, bytes and code points."""

    def __init__(self, raw: bytes, step: int = STEP, piece: int = PIECE):
        self.raw, self.units, self.bytes, self.points = raw, [0], [0], [0]
        data, inside, n, points = np.frombuffer(raw, np.uint8), False, 0, 0
        for lo in range(0, len(raw), piece):
            b = data[lo : lo + piece]
            letter, first = _letter[b], (b & 0xC0) != 0x80  # of a code point
            before = np.concatenate(([inside], letter[:-1]))
            starts = np.flatnonzero(first & ~(letter & before))
            at = starts[-n % step :: step]
            if len(at):
                self.units += range(n + -n % step, n + len(starts), step)
                self.bytes += (at + lo).tolist()
                self.points += (np.cumsum(first)[at] - 1 + points).tolist()
            n, points, inside = n + len(starts), points + int(np.count_nonzero(first)), bool(letter[-1])
        self.n, self.n_points = n, points

    def locate(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before a unit, or before the end for ``n``."""
        if unit >= self.n:
            return len(self.raw), self.n_points
        k = bisect_right(self.units, unit) - 1
        at, point = self.bytes[k], self.points[k]
        for _ in range(unit - self.units[k]):
            end = _unit(self.raw, at).end()
            point += end - at if _letter[self.raw[at]] else 1
            at = end
        return at, point


def draws(doc_id: int | None, salt: int = 1) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the salt and the id in decimal (nothing for a null id)."""
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[4 * i : 4 * i + 4], "big") for i in range(4))


def transform_one(raw: bytes, h: tuple[int, int, int, int], marks=MARKS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, step: int = STEP):
    """(n, form, prefix's and middle's code points, output) of a UTF-8 text."""
    index = Checkpoints(raw, step)
    p, s, m = (x.encode() for x in marks)
    if not raw or any(x in raw for x in (p, s, m)) or h[2] % 100 >= 100 - plain:
        return index.n, "plain", None, None, raw
    a, b = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (i, x), (j, y) = index.locate(a), index.locate(b)
    if h[3] % 100 < suffix_first:
        return index.n, "spm", x, y - x, b"".join((s, raw[j:], p, raw[:i], m, raw[i:j]))
    return index.n, "psm", x, y - x, b"".join((p, raw[:i], s, raw[j:], m, raw[i:j]))


def fill_in_middle(docs: DataFrame, salt: int = 1, marks=MARKS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, step: int = STEP) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of ``docs`` (``doc_id``, ``text``).

    form: ``plain`` (the text as it is: where it is empty, holds a mark, or by its hash), ``psm``
    (prefix, suffix, middle, each after its mark) or ``spm`` (suffix, prefix, middle). The lengths
    are null for plain. Null text is the empty text, plain with 0 units. A null id has a hash of
    its own. Repeated rows stay rows of their own and give equal rows. A text of any length is
    transformed whole, other columns are not looked at, and an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                ids = batch.column(0)[lo : lo + 500]
                found = [
                    transform_one(raw, draws(i, salt), marks, plain, suffix_first, step)
                    for i, raw in zip(ids.to_pylist(), utf8(batch.column(1)[lo : lo + 500]), strict=True)
                ]
                n, form, prefix, middle, output = zip(*found, strict=True)
                cols = [pa.array(c, t) for c, t in zip((n, form, prefix, middle, output), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *cols[:-1], cols[-1].cast(pa.string())], schema=_ROW)

    return id_and_text(docs).mapInArrow(run, ROW)


def restored(output: Column, form: Column, marks=MARKS) -> Column:
    """The text that an output of this form was made of. The marks are the first of their kind in it: the text held none."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    suffix_first, prefix_last, middle_last = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_last, middle_last, suffix_first)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLE_SQL = {
    "op11_fill_in_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS d FROM documents),
h AS (SELECT *, list_transform(range(4), lambda i: ('0x' || substr(d, 8 * i::INT + 1, 8))::UBIGINT) AS h FROM t),
u AS (SELECT *, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]') AS units FROM h),
c AS (SELECT *, len(units)::BIGINT AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1))::BIGINT AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1))::BIGINT AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
}
