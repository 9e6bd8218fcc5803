"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

Features come from whole texts on executors: densities of an abuse lexicon, how near its words
stand to second-person words, capitals, punctuation, and signs of obfuscation (look-alike
digits, inserted symbols, stretched letters). The lexicon has a fixed part and a learned part:
words and word beginnings that labelled toxic documents hold far more often than others.

The model sees at most ``MAX_ROWS`` labelled rows, those with the smallest hash of their id;
every row is scored. A training row's learned-lexicon features leave its own label out of the
counts, so the trees meet them as they will be on unseen rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import fit_isotonic, fit_trees
from .common import id_and_text, shared_dir, stored, table

#: Labelled rows the model may be fitted on.
MAX_ROWS = 20_000
#: Entries of the learned lexicon at most, and how often an entry must occur in toxic rows.
MAX_STEMS, MIN_ROWS, MIN_ODDS, MIN_Z = 4_000, 4, 2.0, 4.0
STEMS = range(4, 9)
THRESHOLD = 0.3

LEXICON = (
    # English
    "arse asshole bastard bitch clown coward crap cretin creep degenerate despicable dimwit disgusting dumb "
    "dumbass dunce failure filth filthy fool freak garbage hate hideous idiot idiotic imbecile jerk liar loser "
    "lunatic maggot moron moronic nasty nitwit parasite pathetic pig rat repulsive rotten scum scumbag shit "
    "shut slime stupid sucker sucks swine trash twit ugly useless vermin vile waste weirdo worthless "
    # French
    "abruti batard cretin débile dégoûtant déchet idiote imbécile inutile lâche merde minable nul ordure "
    "pathétique pourri raté répugnant salaud stupide vermine "
    # German
    "abschaum blödmann dumm dummkopf dreck ekelhaft erbärmlich feigling hässlich idioten lächerlich müll nutzlos "
    "schwachkopf scheiße schwein trottel versager wertlos widerlich "
    # Spanish
    "asco asqueroso basura cobarde escoria estúpido fracasado idiota imbécil inútil mierda miserable patético "
    "payaso ridículo rata repugnante tonto"
).split()
SECOND_PERSON = (
    "you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch "
    "tú ti contigo usted ustedes vosotros vuestro"
).split()
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 5
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

NAMES = (
    "words chars mean_word hits hit_rate hit_chars distinct_hits second second_rate near_hits near_rate nearest upper_rate "
    "shout_rate bang_rate question_rate punct_rate symbol_rate digit_rate odd_rate masked_hits stretched_rate hidden_hits "
    "hidden_rate learned_hits learned_rate learned_sum learned_max learned_distinct learned_near"
).split()

_edge = re.compile(r"^[\W_]+|[\W_]+$").sub
_odd = re.compile(r"[^\W\d_]+[0-9@$!|*._+-]+[^\W\d_][\w@$!|*.+-]*|[0-9@$!|]+[^\W\d_][\w@$!|*.+-]*").fullmatch
_stretched = re.compile(r"([^\W\d_])\1\1+").search
_masked = re.compile(r"[^\W\d_]\*{2,}[^\W\d_]").search
_lexicon, _second = frozenset(LEXICON), frozenset(SECOND_PERSON)


def stems(word: str) -> set[str]:
    """What the learned lexicon may know a word by: itself (marked by a trailing space) and its beginnings."""
    return {word + " ", *(word[:k] for k in STEMS if k <= len(word))}


def odds(a: float, b: float, n1: float, n0: float) -> float:
    """Smoothed log odds ratio of an entry in a of n1 toxic and b of n0 other rows."""
    a, b = max(a, 0), max(b, 0)
    return float(np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5)))


class Reader:
    """Features of texts, with a memo of words bounded by ``memo`` entries."""

    def __init__(self, learned: dict[str, tuple[int, int]], n1: int, n0: int, memo: int = 300_000):
        self.learned, self.n1, self.n0, self.limit = learned, n1, n0, memo
        self.kinds: list[tuple | None] = [None]
        self.memo: dict[str, int] = {}

    def _kind(self, token: str) -> int:
        """0 for a token that matters to no feature, else the place of its description."""
        word = _edge("", token)
        odd = bool(_odd(word))
        hidden = odd and (
            re.sub(r"[\W_]", "", word.translate(LOOKALIKE)) in _lexicon or re.sub(r"[\W\d_]", "", word) in _lexicon
        )
        own = [self.learned[s] for s in stems(word) if s in self.learned] if self.learned else []
        best = max(own, key=lambda ab: (odds(*ab, self.n1, self.n0), ab), default=None)
        kind = (word in _lexicon, word in _second, odd, hidden, bool(_stretched(word)), bool(_masked(token)), best, word)
        if not any(kind[:7]):
            return 0
        self.kinds.append(kind)
        return len(self.kinds) - 1

    def _codes(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        for t in set(tokens).difference(memo):
            memo[t] = self._kind(t)
        return np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))

    def __call__(self, text: str, label: int | None = None) -> list[float]:
        """One value for each of NAMES; all 0 but ``nearest`` for a text without words.

        label: of a training row, to be left out of the learned counts.
        """
        if len(self.memo) > self.limit:
            self.memo, self.kinds = {}, [None]
        n, tokens = len(text), text.lower().split()
        words = len(tokens)
        out = dict.fromkeys(NAMES, 0.0)
        out["nearest"] = 1000.0
        if not words:
            return [out[k] for k in NAMES]
        codes = self._codes(tokens)
        at = np.flatnonzero(codes)
        kinds = [self.kinds[c] for c in codes[at].tolist()]
        hits = np.array([i for i, k in zip(at, kinds, strict=True) if k[0]], dtype=np.int64)
        you = np.array([i for i, k in zip(at, kinds, strict=True) if k[1]], dtype=np.int64)
        out |= {"words": np.log1p(words), "chars": np.log1p(n), "mean_word": n / words}
        own = [k[7] for k in kinds if k[0]]
        out |= {"hits": len(own), "hit_rate": len(own) / words, "hit_chars": sum(map(len, own)) / n, "distinct_hits": len(set(own))}
        out |= {"second": len(you), "second_rate": len(you) / words}
        if len(you) and len(hits):
            gap = self._gaps(hits, you)
            out |= {"near_hits": (gap <= NEAR).sum(), "near_rate": (gap <= NEAR).mean(), "nearest": min(1000, gap.min())}
        hidden = sum(k[3] for k in kinds)
        out |= {"odd_rate": sum(k[2] for k in kinds) / words, "hidden_hits": hidden, "hidden_rate": hidden / words}
        out |= {"stretched_rate": sum(k[4] for k in kinds) / words, "masked_hits": sum(k[5] for k in kinds)}
        a0, b0 = (0, 0) if label is None else (label, 1 - label)
        weights = {}
        for k in kinds:
            if k[6] and k[7] not in weights:
                a, b = k[6]
                weights[k[7]] = odds(a - a0, b - b0, self.n1 - a0, self.n0 - b0) if a - a0 >= MIN_ROWS - 1 else 0.0
        found = [(i, weights[k[7]]) for i, k in zip(at, kinds, strict=True) if k[6] and weights[k[7]] >= MIN_ODDS]
        if found:
            ws = np.array([w for _, w in found])
            out |= {"learned_hits": len(ws), "learned_rate": len(ws) / words, "learned_sum": ws.sum() / np.sqrt(words)}
            out |= {"learned_max": ws.max(), "learned_distinct": sum(w >= MIN_ODDS for w in weights.values())}
            if len(you):
                out["learned_near"] = (self._gaps(np.array([i for i, _ in found]), you) <= NEAR).sum()
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.bincount(np.minimum(raw, 127), minlength=128)
        letters = max(1, seen[65:91].sum() + seen[97:123].sum() + seen[127])
        caps = (raw >= 65) & (raw <= 90)
        out |= {"upper_rate": seen[65:91].sum() / letters, "shout_rate": (caps[1:] & caps[:-1]).mean() if n > 1 else 0.0}
        out |= {"bang_rate": seen[33] / n, "question_rate": seen[63] / n, "digit_rate": seen[48:58].sum() / n}
        out |= {"punct_rate": seen[[44, 46, 58, 59]].sum() / n, "symbol_rate": (seen[35:39].sum() + seen[[42, 64, 94, 124]].sum()) / n}
        return [float(out[k]) for k in NAMES]

    @staticmethod
    def _gaps(at: np.ndarray, you: np.ndarray) -> np.ndarray:
        k = np.searchsorted(you, at)
        left, right = you[np.maximum(k - 1, 0)], you[np.minimum(k, len(you) - 1)]
        return np.minimum(np.abs(at - left), np.abs(right - at))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Trained:
    """Trees on three rows of four, calibration on the fourth. One class or none: a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if len(y) and 0 < y.sum() < len(y):
            late = np.arange(len(y)) % 4 == 3
            if len(set(y[~late])) < 2 or len(set(y[late])) < 2:
                late = np.zeros(len(y), dtype=bool)
            self.trees = fit_trees(x[~late], y[~late])
            own = late if late.any() else ~late
            self.calibrated = fit_isotonic(self.trees.raw(x[own]), y[own])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        raw = self.trees.raw(x)
        # isotonic blocks are flat; a trace of the raw order keeps ranks within them apart
        return np.clip(self.calibrated(raw) * (1 - 1e-6) + 1e-6 / (1 + np.exp(-raw)), 0.0, 1.0)


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """place, text, y of the training rows: labelled, not held out, at most ``max_rows`` by the hash of the id.

    Null labels and ids don't count; of several labels of an id the largest does. The ids are
    bounded by ``max_rows``, so they are broadcast to the texts.
    """
    own = (
        labels.where("toxic is not null and doc_id is not null")
        .where(~is_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("y"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id")
        .limit(max_rows)
    )
    return id_and_text(docs).join(F.broadcast(own), "doc_id").select("place", "text", "y")


def learn_stems(rows: DataFrame) -> tuple[dict[str, tuple[int, int]], int, int]:
    """The learned lexicon with its counts (toxic rows, other rows), and the numbers of both."""
    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n1 or not n0:
        return {}, int(n1), int(n0)

    def count(batches):
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set()
                for word in {_edge("", t) for t in set(text.lower().split())}:
                    if word:
                        own |= stems(word)
                seen[y].update(own)
            keys = sorted(seen[0].keys() | seen[1].keys())
            counts = [pa.array([c[k] for k in keys], pa.int64()) for c in (seen[1], seen[0])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *counts], names=["stem", "a", "b"])

    sums = rows.select("text", "y").mapInArrow(count, "stem string, a long, b long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    w = F.log(a / (n1 - F.col("a") + 0.5)) - F.log(b / (n0 - F.col("b") + 0.5))
    best = (
        sums.where(F.col("a") >= MIN_ROWS)
        .withColumn("w", w)
        .withColumn("z", F.col("w") / F.sqrt(1 / a + 1 / b))
        .where((F.col("w") >= MIN_ODDS) & (F.col("z") >= MIN_Z))
        .orderBy(F.desc("z"), "stem")
        .limit(MAX_STEMS)
    )
    return {r["stem"]: (r["a"], r["b"]) for r in best.collect()}, int(n1), int(n0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """(learned lexicon, toxic rows, other rows, Trained) from the labelled rows."""
    rows = stored(labelled_rows(docs, labels, max_rows), shared_dir(docs.sparkSession, "toxicity"))
    learned, n1, n0 = learn_stems(rows)

    def run(batches):
        read = Reader(learned, n1, n0)
        for batch in batches:
            place, text, y = (batch.column(k) for k in range(3))
            x = [read(t, label) for t, label in zip(text.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([place, y, pa.array(x, pa.list_(pa.float64()))], names=["place", "y", "x"])

    found = rows.mapInArrow(run, "place long, y int, x array<double>").toPandas()  # max_rows rows at most
    found = found.assign(key=[tuple(x) for x in found["x"]]).sort_values(["place", "y", "key"])
    x = np.array(found["key"].tolist(), dtype=float).reshape(-1, len(NAMES))
    return learned, n1, n0, Trained(x, found["y"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (``doc_id``, ``text``).

    Null text counts as empty and gets a score like any other; null ids and repeated rows stay;
    texts of any length are read whole; other columns are not looked at. Without labels all scores
    are 0; with labels of one class only they are its value. An empty table gives no rows.
    """
    learned, n1, n0, trained = fit(docs, labels, max_rows)

    def run(batches):
        read = Reader(learned, n1, n0)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 1000):
                x = np.array([read(t) for t in texts[lo : lo + 1000].to_pylist()]).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays(
                    [ids[lo : lo + 1000], pa.array(trained.score(x), pa.float64())], names=["doc_id", "score"]
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, not shuffled.

    Null text counts as empty and is scored like any other; a row with a null id is scored, but
    never learned from; repeated rows have equal scores and stay or go together; texts of any
    length are read whole; without labels all rows stay; an empty table gives no rows.
    """
    learned, n1, n0, trained = fit(docs, labels, max_rows)
    at = docs.columns.index("text")

    def run(batches):
        read = Reader(learned, n1, n0)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x = np.array([read(t or "") for t in part.column(at).to_pylist()]).reshape(-1, len(NAMES))
                yield part.filter(pa.array(trained.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
