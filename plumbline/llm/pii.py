"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation
weighs the labelers, and a span classifier learned from the weighed votes decides.

Four kinds of base spans are given by patterns and always stay: email, ip, card, phone. Wider
patterns propose further candidates: spelled-out addresses, plain phone numbers, id and account
numbers, names of persons and streets. So do near misses of the base kinds: what looks like one
but fails its rule, such as a run of sixteen digits that is no card by its checksum. Regex, checksum,
gazetteer, context and shape labelers vote on every candidate (1 personal, 2 not, 0 no vote).
Over the whole corpus the votes are counted by pattern: a table bounded by kinds and labelers, not
by the corpus. EM over that table estimates, without any labels, how often each labeler is right,
and gives every pattern a probability.

The classifier sees nothing that a labeler votes by: the span's length and digits, what stands
right before and after it, the shape of the word before, and other candidates nearby. It is a
logistic model of these and the kind, fitted to the mean probability of all candidates that look
alike, again a bounded table; a candidate it puts at 0.5 or more is a span.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, shared_dir, stored, table

BASE = ("email", "ip", "card", "phone")
WIDE = ("email_words", "phone_plain", "id_number", "iban", "name", "street")
#: Near misses of the base kinds.
NEAR = ("email_like", "ip_like", "card_like", "phone_like")
ORDER = {k: i for i, k in enumerate(BASE + WIDE + NEAR)}

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# Possessive forms of the contract's patterns: a failing run of digits is read once, not once from each digit.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digit = re.compile("[0-9]").search
_email_words = re.compile(
    r"\b[A-Za-z0-9._%+-]{2,64}\s?[\[(]?\s?\bat\b\s?[\])]?\s?[A-Za-z0-9-]{2,63}\s?[\[(]?\s?\bdot\b\s?[\])]?\s?(?:com|org|net|edu|de|fr|es)\b",
    re.I | re.A,
).finditer
_phone_plain = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])", re.A).finditer
_id_number = re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A).finditer
_iban = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", re.A).finditer

_W = "[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,20}(?:[-'’][A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,20})?"
_words = f"{_W}(?: {_W}){{0,2}}(?![\\w'’-])"
_titled = re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Sr|Sra|Señor|Señora)\b\.? ({_words})").finditer
_introduced = re.compile(
    rf"\b(?:[Mm]y name is|[Nn]ame:|[Dd]ear|[Ss]igned,?|[Rr]egards,?|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es)\s({_words})"
).finditer
_capitals = re.compile(rf"(?<![\w'’-]){_W}(?: {_W}){{1,2}}(?![\w'’-])").finditer
_street = re.compile(
    rf"\b[0-9]{{1,5}}[A-Za-z]? (?:{_W} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace)\b"
    rf"|\b[A-ZÄÖÜ][a-zäöüß-]{{1,24}}(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?\b"
    rf"|\b[0-9]{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai) (?:(?:de|du|des|la|le|les) |[ld]['’]){{0,3}}{_W}(?: {_W}){{0,2}}"
    rf"|\b(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino) (?:(?:de|del|la|las|los|el) ){{0,3}}{_W}(?: {_W}){{0,2}},? (?:n[.º°]{{0,2}} ?)?[0-9]{{1,4}}\b"
).finditer
#: One of these is in every match of a pattern; looking for them is much faster than the pattern.
_IN_STREETS = (
    " St", " Road", " Rd", " Ave", " Lane", " Ln", " Drive", " Boulevard", " Blvd", " Court", " Square", " Terrace", "straße", "strasse", "str.", "weg ", "platz ", "allee ", "gasse ",
    " rue ", " avenue ", " boulevard ", " place ", " chemin ", " allée ", " impasse ", " quai ", "Calle ", "Avenida ", "Avda.", "Plaza ", "Paseo ", "Camino ",
)
_IN_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Sr", "Señor")
_IN_INTRODUCTIONS = ("y name is", "ame:", "Dear", "dear", "igned", "egards", "heiße", "ein Name ist", "appelle", "llamo", "nombre es")

#: Sizes of a card number's groups of digits.
CARD_GROUPS = ((12,), (13,), (14,), (15,), (16,), (19,), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "22", "23", "24", "25", "26", "27")


@dataclass(frozen=True)
class Gazetteers:
    """Lists the gazetteer labeler looks things up in; a program with larger ones passes its own."""

    mail_ends: frozenset = frozenset("com org net edu gov io de fr es it uk eu co us info".split())
    iban_lands: frozenset = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split())
    given_names: frozenset = frozenset(
        "Adam Agnes Alan Alberto Alejandro Alice Amelie Amy Ana Andrea Andreas Angela Anna Anne Antoine Antonio Barbara Beatriz Ben Bernd Brian Camille "
        "Carlos Carmen Caroline Catherine Charles Charlotte Christian Christine Claire Claudia Daniel David Diego Dieter Elena Elizabeth Emily Emma Eric Eva "
        "Fernando Florian Francisco Frank François Friedrich Gabriel George Gerhard Hans Heike Helen Henri Hugo Inge Isabel Jack Jacques James Jane Javier Jean "
        "Jennifer Jessica Johann John Jorge Joseph José Juan Julia Julien Jürgen Karen Karl Katharina Klaus Laura Léa Linda Louis Lucas Lucía Luis Manuel Marc "
        "Margaret María Marie Mark Markus Martin Mary Mathieu Michael Michel Miguel Monika Nathalie Nicolas Olivier Pablo Patricia Paul Pedro Peter Petra Philippe "
        "Pierre Rachel Ramón Richard Robert Rosa Sabine Sarah Sebastian Sophie Stefan Steven Susan Sylvie Teresa Thomas Ursula Uwe Walter William Wolfgang".split()
    )
    places: frozenset = frozenset(
        "London|Manchester|Birmingham|Leeds|Glasgow|Edinburgh|Dublin|New York|Los Angeles|Chicago|Houston|Boston|Seattle|San Francisco|San Diego|Toronto|"
        "Sydney|Berlin|Hamburg|München|Köln|Frankfurt|Stuttgart|Düsseldorf|Leipzig|Dresden|Wien|Zürich|Paris|Lyon|Marseille|Toulouse|Bordeaux|Lille|Nantes|"
        "Strasbourg|Bruxelles|Genève|Madrid|Barcelona|Valencia|Sevilla|Zaragoza|Málaga|Bilbao|Buenos Aires|Santiago|Lima|Bogotá".split("|")
    )


    @classmethod
    def read(cls, path: str) -> Gazetteers:
        """From a JSON object of lists by field; a field that it lacks keeps its short list. The file is read on the driver and goes to every task."""
        with open(path, encoding="utf-8") as f:
            return cls(**{k: frozenset(v) for k, v in json.load(f).items()})


GAZETTEERS = Gazetteers()
#: Capitalised words that are no part of a name.
NO_NAMES = frozenset(
    "The This That These Those And But For From With January February March April May June July August September October November December Monday Tuesday "
    "Wednesday Thursday Friday Saturday Sunday University Company Street Road License Public General Der Die Das Und Les Des Une Los Las Una".split()
)
POSITIVE = re.compile(
    r"mail|e-mail|contact|call|phone|tel|fax|mobile|ssn|social|account|iban|card|visa|address|reach|write to|kontakt|telefon|anruf|"
    r"appel|courriel|carte|compte|llam|correo|tarjeta|cuenta|konto",
    re.I,
).search
NEGATIVE = re.compile(r"version|order|isbn|issn|invoice|sku|model|serial|build|chapter|page|§|no\.|nr\.|hash|commit|token|\bid\b", re.I).search
POSITIVE_NAME = re.compile(r"name|dear|signed|regards|sincerely|heiße|appelle|llamo|nombre|born|married|Mrs?\b|Dr\b|Herr|Frau|Mme|Señora?", re.I).search
NEGATIVE_NAME = re.compile(r"university|company|\binc\b|\bltd\b|gmbh|license|version|street|avenue|city|team|chapter", re.I).search
POSITIVE_STREET = re.compile(r"address|lives?\b|living|resid|ship to|wohn|adresse|anschrift|habite|domicil|direcci|vive\b", re.I).search
_postcode = re.compile(r"(?<![0-9])[0-9]{5}(?![0-9])").search

LABELERS = ("pattern", "check", "gazetteer", "context", "shape")
#: What the classifier sees, with the number of values each feature has.
FEATURES = {"size": 4, "digits": 4, "before": 4, "after": 4, "prior": 4, "company": 2}
CANDIDATE = "struct<kind:string,start:int,stop:int,votes:int,look:int>"
FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, candidates array<{CANDIDATE}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Matches of the email pattern, found from each @ to the left and right."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _local:
                start -= 1
            if start < at and (m := _domain(text, at + 1)):
                yield start, m.end()
                end = m.end()
        at = text.find("@", at + 1)


_handle = re.compile(r"[A-Za-z0-9-]+(?![A-Za-z0-9.-]|\.[A-Za-z0-9-])").match


def _base_and_near(text: str) -> tuple[list, list]:
    """(start, kind, end) of the base kinds, by start and then kind, and of their near misses."""
    out, near = [], []
    if "@" in text:
        out += [(a, "email", b) for a, b in _emails(text)]
        at = text.find("@")
        while at >= 0:  # a name and a host without a dot
            start = at
            while start > max(0, at - 64) and text[start - 1] in _local:
                start -= 1
            if start < at and (m := _handle(text, at + 1)):
                near.append((start, "email_like", m.end()))
            at = text.find("@", at + 1)
    if _digit(text):
        for m in _ip(text):
            good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            (out if good else near).append((m.start(), "ip" if good else "ip_like", m.end()))
        for m in _card(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), "card", m.end()))
                elif 12 <= len(digits) <= 22:
                    near.append((m.start(), "card_like", m.end()))
        if "+" in text:
            for m in _phone(text):
                n = sum(map(str.isdigit, m[0]))
                if 9 <= n <= 15:
                    out.append((m.start(), "phone", m.end()))
                elif 7 <= n <= 18:
                    near.append((m.start(), "phone_like", m.end()))
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]])), near


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, by start and then kind."""
    return _base_and_near(text)[0]


def _names(text: str, gazetteers: Gazetteers) -> list[tuple[int, int]]:
    """Words after a title or an introduction, and capitalised words of which the first is a given name."""
    found = []
    for find, marks in ((_titled, _IN_TITLES), (_introduced, _IN_INTRODUCTIONS)):
        if any(m in text for m in marks):
            found += [m.span(1) for m in find(text)]
    found += [m.span() for m in _capitals(text) if m[0].split(" ", 1)[0] in gazetteers.given_names]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _wide_spans(text: str, gazetteers: Gazetteers) -> list[tuple[int, str, int]]:
    out = [(a, "name", b) for a, b in _names(text, gazetteers)]
    if _digit(text):
        for kind, find in (("phone_plain", _phone_plain), ("id_number", _id_number), ("iban", _iban)):
            out += [(m.start(), kind, m.end()) for m in find(text)]
        if any(m in text for m in _IN_STREETS):
            out += [(m.start(), "street", m.end()) for m in _street(text)]
    if "dot" in text.lower():
        out += [(m.start(), "email_words", m.end()) for m in _email_words(text)]
    return out


def _iban_ok(raw: str) -> bool:
    s = raw.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _judged(kind: str, raw: str, digits: str, around: str, gazetteers: Gazetteers) -> tuple[int, int, int]:
    """Votes of the pattern, check and gazetteer labelers: is the span written as its kind is, valid by the kind's own rule, and is its part in a list?

    Lists of names and places never hold all there are, so these can vote for a span only.
    """
    say = lambda good: 1 if good else 2
    base = kind.removesuffix("_like")
    if base in ("email", "email_words"):
        end = re.split(r"[.@\s]", raw.lower().rstrip(")]"))[-1]
        return say(end.isalpha() and kind != "email_like"), say(len(raw) <= 254 and ".." not in raw and kind != "email_like"), say(end in gazetteers.mail_ends)
    if base == "ip":
        parts = raw.split(".")
        low = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
        return say(all(len(p) <= 3 for p in parts)), say(low and not any(len(p) > 1 and p[0] == "0" for p in parts)), say(low and parts[0] not in ("0", "255"))
    if base == "card":
        groups = tuple(map(len, re.split("[ -]", raw)))
        return say(groups in CARD_GROUPS), say(luhn(digits) and len(digits) <= 19), say(digits.startswith(CARD_STARTS) and len(digits) in (13, 14, 15, 16, 19))
    if base == "phone":
        return say(raw.count("(") == raw.count(")") <= 1 and "  " not in raw), say(9 <= len(digits) <= 15), 0 if digits[:1] != "1" else say(len(digits) == 11 and digits[1] not in "01")
    if kind == "iban":
        return say(" " not in raw or all(len(g) == 4 for g in raw.split(" ")[:-1])), say(_iban_ok(raw)), say(raw[:2] in gazetteers.iban_lands)
    if kind == "id_number":
        return 0, say(digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"), say(digits[0] != "9")
    if kind == "name":
        words = raw.split(" ")
        return 0, say(len(set(words)) == len(words) and not NO_NAMES & {*words}), int(words[0] in gazetteers.given_names and raw not in gazetteers.places)
    if kind == "street":
        return 1, say(digits.strip("0") != ""), int(any(p in around for p in gazetteers.places) or bool(_postcode(around)))
    national = digits[-10:]
    return int(len(set(re.sub("[0-9()]", "", raw).strip())) <= 1), say(len(national) == 10), say(national[:1] not in ("0", "1") and national[3:6] != "000")


def votes(kind: str, raw: str, digits: str, around: str, edges: bool, judged: tuple[int, int, int]) -> int:
    """Votes of the LABELERS on a candidate as base-3 digits."""
    positive, negative = {"name": (POSITIVE_NAME, NEGATIVE_NAME), "street": (POSITIVE_STREET, NEGATIVE)}.get(kind, (POSITIVE, NEGATIVE))
    good, bad = bool(positive(around)), bool(negative(around))
    written = kind.startswith("email") or kind in ("name", "street")
    varied = len(set(raw if written or not digits else digits)) >= 4
    all_votes = (
        *judged,
        1 if good and not bad else 2 if bad and not good else 0,
        2 if not edges or not varied else 1 if re.search("[ ().@-]", raw) else 0,
    )
    return sum(v * 3**i for i, v in enumerate(all_votes))


def look(text: str, start: int, stop: int, digits: str, company: bool) -> int:
    """The FEATURES of a candidate as one number."""
    before, after, size = text[start - 1 : start], text[stop : stop + 1], stop - start
    side = lambda c, marks: 0 if not c or c in "\n\r" else 1 if c.isspace() else 2 if c in marks else 3
    prior = text[max(0, start - 30) : start].split()[-1:]
    word = prior[0].strip("()[]{}<>\"'.,:;!?") if prior else ""
    values = (
        (size > 10) + (size > 15) + (size > 25),
        (len(digits) > 0) + (len(digits) > 6) + (len(set(digits)) > 6),
        side(before, "([{<\"'«“„:=,;"),
        side(after, ")]}>\"'»”“.,:;!?"),
        0 if not word else 1 if word.islower() else 2 if word[0].isupper() else 3,
        company,
    )
    out = 0
    for v, n in zip(values, FEATURES.values(), strict=True):
        out = out * n + int(v)
    return out


def _may_hold(text: str) -> bool:
    """False only if no pattern of numbers and addresses can match: each asks for an @, a digit or the word dot in any case."""
    return "@" in text or bool(_digit(text)) or "dot" in text.lower()


def candidates(text: str, gazetteers: Gazetteers = GAZETTEERS) -> tuple[list, list]:
    """(base spans, all candidates as CANDIDATE); wide ones that touch a base span are left out, and near misses that touch any other."""
    base, near = _base_and_near(text) if _may_hold(text) else ([], [])
    spans = list(base)
    for more in (_wide_spans(text, gazetteers), near):
        if more:
            held = sorted(spans)
            ends = np.maximum.accumulate([b for _, _, b in held]).tolist() if held else []
            starts = [a for a, _, _ in held]
            for a, kind, b in sorted(more, key=lambda s: (s[0], ORDER[s[1]])):
                k = bisect_right(starts, b - 1)
                if not k or ends[k - 1] <= a:
                    spans.append((a, kind, b))
    places = sorted(a for a, _, _ in spans)
    out = []
    for a, kind, b in spans:
        raw = text[a:b]
        digits = re.sub("[^0-9]", "", raw)
        around = text[max(0, a - 40) : a] + " " + text[b : b + 20]
        edges = not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())
        company = bisect_left(places, b + 100) - bisect_left(places, a - 100) > 1
        judged = _judged(kind, raw, digits, text[max(0, a - 40) : a] + " " + text[b : b + 40], gazetteers)
        out.append((kind, a, b, votes(kind, raw, digits, around, edges, judged), look(text, a, b, digits, company)))
    return base, out


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def extract(docs: DataFrame, gazetteers: Gazetteers = GAZETTEERS) -> DataFrame:
    """FOUND: base counts, base spans as text, and the candidates of every row of ``docs``."""
    schema = T._parse_datatype_string(FOUND)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 1000):
                rows = []
                for doc_id, text in zip(ids[lo : lo + 1000].to_pylist(), texts[lo : lo + 1000].to_pylist(), strict=True):
                    base, found = candidates(text, gazetteers)
                    row = {f"n_{k}": sum(s[1] == k for s in base) for k in BASE}
                    names = ("kind", "start", "stop", "votes", "look")
                    row |= {"doc_id": doc_id, "base": joined(base), "candidates": [dict(zip(names, c, strict=True)) for c in found]}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return id_and_text(docs).mapInArrow(run, schema)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """P(personal) of each vote pattern by EM over a two-class model of independent labelers.

    patterns: (n, labelers) votes. Starts from the majority, keeps pseudo-counts of one.
    """
    yes, no = (patterns == 1).sum(axis=1), (patterns == 2).sum(axis=1)
    p = (yes + 1.0) / (yes + no + 2.0)
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])
        prior = (w.sum(axis=1) + 1) / (w.sum() + 2)
        like = np.log(prior)[:, None] + np.zeros((2, len(p)))
        for j in range(patterns.shape[1]):
            table = np.stack([[(w[y] * (patterns[:, j] == v)).sum() + 1 for v in range(3)] for y in range(2)])
            table /= table.sum(axis=1, keepdims=True)
            like += np.log(table[:, patterns[:, j]])
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic model of soft targets with a constant term."""
    z = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (target - p)) - ridge * beta
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


#: Products of the numbers of values of the features after each one: what a feature's value is multiplied by in a look.
RADIX = {f: int(np.prod(list(FEATURES.values())[i + 1 :], dtype=int)) for i, f in enumerate(FEATURES)}


def _design(kind: list[str], looks: np.ndarray) -> np.ndarray:
    """One column for each kind and each value of each feature."""
    parts = [np.eye(len(ORDER))[[ORDER[k] for k in kind]]]
    parts += [np.eye(n)[looks // RADIX[f] % n] for f, n in FEATURES.items()]
    return np.hstack(parts)


@dataclass(frozen=True)
class Classifier:
    """Weights of the logistic model: a constant, one for each kind, one for each value of each feature."""

    constant: float
    kinds: tuple[float, ...]
    features: tuple[tuple[float, ...], ...]

    def accepts(self, kind: str, look: int) -> bool:
        own = (w[look // RADIX[f] % len(w)] for f, w in zip(FEATURES, self.features, strict=True))
        return kind in BASE or self.constant + self.kinds[ORDER[kind]] + sum(own) >= 0

    def column(self, c):
        """The same of a candidate column."""
        numbers = lambda w: F.array(*[F.lit(float(x)) for x in w])
        score = F.lit(self.constant) + F.get(numbers(self.kinds), F.array_position(F.array(*map(F.lit, ORDER)), c["kind"]).cast("int") - 1)
        for f, w in zip(FEATURES, self.features, strict=True):
            score = score + F.get(numbers(w), (F.floor(c["look"] / RADIX[f]) % len(w)).cast("int"))
        return c["kind"].isin(*BASE) | (score >= 0)


def fit(found: DataFrame) -> Classifier:
    """The span classifier, learned from all candidates; without candidates it accepts base spans only.

    What comes to the driver are two tables whose sizes don't depend on the corpus: at most
    len(ORDER) * 3**len(LABELERS) patterns of votes, and as many kinds of candidates as the
    features tell apart, len(ORDER) times the product of their numbers of values.
    """
    spark = found.sparkSession
    c = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.look")
    rows = sorted(c.groupBy("kind", "votes").count().collect())
    if not rows:
        return Classifier(-1.0, (0.0,) * len(ORDER), tuple((0.0,) * n for n in FEATURES.values()))
    votes = np.array([r["votes"] for r in rows])
    p = estimate((votes[:, None] // 3 ** np.arange(len(LABELERS))) % 3, np.array([r["count"] for r in rows], dtype=float))
    weighed = spark.createDataFrame([(r["kind"], r["votes"], float(x)) for r, x in zip(rows, p, strict=True)], "kind string, votes int, p double")
    alike = c.join(F.broadcast(weighed), ["kind", "votes"]).groupBy("kind", "look").agg(F.count("*").alias("n"), F.avg("p").alias("p"))
    seen = sorted(alike.collect())
    kind = [r["kind"] for r in seen]
    looks, n, target = (np.array([r[k] for r in seen]) for k in ("look", "n", "p"))
    # kinds weigh alike by order of magnitude, so a frequent kind doesn't drown the others
    beta = fit_logistic(_design(kind, looks), target, np.log1p(n)).tolist()
    ends = np.cumsum([1, len(ORDER), *FEATURES.values()])
    return Classifier(beta[0], tuple(beta[1 : ends[1]]), tuple(tuple(beta[a:b]) for a, b in zip(ends[1:], ends[2:], strict=False)))


def detect(docs: DataFrame, gazetteers: Gazetteers = GAZETTEERS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans for every row of ``docs`` (``doc_id``, ``text``).

    Null text counts as empty and has no spans; null ids and repeated rows stay rows of their
    own (and count in the statistics); texts of any length are searched whole; other columns are
    not looked at; an empty table gives no rows.
    """
    found = stored(extract(docs, gazetteers), shared_dir(docs.sparkSession, "pii"))
    learned = fit(found)
    keep = F.filter("candidates", learned.column)
    ordered = F.array_sort(
        F.transform(keep, lambda c: F.struct(c["start"].alias("a"), F.array_position(F.array(*map(F.lit, ORDER)), c["kind"]).alias("o"), c["stop"].alias("b"), c["kind"].alias("k")))
    )
    spans = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")
    return found.select("doc_id", *[f"n_{k}" for k in BASE], "base", spans.alias("spans"))


def mask_text(text: str, learned: Classifier, gazetteers: Gazetteers = GAZETTEERS) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, end = [], 0
    own = [(a, kind, b) for kind, a, b, _, look in candidates(text, gazetteers)[1] if learned.accepts(kind, look)]
    for a, kind, b in sorted(own, key=lambda s: (s[0], ORDER[s[1]], s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
            end = b
        elif b > end:  # the rest of an overlapping span goes, too
            end = b
    return "".join([*out, text[end:]]) if end else text


def redact(docs: DataFrame, gazetteers: Gazetteers = GAZETTEERS) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, and ``n_chars``, where it is there as a number, set to the new length.

    Null texts stay null; empty texts, and texts of any length without a span, are returned as
    they are. Null ids, repeated rows and all other columns stay; an empty table gives no rows.
    Candidates are looked for twice, first to learn from all of them, then to replace: storing
    them with the texts in between would cost a copy of the corpus to save a small part of the time.
    """
    found = stored(extract(docs, gazetteers), shared_dir(docs.sparkSession, "pii"))
    learned = fit(found)
    names = docs.columns
    at = names.index("text")
    counted = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, T.NumericType)
    size = names.index("n_chars") if counted else None

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t and mask_text(t, learned, gazetteers) for t in old]
            if new != old:
                cols = list(batch.columns)
                cols[at] = pa.array(new, cols[at].type)
                if size is not None:
                    lengths = zip(old, new, cols[size].to_pylist(), strict=True)
                    kind = cols[size].type
                    number = Decimal if pa.types.is_decimal(kind) else float if pa.types.is_floating(kind) else int
                    cols[size] = pa.array([n if a == b else number(len(b)) for a, b, n in lengths], kind)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op5_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op5_weak_pii": op5_weak_pii}
ORACLE_SQL: dict[str, str] = {}
