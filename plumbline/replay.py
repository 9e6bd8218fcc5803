"""Runs recorded responses through the whole chain and compares what comes out with what was expected.

A replay is a smoke test that a person can read: each check prints a line, unequal values print
both with a mark under the first difference, and the exit code is the number of failures, at most
one hundred.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from plumbline.operators import answer
from plumbline.operators.report import load_fixture

WIDTH = 78


def wrap(text: str, width: int = WIDTH, indent: str = "") -> str:
    """The words of a paragraph in lines of at most ``width`` characters; a longer word has a line of its own."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(indent + word)
    return "\n".join(lines)


def difference(want: str, got: str) -> str | None:
    """Both texts around their first difference, with a mark under it; None for equal ones."""
    if want == got:
        return None
    at = next((i for i, (a, b) in enumerate(zip(want, got, strict=False)) if a != b), min(len(want), len(got)))
    low = max(0, at - 30)
    show = lambda s: json.dumps(s[low : at + 30], ensure_ascii=False)[1:-1]
    mark = " " * (len("expected ") + len(json.dumps(want[low:at], ensure_ascii=False)) - 2) + "^"
    return f"expected {show(want)}\n     got {show(got)}\n{mark} character {at}"


class Checks:
    """Told line by line, and counted."""

    def __init__(self, out: Callable[[str], None] = print):
        self.out, self.failures = out, 0

    def that(self, holds: bool, what: str) -> bool:
        self.failures += not holds
        self.out(f"  [{'ok' if holds else 'FAIL'}] {what}")
        return holds

    def equal(self, got, want, what: str) -> bool:
        """By their JSON, keys in order."""
        texts = [json.dumps(v, sort_keys=True, ensure_ascii=False) for v in (want, got)]
        if not self.that(texts[0] == texts[1], what):
            self.out(difference(*texts))
        return texts[0] == texts[1]


class Recorded:
    """A generator that replays a recorded response, and counts nothing else."""

    def __init__(self, path: str):
        self.model, self.raw = "replay", json.dumps(load_fixture(path))

    def __call__(self, system: str, user: str) -> str:
        return self.raw


def replay(question: DataFrame, index: DataFrame, path: str, expected: dict, checks: Checks, **options) -> dict:
    """The answer to one question from the recorded response at ``path``; ``expected`` values of its columns are checked.

    question: question_id, question, query, one row. options: of ``answer_questions``.
    """
    row = answer.answer_questions(question, index, Recorded(path), **options).first().asDict(True)
    checks.out(wrap(f"{row['question']} - {row['kind']}" + (f", {row['reason']}: {row['detail']}" if row["reason"] else "")))
    for name, want in expected.items():
        checks.equal(row[name], want, name)
    return row
