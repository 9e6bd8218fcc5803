"""Text reports and JSON artifacts of a run; the only place rows become Python values.

Parts and columns of a report are headed by the names of the artifact's fields, so that a figure
that is read in one can be looked up in the other. Every question's row comes to the driver, for a
report as for an artifact: both are for sets of some 100,000 questions; of larger ones the table of
scores is the result.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import pad_right
from plumbline.operators.calibrate import describe
from plumbline.policy import EMBEDDING_USD_PER_MILLION, GATE, HEADLINE_KINDS, INPUT_USD_PER_MILLION, OUTPUT_USD_PER_MILLION, PRICES_AS_OF, SCHEMA_VERSION


def results_rows(scores: DataFrame) -> DataFrame:
    """pos, head (without the note) and line of the results table, columns as wide as their widest cell."""
    label = F.coalesce(*[F.when(F.col("category") == c, F.lit(name)) for c, (name, _) in GATE.items()])
    status = F.when(F.col("passed"), "PASS").when(F.col("headline"), "HEADLINE").otherwise("FAIL")
    rows = scores.select("pos", status.alias("a"), F.col("id").alias("b"), label.alias("c"), F.col("note").alias("n"))
    heads = {"a": "status", "b": "question", "c": "category"}
    widths = rows.agg(*[F.greatest(F.max(F.length(k)), F.lit(len(h))).alias(f"w{k}") for k, h in heads.items()])
    cells = [pad_right(F.col(k), F.col(f"w{k}")) for k in heads]
    return rows.crossJoin(F.broadcast(widths)).select("pos", F.rtrim(F.concat_ws("  ", *cells)).alias("head"), F.concat_ws("  ", *cells, "n").alias("line"))  # widths: one row


def _table(head: list[str], rows: list[list[str]], left: set[int]) -> list[str]:
    widths = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    line = lambda r: "  ".join(c.ljust(w) if i in left else c.rjust(w) for i, (c, w) in enumerate(zip(r, widths, strict=True))).rstrip()
    return [line(head), "  ".join("-" * w for w in widths), *map(line, rows)]


def usd(x: float) -> str:
    six = f"{x:.6f}"
    return "$" + (f"{x:.2e}".replace("e-0", "e-") if x and six == "0.000000" else six)


def usage_report(steps: list[dict], total: dict) -> str:
    """steps: dicts with label, the counters and cost_usd; the first is the index build."""
    cells = lambda r: [r["label"], *(str(r[k]) for k in ("embedding_tokens", "input_tokens", "output_tokens", "latency_ms")), usd(r["cost_usd"])]
    head = ["label", "embedding_tokens", "input_tokens", "output_tokens", "latency_ms", "cost_usd"]  # as in the artifact
    rows = _table(head, [*map(cells, steps), cells(total | {"label": "TOTAL"})], {0})
    return "\n".join(["usage", "", *rows[:-1], rows[1], rows[-1], "", f"  prices as of {PRICES_AS_OF}"])


def gate_report(scores: DataFrame, categories: DataFrame, usage: str | None = None) -> str:
    """Headline failures first, then the table, the gate of each category, violations and the verdict."""
    rows = sorted(scores.collect(), key=lambda r: r["pos"])  # a row for each question
    gates = sorted(categories.collect(), key=lambda r: r["ord"])
    failed = sorted((r for r in rows if not r["passed"]), key=lambda r: (not r["headline"], r["pos"]))
    heads = [r for r in failed if r["headline"]]
    out = []
    if heads:
        out.append("\n".join([f"headlineViolations: {len(heads)}", "", *(f"  {i}. {r['message']}" for i, r in enumerate(heads, 1))]))
    lines = [[("PASS" if r["passed"] else "HEADLINE" if r["headline"] else "FAIL"), r["id"], GATE[r["category"]][0], r["note"]] for r in rows]
    out.append("\n".join(_table(["status", "question", "category", "note"], lines, {0, 1, 2, 3})))
    out.append("\n".join(["categories", "", *(f"  {g['label']:<26} {g['passed']}/{g['total']}  {g['rate']:.1%} of {g['threshold']:.1%} required: {'MET' if g['met'] else 'NOT MET'}" for g in gates)]))
    if failed:
        out.append("\n".join([f"violations: {len(failed)}", "", *(f"  {i}. {r['message']}" for i, r in enumerate(failed, 1))]))
    if usage:
        out.append(usage)
    passed = sum(r["passed"] for r in rows)
    out.append(f"verdict: {'PASS' if all(g['met'] for g in gates) else 'FAIL'} ({passed}/{len(rows)} questions passed)")
    return "\n\n".join(out)


def calibration_report(sides: list, separation, lowest: list, highest: list, refused: list, floor: float) -> str:
    """sides: rows of ``distribution``; separation: its row; the others: rows of samples."""
    show = lambda x: "n/a" if x is None or x != x else f"{x:.4f}"
    out = ["calibration", ""]
    for r in sorted(sides, key=lambda r: not r["correct"]):
        stats = "  ".join(f"{k} {show(r[k])}" for k in ("min", "p05", "median", "p95", "max", "mean"))
        out.append(f"  {'correct' if r['correct'] else 'wrong':<8} n={r['n']:<6} {stats}")
    out += ["", f"  current floor {show(floor)} (unchanged by this report)"]
    out += [f"  {k.replace('_', ' ')}: {show(separation[k])}" for k in ("lowest_correct", "highest_wrong", "highest_must_refuse", "suggested_floor", "suggested_must_refuse_floor")]
    out += ["", f"  {describe(separation)}"]
    for title, rows in (("boundary.lowestCorrect", lowest), ("boundary.highestWrong", highest), ("mustRefuse.best", refused)):
        out += ["", f"  {title}", *(f"    {i:>2}. {r['score']:.4f}  {r['question_id']}  {r['chunk_id']}" for i, r in enumerate(rows, 1)), *([] if rows else ["    (none)"])]
    return "\n".join(out)


#: Said in every artifact, so that one that is read alone says what its numbers decide.
HEADLINE_RULE = "An answer to a question that had to be refused comes first in a report, before the table, whatever the rates are."
FLOOR_NOTE = "The floor is a committed constant of the code. This file measures where it could be; it does not move it."
PRICES = {"embeddingPerMillion": EMBEDDING_USD_PER_MILLION, "inputPerMillion": INPUT_USD_PER_MILLION, "outputPerMillion": OUTPUT_USD_PER_MILLION, "asOf": PRICES_AS_OF}


def gate_artifact(scores: DataFrame, categories: DataFrame, run: dict, usage: dict | None = None) -> dict:
    """What a run decided, with the policy and the prices it was decided by; usage is None if nothing was measured.

    run: generatedAt, embedder, generator, corpusDir, chunkCount, k and threshold.
    """
    rows = [r.asDict(True) for r in sorted(scores.collect(), key=lambda r: r["pos"])]
    gates = [r.asDict(True) for r in sorted(categories.collect(), key=lambda r: r["ord"])]
    failed = sorted((r for r in rows if not r["passed"]), key=lambda r: (not r["headline"], r["pos"]))
    return {
        "schemaVersion": SCHEMA_VERSION,
        "verdict": "PASS" if all(g["met"] for g in gates) else "FAIL",
        "run": run,
        "policy": {
            "categories": {c: {"label": a, "threshold": b} for c, (a, b) in GATE.items()}, "headlineFailureKinds": list(HEADLINE_KINDS), "headlineRule": HEADLINE_RULE,
        },
        "categories": gates,
        "headlineViolations": [r for r in failed if r["headline"]],
        "violations": failed,
        "questions": rows,
        "totals": {"questions": len(rows), "passed": sum(r["passed"] for r in rows)},
        "usage": usage and usage | {"pricing": PRICES},
    }


def calibration_artifact(sides: list, separation, lowest: list, highest: list, refused: list, floor: float, run: dict, usage: dict | None = None) -> dict:
    """What a calibration measured; arguments as of ``calibration_report``. Single scores are left out, they can be made again.

    usage: embedding_tokens, embedding_calls and latency_ms.
    """
    rows = lambda found: [r.asDict(True) for r in found]
    side = {r["correct"]: {k: v for k, v in r.asDict().items() if k != "correct"} for r in sides}
    ceiling = max((r["score"] for r in refused), default=None)
    return {
        "schemaVersion": SCHEMA_VERSION,
        "run": run,
        "correct": side.get(True),
        "wrong": side.get(False),
        "separation": separation.asDict(),
        "boundary": {"lowestCorrect": rows(lowest), "highestWrong": rows(highest)},
        "mustRefuse": {"ceiling": ceiling, "best": rows(refused)},
        "currentThreshold": floor,
        "thresholdNote": FLOOR_NOTE,
        "usage": usage and usage | {"cost_usd": usage["embedding_tokens"] / 1e6 * EMBEDDING_USD_PER_MILLION, "pricing": PRICES},
    }


def file_stamp(moment: str) -> str:
    return moment.replace(":", "-").replace(".", "-")


def write_pair(artifact: dict, folder: str, prefix: str, moment: str) -> list[str]:
    """The artifact under its time stamp and as the latest one; indented JSON and a line end."""
    import os

    os.makedirs(folder, exist_ok=True)
    paths = [os.path.join(folder, f"{prefix}-{s}.json") for s in (file_stamp(moment), "latest")]
    for p in paths:
        with open(p, "w", encoding="utf-8") as f:
            f.write(json.dumps(artifact, indent=2, ensure_ascii=False, default=str) + "\n")
    return paths


def load_fixture(path: str) -> dict:
    """A recorded response: an object with ``$provenance`` and ``response`` objects; returns the latter."""
    with open(path, encoding="utf-8") as f:
        body = json.load(f)
    if not (isinstance(body, dict) and isinstance(body.get("$provenance"), dict) and isinstance(body.get("response"), dict)):
        raise ValueError(f"{path} is no recorded response")
    return body["response"]
