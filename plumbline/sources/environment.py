"""Settings of the command line: .env files, keys and models."""

from __future__ import annotations

import os
from collections.abc import Mapping


def parse_dotenv(source: str) -> dict[str, str]:
    """KEY=value lines, any name before the first ``=``; full-line comments; optional ``export``; one layer of matching quotes goes.

    Lines end at line feeds, perhaps with a carriage return, and at nothing else.
    """
    out = {}
    for line in map(str.strip, source.split("\n")):
        if line.startswith("#"):
            continue
        name, found, value = line.removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if not found or not name:
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[name] = value
    return out


def read_dotenv(path: str) -> dict[str, str]:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return parse_dotenv(f.read())


def merge_environment(process: Mapping[str, str], dotenv: Mapping[str, str]) -> dict[str, str]:
    """Variables of the process go first unless they are blank."""
    return dict(dotenv) | {k: v for k, v in process.items() if v and v.strip()}


def resolve_keys(names: list[str], env: Mapping[str, str]) -> tuple[dict[str, str], list[str]]:
    """(values, problems): all that is missing is reported together, values never."""
    values, problems = {}, []
    for name in names:
        raw = env.get(name)
        if raw is None:
            problems.append(f"{name} is not set")
        elif not raw.strip():
            problems.append(f"{name} is set but empty")
        else:
            values[name] = raw.strip()
    return values, problems


def resolve_model(name: str, env: Mapping[str, str], fallback: str) -> str:
    return (env.get(name) or "").strip() or fallback
