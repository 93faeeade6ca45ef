"""Operators by name, with their parameters: what a caller may run on a DataFrame."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable

from pyspark.sql import DataFrame

_FOUND: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


def register(name: str, description: str, f: Callable[..., DataFrame]) -> None:
    if name in _FOUND:
        raise ValueError(f"{name} is there already")
    _FOUND[name] = description, f


def describe() -> list[dict]:
    """Name, description and parameters of each operator, in order of names."""
    return [{"name": n, "description": d, "parameters": [p for p in inspect.signature(f).parameters][1:]} for n, (d, f) in sorted(_FOUND.items())]


def run(name: str, df: DataFrame, arguments: str = "") -> DataFrame:
    """Runs an operator with JSON arguments; blank ones are none."""
    if name not in _FOUND:
        raise KeyError(f"unknown operator {name}")
    return _FOUND[name][1](df, **json.loads(arguments.strip() or "{}"))


def load() -> None:
    """Registers the library's own operators once."""
    from millrace.operators import chunking, code, conversation, keyphrase

    for name, description, f in (
        ("chunks", "Overlapping pieces of texts", chunking.chunks),
        ("key_phrases", "Best phrases of each text", keyphrase.key_phrases),
        ("line_stats", "Lines of code, comments and blanks", code.line_stats),
        ("turns", "Turns of conversations with their sizes", conversation.turns),
    ):
        if name not in _FOUND:
            register(name, description, f)
