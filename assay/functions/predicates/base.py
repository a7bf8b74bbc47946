"""How predicates are declared: ``fn(column, args)`` over texts, or ``fn(value, args)`` over any value."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column

from assay.plans.values import Value, false

BUILT_IN: dict[str, Callable[[Value, dict], Column]] = {}


def on_value(*names: str):
    def add(fn: Callable[[Value, dict], Column]):
        for name in names:
            BUILT_IN[name] = fn
        return fn

    return add


def on_text(*names: str):
    """A predicate of texts; every other kind of value fails it."""

    def add(fn: Callable[[Column, dict], Column]):
        on_value(*names)(lambda v, args: false() if v.str is None else fn(v.str, args))
        return fn

    return add


def flag(args: dict, name: str, default: bool) -> bool:
    """A boolean argument; other kinds count as not given."""
    got = args.get(name)
    return got if isinstance(got, bool) else default


def word(args: dict, name: str, default: str | None = None) -> str | None:
    got = args.get(name)
    return got if isinstance(got, str) else default


def count(args: dict, name: str, default: int) -> int:
    got = args.get(name)
    return got if isinstance(got, int) and not isinstance(got, bool) and got >= 0 else default


def any_of(conditions: list[Any]) -> Column:
    out = false()
    for c in conditions:
        out = out | c
    return out
