"""JSON pointers over values: ``/a/b``, array indexes, and ``*`` for all elements; the empty pointer is the value itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Value, false, from_typed


class InvalidPointer(ValueError):
    """A pointer that is neither empty nor begins with a slash."""


def parse(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise InvalidPointer(pointer)
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]


@dataclass
class Matches:
    """What a pointer resolves to: how many values, a test of all of them, a test of the first, and a text of each, in order."""

    count: Column
    all: Callable[[Callable[[Value], Column]], Column]
    first: Callable[[Callable[[Value], Column]], Column]
    each: Callable[[Callable[[Value], Column]], Column]
    single: Value | None = None


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _one(v: Value) -> Matches:
    there = v.present
    return Matches(F.when(there, 1).otherwise(0), lambda f: ~there | f(v), lambda f: F.when(there, f(v)), lambda f: F.when(there, F.array(f(v))).otherwise(_no_texts()), v)


def _none() -> Matches:
    return Matches(F.lit(0), lambda f: F.lit(True), lambda f: F.lit(None), lambda f: _no_texts())


def element(v: Value, k: int) -> Value | None:
    """The k-th element of an array value; None if the value can't be an array."""
    found = v.elements()
    if found is None:
        return None
    arr, kind = found
    inner = from_typed(F.get(arr, k), kind)
    there = F.coalesce(v.is_arr & (F.size(arr) > k), false())
    return Value(**{**inner.__dict__, "present_": there, "null_": inner.null & there})


def resolve(v: Value, parts: list[str]) -> Matches:
    if not parts:
        return _one(v)
    head, rest = parts[0], parts[1:]
    if head == "*":
        found = v.elements()
        if found is None:
            return _none()
        arr, kind = found
        inner = lambda x: resolve(from_typed(x, kind), rest)
        counts = F.aggregate(F.coalesce(F.transform(arr, lambda x: inner(x).count), F.array().cast("array<int>")), F.lit(0), lambda a, c: a + c)
        return Matches(F.when(v.is_arr, counts).otherwise(0), lambda f: F.coalesce(F.forall(arr, lambda x: inner(x).all(f)), F.lit(True)), lambda f: F.get(F.filter(F.transform(arr, lambda x: inner(x).first(f)), lambda x: x.isNotNull()), 0), lambda f: F.when(v.is_arr, F.flatten(F.transform(arr, lambda x: inner(x).each(f)))).otherwise(_no_texts()))
    if head.isdigit():  # a numeric part is an index, never a key
        at = element(v, int(head))
        return resolve(at, rest) if at is not None else _none()
    return resolve(v.member(head), rest)


def lookup(v: Value, pointer: str) -> Matches:
    return resolve(v, parse(pointer))
