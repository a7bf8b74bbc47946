"""Named predicates: the built-in ones and a caller's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Value, false

Predicate = Callable[[Value, dict], Column]


class UnknownPredicate(KeyError):
    """A call names a predicate that is not registered; raised before any job starts."""


class Registry:
    """Predicates by name; a later registration replaces an earlier one."""

    def __init__(self, predicates: dict[str, Predicate] | None = None):
        self.predicates = dict(predicates or {})

    @staticmethod
    def default() -> "Registry":
        from assay.functions.predicates import BUILT_IN

        return Registry(BUILT_IN)

    def register(self, name: str, predicate: Predicate) -> "Registry":
        self.predicates[name] = predicate
        return self

    def register_text(self, name: str, test: Callable[[Column, dict], Column]) -> "Registry":
        """A predicate of texts; other kinds of value fail it."""
        return self.register(name, lambda v, args: false() if v.str is None else F.coalesce(test(v.str, args), false()))

    def names(self) -> list[str]:
        return sorted(self.predicates)

    def evaluate(self, name: str, v: Value, args: dict) -> Column:
        if name not in self.predicates:
            raise UnknownPredicate(name)
        return F.coalesce(self.predicates[name](v, args), false())
