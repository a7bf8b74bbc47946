"""Postal addresses, where the optional parser library ``postal`` is installed; its calls are batched through Arrow."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from assay.plans.registry import Registry
from assay.plans.values import false

from .base import flag, word

try:
    from postal.parser import parse_address
except ImportError:
    parse_address = None


def _parsed(test: Callable[[dict[str, str], dict], bool]):
    def predicate(v, args):
        if v.str is None:
            return false()

        @F.pandas_udf("boolean")
        def run(texts: pd.Series) -> pd.Series:
            parts = [{label: value for value, label in parse_address(t)} if t else {} for t in texts.fillna("")]
            return pd.Series([bool(p) and test(p, args) for p in parts], dtype="bool")

        return run(v.str)

    return predicate


def _us(parts: dict, args: dict) -> bool:
    needed = ("road", "city", "state", "postcode") if flag(args, "strict", True) else ("city", "state")
    return all(k in parts for k in needed)


def register(registry: Registry) -> Registry:
    """Add the four address predicates; raises if the parser is not installed."""
    if parse_address is None:
        raise ImportError("address predicates need the postal library")
    registry.register("is_parseable_address", _parsed(lambda p, a: True))
    registry.register("has_address_component", _parsed(lambda p, a: word(a, "component", "") in p))
    registry.register("is_us_address", _parsed(_us))
    return registry.register("address_component_matches", _parsed(lambda p, a: re.search(word(a, "pattern", "(?!)"), p.get(word(a, "component", ""), "\0")) is not None))
