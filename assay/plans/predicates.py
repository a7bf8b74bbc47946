"""From predicate trees to boolean columns. Every leaf is two-valued: what can't be decided is false, never null."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pointer
from .registry import Registry
from .values import as_key, Value, equals, false, same, true

#: Characters that each kind of template segment takes; fixed values.
SEGMENTS = {"digits": "[0-9]", "ascii_letters": "[A-Za-z]", "ascii_alphanumeric": "[A-Za-z0-9]", "uppercase": "[A-Z]", "lowercase": "[a-z]", "hex": "[0-9A-Fa-f]"}


class InvalidRegex(ValueError):
    """A pattern outside the portable dialect."""


def portable(pattern: str, flags: str | None = None) -> str:
    """A pattern of the linear-time dialect for Java: no look-around or back-references, ``$`` only at the very end, Unicode classes."""
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:[=!>]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise InvalidRegex(pattern)
    out, k, inside, multi = [], 0, False, "m" in (flags or "")
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(r"\z" if c == "$" and not inside and not multi else c)
        k += 1
    text = "".join(out)
    marks = "".join(f for f in "ims" if f in (flags or "")) + ("U" if re.search(r"\\[dwsbDWSB]", text) else "")
    return (f"(?{marks})" if marks else "") + text


def template(parts: list[dict]) -> str | None:
    """One pattern for a template's segments; None if it can never match."""
    out = []
    for part in parts:
        if part["kind"] == "literal":
            out.append(r"\Q" + part["value"].replace(r"\E", r"\E\\E\Q") + r"\E")
            continue
        if part["kind"] not in SEGMENTS:
            raise ValueError(f"unknown segment: {part['kind']}")
        low, high = part.get("min"), part.get("max")
        low = 1 if low is None else low
        if high is not None and low > high:
            return None
        out.append(f"{SEGMENTS[part['kind']]}{{{low},{'' if high is None else high}}}")
    return r"\A" + "".join(out) + r"\z"


def exists(v: Value, path: str) -> Column:
    found = pointer.lookup(v, path)
    return (found.count > 0) & found.all(lambda x: ~x.null)


def number_at(v: Value, path: str) -> Column:
    """The first match's number, null if there is none."""
    return pointer.lookup(v, path).first(lambda x: F.lit(None).cast("double") if x.num is None else x.num).cast("double")


def _two(c: Column) -> Column:
    return F.coalesce(c, false())


def compile_predicate(pred: dict, v: Value, registry: Registry, apply: bool = True) -> Column:
    """Whether the value satisfies the predicate."""
    kind = pred["type"]
    inner = lambda p: compile_predicate(p, v, registry)
    if kind in ("true", "false"):
        return F.lit(kind == "true")
    if kind == "regex":
        pattern = portable(pred["pattern"], pred.get("flags"))
        return true() if v.str is None else F.coalesce(v.str.rlike(pattern), true())
    if kind == "template_literal":
        pattern = template(pred["parts"])
        return true() if v.str is None else ~v.is_str if pattern is None else F.coalesce(v.str.rlike(pattern), true())
    if kind in ("min_len", "max_len"):
        fits = lambda n: n >= pred["len"] if kind == "min_len" else n <= pred["len"]
        ways = [] if v.str is None else [_two(fits(F.length(v.str)))]
        if (found := v.elements()) is not None:
            ways.append(_two(v.is_arr & fits(F.size(found[0]))))
        return reduce(lambda a, b: a | b, ways, false())
    if kind == "range":
        if v.num is None:
            return false()
        low, high = pred.get("min"), pred.get("max")
        out = v.is_num
        out = out if low is None else out & (v.num >= float(low))
        return _two(out if high is None else out & (v.num <= float(high)))
    if kind == "exists":
        return exists(v, pred["path"])
    if kind in ("eq", "in"):
        wanted = [pred["value"]] if kind == "eq" else pred["values"]
        found = pointer.lookup(v, pred["path"])
        return (found.count > 0) & found.all(lambda x: reduce(lambda a, b: a | b, (equals(x, y) for y in wanted), false()))
    if kind == "required_with":
        return ~exists(v, pred["with"]) | exists(v, pred["field"])
    if kind == "required_without":
        return exists(v, pred["without"]) | exists(v, pred["field"])
    if kind == "exactly_one_of":
        return reduce(lambda a, b: a + b, (exists(v, p).cast("int") for p in pred["paths"]), F.lit(0)) == 1
    if kind == "eq_fields":
        left, right = pointer.lookup(v, pred["left"]), pointer.lookup(v, pred["right"])
        if left.single is None or right.single is None:
            a, b = left.each(as_key), right.each(as_key)  # match by match, as many on both sides
            return _two((F.size(a) > 0) & (a == b))
        return (left.count > 0) & (right.count > 0) & same(left.single, right.single)
    if kind in ("gt_field", "gte_field", "lt_field", "lte_field"):
        left, right = number_at(v, pred["left"]), number_at(v, pred["right"])
        return _two({"gt_field": left > right, "gte_field": left >= right, "lt_field": left < right, "lte_field": left <= right}[kind])
    if kind in ("sum_equals", "sum_equals_value"):
        total = reduce(lambda a, b: a + b, (number_at(v, p) for p in pred["paths"]), F.lit(0.0))
        goal = number_at(v, pred["target"]) if kind == "sum_equals" else F.lit(float(pred["value"]))
        return _two(F.abs(total - goal) < 1e-10)
    if kind == "and":
        return reduce(lambda a, b: a & b, map(inner, pred["predicates"]), true())
    if kind == "or":
        return reduce(lambda a, b: a | b, map(inner, pred["predicates"]), false())
    if kind == "not":
        return ~inner(pred["predicate"])
    if kind == "implies":
        return ~inner(pred["if"]) | inner(pred["then"])
    return registry.evaluate(pred["name"], v, pred.get("args") or {})
