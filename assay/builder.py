"""A fluent way to write schemas: ``w.object(email=w.string().trim().email())``. Everything desugars to the portable schema."""

from __future__ import annotations

import re
from copy import deepcopy
from typing import Any

from assay.plans import ir


def _code(name: str) -> str:
    return "INVALID_" + re.sub(r"^(IS_|FORMAT:)", "", name.upper()).replace("-", "_")


class Type:
    """A type under construction; every method returns a new one."""

    def __init__(self, node: dict):
        self.node = node

    def _with(self, **changes: Any) -> "Type":
        return type(self)({**deepcopy(self.node), **changes})

    def to_dict(self) -> dict:
        return deepcopy(self.node)

    def to_schema(self, version: str = "1.0", **meta: Any) -> ir.Schema:
        return ir.Schema.from_json({"version": version, **meta, "root": self.to_dict()})

    def to_json(self, version: str = "1.0", **meta: Any) -> str:
        return self.to_schema(version, **meta).to_json()

    # ---- flags and wrappers
    def optional(self) -> "Type":
        return self._with(required=False)

    def nullable(self) -> "Type":
        return Type({"type": "union", "oneOf": [self.to_dict(), {"type": "literal", "value": None}], **({"required": False} if self.node.get("required") is False else {})})

    def nullish(self) -> "Type":
        return self.nullable().optional()

    def preprocess(self, *transforms: dict) -> "Type":
        return Type({"type": "preprocess", "transforms": list(transforms), "schema": self.to_dict()})

    def catch(self, value: Any) -> "Type":
        return Type({"type": "catch", "schema": self.to_dict(), "value": value})

    def describe(self, text: str) -> "Type":
        return self._with(description=text)

    def label(self, text: str) -> "Type":
        return self._with(label=text)

    # ---- transforms and constraints
    def transform(self, fn: str, **args: Any) -> "Type":
        return self._with(transforms=[*self.node.get("transforms", []), {"fn": fn, **args}])

    def default(self, value: Any) -> "Type":
        return self.transform("default", value=value)

    def check(self, pred: dict, code: str, message: str = "", **error: Any) -> "Type":
        return self._with(constraints=[*self.node.get("constraints", []), {"pred": pred, "error": {"code": code, "message": message, **error}}])

    def satisfies(self, name: str, code: str | None = None, message: str = "", severity: str = "error", **args: Any) -> "Type":
        """A named predicate."""
        pred = {"type": "call", "name": name, **({"args": args} if args else {})}
        return self.check(pred, code or _code(name), message or f"must satisfy {name}", severity=severity)

    def regex(self, pattern: str, flags: str | None = None, code: str = "PATTERN_MISMATCH", message: str = "") -> "Type":
        return self.check({"type": "regex", "pattern": pattern, **({"flags": flags} if flags else {})}, code, message or f"must match {pattern}")

    def range(self, low: float | None = None, high: float | None = None, code: str = "OUT_OF_RANGE", message: str = "") -> "Type":
        pred = {"type": "range", **({} if low is None else {"min": low}), **({} if high is None else {"max": high})}
        return self.check(pred, code, message or "out of range")

    def __getattr__(self, name: str) -> Any:
        """Every transform and named predicate is a method: ``trim()``, ``digits_only()``, ``email()``, ``is_ssn()``, ``one_of_...``."""
        from assay.functions.predicates import BUILT_IN
        from assay.functions.transforms import TRANSFORMS

        if name.startswith("_"):
            raise AttributeError(name)
        if name in TRANSFORMS:
            return lambda **args: self.transform(name, **args)
        for known in (name, f"is_{name}"):
            if known in BUILT_IN:
                return lambda **args: self.satisfies(known, **args)
        raise AttributeError(name)


class StringType(Type):
    def min_length(self, n: int, code: str = "TOO_SHORT", message: str = "") -> "Type":
        return self.check({"type": "min_len", "len": n}, code, message or f"at least {n} characters")

    def max_length(self, n: int, code: str = "TOO_LONG", message: str = "") -> "Type":
        return self.check({"type": "max_len", "len": n}, code, message or f"at most {n} characters")

    def length(self, n: int) -> "Type":
        return self.min_length(n).max_length(n)  # type: ignore[attr-defined]

    def non_empty(self) -> "Type":
        return self.min_length(1, "REQUIRED", "required")

    def replace(self, pattern: str, replacement: str) -> "Type":
        return self.transform("replace", pattern=pattern, replacement=replacement)

    def template(self, *parts: dict, code: str = "TEMPLATE_MISMATCH") -> "Type":
        return self.check({"type": "template_literal", "parts": list(parts)}, code, "must match the template")


class NumberType(Type):
    def min(self, n: float) -> "Type":
        return self.range(n, None, "TOO_SMALL", f"at least {n}")

    def max(self, n: float) -> "Type":
        return self.range(None, n, "TOO_LARGE", f"at most {n}")

    def non_negative(self) -> "Type":
        return self.satisfies("is_non_negative")

    def multiple_of(self, step: float) -> "Type":
        return self.satisfies("is_multiple_of", value=step)


class ArrayType(Type):
    def min_items(self, n: int) -> "Type":
        return self._with(min_items=n).check({"type": "min_len", "len": n}, "ARRAY_TOO_SHORT", f"at least {n} items")

    def max_items(self, n: int) -> "Type":
        return self._with(max_items=n).check({"type": "max_len", "len": n}, "ARRAY_TOO_LONG", f"at most {n} items")

    def non_empty(self) -> "Type":
        return self.min_items(1)

    def length(self, n: int) -> "Type":
        return self.min_items(n).max_items(n)  # type: ignore[attr-defined]


def _path(field: str) -> str:
    return field if field.startswith("/") else "/" + field.replace("~", "~0").replace("/", "~1")


class ObjectType(Type):
    """Objects: unknown keys, cross-field rules and schema algebra."""

    def strict(self) -> "ObjectType":
        return self._with(unknown_keys="strict")  # type: ignore[return-value]

    def strip(self) -> "ObjectType":
        return self._with(unknown_keys="strip")  # type: ignore[return-value]

    def passthrough(self) -> "ObjectType":
        return self._with(unknown_keys="passthrough")  # type: ignore[return-value]

    def additional_properties(self, allowed: bool) -> "ObjectType":
        return self.passthrough() if allowed else self.strict()

    def catchall(self, type_: Type) -> "ObjectType":
        return self._with(catchall=type_.to_dict())  # type: ignore[return-value]

    def rule(self, pred: dict, code: str, message: str = "", **error: Any) -> "ObjectType":
        return self._with(rules=[*self.node.get("rules", []), {"pred": pred, "error": {"code": code, "message": message, **error}}])  # type: ignore[return-value]

    def require_with(self, field: str, other: str, code: str = "REQUIRED_WITH") -> "ObjectType":
        return self.rule({"type": "required_with", "field": _path(field), "with": _path(other)}, code, f"{field} is required with {other}", path=_path(field))

    def require_without(self, field: str, other: str, code: str = "REQUIRED_WITHOUT") -> "ObjectType":
        return self.rule({"type": "required_without", "field": _path(field), "without": _path(other)}, code, f"{field} is required without {other}", path=_path(field))

    def mutually_exclusive(self, a: str, b: str, code: str = "MUTUALLY_EXCLUSIVE") -> "ObjectType":
        both = {"type": "and", "predicates": [{"type": "exists", "path": _path(a)}, {"type": "exists", "path": _path(b)}]}
        return self.rule({"type": "not", "predicate": both}, code, f"{a} excludes {b}")

    def require_one_of(self, *fields: str, code: str = "REQUIRE_ONE_OF") -> "ObjectType":
        return self.rule({"type": "or", "predicates": [{"type": "exists", "path": _path(f)} for f in fields]}, code, f"one of {', '.join(fields)} is required")

    def require_exactly_one_of(self, *fields: str, code: str = "REQUIRE_EXACTLY_ONE_OF") -> "ObjectType":
        return self.rule({"type": "exactly_one_of", "paths": [_path(f) for f in fields]}, code, f"exactly one of {', '.join(fields)} is required")

    def require_fields_match(self, a: str, b: str, code: str = "FIELDS_MUST_MATCH") -> "ObjectType":
        return self.rule({"type": "eq_fields", "left": _path(a), "right": _path(b)}, code, f"{a} must equal {b}", path=_path(b))

    def _compare(self, op: str, a: str, b: str, code: str) -> "ObjectType":
        return self.rule({"type": op, "left": _path(a), "right": _path(b)}, code, f"{a} against {b}", path=_path(a))

    def require_field_greater_than(self, a: str, b: str, code: str = "FIELD_NOT_GREATER") -> "ObjectType":
        return self._compare("gt_field", a, b, code)

    def require_field_greater_or_equal(self, a: str, b: str, code: str = "FIELD_NOT_GREATER_OR_EQUAL") -> "ObjectType":
        return self._compare("gte_field", a, b, code)

    def require_field_less_than(self, a: str, b: str, code: str = "FIELD_NOT_LESS") -> "ObjectType":
        return self._compare("lt_field", a, b, code)

    def require_field_less_or_equal(self, a: str, b: str, code: str = "FIELD_NOT_LESS_OR_EQUAL") -> "ObjectType":
        return self._compare("lte_field", a, b, code)

    def require_sum(self, fields: list[str], target: str, code: str = "SUM_MISMATCH") -> "ObjectType":
        return self.rule({"type": "sum_equals", "paths": [_path(f) for f in fields], "target": _path(target)}, code, f"must sum to {target}", path=_path(target))

    def require_sum_equals(self, fields: list[str], value: float, code: str = "SUM_MISMATCH") -> "ObjectType":
        return self.rule({"type": "sum_equals_value", "paths": [_path(f) for f in fields], "value": value}, code, f"must sum to {value}")

    # ---- algebra
    def extend(self, **members: Type) -> "ObjectType":
        return self._with(properties={**self.node["properties"], **{k: t.to_dict() for k, t in members.items()}})  # type: ignore[return-value]

    def merge(self, other: "ObjectType") -> "ObjectType":
        return ObjectType({**deepcopy(self.node), **{k: v for k, v in deepcopy(other.node).items() if k not in ("properties", "rules")}, "properties": {**self.node["properties"], **other.node["properties"]}, "rules": [*self.node.get("rules", []), *other.node.get("rules", [])]})

    def pick(self, *keys: str) -> "ObjectType":
        return self._with(properties={k: v for k, v in self.node["properties"].items() if k in keys}, rules=[])  # type: ignore[return-value]

    def omit(self, *keys: str) -> "ObjectType":
        return self._with(properties={k: v for k, v in self.node["properties"].items() if k not in keys}, rules=[])  # type: ignore[return-value]

    def partial(self, *keys: str) -> "ObjectType":
        return self._with(properties={k: {**v, "required": False} if not keys or k in keys else v for k, v in self.node["properties"].items()})  # type: ignore[return-value]

    def required(self, *keys: str) -> "ObjectType":
        return self._with(properties={k: {**v, "required": True} if not keys or k in keys else v for k, v in self.node["properties"].items()})  # type: ignore[return-value]

    def when(self, field: str) -> "Condition":
        return Condition(self, [], "and", field)


class Condition:
    """``when(field).equals(x).require(other)``: a condition on members and what then must hold."""

    def __init__(self, owner: ObjectType, tests: list[dict], joined: str, field: str):
        self.owner, self.tests, self.joined, self.field = owner, tests, joined, field

    def _test(self, pred: dict) -> "Condition":
        return Condition(self.owner, [*self.tests, pred], self.joined, self.field)

    def equals(self, value: Any) -> "Condition":
        return self._test({"type": "eq", "path": _path(self.field), "value": value})

    def not_equals(self, value: Any) -> "Condition":
        return self._test({"type": "not", "predicate": {"type": "eq", "path": _path(self.field), "value": value}})

    def in_(self, *values: Any) -> "Condition":
        return self._test({"type": "in", "path": _path(self.field), "values": list(values)})

    def exists(self) -> "Condition":
        return self._test({"type": "exists", "path": _path(self.field)})

    def not_exists(self) -> "Condition":
        return self._test({"type": "not", "predicate": {"type": "exists", "path": _path(self.field)}})

    def gte(self, n: float) -> "Condition":
        """As in the portable schema, a range without a path: it tests the object itself, so the rule never fires."""
        return self._test({"type": "range", "min": n})

    def lte(self, n: float) -> "Condition":
        """See ``gte``."""
        return self._test({"type": "range", "max": n})

    def and_(self, field: str) -> "Condition":
        return Condition(self.owner, self.tests, "and", field)

    def or_(self, field: str) -> "Condition":
        return Condition(self.owner, self.tests, "or", field)

    def then(self, pred: dict, code: str, message: str = "", **error: Any) -> ObjectType:
        test = self.tests[0] if len(self.tests) == 1 else {"type": self.joined, "predicates": self.tests}
        return self.owner.rule({"type": "implies", "if": test, "then": pred}, code, message, **error)

    def require(self, field: str, code: str = "CONDITIONAL_REQUIRED") -> ObjectType:
        return self.then({"type": "exists", "path": _path(field)}, code, f"{field} is required", path=_path(field))

    def forbid(self, field: str, code: str = "CONDITIONAL_FORBIDDEN") -> ObjectType:
        return self.then({"type": "not", "predicate": {"type": "exists", "path": _path(field)}}, code, f"{field} is not allowed", path=_path(field))

    def require_equals(self, field: str, value: Any, code: str = "CONDITIONAL_EQUALS") -> ObjectType:
        return self.then({"type": "eq", "path": _path(field), "value": value}, code, f"{field} must equal {value}", path=_path(field))

    def require_in(self, field: str, *values: Any, code: str = "CONDITIONAL_IN") -> ObjectType:
        return self.then({"type": "in", "path": _path(field), "values": list(values)}, code, f"{field} must be listed", path=_path(field))

    def require_match(self, field: str, pattern: str, code: str = "CONDITIONAL_MATCH") -> ObjectType:
        """As in the portable schema, the pattern has no path and objects pass it, so only existence counts."""
        return self.then({"type": "and", "predicates": [{"type": "exists", "path": _path(field)}, {"type": "regex", "pattern": pattern}]}, code, f"{field} must match", path=_path(field))

    def require_predicate(self, pred: dict, code: str, message: str = "") -> ObjectType:
        return self.then(pred, code, message)


class _Factory:
    """``w``: one factory for each type."""

    def string(self) -> StringType:
        return StringType({"type": "string"})

    def any(self) -> Type:
        return Type({"type": "any"})

    def ref(self, name: str) -> Type:
        return Type({"type": "ref", "$ref": name})

    def boolean(self) -> Type:
        return Type({"type": "boolean"})

    def date(self, format: str | None = None) -> StringType:
        return StringType({"type": "date", **({"format": format} if format else {})})

    def currency(self, code: str = "USD", scale: int = 2) -> NumberType:
        return NumberType({"type": "currency", "code": code, "scale": scale})

    def decimal(self, precision: int | None = None, scale: int | None = None) -> NumberType:
        return NumberType({"type": "decimal", **({} if precision is None else {"precision": precision}), **({} if scale is None else {"scale": scale})})

    def percentage(self, format: str = "whole", allow_over_100: bool = False, scale: int | None = None) -> NumberType:
        return NumberType({"type": "percentage", "format": format, "allow_over_100": allow_over_100, **({} if scale is None else {"scale": scale})})

    def object(self, members: dict[str, Type] | None = None, **more: Type) -> ObjectType:
        return ObjectType({"type": "object", "properties": {k: t.to_dict() for k, t in {**(members or {}), **more}.items()}, "rules": []})

    def array(self, items: Type) -> ArrayType:
        return ArrayType({"type": "array", "items": items.to_dict()})

    def tuple(self, *items: Type) -> Type:
        return Type({"type": "tuple", "items": [t.to_dict() for t in items]})

    def enum(self, *values: Any) -> Type:
        return Type({"type": "enum", "values": list(values)})

    def literal(self, value: Any) -> Type:
        return Type({"type": "literal", "value": value})

    def never(self) -> Type:
        return Type({"type": "never"})

    def union(self, *variants: Type) -> Type:
        return Type({"type": "union", "oneOf": [t.to_dict() for t in variants]})

    def intersection(self, *parts: Type) -> Type:
        return Type({"type": "intersection", "allOf": [t.to_dict() for t in parts]})

    def record(self, value: Type, key: Type | None = None) -> Type:
        return Type({"type": "record", "value": value.to_dict(), **({} if key is None else {"key": key.to_dict()})})

    def nullable(self, type_: Type) -> Type:
        return type_.nullable()

    def nullish(self, type_: Type) -> Type:
        return type_.nullish()

    def preprocess(self, type_: Type, *transforms: dict) -> Type:
        return type_.preprocess(*transforms)

    def catch(self, type_: Type, value: Any) -> Type:
        return type_.catch(value)

    def __getattr__(self, name: str) -> Any:
        if name in ("number", "integer", "int32", "int64", "uint32", "uint64", "money"):
            return lambda: NumberType({"type": name})
        raise AttributeError(name)


w = _Factory()


# Template segments.
def lit(value: str) -> dict:
    return {"kind": "literal", "value": value}


def seg(kind: str, low: int | None = None, high: int | None = None) -> dict:
    return {"kind": kind, **({} if low is None else {"min": low}), **({} if high is None else {"max": high})}
