"""The portable schema: parsing with structure checks, references, serialization, and analysis that needs no data."""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import dataclass, field
from typing import Any

SCALARS = ("string", "number", "integer", "int32", "int64", "uint32", "uint64", "boolean", "money", "currency", "decimal", "percentage", "date")
TYPES = (*SCALARS, "object", "array", "tuple", "enum", "literal", "never", "union", "intersection", "record", "preprocess", "catch", "ref", "any")
NODES = (
    "regex", "template_literal", "min_len", "max_len", "range", "exists", "eq", "in", "required_with", "required_without", "exactly_one_of", "eq_fields",
    "gt_field", "gte_field", "lt_field", "lte_field", "sum_equals", "sum_equals_value", "and", "or", "not", "implies", "call", "true", "false",
)
#: What each node needs.
NEEDS = {
    "regex": ("pattern",), "template_literal": ("parts",), "min_len": ("len",), "max_len": ("len",), "exists": ("path",), "eq": ("path", "value"), "in": ("path", "values"),
    "required_with": ("field", "with"), "required_without": ("field", "without"), "exactly_one_of": ("paths",), "eq_fields": ("left", "right"), "gt_field": ("left", "right"),
    "gte_field": ("left", "right"), "lt_field": ("left", "right"), "lte_field": ("left", "right"), "sum_equals": ("paths", "target"), "sum_equals_value": ("paths", "value"),
    "and": ("predicates",), "or": ("predicates",), "not": ("predicate",), "implies": ("if", "then"), "call": ("name",),
}
MAX_DEPTH = 128


class SchemaParseError(ValueError):
    """A malformed schema; ``path`` points at the place."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path or '/'}: {message}")
        self.path = path


@dataclass
class Schema:
    """A schema document. ``extra`` keeps what is carried but never evaluated."""

    root: dict
    version: str = "1.0"
    id: str | None = None
    title: str | None = None
    description: str | None = None
    definitions: dict[str, dict] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def from_json(source: str | dict | "Schema") -> "Schema":
        """A schema from JSON text or its parsed form; a bare type is the root of a schema without definitions."""
        if isinstance(source, Schema):
            return source
        data = json.loads(source) if isinstance(source, str) else deepcopy(source)
        if not isinstance(data, dict):
            raise SchemaParseError("", "a schema is an object")
        if "root" not in data and "type" in data or "$ref" in data:
            data = {"root": data}
        if "root" not in data:
            raise SchemaParseError("/root", "missing")
        known = {k: data[k] for k in ("id", "title", "description") if data.get(k) is not None}
        definitions = data.get("definitions") or {}
        if not isinstance(definitions, dict):
            raise SchemaParseError("/definitions", "expected an object")
        return Schema(
            root=parse_type(data["root"], "/root"),
            version=str(data.get("version", "1.0")),
            definitions={k: parse_type(v, f"/definitions/{k}") for k, v in definitions.items()},
            extra={k: v for k, v in data.items() if k not in ("root", "version", "definitions", "id", "title", "description")},
            **known,
        )

    def to_dict(self) -> dict:
        out: dict[str, Any] = {"version": self.version, **{k: v for k in ("id", "title", "description") if (v := getattr(self, k)) is not None}, **self.extra}
        if self.definitions:
            out["definitions"] = deepcopy(self.definitions)
        return out | {"root": deepcopy(self.root)}

    def to_json(self, **options: Any) -> str:
        return json.dumps(self.to_dict(), **options)

    def resolve(self, name: str) -> dict | None:
        return self.definitions.get(name.removeprefix("#/definitions/"))


def _need(data: dict, key: str, path: str, kind: type | tuple) -> Any:
    if key not in data:
        raise SchemaParseError(f"{path}/{key}", "missing")
    if not isinstance(data[key], kind) or isinstance(data[key], bool) and kind is not bool:
        raise SchemaParseError(f"{path}/{key}", f"unexpected {type(data[key]).__name__}")
    return data[key]


def parse_type(data: Any, path: str) -> dict:
    """A type with its parts parsed and legacy spellings replaced."""
    if not isinstance(data, dict):
        raise SchemaParseError(path, "a type is an object")
    out = dict(data)
    if "$ref" in out:
        out["type"] = "ref"
    kind = out.get("type")
    if kind not in TYPES:
        raise SchemaParseError(f"{path}/type", f"unknown type {kind!r}")
    if kind == "ref":
        _need(out, "$ref", path, str)
    if "transforms" in out:
        for k, t in enumerate(out["transforms"] or []):
            if not isinstance(t, dict) or not isinstance(t.get("fn"), str):
                raise SchemaParseError(f"{path}/transforms/{k}", "a transform is an object with fn")
    if "constraints" in out:
        out["constraints"] = [parse_constraint(c, f"{path}/constraints/{k}") for k, c in enumerate(out["constraints"] or [])]
    if kind == "object":
        if "fields" in out and "properties" not in out:
            out["properties"] = out.pop("fields")
        properties = out.get("properties", {})
        if not isinstance(properties, dict):
            raise SchemaParseError(f"{path}/properties", "expected an object")
        out["properties"] = {k: parse_type(v, f"{path}/properties/{k}") for k, v in properties.items()}
        if out.get("unknown_keys") not in (None, "strict", "strip", "passthrough"):
            raise SchemaParseError(f"{path}/unknown_keys", "expected strict, strip or passthrough")
        if out.get("catchall") is not None:
            out["catchall"] = parse_type(out["catchall"], f"{path}/catchall")
        out["rules"] = [parse_constraint(c, f"{path}/rules/{k}") for k, c in enumerate(out.get("rules") or [])]
    elif kind == "array":
        out["items"] = parse_type(_need(out, "items", path, dict), f"{path}/items")
    elif kind == "tuple":
        out["items"] = [parse_type(t, f"{path}/items/{k}") for k, t in enumerate(_need(out, "items", path, list))]
    elif kind == "enum":
        _need(out, "values", path, list)
    elif kind == "literal":
        if "value" not in out:
            raise SchemaParseError(f"{path}/value", "missing")
    elif kind in ("union", "intersection"):
        key = "oneOf" if kind == "union" else "allOf"
        out[key] = [parse_type(t, f"{path}/{key}/{k}") for k, t in enumerate(_need(out, key, path, list))]
    elif kind == "record":
        out["value"] = parse_type(_need(out, "value", path, dict), f"{path}/value")
        if out.get("key") is not None:
            out["key"] = parse_type(out["key"], f"{path}/key")
    elif kind in ("preprocess", "catch"):
        out["schema"] = parse_type(_need(out, "schema", path, dict), f"{path}/schema")
    return out


#: Codes of the legacy constraint spellings; fixed values.
LEGACY_CODES = {"pattern": "PATTERN_MISMATCH", "maxLength": "MAX_LENGTH_EXCEEDED", "minLength": "MIN_LENGTH_NOT_MET", "format": "FORMAT_INVALID", "enum": "INVALID_ENUM"}


def parse_constraint(data: Any, path: str) -> dict:
    """A constraint ``{pred, error}``; the legacy ``{type, value}`` spelling is rewritten."""
    if not isinstance(data, dict):
        raise SchemaParseError(path, "a constraint is an object")
    if "pred" in data:
        error = data.get("error")
        if not isinstance(error, dict) or not isinstance(error.get("code"), str):
            raise SchemaParseError(f"{path}/error", "an error has a code")
        if error.get("severity", "error") not in ("error", "warning"):
            raise SchemaParseError(f"{path}/error/severity", "expected error or warning")
        return {**data, "pred": parse_predicate(data["pred"], f"{path}/pred"), "error": {"message": "", "severity": "error", **error}}
    kind = data.get("type")
    if kind not in LEGACY_CODES:
        raise SchemaParseError(path, "a constraint has pred or a known type")
    value = data.get("values", data.get("value")) if kind == "enum" else data.get("value")
    if value is None:
        raise SchemaParseError(f"{path}/value", "missing")
    pred, said = {
        "pattern": lambda: ({"type": "regex", "pattern": value}, f"Must match pattern {value}"),
        "maxLength": lambda: ({"type": "max_len", "len": value}, f"Must be at most {value} characters"),
        "minLength": lambda: ({"type": "min_len", "len": value}, f"Must be at least {value} characters"),
        "format": lambda: ({"type": "call", "name": f"format:{value}"}, f"Must be in {value} format"),
        "enum": lambda: ({"type": "in", "path": "", "values": value}, f"Must be one of: {json.dumps(value, separators=(',', ':'))}"),
    }[kind]()
    error = {"code": LEGACY_CODES[kind], "message": data.get("message") or said, "severity": "error"}
    return {"pred": pred, "error": error | ({"source": data["source"]} if data.get("source") else {})}


def parse_predicate(data: Any, path: str, depth: int = 0) -> dict:
    """A predicate tree; nesting beyond the limit raises."""
    if depth > MAX_DEPTH:
        raise SchemaParseError(path, "predicates are nested too deeply")
    if not isinstance(data, dict) or data.get("type") not in NODES:
        raise SchemaParseError(path, f"unknown predicate {data.get("type") if isinstance(data, dict) else data!r}")
    for key in NEEDS.get(data["type"], ()):
        if key not in data:
            raise SchemaParseError(f"{path}/{key}", "missing")
    out = dict(data)
    for key in ("predicate", "if", "then"):
        if key in out and isinstance(out[key], dict):
            out[key] = parse_predicate(out[key], f"{path}/{key}", depth + 1)
    if "predicates" in out:
        out["predicates"] = [parse_predicate(p, f"{path}/predicates/{k}", depth + 1) for k, p in enumerate(out["predicates"])]
    return out


# ---------------------------------------------------------------- analysis


def has_default(node: dict) -> bool:
    return any(t["fn"] == "default" for t in node.get("transforms") or [])


def fills_missing(schema: Schema, node: dict, seen: tuple = ()) -> bool:
    """A missing member gets a value from a default."""
    if has_default(node):
        return True
    if node["type"] in ("preprocess", "catch"):
        return fills_missing(schema, node["schema"], seen)
    if node["type"] == "ref" and node["$ref"] not in seen and (target := schema.resolve(node["$ref"])):
        return fills_missing(schema, target, (*seen, node["$ref"]))
    return False


def allows_null(schema: Schema, node: dict, seen: tuple = ()) -> bool:
    """A required member may be null."""
    kind = node["type"]
    if has_default(node) or kind == "any":
        return True
    if kind == "literal":
        return node["value"] is None
    if kind == "enum":
        return any(v is None for v in node["values"])
    if kind == "union":
        return any(allows_null(schema, v, seen) for v in node["oneOf"])
    if kind in ("preprocess", "catch"):
        return allows_null(schema, node["schema"], seen)
    if kind == "ref" and node["$ref"] not in seen and (target := schema.resolve(node["$ref"])):
        return allows_null(schema, target, (*seen, node["$ref"]))
    return False


def _refs(x: Any) -> list[str]:
    """The definitions that a node refers to, once for each place."""
    if isinstance(x, list):
        return [r for y in x for r in _refs(y)]
    if not isinstance(x, dict):
        return []
    own = [x["$ref"].removeprefix("#/definitions/")] if x.get("type") == "ref" else []
    return own + [r for y in x.values() for r in _refs(y)]


def recursive(schema: Schema) -> set[str]:
    """The definitions that refer to themselves, if by way of others."""
    to, found = {name: _refs(node) for name, node in schema.definitions.items()}, set()
    for name in to:
        seen, todo = set(), list(to[name])
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += to.get(at, ())
        found |= {name} & seen
    return found


def unrolls(schema: Schema) -> int:
    """How often a reference is worth opening inside itself: a choice, an intersection or a second reference multiplies
    the expression at each level, a single reference adds to it."""
    names = recursive(schema)

    def branches(x: Any) -> bool:
        if isinstance(x, list):
            return any(map(branches, x))
        return isinstance(x, dict) and (x.get("type") in ("union", "intersection", "catch") or any(map(branches, x.values())))

    simple = all(sum(r in names for r in _refs(schema.definitions[n])) <= 1 and not branches(schema.definitions[n]) for n in names)
    return 4 if simple else 1


def chained(schema: Schema) -> bool:
    """Whether values nest in themselves as lists do: each at one place at most, and none of them by a choice or in a collection."""
    names, reach = recursive(schema), set()
    while (more := reach | names | {n for n, x in schema.definitions.items() if reach & set(_refs(x))}) != reach:
        reach = more

    def spreads(x: Any) -> bool:
        if isinstance(x, list):
            return any(map(spreads, x))
        if not isinstance(x, dict):
            return False
        wide = x if x.get("type") in ("union", "intersection", "catch", "array", "record") else x.get("catchall")
        return bool(wide and reach & set(_refs(wide))) or any(map(spreads, x.values()))

    return not any(map(spreads, [schema.root, *schema.definitions.values()])) and all(sum(r in names for r in _refs(schema.definitions[n])) <= 1 for n in names)


def required(node: dict) -> bool:
    return node.get("required", True) is not False


def value_kind(node: dict) -> str:
    """The kind of a node's normalized values, seen through wrappers."""
    while node["type"] in ("preprocess", "catch"):
        node = node["schema"]
    return node["type"]
