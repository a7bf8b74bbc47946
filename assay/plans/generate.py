"""What a schema says about tables: Spark types, DDL and an OpenAPI description."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from .ir import Schema, allows_null, fills_missing, required

_SCALARS = {
    "string": T.StringType(), "date": T.StringType(), "number": T.DoubleType(), "percentage": T.DoubleType(), "integer": T.LongType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "boolean": T.BooleanType(), "money": T.LongType(), "never": T.NullType(), "any": T.VariantType(),
}


def _of_value(x: Any) -> T.DataType:
    return T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) else T.DoubleType() if isinstance(x, float) else T.StringType() if isinstance(x, str) else T.VariantType()


def spark_type(schema: Schema, node: dict, depth: int = 4) -> T.DataType:
    """The Spark type of a node's values; choices without a common type and deep recursion become variants."""
    kind = node["type"]
    if kind in _SCALARS:
        return _SCALARS[kind]
    if kind in ("currency", "decimal"):
        scale = node.get("scale")
        scale = 2 if scale is None and kind == "currency" else scale
        return T.DoubleType() if scale is None else T.DecimalType(max(node.get("precision") or 38, scale), scale)
    if kind == "object":
        return T.StructType([T.StructField(k, spark_type(schema, c, depth), not required(c) or allows_null(schema, c), _meta(c)) for k, c in node["properties"].items()])
    if kind == "array":
        return T.ArrayType(spark_type(schema, node["items"], depth))
    if kind == "tuple":
        return T.StructType([T.StructField(f"_{k}", spark_type(schema, c, depth)) for k, c in enumerate(node["items"])])
    if kind == "record":
        return T.MapType(T.StringType(), spark_type(schema, node["value"], depth))
    if kind in ("preprocess", "catch"):
        return spark_type(schema, node["schema"], depth)
    if kind == "ref":
        target = schema.resolve(node["$ref"])
        return T.VariantType() if target is None or depth == 0 else spark_type(schema, target, depth - 1)
    if kind in ("enum", "literal"):
        kinds = [_of_value(x) for x in (node["values"] if kind == "enum" else [node["value"]]) if x is not None]
    else:
        parts = [c for c in node.get("oneOf") or node.get("allOf") if c != {"type": "literal", "value": None}]
        kinds = [spark_type(schema, c, depth) for c in parts]
    return kinds[0] if kinds and all(k == kinds[0] for k in kinds) else T.VariantType()


def _meta(node: dict) -> dict:
    return {k: node[k] for k in ("label", "description", "section", "render", "acroform") if node.get(k) is not None}


def struct_type(schema: Any) -> T.StructType:
    """The columns of a table whose rows are the schema's root objects."""
    schema = Schema.from_json(schema)
    if schema.root["type"] != "object":
        raise ValueError("only an object has columns")
    return spark_type(schema, schema.root)  # type: ignore[return-value]


def ddl(schema: Any) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in struct_type(schema))


def openapi(schema: Any) -> dict:
    """A JSON-schema style description of the root and the definitions."""
    schema = Schema.from_json(schema)
    names = {"string": "string", "date": "string", "boolean": "boolean", "integer": "integer", "int32": "integer", "int64": "integer", "uint32": "integer", "uint64": "integer"}

    def describe(node: dict) -> dict:
        kind = node["type"]
        about = {k: node[k] for k in ("description",) if node.get(k)}
        if kind == "object":
            needed = [k for k, c in node["properties"].items() if required(c) and not fills_missing(schema, c)]
            return {"type": "object", "properties": {k: describe(c) for k, c in node["properties"].items()}, **({"required": needed} if needed else {}), **about}
        if kind == "array":
            return {"type": "array", "items": describe(node["items"]), **{a: node[b] for a, b in (("minItems", "min_items"), ("maxItems", "max_items")) if node.get(b) is not None}, **about}
        if kind == "tuple":
            return {"type": "array", "prefixItems": [describe(c) for c in node["items"]], **about}
        if kind == "record":
            return {"type": "object", "additionalProperties": describe(node["value"]), **about}
        if kind in ("enum", "literal"):
            return {"enum": node["values"] if kind == "enum" else [node["value"]], **about}
        if kind in ("union", "intersection"):
            key = "oneOf" if kind == "union" else "allOf"
            return {key: [describe(c) for c in node[key]], **about}
        if kind in ("preprocess", "catch"):
            return describe(node["schema"])
        if kind == "ref":
            return {"$ref": f"#/components/schemas/{node['$ref']}"}
        if kind in ("any", "never"):
            return {} if kind == "any" else {"not": {}}
        limits = {}
        for c in node.get("constraints") or []:
            p = c["pred"]
            limits |= {"min_len": lambda: {"minLength": p["len"]}, "max_len": lambda: {"maxLength": p["len"]}, "regex": lambda: {"pattern": p["pattern"]}}.get(p["type"], dict)()  # noqa: B023
            if p["type"] == "range":
                limits |= {k: p[m] for k, m in (("minimum", "min"), ("maximum", "max")) if m in p}
        return {"type": names.get(kind, "number"), **({"format": kind} if kind not in ("string", "number", "integer", "boolean") else {}), **limits, **about}

    return {"openapi": "3.1.0", "info": {"title": schema.title or schema.id or "schema", "version": schema.version}, "components": {"schemas": {"Root": describe(schema.root), **{k: describe(n) for k, n in schema.definitions.items()}}}}


def dataclasses_source(schema: Any, root_name: str = "Root") -> str:
    """Python source of dataclasses for the root and the definitions, nested objects as classes of their own."""
    schema = Schema.from_json(schema)
    done: list[str] = []
    plain = {"string": "str", "date": "str", "boolean": "bool", "integer": "int", "int32": "int", "int64": "int", "uint32": "int", "uint64": "int", "money": "int", "any": "Any", "never": "None"}

    def camel(name: str) -> str:
        return "".join(p[:1].upper() + p[1:] for p in "".join(c if c.isalnum() else " " for c in name).split()) or "Empty"

    def hint(node: dict, name: str) -> str:
        kind = node["type"]
        if kind in plain:
            return plain[kind]
        if kind in ("number", "currency", "decimal", "percentage"):
            return "float"
        if kind == "object":
            return define(node, name)
        if kind == "array":
            return f"list[{hint(node['items'], name + 'Item')}]"
        if kind == "tuple":
            return f"tuple[{', '.join(hint(c, f'{name}Part{k}') for k, c in enumerate(node['items']))}]"
        if kind == "record":
            return f"dict[str, {hint(node['value'], name + 'Value')}]"
        if kind in ("enum", "literal"):
            return f"Literal[{', '.join(map(repr, node['values'] if kind == 'enum' else [node['value']]))}]"
        if kind == "union":
            return " | ".join(dict.fromkeys("None" if c == {"type": "literal", "value": None} else hint(c, f"{name}Choice{k}") for k, c in enumerate(node["oneOf"])))
        if kind in ("preprocess", "catch"):
            return hint(node["schema"], name)
        return f'"{camel(node["$ref"])}"' if kind == "ref" else "Any"

    def define(node: dict, name: str) -> str:
        lines = []
        for k, c in sorted(node["properties"].items(), key=lambda kc: not required(kc[1])):
            own = k if k.isidentifier() else "field_" + "".join(x if x.isalnum() else "_" for x in k)
            kind = hint(c, name + camel(k))
            kind = kind if required(c) and not allows_null(schema, c) or kind == "Any" else f"{kind} | None" if "None" not in kind else kind
            lines.append(f"    {own}: {kind}" + ("" if required(c) else " = None"))
        done.append("@dataclass\nclass " + name + ":\n" + ("\n".join(lines) or "    pass"))
        return name

    for key, node in schema.definitions.items():
        if node["type"] == "object":
            define(node, camel(key))
        else:
            done.append(f"{camel(key)} = {hint(node, camel(key))}")
    if schema.root["type"] == "object":
        define(schema.root, root_name)
    else:
        done.append(f"{root_name} = {hint(schema.root, root_name)}")
    return "from __future__ import annotations\n\nfrom dataclasses import dataclass\nfrom typing import Any, Literal\n\n\n" + "\n\n\n".join(done) + "\n"
