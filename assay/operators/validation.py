"""Validating and normalizing DataFrames against a schema.

Typed mode takes a table's columns as the members of the root object (SQL null is JSON null). Variant mode takes one column of
JSON texts or variants and treats each as a document. Both are one projection without shuffle, on batch and streaming frames;
documents whose references nest deeper than ``unroll`` take further rounds (see ``deep``).
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import transforms
from assay.plans import ir
from assay.plans.compiler import Compiler, Out, Single, issue, no_issues
from assay.plans.registry import Registry
from assay.plans.values import Value, from_typed, from_variant, variant_member

from . import deep


class ValidationError(ValueError):
    """Raised by ``validate_or_raise``; ``rows`` has some of the invalid rows."""

    def __init__(self, rows: list):
        super().__init__(f"{len(rows)} or more rows are invalid, the first: {rows[0] if rows else None}")
        self.rows = rows


def _root(schema: ir.Schema) -> dict:
    if schema.root["type"] != "object":
        raise ValueError("typed mode needs a schema whose root is an object")
    return schema.root


def _staged(df: DataFrame, schema: ir.Schema, apply_transforms: bool) -> tuple[DataFrame, dict[str, Value], list[str]]:
    """Columns with the transformed members, so that constraints read a column and not a chain of transforms again."""
    root, members, added, extra = _root(schema), {}, {}, []
    for name in df.columns:
        v = from_typed(F.col(f"`{name}`"), df.schema[name].dataType)
        node = root["properties"].get(name)
        chain = node.get("transforms") if node and apply_transforms and node["type"] in ir.SCALARS else None
        if chain:
            v = transforms.apply(v, chain)
            slots = {}
            for slot in ("str", "num", "int", "bool"):
                if getattr(v, slot) is not None:
                    added[f"__{name}_{slot}"] = getattr(v, slot)
                    slots[slot] = F.col(f"`__{name}_{slot}`")
            added[f"__{name}_null"] = v.null
            v = v.but(**slots, null_=F.col(f"`__{name}_null`"), members=None)
        members[name] = v
    return df.withColumns(added) if added else df, members, list(added)


def _strip_chains(schema: ir.Schema) -> ir.Schema:
    """The schema without the root members' own transforms, which are staged."""
    root = dict(schema.root)
    root["properties"] = {k: {**n, "transforms": [t for t in n.get("transforms") or [] if t["fn"] == "default"]} if n["type"] in ir.SCALARS else n for k, n in root["properties"].items()}
    return ir.Schema(**{**schema.__dict__, "root": root})


def _compiled(df: DataFrame, schema: ir.Schema, registry: Registry | None, apply_transforms: bool, unroll: int | None) -> tuple[DataFrame, Out]:
    staged, members, added = _staged(df, schema, apply_transforms)
    plain = _strip_chains(schema) if added else schema
    return deep.resolved(staged, plain, lambda c: c.node(plain.root, Value(members=members), ""), registry, apply_transforms, unroll)


def validate(df: DataFrame, schema: Any, registry: Registry | None = None, apply_transforms: bool = True, unroll: int | None = None) -> DataFrame:
    """Typed mode: the columns normalized, then ``valid``, ``errors`` and ``warnings``."""
    schema = ir.Schema.from_json(schema)
    staged, out = _compiled(df, schema, registry, apply_transforms, unroll)
    root = schema.root["properties"]
    strip = schema.root.get("unknown_keys") == "strip"
    keep = [c for c in df.columns if c in root or not strip]
    normal = [out.value.members[c].as_typed(ir.value_kind(root[c])).alias(c) if c in root and c in out.value.members else F.col(f"`{c}`") for c in keep]
    filled = [out.value.members[c].as_typed(ir.value_kind(root[c])).alias(c) for c in root if c not in df.columns and ir.fills_missing(schema, root[c])]
    flagged = staged.withColumns({"__failed": out.failed(), "__warned": out.some("warning")})
    return flagged.select(*normal, *filled, *_columns(out))


def _columns(out: Out) -> list[Column]:
    """Issues are put together for the rows alone that the flags single out."""
    listed = lambda flag, severity: F.when(F.col(flag), out.listed(severity)).otherwise(no_issues()).alias(f"{severity}s")
    return [listed("__failed", "error"), listed("__warned", "warning"), (~F.col("__failed")).alias("valid")]


def is_valid(df: DataFrame, schema: Any, registry: Registry | None = None, unroll: int | None = None) -> Column:
    """Whether each row is valid, as one boolean over the frame's columns, for filters. Typed columns are seen to their full
    depth; in a variant column a reference opens ``unroll`` times (4) inside itself, as a single expression can't go
    further: ``validate`` and ``split_valid`` can."""
    schema = ir.Schema.from_json(schema)
    members = {c: from_typed(F.col(f"`{c}`"), df.schema[c].dataType) for c in df.columns}
    return ~Compiler(schema, registry, unroll=unroll or 4).node(schema.root, Value(members=members), "").failed()


def validate_documents(df: DataFrame, schema: Any, column: str = "value", registry: Registry | None = None, apply_transforms: bool = True, unroll: int | None = None) -> DataFrame:
    """Variant mode: a column of JSON texts or variants. Adds ``normalized`` (variant), ``valid``, ``errors`` and ``warnings``;
    texts that are no JSON get one error, INVALID_JSON."""
    schema = ir.Schema.from_json(schema)
    text = not isinstance(df.schema[column].dataType, T.VariantType)
    raw = F.try_parse_json(F.col(f"`{column}`").cast("string")) if text else F.col(f"`{column}`")
    given = df.columns
    df = df.withColumn("__document", raw)
    v = from_variant(F.col("__document"))
    if schema.root["type"] == "object":  # members and their kinds become columns, read by all their constraints
        names = {key: k for k, key in enumerate(schema.root["properties"])}
        df = df.withColumns({f"__member{k}": variant_member(F.col("__document"), key) for key, k in names.items()}) if names else df
        kinds = {key: k for key, k in names.items() if schema.root["properties"][key]["type"] in ir.SCALARS}
        df = df.withColumns({f"__kind{k}": F.schema_of_variant(f"__member{k}") for k in kinds.values()}) if kinds else df
        v = replace(v, staged={key: from_variant(F.col(f"__member{k}"), F.col(f"__kind{k}") if key in kinds else None) for key, k in names.items()})
    df, out = deep.resolved(df, schema, lambda c: c.node(schema.root, v, ""), registry, apply_transforms, unroll)
    broken = F.col("__document").isNull()
    out.singles.append(Single(broken, issue("INVALID_JSON", "not a JSON document", "")))
    kept = [F.col(f"`{c}`") for c in given]
    flagged = df.withColumns({"__failed": out.failed(), "__warned": out.some("warning")})
    return flagged.select(*kept, out.value.as_variant().alias("normalized"), *_columns(out))


def validate_or_raise(df: DataFrame, schema: Any, **options: Any) -> DataFrame:
    """The normalized frame; raises if a row is invalid, which one bounded job looks for."""
    out = validate(df, schema, **options)
    bad = out.filter(~F.col("valid")).limit(5).collect()
    if bad:
        raise ValidationError(bad)
    return out


def split_valid(df: DataFrame, schema: Any, **options: Any) -> tuple[DataFrame, DataFrame]:
    """The valid and the invalid rows, both normalized and with their issues."""
    out = validate(df, schema, **options)
    return out.filter("valid"), out.filter("not valid")


def errors_for(errors: Column, pointer: str) -> Column:
    """The issues at a pointer or below it."""
    return F.filter(errors, lambda e: (e["path"] == pointer) | e["path"].startswith(f"{pointer}/"))


def first_error(errors: Column, pointer: str) -> Column:
    """The first message at a pointer, null if there is none."""
    return F.get(errors_for(errors, pointer), 0)["message"]


def field_state(errors: Column, warnings: Column, pointer: str) -> Column:
    """A form field's state: valid, how many errors and warnings it has, and the first message."""
    e, w = errors_for(errors, pointer), errors_for(warnings, pointer)
    return F.struct((F.size(e) == 0).alias("valid"), F.size(e).alias("n_errors"), F.size(w).alias("n_warnings"), F.get(e, 0)["message"].alias("message"))


def issue_codes(issues: Column) -> Column:
    """``path:code`` of all issues in order, comma-joined."""
    return F.array_join(F.array_sort(F.transform(issues, lambda i: F.concat(i["path"], F.lit(":"), i["code"]))), ",")
