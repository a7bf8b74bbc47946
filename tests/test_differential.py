"""The compiler against a plain interpreter of the same semantics, on generated schemas and documents."""

import json
import math
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.operators import validation as V
from assay.plans import ir

# ---------------------------------------------------------------- the interpreter

GONE = object()


def is_number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def equal(a, b):
    if is_number(a) and is_number(b):
        return float(a) == float(b)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


def transform(t, x):
    if t["fn"] == "default":
        return t["value"] if x is None else x
    if isinstance(x, str):
        return {"trim": x.strip(" "), "upper": x.upper(), "lower": x.lower(), "digits_only": "".join(c for c in x if c in "0123456789")}[t["fn"]]
    return x


def at(x, path):
    for part in [p for p in path.split("/")[1:]]:
        if not isinstance(x, dict) or part not in x:
            return GONE
        x = x[part]
    return x


def holds(p, x):
    kind = p["type"]
    if kind == "min_len":
        return isinstance(x, (str, list)) and len(x) >= p["len"]
    if kind == "max_len":
        return isinstance(x, (str, list)) and len(x) <= p["len"]
    if kind == "range":
        return is_number(x) and p["min"] <= x <= p["max"]
    if kind == "exists":
        return at(x, p["path"]) not in (GONE, None) if not isinstance(at(x, p["path"]), (list, dict)) else True
    if kind == "eq":
        v = at(x, p["path"])
        return v is not GONE and equal(v, p["value"])
    if kind == "gt_field":
        a, b = at(x, p["left"]), at(x, p["right"])
        return is_number(a) and is_number(b) and a > b
    if kind == "not":
        return not holds(p["predicate"], x)
    if kind in ("and", "or"):
        return (all if kind == "and" else any)(holds(q, x) for q in p["predicates"])
    if kind == "implies":
        return not holds(p["if"], x) or holds(p["then"], x)
    raise AssertionError(kind)


def allows_null(n):
    return ir.allows_null(ir.Schema(root=n), n)


def check(n, x, path):
    """The normalized value and the set of (path, code)."""
    kind = n["type"]
    for t in n.get("transforms", []):
        x = transform(t, x)
    issues = []
    fits = {
        "string": lambda: isinstance(x, str), "number": lambda: is_number(x), "boolean": lambda: isinstance(x, bool),
        "integer": lambda: is_number(x) and math.isfinite(x) and float(x) == math.floor(x), "int32": lambda: isinstance(x, int) and not isinstance(x, bool) and -(2**31) <= x < 2**31,
    }
    if kind in fits:
        if x is None:
            return x, []
        if not fits[kind]():
            return x, [(path, "TYPE_ERROR")]
        return x, [(path, c["error"]["code"]) for c in n.get("constraints", []) if not holds(c["pred"], x)]
    if kind == "enum":
        return x, [] if x is None or x == "" or any(equal(x, v) for v in n["values"]) else [(path, "INVALID_ENUM")]
    if kind == "literal":
        return x, [] if equal(x, n["value"]) else [(path, "INVALID_LITERAL")]
    if kind == "union":
        if x is None:
            return x, []
        for v in n["oneOf"]:
            y, found = check(v, x, path)
            if not found:
                return y, []
        return x, [(path, "INVALID_UNION")]
    if kind == "array":
        if x is None:
            return x, []
        if not isinstance(x, list):
            return x, [(path, "TYPE_ERROR")]
        if len(x) < n.get("min_items", 0):
            issues.append((path, "ARRAY_TOO_SHORT"))
        out = []
        for k, y in enumerate(x):
            z, found = check(n["items"], y, f"{path}/{k}")
            out.append(z)
            issues += found
        return out, issues
    assert kind == "object"
    if x is None:
        return x, []
    if not isinstance(x, dict):
        return x, [(path, "TYPE_ERROR")]
    out = dict(x)
    for key, child in n["properties"].items():
        where, default = f"{path}/{key}", any(t["fn"] == "default" for t in child.get("transforms", []))
        needed = child.get("required", True)
        if key not in x:
            if default:
                out[key], found = check(child, None, where)
                issues += found
            elif needed:
                issues.append((where, "REQUIRED"))
            continue
        if x[key] is None and needed and not allows_null(child):
            issues.append((where, "REQUIRED"))
            continue
        out[key], found = check(child, x[key], where)
        issues += found
    for key in x:
        if key not in n["properties"]:
            if n.get("unknown_keys") == "strip":
                del out[key]
            elif n.get("unknown_keys") != "passthrough":
                issues.append((f"{path}/{key}", "ADDITIONAL_PROPERTY_NOT_ALLOWED"))
    return out, issues + [(path, r["error"]["code"]) for r in n.get("rules", []) if not holds(r["pred"], out)]


# ---------------------------------------------------------------- what is generated

KEYS = ("a", "b", "c")
scalars = st.one_of(st.none(), st.booleans(), st.integers(-1000, 1000), st.decimals(-100, 100, places=2).map(float), st.text("aB1 -", max_size=4))
documents = st.recursive(scalars, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from((*KEYS, "z")), x, max_size=4)), max_leaves=8)


def constraint(preds):
    return st.lists(preds.map(lambda p: {"pred": p, "error": {"code": p["type"].upper(), "message": ""}}), max_size=2, unique_by=lambda c: c["error"]["code"])


lengths = st.builds(lambda t, n: {"type": t, "len": n}, st.sampled_from(("min_len", "max_len")), st.integers(0, 4))
ranges = st.builds(lambda a, b: {"type": "range", "min": a, "max": a + b}, st.integers(-50, 50), st.integers(0, 50))
texts = st.builds(
    lambda ts, cs, d: {"type": "string", "transforms": [{"fn": t} for t in ts] + ([{"fn": "default", "value": "d"}] if d else []), "constraints": cs},
    st.lists(st.sampled_from(("trim", "upper", "lower", "digits_only")), max_size=2), constraint(lengths), st.booleans(),
)
numbers = st.builds(lambda t, cs: {"type": t, "constraints": cs}, st.sampled_from(("number", "integer", "int32")), constraint(ranges))
leaves = st.one_of(texts, numbers, st.just({"type": "boolean"}), st.builds(lambda v: {"type": "enum", "values": v}, st.lists(scalars, min_size=1, max_size=3)), scalars.map(lambda v: {"type": "literal", "value": v}))
tests = st.one_of(
    st.sampled_from(KEYS).map(lambda k: {"type": "exists", "path": f"/{k}"}),
    st.builds(lambda k, v: {"type": "eq", "path": f"/{k}", "value": v}, st.sampled_from(KEYS), scalars),
    st.builds(lambda a, b: {"type": "gt_field", "left": f"/{a}", "right": f"/{b}"}, st.sampled_from(KEYS), st.sampled_from(KEYS)),
)
rules = st.recursive(
    tests,
    lambda p: st.one_of(p.map(lambda q: {"type": "not", "predicate": q}), st.builds(lambda t, q: {"type": t, "predicates": q}, st.sampled_from(("and", "or")), st.lists(p, max_size=2)), st.builds(lambda a, b: {"type": "implies", "if": a, "then": b}, p, p)),
    max_leaves=3,
)


def objects(inner):
    member = st.builds(lambda n, r: {**n, "required": r}, inner, st.booleans())
    return st.builds(
        lambda p, u, r: {"type": "object", "properties": p, "unknown_keys": u, "rules": [{"pred": q, "error": {"code": f"RULE{k}", "message": ""}} for k, q in enumerate(r)]},
        st.dictionaries(st.sampled_from(KEYS), member, max_size=3), st.sampled_from(("strict", "strip", "passthrough")), st.lists(rules, max_size=2),
    )


schemas = st.recursive(
    leaves,
    lambda n: st.one_of(objects(n), st.builds(lambda i, m: {"type": "array", "items": i, "min_items": m}, n, st.integers(0, 2)), st.builds(lambda v: {"type": "union", "oneOf": v}, st.lists(n, min_size=1, max_size=2))),
    max_leaves=4,
)


def plain(x):
    """A parsed JSON value in which equal numbers are equal."""
    if isinstance(x, list):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return float(x) if is_number(x) or isinstance(x, Decimal) else x


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(schemas, st.lists(documents, min_size=6, max_size=14))
def test_compiler_agrees_with_the_interpreter(spark, schema, docs):
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, value string")
    out = V.validate_documents(rows, schema).select("k", "valid", F.to_json("normalized").alias("n"), "errors").collect()
    parsed = ir.Schema.from_json(schema).root
    for r in out:
        value, issues = check(parsed, docs[r.k], "")
        assert sorted((e.path, e.code) for e in r.errors) == sorted(issues), (schema, docs[r.k])
        assert r.valid == (not issues)
        if r.valid:
            assert plain(json.loads(r.n)) == plain(value), (schema, docs[r.k])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(schemas)
def test_schemas_survive_a_round_trip(schema):
    once = ir.Schema.from_json(schema)
    assert ir.Schema.from_json(once.to_json()).to_dict() == once.to_dict()
