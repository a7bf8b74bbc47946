"""From a schema to columns: the normalized value and the issues of each row, in one projection.

A node's order is transforms, kind, constraints, parts; an object's rules see its normalized members and run even if members
failed. References are unrolled a few times; what lies deeper is opened as rows of its own and its results looked up (see
``operators.deep``). Issues are structs of code, message, path, severity, help and source, and a row is valid
if none of them has severity error.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import text as X
from assay.functions import transforms

from . import ir
from .predicates import compile_predicate
from .registry import Registry
from .values import Value, equals, false, from_typed, from_variant, literal, missing, true, variant_null

ISSUE = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "message", "path", "severity", "help", "source")])
NO_ISSUES = f"array<{ISSUE.simpleString()}>"
#: How deep nodes may lie in nodes, references counted; a fixed value.
MAX_DEPTH = 128
#: A reference left open: what its result is known by, the definition, where it stands, how deep, and the value.
OPEN = "struct<key:string,name:string,path:string,level:int,raw:variant>"
#: The results of open references by key.
BELOW = f"map<string,struct<issues:{NO_ISSUES},normal:variant>>"


def no_issues() -> Column:
    return F.array().cast(NO_ISSUES)


def none_open() -> Column:
    return F.array().cast(f"array<{OPEN}>")


@dataclass(frozen=True)
class Single:
    """An issue that a row has where a condition holds."""

    holds: Column
    issue: Column
    severity: str = "error"


def when(holds: Column, issue_: Column, severity: str = "error") -> Single:
    return Single(holds, issue_, severity)


def _any(conditions: list[Column]) -> Column:
    """Whether some condition holds, as a balanced tree."""
    if not conditions:
        return false()
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + ([conditions[-1]] if len(conditions) % 2 else [])
    return F.coalesce(conditions[0], false())


@dataclass
class Out:
    """A node's normalized value and its issues: single ones, and arrays of those of its parts."""

    value: Value
    singles: list[Single] = field(default_factory=list)
    arrays: list[Column] = field(default_factory=list)
    opens: list[Column] = field(default_factory=list)

    def opened(self) -> Column:
        """The references left open, of a compiler that collects them."""
        return none_open() if not self.opens else self.opens[0] if len(self.opens) == 1 else F.concat(*self.opens)

    def listed(self, severity: str | None) -> Column:
        wanted = [s for s in self.singles if severity in (None, s.severity)]
        keep = lambda x: x if severity is None else F.filter(x, lambda i: i["severity"] == severity)
        parts = [F.array_compact(F.array(*[F.when(s.holds, s.issue) for s in wanted]))] if wanted else []
        parts += [keep(x) for x in self.arrays]
        return no_issues() if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)

    def issues(self) -> Column:
        return self.listed(None)

    def some(self, severity: str) -> Column:
        """Whether an issue of the severity is among them; builds no issue of its own."""
        found = [s.holds for s in self.singles if s.severity == severity]
        return _any(found + [F.exists(x, lambda i: i["severity"] == severity) for x in self.arrays])

    def failed(self) -> Column:
        return self.some("error")

    def when(self, condition: Column) -> "Out":
        return Out(self.value, [replace(s, holds=condition & s.holds) for s in self.singles], [F.when(condition, a).otherwise(no_issues()) for a in self.arrays], _gated(condition, self.opens))


def _gated(condition: Column, opens: list[Column]) -> list[Column]:
    return [F.when(condition, o).otherwise(none_open()) for o in opens]


Path = str | Column


def _path(path: Path) -> Column:
    return F.lit(path) if isinstance(path, str) else path


def _join(path: Path, part: Path) -> Path:
    """The pointer of a part; ``~`` and ``/`` in its key are escaped."""
    if isinstance(part, str):
        part = part.replace("~", "~0").replace("/", "~1")
        return f"{path}/{part}" if isinstance(path, str) else F.concat(path, F.lit(f"/{part}"))
    return F.concat(_path(path), F.lit("/"), F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def issue(code: str, message: str | Column, path: Path, severity: str = "error", help_: str | None = None, source: str | None = None) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(F.lit(code).alias("code"), text(message).alias("message"), _path(path).alias("path"), F.lit(severity).alias("severity"), text(help_).alias("help"), text(source).alias("source"))


class Compiler:
    """Compiles one schema.

    ``unroll`` is how often a reference opens inside itself before it is left open: its result is then looked up in ``below``
    or, with ``collect``, the reference listed; without either the value gets MAX_DEPTH_EXCEEDED. A typed column is finite
    and never left open. ``level`` is how deep the first node lies; nodes beyond ``MAX_DEPTH`` are errors. ``base`` is a column
    to be added to it where rows' first nodes lie at different depths, and ``deepest`` how deep nodes were seen to go without it."""

    def __init__(self, schema: ir.Schema, registry: Registry | None = None, apply_transforms: bool = True, unroll: int = 4, level: int = 0, below: Column | None = None, collect: bool = False, base: Column | None = None):
        self.schema, self.registry, self.apply_transforms, self.unroll = schema, registry or Registry.default(), apply_transforms, unroll
        self.level, self.below, self.collect, self.base, self.deepest = level, below, collect, base, level

    # ---- parts of a node
    def _changed(self, node: dict, v: Value) -> Value:
        return transforms.apply(v, node.get("transforms")) if self.apply_transforms else v

    def _constraints(self, listed: list[dict] | None, v: Value, path: Path, applies: Column) -> list[Single]:
        out = []
        for c in listed or []:
            error = c["error"]
            holds = compile_predicate(c["pred"], v, self.registry)
            at = error["path"] if error.get("path") is not None else path
            severity = error.get("severity", "error")
            out.append(when(applies & ~holds, issue(error["code"], error.get("message", ""), at, severity, error.get("help"), error.get("source")), severity))
        return out

    def node(self, node: dict, v: Value, path: Path, refs: tuple = ()) -> Out:
        if self.level >= MAX_DEPTH:
            return self._too_deep(v, path)
        self.level += 1
        self.deepest = max(self.deepest, self.level)
        try:
            return getattr(self, f"_{node['type']}")(node, v, path, refs)
        finally:
            self.level -= 1

    @staticmethod
    def _too_deep(v: Value, path: Path) -> Out:
        return Out(v, [when(v.present, issue("MAX_DEPTH_EXCEEDED", "maximum validation depth exceeded", path))])

    @staticmethod
    def _sure(node: dict, v: Value) -> bool:
        """The column's own type already says that every value is null or fits."""
        held = [s for s in ("str", "num", "bool") if getattr(v, s) is not None]
        if v.variant or v.type is None or len(held) != 1:
            return False
        wanted = {"string": "str", "date": "str", "boolean": "bool", "number": "num", "money": "num", "currency": "num", "decimal": "num", "percentage": "num"}
        if node["type"] in wanted:
            return held[0] == wanted[node["type"]]
        whole = {"integer": T.IntegralType, "int64": T.IntegralType, "int32": (T.ByteType, T.ShortType, T.IntegerType)}
        return not v.changed and node["type"] in whole and isinstance(v.type, whole[node["type"]])

    # ---- scalars
    def _scalar(self, node: dict, v: Value, path: Path, fits: Column, more: Any = None) -> Out:
        singles = [] if self._sure(node, v) else [when(v.present & ~v.null & ~fits, issue("TYPE_ERROR", f"expected {node['type']}", path))]
        if more is not None:
            singles += more(v)
        singles += self._constraints(node.get("constraints"), v, path, fits)
        return Out(v, singles)

    def _string(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        v = self._changed(node, v)
        return self._scalar(node, v, path, v.is_str)

    _date = _string

    def _number(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        v = self._changed(node, v)
        return self._scalar(node, v, path, v.is_num)

    _money = _number

    def _boolean(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        return self._scalar(node, v, path, v.is_bool)

    def _integer(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        v = self._changed(node, v)
        return self._scalar(node, v, path, false() if v.num is None else F.coalesce((v.num == F.rint(v.num)) & (F.abs(v.num) < float("inf")), false()))

    def _exact(self, node: dict, v: Value, path: Path, low: int, high: int) -> Out:
        v = self._changed(node, v)
        return self._scalar(node, v, path, false() if v.int is None else F.coalesce(v.int.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), false()))

    def _int32(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        return self._exact(node, v, path, -(2**31), 2**31 - 1)

    def _int64(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        return self._exact(node, v, path, -(2**63), 2**63 - 1)

    def _uint32(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        return self._exact(node, v, path, 0, 2**32 - 1)

    def _uint64(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        return self._exact(node, v, path, 0, 2**64 - 1)

    @staticmethod
    def _too_fine(v: Value, scale: int) -> Column:
        scaled = v.num * F.lit(10.0**scale)
        return F.abs(scaled - X.half_away(scaled)) > 1e-10

    def _currency(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        v = self._changed(node, v)
        scale = 2 if node.get("scale") is None else node["scale"]
        more = lambda v: [] if v.num is None else [when(self._too_fine(v, scale), issue("CURRENCY_SCALE_EXCEEDED", f"more than {scale} decimal places", path))]
        return self._scalar(node, v, path, v.is_num, more)

    def _decimal(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        v = self._changed(node, v)
        scale, precision = node.get("scale"), node.get("precision")

        def more(v: Value) -> list[Single]:
            out = []
            if v.num is not None and scale is not None:
                out.append(when(self._too_fine(v, scale), issue("DECIMAL_SCALE_EXCEEDED", f"more than {scale} decimal places", path)))
            if v.num is not None and precision is not None:
                shown = F.regexp_replace(F.format_string("%.10f", F.abs(v.num)), r"\.?0+$", "")
                count = F.when(v.num == 0, 1).otherwise(F.length(X.digits(shown)))
                out.append(when(count > precision, issue("DECIMAL_PRECISION_EXCEEDED", f"more than {precision} digits", path)))
            return out

        return self._scalar(node, v, path, v.is_num, more)

    def _percentage(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        v = self._changed(node, v)
        high, free, scale = 1.0 if node.get("format", "whole") == "decimal" else 100.0, bool(node.get("allow_over_100")), node.get("scale")

        def more(v: Value) -> list[Single]:
            if v.num is None:
                return []
            out = [when(v.num < 0, issue("PERCENTAGE_NEGATIVE", "percentage cannot be negative", path))]
            if not free:
                out.append(when(v.num > high, issue("PERCENTAGE_TOO_HIGH", f"percentage cannot exceed {high:g}", path)))
            if scale is not None:
                out.append(when(self._too_fine(v, scale), issue("PERCENTAGE_SCALE_EXCEEDED", f"more than {scale} decimal places", path)))
            return out

        return self._scalar(node, v, path, v.is_num, more)

    def _any(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        return Out(v)

    def _never(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        return Out(v, [when(v.present, issue("TYPE_ERROR", "no value is allowed", path))])

    def _enum(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        empty = false() if v.str is None else F.coalesce(v.str == "", false())
        fits = reduce(lambda a, b: a | b, (equals(v, x) for x in node["values"]), v.null | empty)
        return Out(v, [when(v.present & ~fits, issue("INVALID_ENUM", "not one of the values", path))])

    def _literal(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        return Out(v, [when(v.present & ~equals(v, node["value"]), issue("INVALID_LITERAL", "not the value", path))])

    # ---- wrappers
    def _preprocess(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        return self.node(node["schema"], self._changed(node, v), path, refs)

    def _catch(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        inner = self.node(node["schema"], v, path, refs)
        bad, other = inner.failed(), literal(node.get("value"))
        a, b = inner.value, other
        pick = lambda x, y: None if x is None and y is None else F.when(bad, F.lit(None) if y is None else y).otherwise(F.lit(None) if x is None else x)
        deep = a.variant or a.out is not None or isinstance(node.get("value"), (list, dict))
        value = Value(
            str=pick(a.str, b.str), num=pick(a.num, b.num), int=pick(a.int, b.int), bool=pick(a.bool, b.bool), null_=F.when(bad, b.null).otherwise(a.null), present_=bad | a.present,
            raw=a.raw, type=a.type, changed=True, out=F.when(bad, b.as_variant()).otherwise(a.as_variant()) if deep and (a.variant or a.type is None) else None,
        )
        return Out(value, [replace(s, holds=~bad & s.holds) for s in inner.singles], [F.when(~bad, x).otherwise(no_issues()) for x in inner.arrays], inner.opens)

    def _ref(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        name, chain = node["$ref"], {node["$ref"]}
        target = self.schema.resolve(name)
        while target is not None and target["type"] == "ref":  # a chain of references that comes back to itself
            if target["$ref"] in chain:
                return Out(v, [when(v.present, issue("REF_CYCLE", f"reference cycle at {name}", path))])
            chain.add(target["$ref"])
            target = self.schema.resolve(target["$ref"])
        if target is None:
            return Out(v, [when(v.present, issue("REF_NOT_FOUND", f"no definition {name}", path))])
        if v.absent:
            return Out(v)
        if any(n == name and x is v for n, x in refs):  # the same reference to the same value never ends
            return self._too_deep(v, path)
        if sum(n == name for n, _ in refs) >= self.unroll and not isinstance(v.type, (T.StructType, T.MapType, T.ArrayType)):
            return self._left_open(name, v, path)
        return self.node(target, v, path, (*refs, (name, v)))

    def _left_open(self, name: str, v: Value, path: Path) -> Out:
        level = F.lit(self.level) if self.base is None else self.base + F.lit(self.level)
        key = F.concat(F.lit(f"{name}\n"), level.cast("string"), F.lit("\n"), _path(path))
        if self.collect:
            raw = v.as_variant().cast("variant")
            row = F.struct(key.alias("key"), F.lit(name).alias("name"), _path(path).alias("path"), level.alias("level"), raw.alias("raw"))
            return Out(v, opens=[F.when(v.present, F.array(row.cast(OPEN))).otherwise(none_open())])
        if self.below is None:
            return self._too_deep(v, path)
        got = F.try_element_at(self.below, key)
        lost = F.array(issue("MAX_DEPTH_EXCEEDED", "maximum validation depth exceeded", path)).cast(NO_ISSUES)
        value = from_variant(F.coalesce(got["normal"], v.as_variant()))
        return Out(replace(value, out=value.raw), [], [F.when(v.present, F.coalesce(got["issues"], lost)).otherwise(no_issues())])

    # ---- choices
    def _merge(self, v: Value, outs: list[tuple[Column, Value]]) -> Value:
        """The first value whose condition holds, else the given one."""

        def slot(name: str) -> Column | None:
            got = [(c, getattr(o, name)) for c, o in outs]
            own = getattr(v, name)
            if own is None and all(x is None for _, x in got):
                return None
            expr = F.lit(None) if own is None else own
            for c, x in reversed(got):
                expr = F.when(c, F.lit(None) if x is None else x).otherwise(expr)
            return expr

        out = None
        if v.variant:
            out = v.as_variant()
            for c, o in reversed(outs):
                out = F.when(c, o.as_variant()).otherwise(out)
        null = v.null
        for c, o in reversed(outs):
            null = F.when(c, o.null).otherwise(null)
        return replace(v, str=slot("str"), num=slot("num"), int=slot("int"), bool=slot("bool"), null_=null, changed=True, out=out, members=None)

    def _union(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        live, taken, wins, arrays, opens = v.present & ~v.null, false(), [], [], []
        for variant in node["oneOf"]:
            out = self.node(variant, v, path, refs)
            opens += _gated(live, out.opens)
            if self.collect:
                continue
            wins.append((live & ~taken & ~out.failed(), out.value))
            arrays.append(F.when(live & ~taken & ~out.failed(), out.issues()).otherwise(no_issues()))
            taken = taken | ~out.failed()
        if self.collect:
            return Out(v, opens=opens)
        return Out(self._merge(v, wins), [when(live & ~taken, issue("INVALID_UNION", "no variant fits", path))], arrays)

    def _intersection(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        now, going, arrays, opens = v, true(), [], []
        for part in node["allOf"]:
            out = self.node(part, now, path, refs)
            opens += out.opens
            if self.collect:
                continue
            arrays.append(F.when(going, out.issues()).otherwise(no_issues()))
            going = going & ~out.failed()
            now = out.value
        return Out(v, opens=opens) if self.collect else Out(self._merge(v, [(going, now)]), [], arrays)

    # ---- structures
    def member_issues(self, node: dict, child: dict, key: str, v: Value, path: Path, refs: tuple, inside: Column) -> Out:
        """A property: REQUIRED where it is missing or null without leave, else its own issues."""
        at = _join(path, key)
        needed, fills = ir.required(child), ir.fills_missing(self.schema, child)
        given = replace(v, present_=None, null_=v.null | ~v.present) if fills else v
        out = self.node(child, given, at, refs)
        if not needed or fills and ir.allows_null(self.schema, child):
            # a typed column can't tell null from missing, so an optional one's null is taken for missing
            there = v.present & ~v.null if not v.variant and not needed and not ir.allows_null(self.schema, child) else v.present
            return out.when(inside & (true() if fills else there))
        absent = ~v.present if ir.allows_null(self.schema, child) else ~v.present | v.null
        gated = out.when(inside & ~absent)
        gated.singles.append(when(inside & absent, issue("REQUIRED", "required", at)))
        return gated

    def _object(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        inside = v.is_obj if v.members is None else true()
        wrong = when(v.present & ~v.null & ~inside, issue("TYPE_ERROR", "expected object", path))
        singles, arrays, members, opens = [wrong], [], {}, []
        for key, child in node["properties"].items():
            got = v.member(key)
            out = self.member_issues(node, child, key, got, path, refs, inside)
            singles += out.singles
            arrays += out.arrays
            opens += out.opens
            members[key] = out.value
        mode = node.get("unknown_keys") or ("passthrough" if node.get("additional_properties") is True else "strict")
        catchall = node.get("catchall")
        known = list(node["properties"])
        found = v.entries()
        rest = None
        if found is not None:
            entries, kind = found
            unknown = F.map_filter(entries, lambda k, x: ~k.isin(known)) if known else entries
            rest = unknown
            if catchall is not None:
                each = lambda k, x: self.node(catchall, from_typed(x, kind), _join(path, k), refs)
                listed = F.flatten(F.transform(F.map_entries(unknown), lambda e: each(e["key"], e["value"]).issues()))
                arrays.append(F.when(inside, listed).otherwise(no_issues()))
                if self.collect:
                    opens += _gated(inside, [F.flatten(F.transform(F.map_entries(unknown), lambda e: each(e["key"], e["value"]).opened()))])
                if v.variant:
                    rest = F.transform_values(unknown, lambda k, x: each(k, x).value.as_variant())
            elif mode == "strict":
                listed = F.transform(F.array_sort(F.filter(v.keys(), lambda k: ~k.isin(known)) if known else v.keys()), lambda k: issue("ADDITIONAL_PROPERTY_NOT_ALLOWED", F.concat(F.lit("unexpected property "), k), _join(path, k)))
                arrays.append(F.when(inside, listed).otherwise(no_issues()))
            elif mode == "strip":
                rest = None
        elif isinstance(v.type, T.StructType) or v.members is not None:
            names = v.type.names if isinstance(v.type, T.StructType) else list(v.members)
            for key in sorted(n for n in names if n not in known):
                got = v.member(key)
                if catchall is not None:
                    out = self.node(catchall, got, _join(path, key), refs).when(inside & got.present)
                    singles, arrays, opens = singles + out.singles, arrays + out.arrays, opens + out.opens
                    members[key] = out.value
                elif mode == "strict":
                    singles.append(when(inside & got.present, issue("ADDITIONAL_PROPERTY_NOT_ALLOWED", f"unexpected property {key}", _join(path, key))))
                    members[key] = got
                elif mode == "passthrough":
                    members[key] = got
        out = None
        if v.variant:
            pairs = [x for k, m in members.items() for x in (F.lit(k), m.as_variant())]
            made = F.map_filter(F.create_map(*pairs), lambda k, x: x.isNotNull()) if pairs else F.create_map().cast("map<string,variant>")
            whole = F.map_concat(made, F.coalesce(rest, F.create_map().cast("map<string,variant>"))) if rest is not None else made
            out = F.when(inside, F.to_variant_object(whole)).otherwise(v.raw)
        elif isinstance(v.type, T.StructType):
            fields = [members[k].as_typed(ir.value_kind(node["properties"].get(k, {"type": "any"}))).alias(k) for k in members if k in node["properties"] or k in v.type.names]
            out = F.when(inside, F.struct(*fields)) if fields else v.raw
        value = replace(v, out=out, changed=True, members=dict(members), rest=None if rest is None else (rest, kind))
        singles += self._constraints(node.get("rules"), value, path, inside)
        return Out(value, singles, arrays, opens)

    def _array(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        inside = v.is_arr
        singles = [when(v.present & ~v.null & ~inside, issue("TYPE_ERROR", "expected array", path))]
        found = v.elements()
        if found is None:
            return Out(v, singles)
        arr, kind = found
        stated = {(c["pred"]["type"], c["pred"].get("len")) for c in node.get("constraints") or []}
        low, high = node.get("min_items"), node.get("max_items")
        if low is not None and ("min_len", low) not in stated:
            singles.append(when(inside & (F.size(arr) < low), issue("ARRAY_TOO_SHORT", f"at least {low} items", path)))
        if high is not None and ("max_len", high) not in stated:
            singles.append(when(inside & (F.size(arr) > high), issue("ARRAY_TOO_LONG", f"at most {high} items", path)))
        each = lambda x, i: self.node(node["items"], from_typed(x, kind), _join(path, i.cast("string")), refs)
        arrays = [F.when(inside, F.flatten(F.transform(arr, lambda x, i: each(x, i).issues()))).otherwise(no_issues())]
        if v.variant:
            out = F.when(inside, F.to_variant_object(F.transform(arr, lambda x, i: F.coalesce(each(x, i).value.as_variant(), variant_null())))).otherwise(v.raw)
        else:
            out = F.transform(arr, lambda x, i: each(x, i).value.as_typed(ir.value_kind(node["items"])))
        value = replace(v, out=out, changed=True)
        singles += self._constraints(node.get("constraints"), value, path, inside)
        opens = _gated(inside, [F.flatten(F.transform(arr, lambda x, i: each(x, i).opened()))]) if self.collect else []
        return Out(value, singles, arrays, opens)

    def _tuple(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        inside, parts = v.is_arr, node["items"]
        singles, arrays, opens = [when(v.present & ~v.null & ~inside, issue("TYPE_ERROR", "expected tuple", path))], [], []
        found = v.elements()
        if found is None:
            return Out(v, singles)
        arr, kind = found
        singles.append(when(inside & (F.size(arr) != len(parts)), issue("INVALID_TUPLE", f"expected {len(parts)} items", path)))
        outs = [self.node(part, from_typed(F.get(arr, k), kind), _join(path, str(k)), refs) for k, part in enumerate(parts)]
        for k, out in enumerate(outs):
            gated = out.when(inside & (F.size(arr) > k))
            singles, arrays, opens = singles + gated.singles, arrays + gated.arrays, opens + gated.opens
        made = None
        if v.variant:
            done = [F.when(F.size(arr) > k, F.coalesce(o.value.as_variant(), variant_null())) for k, o in enumerate(outs)]
            rest = F.slice(arr, len(parts) + 1, F.greatest(F.lit(0), F.size(arr)))
            made = F.when(inside, F.to_variant_object(F.concat(F.filter(F.array(*done), lambda x: x.isNotNull()), rest))).otherwise(v.raw) if done else None
        return Out(replace(v, out=made, changed=made is not None), singles, arrays, opens)

    def _record(self, node: dict, v: Value, path: Path, refs: tuple) -> Out:
        inside = v.is_obj
        singles = [when(v.present & ~v.null & ~inside, issue("TYPE_ERROR", "expected record", path))]
        found = v.entries()
        if found is None:
            return Out(v, singles)
        entries, kind = found
        keys = node.get("key")

        def each(e: Column) -> Column:
            own = self.node(node["value"], from_typed(e["value"], kind), _join(path, e["key"]), refs).issues()
            if keys is None:
                return own
            named = self.node(keys, from_typed(e["key"], T.StringType()), _join(_join(path, e["key"]), "$key"), refs).issues()
            return F.concat(named, own)

        arrays = [F.when(inside, F.flatten(F.transform(F.map_entries(entries), each))).otherwise(no_issues())]
        normal = lambda k, x: self.node(node["value"], from_typed(x, kind), _join(path, k), refs).value
        if v.variant:
            out = F.when(inside, F.to_variant_object(F.transform_values(entries, lambda k, x: F.coalesce(normal(k, x).as_variant(), variant_null())))).otherwise(v.raw)
        else:
            out = F.transform_values(entries, lambda k, x: normal(k, x).as_typed(ir.value_kind(node["value"])))
        deeper = lambda e: self.node(node["value"], from_typed(e["value"], kind), _join(path, e["key"]), refs).opened()
        opens = _gated(inside, [F.flatten(F.transform(F.map_entries(entries), deeper))]) if self.collect else []
        return Out(replace(v, out=out, changed=True), singles, arrays, opens)


__all__ = ["Compiler", "ISSUE", "Out", "Single", "issue", "missing", "no_issues"]
