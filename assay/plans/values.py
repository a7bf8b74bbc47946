"""A document value as a bundle of columns, one for each kind that it may have.

``str``, ``num`` (and ``int``, its exact whole value where it was written as one) and ``bool`` are null unless the value is of
that kind; ``raw`` is the variant or typed column behind it. A slot that is None can't hold that kind at all, which spares
the plan its checks. JSON null is ``null``; a missing member is ``~present``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


@dataclass(frozen=True)
class Value:
    str: Column | None = None
    num: Column | None = None
    int: Column | None = None
    bool: Column | None = None
    raw: Column | None = None
    type: T.DataType | None = None  # of ``raw``; variant values have VariantType
    members: dict | None = None  # Value by key, of an object that has been rebuilt or of a struct
    null_: Column | None = None
    present_: Column | None = None
    changed: bool = False
    out: Column | None = field(default=None)  # the normalized column, where a validator has made one
    staged: dict | None = None  # members of a variant object that have been put into columns already
    rest: tuple[Column, T.DataType] | None = None  # of an object that has been rebuilt, a map of the unknown keys that it keeps
    absent: bool = False  # no row has it

    # ---- kinds
    @property
    def present(self) -> Column:
        return true() if self.present_ is None else self.present_

    @property
    def null(self) -> Column:
        return false() if self.null_ is None else self.null_

    @property
    def is_str(self) -> Column:
        return false() if self.str is None else self.str.isNotNull()

    @property
    def is_num(self) -> Column:
        return false() if self.num is None else self.num.isNotNull()

    @property
    def is_bool(self) -> Column:
        return false() if self.bool is None else self.bool.isNotNull()

    @property
    def variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    @property
    def is_arr(self) -> Column:
        if self.variant:
            return self.raw.try_cast("array<struct<>>").isNotNull()  # not its schema, whose text grows with the square of the depth
        return self.raw.isNotNull() if isinstance(self.type, T.ArrayType) else false()

    @property
    def is_obj(self) -> Column:
        if self.variant:
            return self.raw.try_cast("struct<>").isNotNull()
        return self.raw.isNotNull() if isinstance(self.type, (T.StructType, T.MapType)) else false()

    def but(self, **slots: Any) -> "Value":
        return replace(self, changed=True, out=None, **slots)

    def or_else(self, other: "Value") -> "Value":
        """The other value where this one is null or missing."""
        gone = self.null | ~self.present
        pick = lambda a, b: None if a is None and b is None else F.when(gone, F.lit(None) if b is None else b).otherwise(F.lit(None) if a is None else a)
        return replace(
            self, str=pick(self.str, other.str), num=pick(self.num, other.num), int=pick(self.int, other.int), bool=pick(self.bool, other.bool),
            raw=F.when(gone, other.as_variant()).otherwise(self.raw) if self.variant else self.raw, null_=gone & other.null, present_=None, changed=True, out=None,
        )

    # ---- parts
    def member(self, key: str) -> "Value":
        """The value under a key; missing if this is no object or lacks it."""
        if self.members is not None:
            if key in self.members or self.rest is None:
                return self.members.get(key, missing())
            kept, kind = self.rest
            inner = from_typed(F.try_element_at(kept, F.lit(key)), kind)
            there = F.coalesce(F.map_contains_key(kept, F.lit(key)), false())
            return replace(inner, present_=there, null_=inner.null & there)
        if self.staged is not None and key in self.staged:
            return self.staged[key]
        if self.variant:
            return from_variant(variant_member(self.raw, key))
        if isinstance(self.type, T.StructType):
            if key not in self.type.names:
                return missing()
            inner = from_typed(self.raw.getField(key), self.type[key].dataType)
            return replace(inner, null_=inner.null & self.raw.isNotNull(), present_=self.raw.isNotNull())
        if isinstance(self.type, T.MapType):
            inner = from_typed(F.try_element_at(self.raw, F.lit(key)), self.type.valueType)
            return replace(inner, present_=F.coalesce(F.map_contains_key(self.raw, F.lit(key)), false()))
        return missing()

    def elements(self) -> tuple[Column, T.DataType] | None:
        """The array column and its element type."""
        if self.variant:
            return self.raw.try_cast("array<variant>"), T.VariantType()
        return (self.raw, self.type.elementType) if isinstance(self.type, T.ArrayType) else None

    def entries(self) -> tuple[Column, T.DataType] | None:
        """The map column of an object and its value type."""
        if self.variant:
            return self.raw.try_cast("map<string,variant>"), T.VariantType()
        return (self.raw, self.type.valueType) if isinstance(self.type, T.MapType) else None

    def keys(self) -> Column:
        """The keys of an object that has ``entries``; of a variant without its values, which a cast would build anew."""
        return F.map_keys(self.raw.try_cast("map<string,struct<>>") if self.variant else self.raw)

    # ---- back to columns
    def as_variant(self) -> Column:
        """The value as a variant; SQL null where it is missing."""
        if self.out is not None:
            return self.out
        if self.variant and not self.changed:
            return self.raw
        if not self.changed and isinstance(self.type, (T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.to_variant_object(self.raw), variant_null())
        ways = [s.cast("variant") for s in (self.str, None if self.int is None else F.when((F.abs(self.int) < 10**18), self.int.cast("long")).cast("long"), self.int, self.num, self.bool) if s is not None]
        if self.variant:
            ways.append(F.when(self.is_arr | self.is_obj, self.raw))
        return F.when(self.present, F.coalesce(*ways, variant_null()))

    def as_typed(self, kind: str) -> Column:
        """The value as a plain column of a schema kind; null where it is not of it."""
        if self.out is not None:
            return self.out
        none = F.lit(None)
        if not self.changed and isinstance(self.type, T.NumericType) and self.num is not None and kind not in ("string", "date", "boolean"):
            return self.raw  # numbers keep their column's type
        if kind in ("string", "date"):
            return none.cast("string") if self.str is None else self.str
        if kind in ("integer", "int32", "int64", "uint32", "money"):
            if self.num is None:
                return none.cast("long")
            if kind == "money" and self.int is None:
                return self.num
            whole = self.num.try_cast("long")
            return whole if self.int is None else F.coalesce(self.int.cast("long"), whole)
        if kind == "uint64":
            return none.cast("decimal(20,0)") if self.int is None else self.int.cast("decimal(20,0)")
        if kind in ("number", "currency", "decimal", "percentage"):
            return none.cast("double") if self.num is None else self.num
        if kind == "boolean":
            return none.cast("boolean") if self.bool is None else self.bool
        if not self.changed and self.raw is not None:
            return self.raw
        if self.str is not None:
            return F.coalesce(self.str, *[x.cast("string") for x in (self.int, self.num, self.bool) if x is not None])
        if self.num is not None:
            return F.coalesce(*[x.cast(self.type) for x in (self.int, self.num) if x is not None]) if isinstance(self.type, T.IntegralType) else self.num
        return none.cast("string") if self.bool is None else self.bool


def variant_null() -> Column:
    return F.parse_json(F.lit("null"))


def missing() -> Value:
    return Value(present_=false(), null_=false(), raw=F.lit(None).cast("variant"), type=T.VariantType(), absent=True)


def variant_member(raw: Column, key: str) -> Column:
    """The variant under a key, SQL null if there is none."""
    quoted = key.replace("\\", "\\\\").replace('"', '\\"').replace("'", "\\'")
    return F.try_variant_get(raw, f"$[\"{quoted}\"]", "variant")


def from_variant(raw: Column, kind: Column | None = None) -> Value:
    """A value whose kind is known per row only; ``kind`` is its schema where that is a column already."""
    kind = F.schema_of_variant(raw) if kind is None else kind
    # whole numbers are BIGINT or, beyond that, DECIMAL(19,0) and wider; 1.0 is DECIMAL(1,0)
    whole = (kind == "BIGINT") | (kind.endswith(",0)") & (F.length(kind) == 13) & (kind >= "DECIMAL(19,0)"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return Value(
        str=F.when(kind == "STRING", F.try_variant_get(raw, "$", "string")),
        num=F.when(number, raw.try_cast("double")),
        int=F.when(whole, raw.try_cast("decimal(38,0)")),
        bool=F.when(kind == "BOOLEAN", raw.try_cast("boolean")),
        raw=raw,
        type=T.VariantType(),
        null_=F.coalesce(F.is_variant_null(raw), false()),
        present_=raw.isNotNull(),
    )


def from_typed(col: Column, type_: T.DataType) -> Value:
    """A value of a column's type; SQL null is JSON null."""
    if isinstance(type_, T.VariantType):
        v = from_variant(col)
        return replace(v, null_=v.null | col.isNull(), present_=None)
    base = {"raw": col, "type": type_, "null_": col.isNull()}
    if isinstance(type_, (T.StringType, T.CharType, T.VarcharType)):
        return Value(str=col, **base)
    if isinstance(type_, T.IntegralType):
        return Value(num=col.cast("double"), int=col.cast("decimal(38,0)"), **base)
    if isinstance(type_, T.DecimalType):
        return Value(num=col.cast("double"), int=col.cast("decimal(38,0)") if type_.scale == 0 else None, **base)
    if isinstance(type_, T.FractionalType):
        return Value(num=col.cast("double"), **base)
    if isinstance(type_, T.BooleanType):
        return Value(bool=col, **base)
    if isinstance(type_, (T.ArrayType, T.StructType, T.MapType)):
        return Value(**base)
    return Value(str=col.cast("string"), **base)  # dates and timestamps as their text


def literal(x: Any) -> Value:
    """A constant JSON value."""
    if x is None:
        return Value(null_=true(), raw=variant_null(), type=T.VariantType(), changed=True)
    if isinstance(x, bool):
        return Value(bool=F.lit(x), changed=True)
    if isinstance(x, int):
        return Value(num=F.lit(float(x)), int=F.lit(str(x)).cast("decimal(38,0)"), changed=True)
    if isinstance(x, float):
        return Value(num=F.lit(x), changed=True)
    if isinstance(x, str):
        return Value(str=F.lit(x), changed=True)
    return replace(from_variant(F.parse_json(F.lit(json.dumps(x)))), present_=None)


def canonical(x: Any) -> str:
    """A JSON constant as text in which equal values are equal: numbers as doubles, keys sorted."""
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    if isinstance(x, (int, float)):
        return json.dumps(float(x))
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(x[k])}" for k in sorted(x)) + "}"


def equals(v: Value, x: Any) -> Column:
    """The value equals a JSON constant; numbers by their double, arrays and objects member by member."""
    if x is None:
        return v.null & v.present
    if isinstance(x, bool):
        return false() if v.bool is None else F.coalesce(v.bool == F.lit(x), false())
    if isinstance(x, (int, float)):
        return false() if v.num is None else F.coalesce(v.num == F.lit(float(x)), false())
    if isinstance(x, str):
        return false() if v.str is None else F.coalesce(v.str == F.lit(x), false())
    if isinstance(x, list):
        found = v.elements()
        if found is None:
            return false()
        arr, kind = found
        same = F.size(arr) == len(x)
        for k, y in enumerate(x):
            same = same & equals(from_typed(F.get(arr, k), kind), y)
        return F.coalesce(v.is_arr & same, false())
    same = v.is_obj
    found = v.entries()
    if found is not None:
        same = same & (F.size(found[0]) == len(x))
    for k, y in x.items():
        same = same & equals(v.member(k), y)
    return F.coalesce(same, false())


def same(a: Value, b: Value) -> Column:
    """Two values are equal."""
    ways = [a.null & b.null]
    for x, y in ((a.str, b.str), (a.num, b.num), (a.bool, b.bool)):
        if x is not None and y is not None:
            ways.append(F.coalesce(x == y, false()))
    if a.raw is not None and b.raw is not None and (a.variant or isinstance(a.type, (T.ArrayType, T.StructType, T.MapType))):
        deep = (a.is_arr & b.is_arr) | (a.is_obj & b.is_obj)
        ways.append(F.coalesce(deep & (F.to_json(a.raw) == F.to_json(b.raw)), false()))
    out = ways[0]
    for w in ways[1:]:
        out = out | w
    return out


def as_key(v: Value) -> Column:
    """A text that two values share if and only if they are the ``same``."""
    ways = [F.when(v.null, F.lit("null"))]
    ways += [F.concat(F.lit(mark), x.cast("string")) for mark, x in (("s", v.str), ("n", None if v.num is None else v.num.cast("double") + F.lit(0.0)), ("b", v.bool)) if x is not None]
    if v.raw is not None and (v.variant or isinstance(v.type, (T.ArrayType, T.StructType, T.MapType))):
        ways.append(F.when(v.is_arr | v.is_obj, F.concat(F.lit("j"), F.to_json(v.raw))))
    return F.coalesce(*ways, F.lit(""))
