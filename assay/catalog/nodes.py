"""One query for each transform, predicate node, template segment and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assay.functions.transforms import TRANSFORMS
from assay.operators import validation as V
from assay.plans.predicates import compile_predicate
from assay.plans.registry import Registry
from assay.plans.values import from_typed

from .base import KEYS, ORACLES, QUERIES, column_query, either, full, nines, samples, shifted, table

# ---------------------------------------------------------------- transforms


def texts(*values: str | None) -> str:
    return shifted(samples(*values))


def transform(name: str, value: str, result: str, args: dict | None = None, as_: str | None = None, slot: str = "str") -> None:
    run = lambda c: getattr(TRANSFORMS[name](from_typed(c, StringType()), args or {}), slot)
    column_query(f"transform_{as_ or name}", "customer", value, run, result, "normal")


NINE = nines()
LOOSE = texts("  Hello   World ", "", None, " a\tb ", "ÄÖ ß", "MiXeD 12-34")
transform("trim", LOOSE, "trim(x)")
transform("collapse_whitespace", LOOSE, "trim(regexp_replace(x, '[ \t]+', ' ', 'g'))")
transform("digits_only", either(LOOSE, "c_name"), "d")
transform("upper", either(texts("abc", "Äé", "", None, "a1"), "lower(c_name)"), "upper(x)")
transform("lower", either(texts("ABC", "ÄÉ", "", None, "A1"), "c_mktsegment"), "lower(x)")
transform("replace", "c_name", "replace(x, '00', '-')", {"pattern": "00", "replacement": "-"})
transform("default", texts("x", None, ""), "coalesce(x, 'none')", {"value": "none"})
MONEY = either(texts("$1,234.56", "-12.345", "abc", "", None, "(5)", "1.005", "0.125", "--3"), "concat(cast((c_custkey * 37) % 400 - 200 as string), '.', lpad(cast(c_custkey % 1000 as string), 3, '0'))")
KEPT = "regexp_replace(x, '[^0-9.-]', '', 'g')"
SIZE = f"try_cast(regexp_replace({KEPT}, '^-+', '') AS DOUBLE)"
AWAY = lambda v: f"(floor({v}) + CASE WHEN {v} - floor({v}) >= 0.5 THEN 1 ELSE 0 END)"
transform("money_to_cents", MONEY, f"cast(CASE WHEN starts_with({KEPT}, '-') THEN -{AWAY(SIZE + ' * 100')} ELSE {AWAY(SIZE + ' * 100')} END AS DOUBLE)", {"scale": 2}, slot="num")
DATES = either(texts("1/2/2024", "01/02/2024", "13/01/2024", "02/30/2024", "2024-01-02", "", None, "01/02/24"), "concat(cast(c_custkey % 14 as string), '/', cast(c_custkey % 33 as string), '/', cast(1990 + c_custkey % 50 as string))")
PARTS = [f"try_cast(split_part(x, '/', {k}) AS INT)" for k in (1, 2, 3)]
ISO = f"lpad(cast({PARTS[2]} AS VARCHAR), 4, '0') || '-' || lpad(cast({PARTS[0]} AS VARCHAR), 2, '0') || '-' || lpad(cast({PARTS[1]} AS VARCHAR), 2, '0')"
transform("date_parse", DATES, f"CASE WHEN {full('x', '[0-9]+/[0-9]+/[0-9]+')} AND {PARTS[0]} BETWEEN 1 AND 12 AND {PARTS[1]} BETWEEN 1 AND 31 AND try_cast({ISO} AS DATE) IS NOT NULL THEN {ISO} ELSE x END", {"format": "MM/DD/YYYY"})
TEN = "CASE WHEN length(d) = 11 AND starts_with(d, '1') THEN substr(d, 2) ELSE d END"
PHONES = either(texts("2125551234", "1 (212) 555-1234", "555-1234", "+44 20 7946 0958", "+123", "", None), nines(10))
transform("phone_us", PHONES, f"CASE WHEN length({TEN}) = 10 THEN '(' || substr({TEN},1,3) || ') ' || substr({TEN},4,3) || '-' || substr({TEN},7,4) ELSE x END")
transform("phone_e164", PHONES, "CASE WHEN starts_with(t, '+') THEN CASE WHEN length(d) BETWEEN 7 AND 15 THEN '+' || d ELSE x END WHEN length(d) = 10 THEN '+1' || d WHEN length(d) = 11 AND starts_with(d, '1') THEN '+' || d ELSE x END")
transform("normalize_flight_number", either(texts(" ua 123 ", "b6-42", "", None), "concat('ua ', cast(c_custkey as string))"), "upper(replace(replace(t, ' ', ''), '-', ''))")
COMPACT = "upper(regexp_replace(x, '[^0-9A-Za-z]', '', 'g'))"
transform("normalize_icd10", either(texts("s72001a", "A00", "a-00.1", "1A0", "", None), "concat('e', cast(c_custkey as string))"), f"CASE WHEN {full(COMPACT, '[A-Z][0-9A-Z]{2,6}')} THEN CASE WHEN length({COMPACT}) > 3 THEN substr({COMPACT},1,3) || '.' || substr({COMPACT},4) ELSE {COMPACT} END ELSE x END")
transform("normalize_cpt", either(texts("99-213", "0001f", "12x45", "", None), nines(5)), f"CASE WHEN {full(COMPACT, '[0-9]{4}[0-9FT]')} THEN {COMPACT} ELSE x END")
transform("normalize_hcpcs", either(texts("j-1885", "w1234", "", None), "concat('a', lpad(cast(c_custkey % 10000 as string), 4, '0'))"), f"CASE WHEN {full(COMPACT, '[A-V][0-9]{4}')} THEN {COMPACT} ELSE x END")
P = [f"split_part(t, '-', {k})" for k in (1, 2, 3)]
transform("normalize_ndc11", either(texts("0002-1433-80", "50242-040-62", "60575-4112-1", "50242-0040-62", "123", "", None), nines(11)), f"CASE WHEN length(d) = 11 THEN d WHEN {full('t', '[0-9]{4}-[0-9]{4}-[0-9]{2}')} THEN '0' || {P[0]} || {P[1]} || {P[2]} WHEN {full('t', '[0-9]{5}-[0-9]{3}-[0-9]{2}')} THEN {P[0]} || '0' || {P[1]} || {P[2]} WHEN {full('t', '[0-9]{5}-[0-9]{4}-[0-9]')} THEN {P[0]} || {P[1]} || '0' || {P[2]} ELSE x END")
transform("card_mask_last4", either(texts("4111 1111 1111 1111", "123", "", None), nines(16)), "CASE WHEN length(d) <= 4 THEN d ELSE repeat('*', length(d) - 4) || right(d, 4) END")
IDS = either(texts("123-45-6789", "12345", "", None), NINE)
transform("format_ssn", IDS, "CASE WHEN length(d) = 9 THEN substr(d,1,3) || '-' || substr(d,4,2) || '-' || substr(d,6) ELSE x END")
transform("format_ein", IDS, "CASE WHEN length(d) = 9 THEN substr(d,1,2) || '-' || substr(d,3) ELSE x END")
transform("mask_ssn", IDS, "CASE WHEN length(d) = 9 THEN '***-**-' || substr(d,6) ELSE x END")
transform("mask_ein", IDS, "CASE WHEN length(d) = 9 THEN '**-***' || substr(d,6) ELSE x END")
FOURS = lambda v: f"array_to_string(list_transform(range(0, cast(ceil(length({v}) / 4.0) AS BIGINT)), lambda i: substr({v}, i * 4 + 1, 4)), ' ')"
SQUEEZED = "upper(replace(x, ' ', ''))"
transform("format_iban", either(texts("gb29nwbk60161331926819", "de89 3704", "abcd", "", None), f"concat('de', {NINE})"), f"CASE WHEN length({SQUEEZED}) >= 5 THEN {FOURS(SQUEEZED)} ELSE x END")
transform("format_credit_card", either(texts("4111-1111-1111-1111", "123", "", None), nines(15)), f"CASE WHEN length(d) >= 13 THEN {FOURS('d')} ELSE x END")
BARE = f"regexp_replace({KEPT}, '^-+', '')"
HEAD, TAIL = f"split_part({BARE}, '.', 1)", f"CASE WHEN contains({BARE}, '.') THEN substr({BARE}, strpos({BARE}, '.')) ELSE '' END"
GROUPED = f"reverse(regexp_replace(reverse({HEAD}), '([0-9]{{3}})', '\\1,', 'g'))"
transform("format_thousands", either(texts("1234567.891", "-1000", "999", "abc", "", None, "$12,345", "1.2.3"), "cast(c_custkey * 104729 as string)"), f"CASE WHEN {full(HEAD, '[0-9]+')} THEN CASE WHEN starts_with({KEPT}, '-') THEN '-' ELSE '' END || ltrim({GROUPED}, ',') || {TAIL} ELSE x END")
AMOUNT = f"try_cast({KEPT} AS DOUBLE)"
CENTS = f"{AWAY(f'(abs({AMOUNT}) * 100)')}"
transform("format_decimal", MONEY, f"CASE WHEN {AMOUNT} IS NOT NULL THEN CASE WHEN {AMOUNT} < 0 AND {CENTS} > 0 THEN '-' ELSE '' END || cast(cast(floor({CENTS} / 100) AS BIGINT) AS VARCHAR) || '.' || lpad(cast(cast({CENTS} AS BIGINT) % 100 AS VARCHAR), 2, '0') ELSE x END", {"places": 2})

# ---------------------------------------------------------------- predicate nodes over rows

_REGISTRY = Registry.default()


def node_query(name: str, source: str, pred: dict, result: str, columns: str = "*") -> None:
    """A rule over a table's rows as objects."""
    key = KEYS[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).selectExpr(key, f"struct({columns}) as doc")
        return rows.select(key, compile_predicate(pred, from_typed(F.col("doc"), rows.schema["doc"].dataType), _REGISTRY).alias("ok"))

    QUERIES[f"node_{name}"] = run
    picked = "" if columns == "*" else f", {columns}"
    ORACLES[f"node_{name}"] = f"SELECT {key}, {result} AS ok FROM (SELECT *{picked} FROM {source})" if columns != "*" else f"SELECT {key}, {result} AS ok FROM {source}"


KEYS["lineitem"] = "l_orderkey"
#: Some members that are null for some rows, alike in both engines.
SPARSE = "CASE WHEN c_custkey % 3 = 0 THEN c_name END AS a, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS b, c_custkey % 7 AS m, c_custkey % 4 AS n, c_acctbal AS bal"
node_query("exists", "customer", {"type": "exists", "path": "/a"}, "a IS NOT NULL", SPARSE)
node_query("eq", "customer", {"type": "eq", "path": "/c_mktsegment", "value": "BUILDING"}, "coalesce(c_mktsegment = 'BUILDING', false)")
node_query("in", "orders", {"type": "in", "path": "/o_orderstatus", "values": ["F", "P"]}, "coalesce(o_orderstatus IN ('F', 'P'), false)")
node_query("required_with", "customer", {"type": "required_with", "field": "/a", "with": "/b"}, "b IS NULL OR a IS NOT NULL", SPARSE)
node_query("required_without", "customer", {"type": "required_without", "field": "/a", "without": "/b"}, "b IS NOT NULL OR a IS NOT NULL", SPARSE)
node_query("exactly_one_of", "customer", {"type": "exactly_one_of", "paths": ["/a", "/b"]}, "(a IS NOT NULL) <> (b IS NOT NULL)", SPARSE)
node_query("eq_fields", "customer", {"type": "eq_fields", "left": "/m", "right": "/n"}, "m = n", SPARSE)
node_query("eq_fields_each", "customer", {"type": "eq_fields", "left": "/p/*", "right": "/q/*"}, "c_custkey % 3 = c_custkey % 6 AND c_custkey % 4 <> 0", "CASE WHEN c_custkey % 4 = 0 THEN array(c_custkey, 1) ELSE array(1, c_custkey % 3) END AS p, array(1, c_custkey % 6) AS q")
ORACLES["node_eq_fields_each"] = "SELECT c_custkey, c_custkey % 3 = c_custkey % 6 AND c_custkey % 4 <> 0 AS ok FROM customer"
for _op, _sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    node_query(f"{_op}_field", "customer", {"type": f"{_op}_field", "left": "/m", "right": "/n"}, f"m {_sign} n", SPARSE)
node_query("sum_equals", "customer", {"type": "sum_equals", "paths": ["/m", "/n"], "target": "/q"}, "m + n = q", SPARSE + ", c_custkey % 10 AS q")
node_query("sum_equals_value", "customer", {"type": "sum_equals_value", "paths": ["/m", "/n"], "value": 5}, "m + n = 5", SPARSE)
RICH, BUILD = {"type": "gt_field", "left": "/m", "right": "/n"}, {"type": "exists", "path": "/b"}
node_query("and", "customer", {"type": "and", "predicates": [RICH, BUILD]}, "m > n AND b IS NOT NULL", SPARSE)
node_query("or", "customer", {"type": "or", "predicates": [RICH, BUILD]}, "m > n OR b IS NOT NULL", SPARSE)
node_query("not", "customer", {"type": "not", "predicate": RICH}, "NOT (m > n)", SPARSE)
node_query("implies", "customer", {"type": "implies", "if": RICH, "then": BUILD}, "NOT (m > n) OR b IS NOT NULL", SPARSE)
node_query("true", "customer", {"type": "true"}, "true")
node_query("false", "customer", {"type": "false"}, "false")


def value_node(name: str, source: str, value: str, pred: dict, result: str) -> None:
    """A node that tests the value itself."""
    key = KEYS[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(key, F.expr(value).alias("input"))
        return rows.withColumn("ok", compile_predicate(pred, from_typed(F.col("input"), rows.schema["input"].dataType), _REGISTRY))

    QUERIES[f"node_{name}"] = run
    ORACLES[f"node_{name}"] = f"SELECT {key}, {value} AS input, {result.replace('{x}', '(' + value + ')')} AS ok FROM {source}"


value_node("regex", "customer", "c_name", {"type": "regex", "pattern": "^Customer#0+[1-4]\\d*5$"}, "regexp_matches({x}, '^Customer#0+[1-4][0-9]*5$')")
value_node("regex_flags", "customer", "c_mktsegment", {"type": "regex", "pattern": "^b", "flags": "i"}, "regexp_matches({x}, '^[bB]')")
value_node("min_len", "customer", "c_mktsegment", {"type": "min_len", "len": 9}, "length({x}) >= 9")
value_node("max_len", "customer", "c_mktsegment", {"type": "max_len", "len": 9}, "length({x}) <= 9")
value_node("range", "customer", "c_acctbal", {"type": "range", "min": 0, "max": 5000}, "coalesce({x} BETWEEN 0 AND 5000, false)")
value_node("call", "customer", "c_acctbal", {"type": "call", "name": "is_multiple_of", "args": {"value": 0.5}}, "coalesce(abs({x} / 0.5 - round({x} / 0.5)) < 1e-9, false)")
value_node("template_literal", "part", "p_brand", {"type": "template_literal", "parts": [{"kind": "literal", "value": "Brand#"}, {"kind": "digits", "min": 2, "max": 2}]}, "regexp_full_match({x}, 'Brand#[0-9]{2}')")
TAGS = samples("ab-12", "AB-12", "aB3-9", "ff-0a", "zz-xy", "-", "Q1-", None)
for _kind, _class in (("literal", ""), ("digits", "[0-9]"), ("ascii_letters", "[A-Za-z]"), ("ascii_alphanumeric", "[A-Za-z0-9]"), ("uppercase", "[A-Z]"), ("lowercase", "[a-z]"), ("hex", "[0-9A-Fa-f]")):
    _part = {"kind": "literal", "value": "ab"} if _kind == "literal" else {"kind": _kind}
    value_node(f"segment_{_kind}", "customer", TAGS, {"type": "template_literal", "parts": [_part, {"kind": "literal", "value": "-"}, {"kind": "ascii_alphanumeric", "min": 0}]}, f"coalesce(regexp_full_match({{x}}, '{_class + '+' if _class else 'ab'}-[A-Za-z0-9]*'), true)")

# ---------------------------------------------------------------- types


def type_query(name: str, value: str, node: dict, result: str, source: str = "customer") -> None:
    """A type over documents of JSON text; the result is the joined paths and codes."""
    key = KEYS[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(key, F.expr(value).alias("input"))
        return V.validate_documents(rows, node, "input").select(key, "input", "valid", V.issue_codes(F.col("errors")).alias("codes"))

    QUERIES[f"type_{name}"] = run
    ORACLES[f"type_{name}"] = f"SELECT k AS {key}, x AS input, codes = '' AS valid, codes FROM (SELECT k, x, {result} AS codes FROM (SELECT {key} AS k, {value} AS x FROM {source}))"


DOCS = samples('1', '1.0', '1.5', '-3', '300', '"a"', '""', 'null', 'true', '[1]', '{"a":1}', '4294967296', '9223372036854775808', '18446744073709551616')
KIND = "json_type(x)"
NUMBER = f"{KIND} IN ('BIGINT','UBIGINT','DOUBLE','HUGEINT','INTEGER')"
NULLISH = f"{KIND} = 'NULL'"
EXACT = "CASE WHEN regexp_full_match(x, '-?[0-9]+') THEN try_cast(x AS HUGEINT) END"


def bad(test: str, code: str = ":TYPE_ERROR") -> str:
    return f"CASE WHEN {test} THEN '{code}' ELSE '' END"


type_query("string", DOCS, {"type": "string", "constraints": [{"pred": {"type": "min_len", "len": 1}, "error": {"code": "EMPTY"}}]}, f"CASE WHEN {NULLISH} THEN '' WHEN {KIND} <> 'VARCHAR' THEN ':TYPE_ERROR' WHEN x = '\"\"' THEN ':EMPTY' ELSE '' END")
type_query("date", DOCS, {"type": "date", "format": "MM/DD/YYYY"}, bad(f"{KIND} NOT IN ('NULL','VARCHAR')"))
for _n in ("number", "money"):
    type_query(_n, DOCS, {"type": _n}, bad(f"NOT ({NULLISH} OR {NUMBER})"))
type_query("integer", DOCS, {"type": "integer"}, bad(f"NOT ({NULLISH} OR {NUMBER} AND try_cast(x AS DOUBLE) = floor(try_cast(x AS DOUBLE)))"))
for _n, _low, _high in (("int32", -(2**31), 2**31 - 1), ("int64", -(2**63), 2**63 - 1), ("uint32", 0, 2**32 - 1), ("uint64", 0, 2**64 - 1)):
    type_query(_n, DOCS, {"type": _n}, bad(f"NOT ({NULLISH} OR coalesce({EXACT} BETWEEN {_low}::HUGEINT AND {_high}::HUGEINT, false))"))
type_query("boolean", DOCS, {"type": "boolean"}, bad(f"{KIND} NOT IN ('NULL','BOOLEAN')"))
FINE = samples('1.5', '1.234', '12', '"x"', 'null', '99.999', '-1', '100.5', '0.25', '123456.78')
D = "try_cast(x AS DOUBLE)"
FINER = lambda s: f"abs({D} * {10.0**s} - round({D} * {10.0**s})) > 1e-10"
TYPED = f"CASE WHEN {NULLISH} THEN '' WHEN {KIND} = 'VARCHAR' THEN ':TYPE_ERROR' ELSE "
JOIN = lambda *p: "array_to_string(list_filter([" + ", ".join(p) + "], lambda c: c <> ''), ',') END"
type_query("currency", FINE, {"type": "currency", "code": "USD", "scale": 2}, TYPED + JOIN(bad(FINER(2), ":CURRENCY_SCALE_EXCEEDED")))
DIGITS = f"length(regexp_replace(regexp_replace(printf('%.10f', abs({D})), '[.]?0+$', ''), '[^0-9]', '', 'g'))"
type_query("decimal", FINE, {"type": "decimal", "scale": 2, "precision": 5}, TYPED + JOIN(bad(f"{DIGITS} > 5", ":DECIMAL_PRECISION_EXCEEDED"), bad(FINER(2), ":DECIMAL_SCALE_EXCEEDED")))
type_query("percentage", FINE, {"type": "percentage", "format": "whole", "scale": 2}, TYPED + JOIN(bad(f"{D} < 0", ":PERCENTAGE_NEGATIVE"), bad(FINER(2), ":PERCENTAGE_SCALE_EXCEEDED"), bad(f"{D} > 100", ":PERCENTAGE_TOO_HIGH")))
type_query("enum", DOCS, {"type": "enum", "values": [1, "a", True]}, bad(f"NOT ({NULLISH} OR x IN ('1', '1.0', '\"a\"', '\"\"', 'true'))", ":INVALID_ENUM"))
type_query("literal", DOCS, {"type": "literal", "value": 1}, bad("x NOT IN ('1', '1.0')", ":INVALID_LITERAL"))
type_query("never", DOCS, {"type": "never"}, "':TYPE_ERROR'")
type_query("any", DOCS, {"type": "any"}, "''")
type_query("union", DOCS, {"type": "union", "oneOf": [{"type": "integer"}, {"type": "string"}]}, bad(f"NOT ({NULLISH} OR {KIND} = 'VARCHAR' OR {NUMBER} AND {D} = floor({D}))", ":INVALID_UNION"))
type_query("intersection", DOCS, {"type": "intersection", "allOf": [{"type": "number"}, {"type": "integer"}]}, bad(f"NOT ({NULLISH} OR {NUMBER} AND {D} = floor({D}))"))
type_query("preprocess", samples('" 5 "', '"x"', '7', 'null'), {"type": "preprocess", "transforms": [{"fn": "money_to_cents", "scale": 0}], "schema": {"type": "integer"}}, bad("x = '\"x\"'"))
type_query("catch", DOCS, {"type": "catch", "schema": {"type": "boolean"}, "value": False}, "''")
LISTS = samples('[]', '[1]', '[1,2]', '[1,"x"]', '[1,2,3,4]', '"a"', 'null', '[null]')
type_query("array", LISTS, {"type": "array", "items": {"type": "integer"}, "min_items": 1, "max_items": 3}, "CASE x WHEN '[]' THEN ':ARRAY_TOO_SHORT' WHEN '[1,\"x\"]' THEN '/1:TYPE_ERROR' WHEN '[1,2,3,4]' THEN ':ARRAY_TOO_LONG' WHEN '\"a\"' THEN ':TYPE_ERROR' ELSE '' END")
type_query("tuple", LISTS, {"type": "tuple", "items": [{"type": "integer"}, {"type": "string"}]}, "CASE x WHEN '[]' THEN ':INVALID_TUPLE' WHEN '[1]' THEN ':INVALID_TUPLE' WHEN '[1,2]' THEN '/1:TYPE_ERROR' WHEN '[1,2,3,4]' THEN '/1:TYPE_ERROR,:INVALID_TUPLE' WHEN '\"a\"' THEN ':TYPE_ERROR' WHEN '[null]' THEN ':INVALID_TUPLE' ELSE '' END")
type_query("record", "props", {"type": "record", "value": {"type": "number"}, "key": {"type": "string", "constraints": [{"pred": {"type": "max_len", "len": 1}, "error": {"code": "LONG_KEY"}}]}}, "''", source="events")
OBJECTS = samples('{"a":1}', '{"a":1,"b":"x"}', '{"b":"x"}', '{"a":null}', '{"a":"1"}', '{"a":1,"z":2}', '7', 'null')
MEMBERS = {"a": {"type": "number"}, "b": {"type": "string", "required": False}}
type_query("object", OBJECTS, {"type": "object", "properties": MEMBERS}, "CASE x WHEN '{\"b\":\"x\"}' THEN '/a:REQUIRED' WHEN '{\"a\":null}' THEN '/a:REQUIRED' WHEN '{\"a\":\"1\"}' THEN '/a:TYPE_ERROR' WHEN '{\"a\":1,\"z\":2}' THEN '/z:ADDITIONAL_PROPERTY_NOT_ALLOWED' WHEN '7' THEN ':TYPE_ERROR' ELSE '' END")
type_query("object_catchall", OBJECTS, {"type": "object", "properties": MEMBERS, "catchall": {"type": "string"}}, "CASE x WHEN '{\"b\":\"x\"}' THEN '/a:REQUIRED' WHEN '{\"a\":null}' THEN '/a:REQUIRED' WHEN '{\"a\":\"1\"}' THEN '/a:TYPE_ERROR' WHEN '{\"a\":1,\"z\":2}' THEN '/z:TYPE_ERROR' WHEN '7' THEN ':TYPE_ERROR' ELSE '' END")
type_query("ref", OBJECTS, {"version": "1.0", "definitions": {"A": {"type": "object", "properties": MEMBERS, "unknown_keys": "passthrough"}}, "root": {"$ref": "A"}}, "CASE x WHEN '{\"b\":\"x\"}' THEN '/a:REQUIRED' WHEN '{\"a\":null}' THEN '/a:REQUIRED' WHEN '{\"a\":\"1\"}' THEN '/a:TYPE_ERROR' WHEN '7' THEN ':TYPE_ERROR' ELSE '' END")


def chain(n: int, last: str = "1") -> str:
    """A list of n nodes, each but the last with a next one."""
    return '{"v":1,"next":' * (n - 1) + f'{{"v":{last}}}' + "}" * (n - 1)


#: A node lies two levels below the one before it (reference and object), its value one more: of 128 levels the 64th node's value is the first beyond.
TREES = samples('{"v":1}', '{"v":1,"next":{"v":"x"}}', '{"v":1,"next":{"v":1,"next":{}}}', *(chain(n, v) for n in (2, 5, 20, 63) for v in ("1", '"x"')), chain(64))
type_query("ref_recursive", TREES, {"version": "1.0", "definitions": {"N": {"type": "object", "properties": {"v": {"type": "number"}, "next": {"$ref": "N", "required": False}}}}, "root": {"$ref": "N"}}, "CASE k % 12 WHEN 1 THEN '/next/v:TYPE_ERROR' WHEN 2 THEN '/next/next/v:REQUIRED' WHEN 4 THEN '/next/v:TYPE_ERROR' WHEN 6 THEN repeat('/next', 4) || '/v:TYPE_ERROR' WHEN 8 THEN repeat('/next', 19) || '/v:TYPE_ERROR' WHEN 10 THEN repeat('/next', 62) || '/v:TYPE_ERROR' WHEN 11 THEN repeat('/next', 63) || '/v:MAX_DEPTH_EXCEEDED' ELSE '' END")
