"""Queries over whole schemas: validation, reports, columnar checks, sources and streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StringType

from assay.builder import lit, seg, w
from assay.forms import define_form, f
from assay.functions.predicates import reference
from assay.functions.predicates.lite import lite
from assay.operators import batch, report
from assay.operators import validation as V
from assay.operators.scratch import folder
from assay.plans import generate
from assay.plans.registry import Registry
from assay.plans.values import from_typed
from assay.sources import readers
from assay.streaming import streams

from .base import KEYS, ORACLES, QUERIES, checked, column_query, either, full, luhn, nines, quoted, samples, shifted, table
from .predicates import EIN, ITIN, SSN, STRICT
from .predicates import ATIN as ATIN_SQL

KEYS["lineitem"] = "l_orderkey"

# ---------------------------------------------------------------- schemas over tables


def _warn(pred: dict, code: str) -> dict:
    return {"pred": pred, "error": {"code": code, "message": code.lower(), "severity": "warning"}}


def customer_schema() -> dict:
    """A schema of the customer table, written with the builder."""
    schema = w.object(
        c_custkey=w.int64(),
        c_name=w.string().trim().starts_with(code="BAD_NAME", value="Customer#").template(lit("Customer#"), seg("digits", 9, 9), code="BAD_NAME_SHAPE"),
        c_nationkey=w.int32().range(0, 24, "BAD_NATION"),
        c_acctbal=w.number(),
        c_mktsegment=w.enum("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"),
    ).when("c_mktsegment").equals("BUILDING").require_predicate({"type": "in", "path": "/c_nationkey", "values": list(range(0, 20))}, "BUILDING_NATION")
    node = schema.to_dict()
    node["properties"]["c_acctbal"]["constraints"] = [_warn({"type": "call", "name": "is_non_negative"}, "OVERDRAWN")]
    return node


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate(table(spark, sf_dir, "customer"), customer_schema())


_CUSTOMER_SQL = """
    SELECT *, list_filter([CASE WHEN NOT starts_with(c_name, 'Customer#') THEN '/c_name:BAD_NAME' END,
        CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN '/c_name:BAD_NAME_SHAPE' END,
        CASE WHEN c_nationkey NOT BETWEEN 0 AND 24 THEN '/c_nationkey:BAD_NATION' END,
        CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', '') THEN '/c_mktsegment:INVALID_ENUM' END,
        CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey >= 20 THEN ':BUILDING_NATION' END], lambda e: e IS NOT NULL) AS errors,
        CASE WHEN c_acctbal < 0 THEN ['/c_acctbal:OVERDRAWN'] ELSE [] END AS warnings FROM customer
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the customer table by path and code."""
    return report.by_code(_customers(spark, sf_dir))


def register(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


register("validate_report", flagship, f"SELECT split_part(i, ':', 1) AS path, split_part(i, ':', 2) AS code, CASE WHEN split_part(i, ':', 2) = 'OVERDRAWN' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM (SELECT unnest(list_concat(errors, warnings)) AS i FROM ({_CUSTOMER_SQL})) GROUP BY ALL")
register(
    "validate_rows",
    lambda s, d: _customers(s, d).select("c_custkey", "c_name", "valid", V.issue_codes(F.col("errors")).alias("errors"), V.issue_codes(F.col("warnings")).alias("warnings")),
    f"SELECT c_custkey, c_name, len(errors) = 0 AS valid, array_to_string(list_sort(errors), ',') AS errors, array_to_string(warnings, ',') AS warnings FROM ({_CUSTOMER_SQL})",
)
register("validate_summary", lambda s, d: report.summary(_customers(s, d)), f"SELECT count(*) AS rows, count(*) FILTER (len(errors) = 0) AS valid_count, count(*) FILTER (len(errors) > 0) AS invalid_count, bool_and(len(errors) = 0) AS all_valid FROM ({_CUSTOMER_SQL})")
register("validate_rollup", lambda s, d: report.rolled_up(_customers(s, d)), f"SELECT path, code, count(*) AS n FROM (SELECT split_part(i, ':', 1) AS path, split_part(i, ':', 2) AS code FROM (SELECT unnest(list_concat(errors, warnings)) AS i FROM ({_CUSTOMER_SQL}))) GROUP BY ROLLUP (path, code)")
register("validate_worst", lambda s, d: report.worst(_customers(s, d), "c_custkey", 20), f"SELECT c_custkey, cast(len(errors) AS INT) AS n_errors FROM ({_CUSTOMER_SQL}) ORDER BY n_errors DESC, c_custkey LIMIT 20")
register("validate_split_valid", lambda s, d: V.split_valid(table(s, d, "customer"), customer_schema())[0].select("c_custkey"), f"SELECT c_custkey FROM ({_CUSTOMER_SQL}) WHERE len(errors) = 0")
register("validate_split_invalid", lambda s, d: V.split_valid(table(s, d, "customer"), customer_schema())[1].select("c_custkey"), f"SELECT c_custkey FROM ({_CUSTOMER_SQL}) WHERE len(errors) > 0")


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.filter(V.is_valid(rows, customer_schema())).select("c_custkey")


register("validate_filter", _filtered, f"SELECT c_custkey FROM ({_CUSTOMER_SQL}) WHERE len(errors) = 0")
register(
    "validate_field_state",
    lambda s, d: _customers(s, d).select("c_custkey", V.field_state(F.col("errors"), F.col("warnings"), "/c_mktsegment").alias("f")).select("c_custkey", "f.valid", "f.n_errors", "f.n_warnings"),
    "SELECT c_custkey, c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', '') AS valid, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', '') THEN 0 ELSE 1 END AS n_errors, 0 AS n_warnings FROM customer",
)
register(
    "validate_or_raise",
    lambda s, d: V.validate_or_raise(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), {"type": "object", "properties": {"o_orderkey": {"type": "integer"}, "o_orderstatus": {"type": "enum", "values": ["F", "O", "P"]}}}).select("o_orderkey", "valid"),
    "SELECT o_orderkey, true AS valid FROM orders",
)



def customer_form():
    """The customer table as a form of two sections."""
    return (
        define_form().id("customer").title("Customer").description("A customer's master data").section("who", "Identity", 1).section("account", "Account", 2)
        .field("c_custkey", f.uint32("Number").required().section("who").range(1, 1000, "NUMBER"))
        .field("c_name", f.string("Name").required().section("who").label("Name").example("Customer#000000001").lower().starts_with(value="customer#"))
        .field("c_nationkey", f.int32("Nation").optional().section("who"))
        .field("c_acctbal", f.money("Balance").section("account").is_non_negative())
        .field("c_mktsegment", f.enum("Segment", ["BUILDING", "MACHINERY"]).section("account"))
    )


register(
    "validate_form",
    lambda s, d: customer_form().validate(table(s, d, "customer")).select("c_custkey", "c_name", "valid", V.issue_codes(F.col("errors")).alias("codes")),
    """
    SELECT c_custkey, lower(c_name) AS c_name, len(e) = 0 AS valid, array_to_string(list_sort(e), ',') AS codes FROM (SELECT *, list_filter([CASE WHEN c_custkey NOT BETWEEN 1 AND 1000 THEN '/c_custkey:NUMBER' END,
        CASE WHEN c_acctbal < 0 THEN '/c_acctbal:INVALID_NON_NEGATIVE' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', '') THEN '/c_mktsegment:INVALID_ENUM' END], lambda x: x IS NOT NULL) AS e FROM customer)
    """,
)

LINE_SCHEMA = {
    "type": "object",
    "unknown_keys": "passthrough",
    "properties": {
        "l_quantity": {"type": "number", "constraints": [{"pred": {"type": "range", "min": 1, "max": 50}, "error": {"code": "QUANTITY"}}, {"pred": {"type": "call", "name": "is_integer"}, "error": {"code": "WHOLE"}}]},
        "l_extendedprice": {"type": "currency", "scale": 2, "constraints": [{"pred": {"type": "call", "name": "is_positive"}, "error": {"code": "PRICE"}}]},
        "l_discount": {"type": "percentage", "format": "decimal", "scale": 2},
        "l_tax": {"type": "percentage", "format": "decimal", "constraints": [{"pred": {"type": "range", "max": 0.05}, "error": {"code": "TAX"}}]},
        "l_returnflag": {"type": "enum", "values": ["A", "N", "R"]},
        "l_linestatus": {"type": "string", "transforms": [{"fn": "lower"}], "constraints": [{"pred": {"type": "in", "path": "", "values": ["o", "f"]}, "error": {"code": "STATUS"}}]},
    },
    "rules": [{"pred": {"type": "lt_field", "left": "/l_discount", "right": "/l_tax"}, "error": {"code": "DISCOUNT_UNDER_TAX", "severity": "warning"}}],
}
register(
    "validate_lines",
    lambda s, d: V.validate(table(s, d, "lineitem"), LINE_SCHEMA).select(F.explode(F.concat("errors", "warnings")).alias("i")).groupBy("i.path", "i.code").agg(F.count("*").alias("n")),
    """
    SELECT split_part(i, ':', 1) AS path, split_part(i, ':', 2) AS code, count(*) AS n FROM (SELECT unnest([
        CASE WHEN l_quantity NOT BETWEEN 1 AND 50 THEN '/l_quantity:QUANTITY' END, CASE WHEN l_quantity <> floor(l_quantity) THEN '/l_quantity:WHOLE' END,
        CASE WHEN abs(l_extendedprice * 100 - round(l_extendedprice * 100)) > 1e-10 THEN '/l_extendedprice:CURRENCY_SCALE_EXCEEDED' END, CASE WHEN l_extendedprice <= 0 THEN '/l_extendedprice:PRICE' END,
        CASE WHEN l_discount < 0 THEN '/l_discount:PERCENTAGE_NEGATIVE' END, CASE WHEN l_discount > 1 THEN '/l_discount:PERCENTAGE_TOO_HIGH' END,
        CASE WHEN abs(l_discount * 100 - round(l_discount * 100)) > 1e-10 THEN '/l_discount:PERCENTAGE_SCALE_EXCEEDED' END,
        CASE WHEN l_tax < 0 THEN '/l_tax:PERCENTAGE_NEGATIVE' END, CASE WHEN l_tax > 1 THEN '/l_tax:PERCENTAGE_TOO_HIGH' END, CASE WHEN l_tax > 0.05 THEN '/l_tax:TAX' END,
        CASE WHEN l_returnflag NOT IN ('A', 'N', 'R', '') THEN '/l_returnflag:INVALID_ENUM' END, CASE WHEN lower(l_linestatus) NOT IN ('o', 'f') THEN '/l_linestatus:STATUS' END,
        CASE WHEN NOT l_discount < l_tax THEN ':DISCOUNT_UNDER_TAX' END]) AS i FROM lineitem) WHERE i IS NOT NULL GROUP BY ALL
    """,
)
EVENT_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "constraints": [{"pred": {"type": "range", "max": 50}, "error": {"code": "LARGE"}}]}}}
register(
    "validate_json_column",
    lambda s, d: V.validate_documents(table(s, d, "events").select("event_id", "props"), EVENT_SCHEMA, "props").select("event_id", "valid", V.issue_codes(F.col("errors")).alias("codes"), F.to_json("normalized").alias("normalized")),
    "SELECT event_id, cast(json_extract(props, '$.k') AS INT) <= 50 AS valid, CASE WHEN cast(json_extract(props, '$.k') AS INT) <= 50 THEN '' ELSE '/k:LARGE' END AS codes, replace(props, ' ', '') AS normalized FROM events",
)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    item = {"type": "object", "properties": {"turn": {"type": "integer"}, "role": {"type": "enum", "values": ["user", "assistant"]}, "text": {"type": "string", "constraints": [{"pred": {"type": "max_len", "len": 200}, "error": {"code": "LONG"}}]}}}
    schema = {"type": "object", "properties": {"conv_id": {"type": "integer"}, "turns": {"type": "array", "items": item, "min_items": 3}}}
    return V.validate(turns, schema).select("conv_id", F.size("turns").alias("n"), F.size("errors").alias("n_errors"))


register("validate_nested", _turns, "SELECT conv_id, cast(count(*) AS INT) AS n, cast(CASE WHEN count(*) < 3 THEN 1 ELSE 0 END + count(*) FILTER (role NOT IN ('user', 'assistant')) + count(*) FILTER (length(text) > 200) AS INT) AS n_errors FROM conversations GROUP BY conv_id")
register(
    "validate_embeddings",
    lambda s, d: V.validate(table(s, d, "embeddings").select("vec_id", "embedding"), {"type": "object", "properties": {"vec_id": {"type": "integer"}, "embedding": {"type": "array", "items": {"type": "number", "constraints": [{"pred": {"type": "range", "min": -2, "max": 2}, "error": {"code": "FAR"}}]}}}}).select("vec_id", F.size("errors").alias("n_errors")),
    "SELECT vec_id, cast(len(list_filter(embedding, lambda e: e < -2 OR e > 2)) AS INT) AS n_errors FROM embeddings",
)


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own predicate."""
    registry = Registry.default().register("custom_is_even", lambda v, args: F.coalesce(v.num % 2 == 0, F.lit(False)))
    schema = {"type": "object", "properties": {"c_custkey": {"type": "integer", "constraints": [{"pred": {"type": "call", "name": "custom_is_even"}, "error": {"code": "ODD"}}]}}}
    return V.validate(table(spark, sf_dir, "customer").select("c_custkey"), schema, registry=registry).select("c_custkey", "valid")


register("validate_custom_predicate", _own, "SELECT c_custkey, c_custkey % 2 = 0 AS valid FROM customer")

# ---------------------------------------------------------------- columnar checks

NINE = nines()
IDS = either(shifted(samples("123-45-6789", "000-12-3456", "666-12-3456", "987-65-4321", "111111111", "123-00-6789", "123-45-0000", "912-70-1234", "912-93-1234", "99-9999999", "x", None)), NINE)
GUARD = f"coalesce({STRICT}, false)"
column_query("batch_tin_kind", "customer", IDS, batch.tin_kind, f"CASE WHEN NOT {GUARD} THEN 'Unknown' WHEN {ATIN_SQL} THEN 'Atin' WHEN {ITIN} THEN 'Itin' WHEN {SSN} THEN 'Ssn' WHEN {EIN} THEN 'Ein' ELSE 'Unknown' END", "kind")
column_query("batch_ssn_reason", "customer", IDS, batch.ssn_reason, f"CASE WHEN NOT {GUARD} THEN 'InvalidFormat' WHEN substr(d,1,3) = '000' THEN 'AreaZero' WHEN substr(d,1,3) = '666' THEN 'Area666' WHEN substr(d,1,1) = '9' THEN 'Area9xx' WHEN substr(d,4,2) = '00' THEN 'GroupZero' WHEN substr(d,6,4) = '0000' THEN 'SerialZero' WHEN d = repeat(substr(d,1,1), 9) THEN 'AllSameDigit' END", "reason")
column_query("batch_ein_reason", "customer", IDS, batch.ein_reason, f"CASE WHEN NOT {GUARD} THEN 'InvalidFormat' WHEN NOT {EIN} THEN 'InvalidCampusCode' END", "reason")
column_query("batch_valid_tin", "customer", IDS, batch.valid_tin, checked(STRICT, f"d <> '000000000' AND ({SSN} OR {EIN} OR {ITIN} OR {ATIN_SQL})"))
for _n, _f, _p in (("ssn", batch.is_ssn_format, "[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9}"), ("ein", batch.is_ein_format, "[0-9]{2}-[0-9]{7}|[0-9]{9}"), ("zip", batch.is_zip_format, "[0-9]{5}(-[0-9]{4})?")):
    column_query(f"batch_{_n}_format", "customer", either(shifted(samples("123-45-6789", "12-3456789", "12345", "12345-6789", "x", "")), NINE), _f, full("x", _p))
column_query("batch_email_format", "customer", samples("a@b.c", "@b.c", "a@", "a@b", "a@.b", "a@b.", "a@@b.c", ""), batch.is_email_format, "strpos(x, '@') > 1 AND strpos(x, '@') < length(x) AND contains(substr(x, strpos(x, '@') + 1), '.') AND NOT starts_with(substr(x, strpos(x, '@') + 1), '.') AND NOT ends_with(x, '.')")
column_query("batch_to_cents", "customer", "c_acctbal", batch.to_cents, "NULL", "cents")
ORACLES["batch_to_cents"] = "SELECT c_custkey, c_acctbal AS input, cast(sign(c_acctbal) * (floor(abs(c_acctbal * 100)) + CASE WHEN abs(c_acctbal * 100) - floor(abs(c_acctbal * 100)) >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS cents FROM customer"
SCANNED = either(shifted(samples("123-45-6789", "12-3456789", "ada@example.com", "(212) 555-1234", "+44 2079460958", "12345", "12345-6789", "01/31/2024", "2024-01-31", "$1,234.56", "-5.25", "037833100", "x", "")), NINE)
column_query("batch_scan_patterns", "customer", SCANNED, lambda c: F.array_join(batch.scan_patterns(c), ","), "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {full('x', p)} THEN {quoted(n)} END" for n, p in batch.PATTERNS.items()) + "], lambda e: e IS NOT NULL), ',')", "ids")
FORMS = f"SELECT c_custkey, {NINE} AS payer_tin, {nines(9, 104729)} AS recipient_tin, cast(floor(c_acctbal * 100) as bigint) AS interest_income, cast(2015 + c_custkey % 20 as smallint) AS tax_year FROM customer"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{NINE} AS payer_tin", f"{nines(9, 104729)} AS recipient_tin", "cast(floor(c_acctbal * 100) as bigint) AS interest_income", "cast(2015 + c_custkey % 20 as smallint) AS tax_year")
    return batch.validate_forms(rows)


def _tin_sql(c: str) -> str:
    rules = f"{c} <> '000000000' AND (({SSN}) OR {EIN} OR {ITIN} OR {ATIN_SQL})"
    return rules.replace("(d,", f"({c},").replace("d <>", f"{c} <>").replace("match(d", f"match({c}")


FORMS_SQL = f"SELECT *, coalesce(({_tin_sql('payer_tin')}) AND ({_tin_sql('recipient_tin')}) AND interest_income >= 0 AND tax_year BETWEEN 2020 AND 2100, false) AS valid FROM ({FORMS})"
register("batch_forms", lambda s, d: _forms(s, d).select("c_custkey", "valid"), f"SELECT c_custkey, valid FROM ({FORMS_SQL})")
register("batch_forms_tins_only", lambda s, d: batch.validate_forms(_forms(s, d).drop("valid"), batch.FormRules(amounts=False, years=False)).select("c_custkey", "valid"), f"SELECT c_custkey, ({_tin_sql('payer_tin')}) AND ({_tin_sql('recipient_tin')}) AS valid FROM ({FORMS})")
register("batch_summary", lambda s, d: _forms(s, d).agg(F.count_if("valid").alias("valid_count"), F.count_if(~F.col("valid")).alias("invalid_count"), F.bool_and("valid").alias("all_valid")), f"SELECT count(*) FILTER (valid) AS valid_count, count(*) FILTER (NOT valid) AS invalid_count, bool_and(valid) AS all_valid FROM ({FORMS_SQL})")

register("batch_valid_indices", lambda s, d: report.valid_indices(_forms(s, d), "c_custkey"), f"SELECT c_custkey FROM ({FORMS_SQL}) WHERE valid")
register("batch_invalid_indices", lambda s, d: report.invalid_indices(_forms(s, d), "c_custkey"), f"SELECT c_custkey FROM ({FORMS_SQL}) WHERE NOT valid")
_LITE = lite()


def _lite(name: str, value: str, result: str) -> None:
    column_query(f"lite_{name}", "customer", value, lambda c: _LITE.evaluate(name, from_typed(c, StringType()), {}), result)


for _n, _rule in (("is_ssn", SSN), ("is_ein", EIN), ("is_itin", ITIN), ("is_atin", ATIN_SQL), ("is_tin", f"d <> '000000000' AND ({SSN} OR {EIN} OR {ITIN} OR {ATIN_SQL})")):
    _lite(_n, IDS, checked(STRICT, _rule))
_lite("is_us_state", samples("CA", "ny", " DC ", "UM", "AE", "", None), "coalesce(u = upper(x) AND u IN (" + ", ".join(quoted(c) for c in [*reference.STATES, "AS", "GU", "MP", "PR", "VI"]) + "), false)")
_lite("is_us_zip", samples("12345", "12345-6789", "1234", " 12345", "", None), f"coalesce({full('x', '[0-9]{5}(-[0-9]{4})?')}, false)")
_lite("is_email", samples("a@b.c", "@b.c", "a@", "a@b", "a@.b", "a@@b.c", None), "coalesce(strpos(x, '@') > 1 AND contains(substr(x, strpos(x, '@') + 1), '.') AND NOT starts_with(substr(x, strpos(x, '@') + 1), '.') AND NOT ends_with(x, '.'), false)")
_lite("is_phone", either(shifted(samples("555-1234", "12345", "+44 20 7946 0958", "", None)), NINE), "coalesce(length(d) BETWEEN 7 AND 15, false)")
_lite("luhn", either(shifted(samples("4111 1111 1111 1111", "79927398713", "0", "", "abc", None)), nines(10)), checked("length(d) > 0", luhn("d")))
_lite("is_tax_year", either(shifted(samples("2020", " 2024 ", "x", "", None)), "cast(1990 + c_custkey % 130 as string)"), checked(full("x", "[0-9]{1,9}"), "cast(x AS BIGINT) BETWEEN 2020 AND 2100"))
for _n, _op in (("is_non_negative", ">="), ("is_positive", ">")):
    column_query(f"lite_{_n}", "customer", "c_acctbal", lambda c, n=_n: _LITE.evaluate(n, from_typed(c, DoubleType()), {}), f"x {_op} 0")
    ORACLES[f"lite_{_n}"] = f"SELECT c_custkey, c_acctbal AS input, c_acctbal {_op} 0 AS ok FROM customer"

# ---------------------------------------------------------------- sources, sinks and streams


#: Customers spread over several files and splits, with whole numbers of 19 digits and beyond, and cells that are no numbers.
CELLS = "CASE c_custkey % 5 WHEN 0 THEN '9223372036854775807' WHEN 1 THEN '1234567890123456789' WHEN 2 THEN '9223372036854775808' WHEN 3 THEN '1.5' ELSE concat('x', cast(c_custkey AS string)) END"


def _csv_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS Key", "c_name AS Name", f"{CELLS} AS Cell")
    rows.repartitionByRange(7, "Key").sortWithinPartitions("Key").write.option("header", True).csv(path)
    schema = {"version": "1.0", "import": {"enabled": True, "column_mappings": {"Key": "key", "Name": "name", "Cell": "cell"}, "required_columns": ["Key"]}, "root": w.object(key=w.integer().range(0, 1000), name=w.string().lower(), cell=w.any()).to_dict()}
    out = readers.import_csv(spark, path, schema)
    got = lambda k, t: F.variant_get("normalized", f"$.{k}", t)
    return out.select("row", got("key", "bigint").alias("key"), got("name", "string").alias("name"), F.to_json(got("cell", "variant")).alias("cell"), "valid")


register(
    "source_csv_import",
    _csv_round,
    f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, c_custkey AS key, lower(c_name) AS name, CASE c_custkey % 5 WHEN 2 THEN '9.223372036854776E18' WHEN 4 THEN '\"x' || c_custkey || '\"' ELSE {CELLS} END AS cell, c_custkey <= 1000 AS valid FROM customer",
)


def _lines_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    table(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("value")).write.text(path)
    out = readers.read_json_lines(spark, path, w.object(o_orderkey=w.integer(), o_orderstatus=w.string().lower()).to_schema())
    back = folder(spark)
    readers.write_json_lines(out, back)
    return spark.read.schema("o_orderkey long, o_orderstatus string").json(back)


register("source_json_lines", _lines_round, "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus FROM orders")


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request over several partitions, taken apart; a request is small by contract, so its table is."""
    rows = table(spark, sf_dir, "nation").repartitionByRange(5, "n_nationkey").sortWithinPartitions("n_nationkey").select("n_nationkey", "n_name")
    schema = w.object(n_nationkey=w.integer().range(0, 20, "FAR"), n_name=w.string().lower()).to_schema()
    good, bad = readers.bulk_split(rows, schema)
    return good.select("_row_index", "n_name", F.lit("").alias("codes")).unionByName(bad.select("_row_index", F.lit(None).cast("string").alias("n_name"), V.issue_codes(F.col("errors")).alias("codes")))


register("source_bulk", _bulk, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS _row_index, CASE WHEN n_nationkey <= 20 THEN lower(n_name) END AS n_name, CASE WHEN n_nationkey <= 20 THEN '' ELSE '/n_nationkey:FAR' END AS codes FROM nation")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream, validated and routed to two folders, then read back."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    checked_ = streams.validate_stream(stream.select("event_id", "value"), {"type": "object", "properties": {"event_id": {"type": "integer"}, "value": {"type": "number", "constraints": [{"pred": {"type": "range", "max": 50}, "error": {"code": "LARGE"}}]}}})
    place = folder(spark)
    streams.route(checked_.drop("errors", "warnings"), f"{place}/valid", f"{place}/invalid", f"{place}/checkpoint").awaitTermination()
    read = lambda name: spark.read.parquet(f"{place}/{name}").select("event_id", "valid")
    return read("valid").unionByName(read("invalid"))


register("stream_validate", _stream, "SELECT event_id, coalesce(value <= 50, true) AS valid FROM events")

# ---------------------------------------------------------------- generators


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a schema describes."""
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in generate.struct_type(customer_schema())], "name string, type string, nullable boolean")


register("schema_struct_type", _generated, "SELECT * FROM (VALUES ('c_custkey', 'bigint', false), ('c_name', 'string', false), ('c_nationkey', 'int', false), ('c_acctbal', 'double', false), ('c_mktsegment', 'string', false)) t(name, type, nullable)")


def _openapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of the description, by pointer, as JSON."""

    def leaves(node, at: str = "") -> list[tuple[str, str]]:
        if not isinstance(node, (dict, list)):
            return [(at, json.dumps(node))]
        return [x for k, v in (node.items() if isinstance(node, dict) else enumerate(node)) for x in leaves(v, f"{at}/{k}")]

    return spark.createDataFrame(leaves(generate.openapi(customer_schema())), "pointer string, value string")


_OPENAPI_SQL = """
    WITH members(n, name, about) AS (VALUES (0, 'c_custkey', {'type': '"integer"', 'format': '"int64"'}::JSON), (1, 'c_name', {'type': '"string"'}::JSON),
        (2, 'c_nationkey', {'type': '"integer"', 'format': '"int32"', 'minimum': '0', 'maximum': '24'}::JSON), (3, 'c_acctbal', {'type': '"number"'}::JSON),
        (4, 'c_mktsegment', {'enum/0': '"AUTOMOBILE"', 'enum/1': '"BUILDING"', 'enum/2': '"FURNITURE"', 'enum/3': '"HOUSEHOLD"'}::JSON)), root AS (SELECT '/components/schemas/Root' AS base)
    SELECT base || '/properties/' || name || '/' || key AS pointer, about ->> ('$."' || key || '"') AS value FROM (SELECT *, unnest(json_keys(about)) AS key FROM members), root
    UNION ALL SELECT base || '/required/' || n, '"' || name || '"' FROM members, root
    UNION ALL SELECT base || '/type', '"object"' FROM root
    UNION ALL VALUES ('/openapi', '"3.1.0"'), ('/info/title', '"schema"'), ('/info/version', '"1.0"')
"""
register("schema_openapi", _openapi, _OPENAPI_SQL)
