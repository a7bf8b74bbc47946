import ipaddress
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from assay.functions import text as T
from assay.functions.predicates.contact import V4, V6
from assay.functions.transforms import TRANSFORMS
from assay.operators import batch, report
from assay.operators import validation as V
from assay.plans.registry import Registry
from assay.plans.values import from_typed
from assay.sources import readers
from assay.streaming import streams

SCHEMA = {
    "type": "object",
    "properties": {
        "id": {"type": "integer"},
        "name": {"type": "string", "transforms": [{"fn": "trim"}, {"fn": "upper"}], "constraints": [{"pred": {"type": "min_len", "len": 2}, "error": {"code": "SHORT", "message": "short"}}]},
        "cents": {"type": "money", "transforms": [{"fn": "money_to_cents", "scale": 2}], "required": False},
    },
}


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, " ada ", "$1.50"), (2, "b", "x"), (3, None, None)], "id long, name string, cents string")


def test_typed_mode(people):
    rows = {r.id: r for r in V.validate(people, SCHEMA).collect()}
    assert rows[1].valid and rows[1].name == "ADA" and rows[1].cents == 150
    assert [e.code for e in rows[2].errors] == ["SHORT", "TYPE_ERROR"] and [e.path for e in rows[3].errors] == ["/name"]


def test_without_transforms(people):
    rows = {r.id: r for r in V.validate(people, SCHEMA, apply_transforms=False).collect()}
    assert rows[1].name == " ada "


def test_extra_column_is_an_unknown_key(people):
    row = V.validate(people.withColumn("z", F.lit(1)), SCHEMA).filter("id = 1").first()
    assert [e.code for e in row.errors] == ["ADDITIONAL_PROPERTY_NOT_ALLOWED"]
    assert "z" not in V.validate(people.withColumn("z", F.lit(1)), {**SCHEMA, "unknown_keys": "strip"}).columns


def test_missing_column(people):
    row = V.validate(people.drop("name"), SCHEMA).first()
    assert [(e.path, e.code) for e in row.errors if e.code == "REQUIRED"] == [("/name", "REQUIRED")]


def test_raise_split_and_filter(people):
    with pytest.raises(V.ValidationError):
        V.validate_or_raise(people, SCHEMA)
    good, bad = V.split_valid(people, SCHEMA)
    assert [r.id for r in good.collect()] == [1] and {r.id for r in bad.collect()} == {2, 3}
    assert [r.id for r in people.filter(V.is_valid(people, SCHEMA)).collect()] == [1]


def test_reports(people):
    v = V.validate(people, SCHEMA)
    assert tuple(report.summary(v).first()) == (3, 1, 2, False)
    assert {(r.path, r.code): r.n for r in report.by_code(v).collect()} == {("/name", "SHORT"): 1, ("/cents", "TYPE_ERROR"): 1, ("/name", "REQUIRED"): 1}
    assert report.worst(v, "id", 1).first().id == 2
    assert v.filter("id = 2").select(V.first_error(F.col("errors"), "/name")).first()[0] == "short"


def test_empty_frame(spark, people):
    v = V.validate(people.filter("1 = 0"), SCHEMA)
    assert v.collect() == [] and report.summary(v).first().all_valid


def test_one_projection_without_shuffle(people):
    plan = V.validate(people, SCHEMA)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_nested_and_maps(spark):
    rows = spark.sql("SELECT named_struct('a', 1L, 'b', array('x', NULL)) AS o, map('k', 1.5D) AS m")
    schema = {"type": "object", "properties": {"o": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string", "transforms": [{"fn": "upper"}]}}}}, "m": {"type": "record", "value": {"type": "integer"}}}}
    row = V.validate(rows, schema).first()
    assert row.o.b == ["X", None] and [(e.path, e.code) for e in row.errors] == [("/m/k", "TYPE_ERROR")]


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(2)
    made = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "1:2:3:4:5:6:7", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::2::3", "12345::", "1.2.3.4", "1.2.3.04", ":1", "1:", "::1.2.3.4:5", "1:2:3:4:5:6:7:1.2.3.4"]
    made += [":".join(rng.choice(["", "0", "ab", "ffff", "1.2.3.4", "12345"]) for _ in range(rng.randrange(2, 10))) for _ in range(600)]

    def known(x, kind):
        try:
            kind(x)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(x,) for x in made], "x string").select("x", T.whole(F.col("x"), V4).alias("four"), T.whole(F.col("x"), V6).alias("six")).collect()
    for r in rows:
        assert r.four == known(r.x, ipaddress.IPv4Address), r.x
        assert r.six == known(r.x, ipaddress.IPv6Address), r.x


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=60))
def test_plain_float_is_exact(spark, numbers):
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", T.plain_float(F.col("x")).alias("s")).collect()
    for r in rows:
        assert "E" not in r.s and "e" not in r.s and float(r.s) == r.x and not r.s.endswith(".0")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=60))
def test_trim_agrees_with_the_white_space_property(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    got = {r.k: r.s for r in rows.select("k", T.strip(F.col("x")).alias("s")).collect()}
    assert got == {k: t.strip(T.WHITE) for k, t in enumerate(texts)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=60), st.integers(0, 4))
def test_decimal_places_are_exact(spark, numbers, places):
    v = from_typed(F.col("x"), DoubleType())
    rows = spark.createDataFrame([(n / 1000,) for n in numbers], "x double").select(TRANSFORMS["format_decimal"](v, {"places": places}).str.alias("s")).collect()
    assert all(len(r.s.partition(".")[2]) == places and (places > 0) == ("." in r.s) for r in rows)


def test_every_predicate_is_two_valued_on_every_kind(spark):
    registry = Registry.default()
    docs = spark.createDataFrame([(x,) for x in ("null", "1", "1.5", "true", '""', '"abc"', "[1]", '{"a":1}')], "x string").select(F.parse_json("x").alias("v"))
    v = from_typed(F.col("v"), docs.schema["v"].dataType)
    names = registry.names()
    for k in range(0, len(names), 27):
        part = names[k : k + 27]
        for row in docs.select(*[registry.evaluate(n, v, {}).alias(n) for n in part]).collect():
            assert all(x is not None for x in row)


def test_csv_rules(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w") as f:
        f.write("Id,Amount,Note\n1,2.5,x\n2,,y\nz,3,\n")
    schema = {"type": "object", "properties": {"id": {"type": "integer"}, "Amount": {"type": "number", "required": False}, "Note": {"type": "string", "required": False}}}
    out = readers.import_csv(spark, path, schema, columns={"Id": "id"}).orderBy("row").collect()
    assert [r.valid for r in out] == [True, True, False] and out[2].errors[0].path == "/id"
    with pytest.raises(readers.ImportRuleError):
        readers.read_csv(spark, path, schema, required=["Missing"])
    with pytest.raises(readers.ImportRuleError):
        readers.read_csv(spark, path, schema, max_rows=2)


def test_split_sinks(spark, people, tmp_path):
    readers.write_split(V.validate(people, SCHEMA), str(tmp_path / "v"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1 and spark.read.parquet(str(tmp_path / "i")).count() == 2


def test_bulk_limit(people):
    with pytest.raises(readers.ImportRuleError):
        readers.bulk(people, SCHEMA, most=2)


def test_stream_windows(spark, data, tmp_path):
    source = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{data}/events.parquet*")
    schema = {"type": "object", "unknown_keys": "passthrough", "properties": {"value": {"type": "number", "constraints": [{"pred": {"type": "range", "max": 50}, "error": {"code": "LARGE"}}]}}}
    counts = streams.issue_counts(streams.validate_stream(stream, schema), "ts")
    q = counts.writeStream.format("memory").queryName("issue_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM issue_windows").first()[0] == source.filter("value > 50").count()


def test_batches_of_a_stream_reach_the_full_depth(spark, tmp_path):
    chain = {"version": "1.0", "definitions": {"n": {"type": "object", "properties": {"v": {"type": "integer"}, "next": {"type": "ref", "$ref": "n", "required": False}}}}, "root": {"type": "ref", "$ref": "n"}}
    nested = lambda depth, last: '{"v":1,"next":' * (depth - 1) + last + "}" * (depth - 1)
    texts = [nested(2, '{"v":1}'), nested(12, '{"v":1}'), nested(12, '{"v":"x"}')]
    spark.createDataFrame([(t,) for t in texts], "value string").write.text(f"{tmp_path}/in")
    stream = spark.readStream.schema("value string").text(f"{tmp_path}/in")
    check = lambda batch: V.validate_documents(batch, chain).select("value", "valid", V.issue_codes(F.col("errors")).alias("codes"))
    streams.route_each(stream, check, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/good").collect()) == sorted(texts[:2])
    assert [r.codes for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["/next" * 11 + "/v:TYPE_ERROR"]


def test_address_predicates_with_a_stub_parser(spark, monkeypatch):
    from assay.functions.predicates import address

    monkeypatch.setattr(address, "parse_address", None)
    with pytest.raises(ImportError):
        address.register(Registry.default())

    def parse(text):
        return [(part.split("=")[1], part.split("=")[0]) for part in text.split(";") if "=" in part]

    monkeypatch.setattr(address, "parse_address", parse)
    r = address.register(Registry.default())
    rows = spark.createDataFrame([("road=main;city=x;state=ca;postcode=94105",), ("city=x;state=ca",), ("nothing",), ("",), (None,)], "a string")
    on = lambda name, **args: F.coalesce(r.evaluate(name, from_typed(F.col("a"), StringType()), args), F.lit(False))
    got = rows.select(
        on("is_parseable_address"), on("has_address_component", component="road"), on("is_us_address"), on("is_us_address", strict=False), on("address_component_matches", component="postcode", pattern="^9[0-9]{4}$"),
        on("address_component_matches", component="state", pattern="^ny$"),
    ).collect()
    assert [list(x) for x in got] == [[True, True, True, True, True, False], [True, False, False, True, False, False], *[[False] * 6] * 3]


def test_forms(spark):
    rows = spark.createDataFrame([("123-45-6789", "12-3456789", 5, 2024), ("123-45-6789", "x", 5, 2024), ("123-45-6789", "123456789", -1, 2024), ("123-45-6789", "123456789", None, 2019)], "payer_tin string, recipient_tin string, interest_income long, tax_year int")
    assert [r.valid for r in batch.validate_forms(rows).collect()] == [True, False, False, False]
    assert [r.valid for r in batch.validate_forms(rows, batch.FormRules(amounts=False, years=False)).collect()] == [True, False, True, True]


def test_arguments_change_predicates(spark):
    rows = spark.createDataFrame([("555-1234", "fff", "550e8400-e29b-41d4-a716-446655440000", "12/20", "UA123", "AB1", "a-b_")], "phone string, hex string, uuid string, card string, flight string, icd string, b64 string")
    r = Registry.default()
    on = lambda name, col, **args: r.evaluate(name, from_typed(F.col(col), StringType()), args)
    got = rows.select(
        on("phone_number_us", "phone", require_area_code=False), on("phone_number_us", "phone"), on("is_hex_color", "hex", require_hash=False), on("is_uuid", "uuid", version=4), on("is_uuid", "uuid", version=1),
        on("is_card_expiry", "card", reject_expired=True, as_of=202101), on("is_card_expiry", "card", reject_expired=True, as_of=202012), on("is_flight_number", "flight", carrier_format="ICAO"),
        on("is_flight_number", "flight", known_carrier=True), on("is_base64", "b64", url_safe=True), on("is_base64", "b64"), on("is_account_number", "phone", allow_hyphens=False),
    ).first()
    assert list(got) == [True, False, True, True, False, False, True, False, True, True, False, False]


def test_defaults_fill_nulls_and_missing_columns(people):
    schema = {"type": "object", "unknown_keys": "passthrough", "properties": {"name": {"type": "string", "transforms": [{"fn": "default", "value": "none"}, {"fn": "upper"}]}, "level": {"type": "integer", "transforms": [{"fn": "default", "value": 3}]}}}
    rows = {r.id: r for r in V.validate(people, schema).collect()}
    assert (rows[3].name, rows[3].level, rows[3].valid) == ("NONE", 3, True) and rows[1].name == " ADA "


def test_variant_columns_in_typed_mode(spark):
    df = spark.sql("SELECT 1L AS id, parse_json('{\"a\": [1, \"x\"]}') AS doc")
    schema = {"type": "object", "properties": {"id": {"type": "integer"}, "doc": {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer"}}}}}}
    row = V.validate(df, schema).first()
    assert [(e.path, e.code) for e in row.errors] == [("/doc/a/1", "TYPE_ERROR")]


def test_typed_unions_and_catches(spark):
    df = spark.createDataFrame([("5", 1.5), ("x", 2.0)], "s string, n double")
    schema = {"type": "object", "properties": {"s": {"type": "union", "oneOf": [{"type": "string", "constraints": [{"pred": {"type": "call", "name": "is_digits"}, "error": {"code": "D"}}]}, {"type": "string", "transforms": [{"fn": "upper"}]}]}, "n": {"type": "catch", "schema": {"type": "integer"}, "value": 0}}}
    rows = V.validate(df, schema).collect()
    assert [(r.s, r.n, r.valid) for r in rows] == [("5", 0, True), ("X", 2, True)]
