import json

import pytest

from assay.builder import lit, seg, w
from assay.plans import generate, ir, pointer
from assay.plans.predicates import InvalidRegex, portable, template
from assay.plans.registry import Registry, UnknownPredicate


@pytest.mark.parametrize(
    "schema, path",
    [
        ({"version": "1"}, "/root"),
        ({"root": {"type": "text"}}, "/root/type"),
        ({"root": {"type": "array"}}, "/root/items"),
        ({"root": {"type": "object", "properties": {"a": {"type": "enum"}}}}, "/root/properties/a/values"),
        ({"root": {"type": "string", "constraints": [{"pred": {"type": "min_len"}, "error": {"code": "X"}}]}}, "/root/constraints/0/pred/len"),
        ({"root": {"type": "string", "constraints": [{"pred": {"type": "nope"}, "error": {"code": "X"}}]}}, "/root/constraints/0/pred"),
        ({"root": {"type": "string", "constraints": [{"pred": {"type": "true"}}]}}, "/root/constraints/0/error"),
        ({"root": {"type": "string"}, "definitions": {"A": {"type": "tuple"}}}, "/definitions/A/items"),
    ],
)
def test_malformed_schemas_name_the_place(schema, path):
    with pytest.raises(ir.SchemaParseError) as e:
        ir.Schema.from_json(schema)
    assert e.value.path == path


def test_round_trip_keeps_metadata():
    data = {"version": "2.0", "id": "f", "title": "T", "irs_form": {"number": "1"}, "definitions": {"A": {"type": "any"}}, "root": {"type": "object", "properties": {"a": {"type": "ref", "$ref": "A", "label": "L"}}, "rules": []}}
    assert ir.Schema.from_json(json.dumps(data)).to_dict() == data


def test_legacy_spellings():
    s = ir.Schema.from_json({"type": "object", "fields": {"a": {"type": "string", "constraints": [{"type": "pattern", "value": "^a", "message": "m"}, {"type": "format", "value": "decimal-2"}]}}})
    made = s.root["properties"]["a"]["constraints"]
    assert [c["error"]["code"] for c in made] == ["PATTERN_MISMATCH", "FORMAT_INVALID"] and made[0]["error"]["message"] == "m"


def test_regex_dialect():
    assert portable("^a$") == r"^a\z" and portable(r"\d+$") == r"(?U)\d+\z" and portable("[$]") == "[$]" and portable("a$", "im") == "(?im)a$"
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1"):
        with pytest.raises(InvalidRegex):
            portable(bad)


def test_templates():
    assert template([lit("a.b"), seg("digits", 2, 3)]) == r"\A\Qa.b\E[0-9]{2,3}\z"
    assert template([seg("digits", 3, 2)]) is None


def test_pointers():
    assert pointer.parse("") == [] and pointer.parse("/a~1b/c~0d") == ["a/b", "c~d"]
    with pytest.raises(pointer.InvalidPointer):
        pointer.parse("a")


def test_unknown_predicate_raises_before_a_job():
    with pytest.raises(UnknownPredicate):
        Registry.default().evaluate("nope", None, {})


def test_builder_desugars():
    t = w.object(
        kind=w.enum("individual", "business"),
        name=w.string().trim().non_empty(),
        ssn=w.string().digits_only().ssn().optional(),
        ein=w.string().is_ein().optional(),
        age=w.integer().range(18, 99).nullable(),
        tags=w.array(w.string()).min_items(1),
    )
    t = t.when("kind").equals("individual").require("ssn").mutually_exclusive("ssn", "ein")
    s = t.to_schema()
    assert s.root["properties"]["ssn"]["constraints"][0]["pred"] == {"type": "call", "name": "is_ssn"}
    assert s.root["rules"][0]["pred"] == {"type": "implies", "if": {"type": "eq", "path": "/kind", "value": "individual"}, "then": {"type": "exists", "path": "/ssn"}}
    assert s.root["properties"]["age"]["type"] == "union" and s.root["properties"]["tags"]["min_items"] == 1
    assert ir.Schema.from_json(s.to_json()).to_dict() == s.to_dict()


def test_algebra():
    a = w.object(x=w.string(), y=w.integer()).rule({"type": "true"}, "R")
    assert list(a.pick("x").node["properties"]) == ["x"] and a.pick("x").node["rules"] == []
    assert list(a.omit("x").node["properties"]) == ["y"] and len(a.extend(z=w.any()).node["rules"]) == 1
    assert a.partial().node["properties"]["x"]["required"] is False and a.partial().required("x").node["properties"]["x"]["required"] is True
    assert len(a.merge(a).node["rules"]) == 2


def test_every_predicate_and_transform_is_a_method():
    from assay.functions.predicates import BUILT_IN
    from assay.functions.transforms import TRANSFORMS

    for name in BUILT_IN:
        assert getattr(w.string(), name)().node["constraints"][0]["pred"]["name"] == name
    for name in set(TRANSFORMS) - {"replace"}:
        assert getattr(w.number(), name, None) is not None


def test_generated_types():
    s = w.object(a=w.int32(), b=w.string().optional(), c=w.array(w.decimal(10, 2)), d=w.record(w.number()), e=w.enum("x", "y"), f=w.union(w.string(), w.integer()))
    kinds = {f.name: f.dataType.simpleString() for f in generate.struct_type(s.to_schema())}
    assert kinds == {"a": "int", "b": "string", "c": "array<decimal(10,2)>", "d": "map<string,double>", "e": "string", "f": "variant"}
    assert generate.ddl(s.to_schema()).startswith("`a` INT NOT NULL, `b` STRING")
    assert generate.openapi(s.to_schema())["components"]["schemas"]["Root"]["required"] == ["a", "c", "d", "e", "f"]


def test_generated_classes_run():
    s = w.object(a=w.int32(), b=w.string().optional(), c=w.object(d=w.array(w.number()), e=w.enum("x", 1)), f=w.record(w.boolean()).nullable()).to_schema()
    names = {}
    exec(generate.dataclasses_source(s, "Form"), names)
    made = names["Form"](a=1, c=names["FormC"](d=[1.0], e="x"), f=None)
    assert made.b is None and names["Form"].__annotations__["f"] == "dict[str, bool] | None" and names["FormC"].__annotations__["e"] == "Literal['x', 1]"


def test_form_definitions():
    from assay.forms import checkbox, define_form, f, text_field

    empty = define_form()
    form = empty.id("slip").title("Slip").description("A slip").version("2.0").irs_form(name="S-1").pdf_template(path="s1.pdf").section("payer", "Payer", 1, "who pays")
    form = form.field("A", f.string("Payer's name").section("payer").label("Name").example("Ada").trim().required()).fields({"B": f.money("Amount").optional(), "C": f.enum("Kind", ["x", "y"]), "D": f.boolean("Final")})
    form = form.page(1, "first", {"A": text_field(1, 2, 30, 4, align="left"), "D": checkbox(5, 6)}).acroform_field("f1[0]", 1, "A", ["A", "B"], format="{A}, {B}").acroform_field("f2[0]", 1, "A", ["C"])
    doc = form.to_dict()
    assert doc["root"]["fields"]["A"] == {"type": "string", "description": "Payer's name", "section": "payer", "label": "Name", "example": "Ada", "transforms": [{"fn": "trim"}], "required": True}
    assert doc["root"]["pages"]["1"]["fields"]["D"] == {"type": "checkbox", "x": 5, "y": 6, "width": 10, "height": 10}
    assert [m["field_id"] for m in doc["root"]["acroform_mappings"]] == ["f1[0]", "f2[0]"] and doc["root"]["acroform_mappings"][0]["format"] == "{A}, {B}"
    assert doc["irs_form"]["name"] == "S-1" and doc["irs_form"]["omb_number"] == "" and doc["pdf_template"] == {"hash": None, "path": "s1.pdf", "source_uri": ""}
    assert doc["description"] == doc["root"]["description"] == "A slip" and doc["sections"]["payer"]["order"] == 1
    assert json.loads(form.to_json()) == json.loads(form.to_json(pretty=False)) == doc
    assert empty.to_dict()["root"]["fields"] == {} and empty.to_dict()["id"] == ""
    assert list(form.to_schema().root["properties"]) == ["A", "B", "C", "D"] and form.to_schema().extra["sections"]["payer"]["title"] == "Payer"


def test_a_form_validates_tables(spark):
    from assay.forms import define_form, f

    form = define_form().fields({"n": f.uint32("Count"), "d": f.date("Day").optional(), "t": f.string("Number").digits_only().is_ssn()})
    rows = spark.createDataFrame([(1, "2024-02-29", "123-45-6789"), (-1, None, "000-00-0000")], "n long, d string, t string")
    assert [(r.t, r.valid) for r in form.validate(rows).orderBy("n").collect()] == [("000000000", False), ("123456789", True)]
    with pytest.raises(AttributeError):
        f.number("no such field")
