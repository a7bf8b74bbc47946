"""Form definitions: fields in sections with labels and examples, page layout and how fields make up those of a PDF template.

A form is a schema with more metadata. ``to_schema`` gives what validates its tables; sections, pages and mappings are carried along and
never evaluated.
"""

from __future__ import annotations

import json
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame

from assay.builder import Type
from assay.operators import validation
from assay.plans import ir


class Field(Type):
    """A form's field: a type with what a form shows of it. Transforms and predicates chain as on any type."""

    def required(self, value: bool = True) -> "Field":
        return self._with(required=value)  # type: ignore[return-value]

    def example(self, value: str) -> "Field":
        return self._with(example=value)  # type: ignore[return-value]

    def section(self, name: str) -> "Field":
        return self._with(section=name)  # type: ignore[return-value]

    def values(self, values: list[str]) -> "Field":
        return self._with(values=list(values))  # type: ignore[return-value]


class _Fields:
    """``f``: one factory for each type of field, called with its description."""

    KINDS = ("string", "uint32", "int32", "money", "boolean", "date")

    def enum(self, description: str, values: list[str]) -> Field:
        return Field({"type": "enum", "description": description, "values": list(values)})

    def __getattr__(self, name: str) -> Any:
        if name not in self.KINDS:
            raise AttributeError(name)
        return lambda description: Field({"type": name, "description": description})


f = _Fields()

#: What a form's document has before anything is set; keys and defaults are the format's, so fixed values.
_EMPTY = {
    "version": "1.0.0",
    "irs_form": {"name": "", "title": "", "revision": "", "revision_date": "", "omb_number": "", "cat_number": ""},
    "pdf_template": {"hash": None, "path": "", "source_uri": ""},
    "id": "",
    "title": "",
    "description": "",
    "sections": {},
    "root": {"type": "object", "description": "", "fields": {}},
}


class Form:
    """A form under construction; every method returns a new one."""

    def __init__(self, document: dict | None = None):
        self.document = _EMPTY if document is None else document

    def _set(self, **changes: Any) -> "Form":
        return Form({**self.document, **changes})

    def _root(self, **changes: Any) -> "Form":
        return self._set(root={**self.document["root"], **changes})

    def version(self, text: str) -> "Form":
        return self._set(version=text)

    def irs_form(self, **meta: str) -> "Form":
        """Name, title, revision, revision_date, omb_number and cat_number."""
        return self._set(irs_form={**self.document["irs_form"], **meta})

    def pdf_template(self, **meta: str | None) -> "Form":
        """Hash, path and source_uri."""
        return self._set(pdf_template={**self.document["pdf_template"], **meta})

    def id(self, text: str) -> "Form":
        return self._set(id=text)

    def title(self, text: str) -> "Form":
        return self._set(title=text)

    def description(self, text: str) -> "Form":
        return self._set(description=text)._root(description=text)

    def section(self, name: str, title: str, order: int, description: str = "") -> "Form":
        return self._set(sections={**self.document["sections"], name: {"title": title, "order": order, "description": description}})

    def field(self, name: str, field: Type) -> "Form":
        return self.fields({name: field})

    def fields(self, fields: dict[str, Type]) -> "Form":
        return self._root(fields={**self.document["root"]["fields"], **{k: t.to_dict() for k, t in fields.items()}})

    def page(self, number: int, name: str, fields: dict[str, dict]) -> "Form":
        """Where a page's fields stand, by ``text_field`` and ``checkbox``."""
        return self._root(pages={**self.document["root"].get("pages", {}), str(number): {"name": name, "fields": fields}})

    def acroform_field(self, field_id: str, page: int, copy: str, compose: list[str], **how: str) -> "Form":
        """Which columns, in order, make up a field of the template; ``format`` or ``separator`` says how."""
        mapping = {"field_id": field_id, "page": page, "copy": copy, "compose": list(compose), **how}
        return self._root(acroform_mappings=[*self.document["root"].get("acroform_mappings", []), mapping])

    def to_dict(self) -> dict:
        return deepcopy(self.document)

    def to_json(self, pretty: bool = True) -> str:
        return json.dumps(self.document, indent=2 if pretty else None)

    def to_schema(self) -> ir.Schema:
        return ir.Schema.from_json(self.document)

    def validate(self, df: DataFrame, **options: Any) -> DataFrame:
        """A table with a column for each field, normalized and validated (typed mode)."""
        return validation.validate(df, self.to_schema(), **options)


def define_form() -> Form:
    return Form()


def text_field(x: float, y: float, width: float, height: float, **look: Any) -> dict:
    """A text box's place on a page; ``font_size``, ``align`` and ``multiline`` may follow."""
    return {"type": "text", "x": x, "y": y, "width": width, "height": height, **look}


def checkbox(x: float, y: float, size: float = 10) -> dict:
    return {"type": "checkbox", "x": x, "y": y, "width": size, "height": size}
