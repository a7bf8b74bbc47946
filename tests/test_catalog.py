"""Every registered query against its SQL, and the driver's entry points."""

import pytest
from compare import same_rows

import __spark_entry__ as entry
from assay import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    assert name in catalog.ORACLES
    assert same_rows(got, duck.sql(catalog.ORACLES[name]).df())


def test_every_operator_is_registered():
    from assay.functions.predicates import BUILT_IN
    from assay.functions.transforms import TRANSFORMS
    from assay.plans import ir

    names = set(catalog.QUERIES)
    assert len(BUILT_IN) == 108 and len(TRANSFORMS) == 25 and len(ir.TYPES) == 26 and len(ir.NODES) == 25
    assert {f"pred_{n.replace(':', '_').replace('-', '_')}" for n in BUILT_IN} <= names
    assert {f"transform_{n}" for n in TRANSFORMS} <= names
    assert {f"type_{n}" for n in ir.TYPES} <= names
    assert {f"node_{n}" for n in ir.NODES} <= names


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["path", "code", "severity", "n"] and frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
