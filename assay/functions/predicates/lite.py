"""A second, simpler set of predicates under the same names, for callers that ask for it: no trimming, loose mail and phone checks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.operators.batch import is_email_format, is_zip_format
from assay.plans.registry import Registry
from assay.plans.values import Value, false

from . import reference, tax


def _text(test):
    return lambda v, args: false() if v.str is None else F.coalesce(test(v.str, args), false())


def _any(s: Column) -> Column:
    d = tax.strict_nine(s)
    return (d != "000000000") & (tax.ssn_rules(d) | tax.ein_rules(d) | tax.itin_rules(d) | tax.atin_rules(d))


def _tin(s: Column, args: dict) -> Column:
    rules = tax.RULES.get(args.get("kind", "ANY"))
    return _any(s) if rules is None else rules(tax.strict_nine(s))


def _sign(test):
    return lambda v, args: false() if v.num is None else F.coalesce(test(v.num), false())


def _tax_year(v: Value, args: dict) -> Column:
    ways = []
    if v.int is not None:
        ways.append(v.int.between(2020, 2100))
    if v.str is not None:
        ways.append(T.whole(v.str, r"\+?[0-9]{1,18}") & v.str.try_cast("long").between(2020, 2100))
    out = false()
    for w in ways:
        out = out | F.coalesce(w, false())
    return out


def lite() -> Registry:
    """The thirteen simple predicates."""
    states = [*reference.STATES, *(t for t in reference.TERRITORIES if t != "UM")]
    return Registry(
        {
            "is_ssn": _text(lambda s, a: tax.ssn_rules(tax.strict_nine(s))),
            "is_ein": _text(lambda s, a: tax.ein_rules(tax.strict_nine(s))),
            "is_itin": _text(lambda s, a: tax.itin_rules(tax.strict_nine(s))),
            "is_atin": _text(lambda s, a: tax.atin_rules(tax.strict_nine(s))),
            "is_tin": _text(_tin),
            "is_non_negative": _sign(lambda n: n >= 0),
            "is_positive": _sign(lambda n: n > 0),
            "is_tax_year": _tax_year,
            "is_us_state": _text(lambda s, a: F.upper(s).isin(states)),
            "is_us_zip": _text(lambda s, a: is_zip_format(s)),
            "is_email": _text(lambda s, a: is_email_format(s)),
            "is_phone": _text(lambda s, a: F.length(T.digits(s)).between(7, 15)),
            "luhn": _text(lambda s, a: T.luhn(T.digits(s))),
        }
    )
