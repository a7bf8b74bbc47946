"""Columnar checks of tax forms, identification numbers and formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.functions.predicates import tax


def tin_kind(s: Column) -> Column:
    """Atin, Itin, Ssn, Ein or Unknown for a text of nine digits; the first that fits."""
    d = tax.strict_nine(s)
    return F.when(tax.atin_rules(d), "Atin").when(tax.itin_rules(d), "Itin").when(tax.ssn_rules(d), "Ssn").when(tax.ein_rules(d), "Ein").otherwise("Unknown")


def ssn_reason(s: Column) -> Column:
    """Why a text is no social security number: the first rule that it breaks; null if it is one."""
    d = tax.strict_nine(s)
    area = F.substring(d, 1, 3)
    return (
        F.when(d.isNull(), "InvalidFormat")
        .when(area == "000", "AreaZero")
        .when(area == "666", "Area666")
        .when(area >= "900", "Area9xx")
        .when(F.substring(d, 4, 2) == "00", "GroupZero")
        .when(F.substring(d, 6, 4) == "0000", "SerialZero")
        .when(d == F.repeat(F.substring(d, 1, 1), F.lit(9)), "AllSameDigit")
    )


def ein_reason(s: Column) -> Column:
    """Why a text is no employer number; null if it is one."""
    d = tax.strict_nine(s)
    return F.when(d.isNull(), "InvalidFormat").when(~tax.ein_rules(d), "InvalidCampusCode")


@dataclass(frozen=True)
class FormRules:
    """Which parts of a form are checked, and the years that count."""

    payer: bool = True
    recipient: bool = True
    amounts: bool = True
    years: bool = True
    first_year: int = 2020
    last_year: int = 2100


def valid_tin(s: Column) -> Column:
    """A text that is some taxpayer number."""
    return F.coalesce(tax.is_tin(s, {}), F.lit(False))


def validate_forms(df: DataFrame, rules: FormRules = FormRules(), payer: str = "payer_tin", recipient: str = "recipient_tin", amount: str = "interest_income", year: str = "tax_year") -> DataFrame:
    """Adds ``valid``: both numbers valid, the amount (cents) not negative, the year in range. A null amount or year is not checked."""
    ok = F.lit(True)
    if rules.payer:
        ok = ok & valid_tin(F.col(payer))
    if rules.recipient:
        ok = ok & valid_tin(F.col(recipient))
    if rules.amounts:
        ok = ok & F.coalesce(F.col(amount) >= 0, F.lit(True))
    if rules.years:
        ok = ok & F.coalesce(F.col(year).between(rules.first_year, rules.last_year), F.lit(True))
    return df.withColumn("valid", ok)


def to_cents(dollars: Column) -> Column:
    """Dollars as whole cents, halves away from zero."""
    return T.saturated_long(T.half_away(dollars.cast("double") * 100.0))


def is_ssn_format(s: Column) -> Column:
    return T.whole(s, "[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9}")


def is_ein_format(s: Column) -> Column:
    return T.whole(s, "[0-9]{2}-[0-9]{7}|[0-9]{9}")


def is_zip_format(s: Column) -> Column:
    return T.whole(s, "[0-9]{5}(?:-[0-9]{4})?")


def is_email_format(s: Column) -> Column:
    domain = s.substr(F.instr(s, "@") + 1, F.length(s))
    return (F.instr(s, "@") > 1) & (domain != "") & domain.contains(".") & ~domain.startswith(".") & ~domain.endswith(".")


#: The scanner's patterns by id, whole-text matches; fixed values.
PATTERNS = {
    "SsnFormatted": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "SsnUnformatted": "[0-9]{9}",
    "EinFormatted": "[0-9]{2}-[0-9]{7}",
    "EinUnformatted": "[0-9]{9}",
    "Email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "PhoneUs": r"(\+1)?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "PhoneInternational": r"\+[0-9]{1,3}[-.\s]?[0-9]{4,14}",
    "ZipCode": "[0-9]{5}",
    "ZipPlus4": "[0-9]{5}-[0-9]{4}",
    "DateMmDdYyyy": "(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])/[0-9]{4}",
    "DateYyyyMmDd": "[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])",
    "MoneyUsd": r"\$?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]{2})?",
    "MoneyDecimal": r"-?[0-9]+(\.[0-9]{1,2})?",
    "Cusip": "[A-Z0-9]{9}",
    "AbaRouting": "[0-9]{9}",
}


def scan_patterns(s: Column) -> Column:
    """The ids of all patterns that match the whole text, in order."""
    once: dict[str, Column] = {}
    for pattern in PATTERNS.values():  # ids with the same pattern share one match
        once.setdefault(pattern, T.whole(s, pattern))
    return F.array_compact(F.array(*[F.when(once[p], F.lit(name)) for name, p in PATTERNS.items()]))
