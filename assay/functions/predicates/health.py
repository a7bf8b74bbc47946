"""Health-care identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T

from .base import flag, on_text, word


def _upper(s: Column) -> Column:
    return F.upper(T.strip(s))


@on_text("is_npi")
def is_npi(s: Column, args: dict) -> Column:
    t = F.regexp_replace(T.strip(s), "[ -]", "")
    return T.whole(t, "[0-9]{10}") & T.luhn(F.concat(F.lit("80840"), t))


@on_text("is_dea_number")
def is_dea_number(s: Column, args: dict) -> Column:
    u = _upper(s)
    d = F.substring(u, 3, 7)
    return T.whole(u, "[A-HJ-MPR-UX][A-Z][0-9]{7}") & (T.weighted(d, [1, 2, 1, 2, 1, 2]) % 10 == T.digit(d, 6))


@on_text("is_icd10_code")
def is_icd10_code(s: Column, args: dict) -> Column:
    point = r"\." if flag(args, "strict_format", False) else r"\.?"
    return T.whole(_upper(s), rf"[A-Z][0-9A-Z]{{2}}(?:{point}[0-9A-Z]{{1,4}})?")


@on_text("is_cpt_code")
def is_cpt_code(s: Column, args: dict) -> Column:
    last = "0-9" + ("F" if flag(args, "allow_category_ii", True) else "") + ("T" if flag(args, "allow_category_iii", True) else "")
    return T.whole(_upper(s), f"[0-9]{{4}}[{last}]")


on_text("is_hcpcs_code")(lambda s, a: T.whole(_upper(s), "[A-V][0-9]{4}"))


@on_text("is_ndc_code")
def is_ndc_code(s: Column, args: dict) -> Column:
    t, form = T.strip(s), str(word(args, "format", "ANY")).upper()
    n = F.length(T.digits(t))
    three = F.size(F.split(t, "-")) == 3
    ten = F.when(three, T.whole(t, "[0-9]{4}-[0-9]{4}-[0-9]{2}|[0-9]{5}-[0-9]{3}-[0-9]{2}|[0-9]{5}-[0-9]{4}-[0-9]")).otherwise(n == 10)
    return ten if form == "10" else n == 11 if form == "11" else ten | (n == 11)
