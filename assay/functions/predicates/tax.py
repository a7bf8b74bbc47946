"""Taxpayer identification numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T

from .base import on_text, word

#: First two digits that the tax office has given out; fixed values.
EIN_PREFIXES = """01 02 03 04 05 06 10 11 12 13 14 15 16 20 21 22 23 24 25 26 27 30 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 47 48
50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 71 72 73 74 75 76 77 80 81 82 83 84 85 86 87 88 90 91 92 93 94 95 98 99""".split()


def strict_nine(s: Column) -> Column:
    """The nine digits of a text of digits, hyphens and spaces; null for any other text."""
    d = T.digits(s)
    return F.when(T.whole(s, "[0-9 -]*") & (F.length(d) == 9), d)


def ssn_rules(d: Column) -> Column:
    area = F.substring(d, 1, 3)
    return ~area.isin("000", "666") & ~d.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000") & (d != F.repeat(F.substring(d, 1, 1), F.lit(9)))


def ein_rules(d: Column) -> Column:
    return F.substring(d, 1, 2).isin(EIN_PREFIXES)


def itin_rules(d: Column) -> Column:
    return T.whole(d, "9[0-9]{2}[78][0-9]{5}")


def atin_rules(d: Column) -> Column:
    return T.whole(d, "9[0-9]{2}93[0-9]{4}")


RULES = {"SSN": ssn_rules, "EIN": ein_rules, "ITIN": itin_rules, "ATIN": atin_rules}

# The same rules as one pattern each over the text itself, digits with any hyphens and spaces between them: one match a
# value in place of a copy of its digits and a test for each rule.
_GAP = "[ -]*"


def _spread(*classes: str) -> str:
    """Digits of the classes in turn, each with what may follow it."""
    return "".join(c + _GAP for c in classes)


_N = "[0-9]"
_EIN_HEAD = "|".join(f"{first}{_GAP}[{''.join(p[1] for p in EIN_PREFIXES if p[0] == first)}]" for first in sorted({p[0] for p in EIN_PREFIXES}))
STRICT = {
    "SSN": rf"{_GAP}(?!9|{_spread(*'000')}|{_spread(*'666')}|([0-9])(?:{_GAP}\1){{8}}{_GAP}\z){_spread(*[_N] * 3)}(?!{_spread(*'00')}){_spread(*[_N] * 2)}(?!{_spread(*'0000')}\z){_spread(*[_N] * 4)}",
    "EIN": rf"{_GAP}(?:{_EIN_HEAD}){_GAP}{_spread(*[_N] * 7)}",
    "ITIN": rf"{_GAP}{_spread('9', _N, _N, '[78]', *[_N] * 5)}",
    "ATIN": rf"{_GAP}{_spread('9', _N, _N, '9', '3', *[_N] * 4)}",
}


def strict(s: Column, kind: str) -> Column:
    return s.rlike(rf"\A{STRICT[kind]}\z")


@on_text("is_tin")
def is_tin(s: Column, args: dict) -> Column:
    kind = word(args, "kind", "ANY")
    if kind in STRICT:
        return strict(s, kind)
    return strict(s, "EIN") | strict(s, "SSN") | strict(s, "ITIN") | strict(s, "ATIN")  # nine zeros fit none of them


on_text("is_ssn")(lambda s, a: strict(s, "SSN"))
on_text("is_ein")(lambda s, a: strict(s, "EIN"))
on_text("is_itin")(lambda s, a: itin_rules(T.digits(s)))
on_text("is_atin")(lambda s, a: atin_rules(T.digits(s)))
on_text("luhn")(lambda s, a: T.luhn(T.digits(s)))
