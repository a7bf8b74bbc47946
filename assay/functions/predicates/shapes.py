"""The shape of a text: direction, affixes, alphabets and case."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T

from .base import on_text, word

#: Code points written from right to left; fixed values.
RTL = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ((0x590, 0x5FF), (0x600, 0x6FF), (0x700, 0x74F), (0x750, 0x77F), (0x780, 0x7BF), (0x7C0, 0x7FF), (0x800, 0x83F), (0x840, 0x85F), (0x8A0, 0x8FF), (0xFB1D, 0xFB4F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF), (0x200F, 0x200F), (0x202B, 0x202B), (0x202E, 0x202E), (0x2067, 0x2067)))


@on_text("is_rtl")
def is_rtl(s: Column, args: dict) -> Column:
    share = args.get("threshold")
    if not isinstance(share, (int, float)) or share <= 0:
        return s.rlike(f"[{RTL}]")
    right = F.regexp_count(s, F.lit(f"[{RTL}]"))
    left = F.regexp_count(s, F.lit(rf"[\p{{IsAlphabetic}}&&[^{RTL}]]"))
    return (right + left > 0) & (right / (right + left) >= float(share))


on_text("is_ltr")(lambda s, a: (T.strip(s) != "") & ~s.rlike(f"[{RTL}]"))


def _affix(test: str):
    def run(s: Column, args: dict) -> Column:
        value = word(args, "value")
        return F.lit(False) if value is None else getattr(s, test)(value)

    return run


on_text("starts_with")(_affix("startswith"))
on_text("ends_with")(_affix("endswith"))
on_text("contains")(_affix("contains"))

#: Alphabets, of the text without white space at its ends.
ALPHABETS = {
    "is_alpha": "[A-Za-z]+",
    "is_digits": "[0-9]+",
    "is_alphanumeric": "[0-9A-Za-z]+",
    "is_alpha_spaces": "[A-Za-z ]+",
    "is_alphanumeric_spaces": "[0-9A-Za-z ]+",
    "is_name_chars": "[A-Za-z'-]*[A-Za-z][A-Za-z'-]*",
    "is_uppercase": "[A-Z]+",
    "is_lowercase": "[a-z]+",
    "is_title_case": "[A-Z][a-z]+",
}
for _name, _pattern in ALPHABETS.items():
    on_text(_name)(lambda s, a, pattern=_pattern: T.whole(T.strip(s), pattern))
