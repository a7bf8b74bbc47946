"""Column helpers that the transforms and predicates share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point with the White_Space property; fixed values.
WHITE = "".join(chr(c) for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_FLOAT = r"(?i)[+-]?(?:inf(?:inity)?|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)"


def strip(s: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(s, F.lit(WHITE))


def digits(s: Column) -> Column:
    """The ASCII digits of a text."""
    return F.regexp_replace(s, "[^0-9]", "")


def whole(s: Column, pattern: str) -> Column:
    """The pattern matches the whole text."""
    flags, rest = (pattern[:4], pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return s.rlike(rf"{flags}\A(?:{rest})\z")


def at(s: Column, k: int) -> Column:
    """The k-th character, from 0."""
    return F.substring(s, k + 1, 1)


def digit(s: Column, k: int) -> Column:
    """The k-th character's value as a digit."""
    return F.ascii(at(s, k)) - 48


def weighted(s: Column, weights: list[int]) -> Column:
    """The sum of the leading digits times the weights."""
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + digit(s, k) * w
    return total


def luhn(d: Column) -> Column:
    """The mod-10 check over a text of digits; empty texts fail."""
    return F.coalesce(F.call_function("luhn_check", d), F.lit(False)) & (F.length(d) > 0)


def money_chars(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9.\-]", "")


def loose_number(s: Column) -> Column:
    """The number left when all but digits, points and minus signs are dropped; null if that is none."""
    return money_chars(s).try_cast("double")


def strict_float(s: Column) -> Column:
    """A text in float grammar (inf and nan included) as a double; null if it is not one."""
    return F.when(whole(s, _FLOAT), F.when(F.lower(s).endswith("nan"), F.lit(float("nan"))).otherwise(s.try_cast("double")))


def half_away(x: Column) -> Column:
    """A double rounded to a whole number, halves away from zero."""
    low = F.floor(F.abs(x)).cast("double")
    size = low + F.when(F.abs(x) - low >= 0.5, 1.0).otherwise(0.0)
    return F.when(F.abs(x) >= 4503599627370496.0, x).otherwise(F.signum(x) * size)


def saturated_long(x: Column) -> Column:
    """A double as a long, held at the type's ends."""
    return F.when(F.isnan(x), F.lit(0)).when(x >= 9223372036854775807.0, F.lit(9223372036854775807)).when(x <= -9223372036854775808.0, F.lit(-9223372036854775808)).otherwise(x.try_cast("long"))


def plain_float(x: Column) -> Column:
    """A double in plain decimal notation, without exponent and without the point of a whole number."""
    s = x.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    size = F.regexp_replace(s, "^-", "")
    mantissa = F.substring_index(size, "E", 1)
    power = F.when(size.contains("E"), F.substring_index(size, "E", -1).try_cast("int")).otherwise(F.lit(0))
    head = F.substring_index(mantissa, ".", 1)
    tail = F.regexp_replace(F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise(""), "0+$", "")
    grown = F.rpad(tail, F.greatest(power, F.length(tail)).cast("int"), "0")
    up = F.concat(head, F.substring(grown, F.lit(1), power), F.when(F.length(grown) > power, F.concat(F.lit("."), grown.substr(power + 1, F.lit(400)))).otherwise(""))
    up = F.when(up.rlike(r"^0+[1-9]"), F.regexp_replace(up, "^0+", "")).otherwise(up)
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), head, tail)
    named = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf")))
    return F.coalesce(named, F.concat(sign, F.when(power >= 0, up).otherwise(down)))


def valid_day(y: Column, m: Column, d: Column) -> Column:
    """The Gregorian calendar has the day; years from 0 on."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return m.between(1, 12) & (d >= 1) & (d <= last)


def day_key(s: Column) -> Column:
    """yyyymmdd of a date in one of the accepted spellings, else null."""
    t = strip(s)
    two, four = r"(?:\+[0-9]|[0-9]{2})", r"(?:\+[0-9]{3}|[0-9]{4})"
    number = lambda a, n: F.substring(t, a, n).try_cast("int")
    us, iso, bare = whole(t, rf"{two}/{two}/{four}|{two}-{two}-{four}"), whole(t, f"{four}-{two}-{two}"), whole(t, "[0-9]{8}")
    y = F.when(us, number(7, 4)).when(iso, number(1, 4)).when(bare, number(5, 4))
    m = F.when(us, number(1, 2)).when(iso, number(6, 2)).when(bare, number(1, 2))
    d = F.when(us, number(4, 2)).when(iso, number(9, 2)).when(bare, number(3, 2))
    return F.when(valid_day(y, m, d), y * 10000 + m * 100 + d)


def is_24h(t: Column) -> Column:
    return whole(t, "(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?")


def is_12h(t: Column) -> Column:
    return whole(t, r"(?i)0*(?:[1-9]|1[0-2]):0*[0-5]?[0-9](?::0*[0-5]?[0-9])?[\s\x{85}\x{A0}]*[AP]M")


def second_key(t: Column) -> Column:
    """Seconds of the day of a time in either notation, else null."""
    part = lambda k: F.regexp_extract(t, r"(?i)\A([0-9]+):([0-9]+)(?::([0-9]+))?", k).try_cast("int")
    h, m, s = part(1), part(2), F.coalesce(part(3), F.lit(0))
    afternoon = F.upper(t).endswith("PM")
    h12 = F.when(afternoon & (h != 12), h + 12).when(~afternoon & (h == 12), 0).otherwise(h)
    return F.when(is_24h(t), h * 3600 + m * 60 + s).when(is_12h(t), h12 * 3600 + m * 60 + s)
