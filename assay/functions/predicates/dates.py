"""Dates and times of day."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.plans.values import Value, false

from .base import count, flag, on_text, on_value, word

on_text("is_date")(lambda s, a: T.day_key(s).isNotNull())


@on_text("is_time")
def is_time(s: Column, args: dict) -> Column:
    t, form = T.strip(s), word(args, "format")
    return T.is_24h(t) if form == "24h" else T.is_12h(t) if form == "12h" else T.is_24h(t) | T.is_12h(t)


@on_text("is_iso_datetime")
def is_iso_datetime(s: Column, args: dict) -> Column:
    t = T.strip(s)
    day, clock = F.substring_index(t, "T", 1), t.substr(F.instr(t, "T") + 1, F.length(t))
    number = r"\+?[0-9]{1,9}"
    parts = F.split(day, "-")
    y, m, d = (F.get(parts, k).try_cast("long") for k in range(3))
    loose = T.whole(day, f"{number}-{number}-{number}") & T.valid_day(y, m, d)
    zone = r"(?:Z|[+-]0*(?:1?[0-9]|2[0-3]):0*[1-5]?[0-9])?"
    return t.contains("T") & (T.day_key(day).isNotNull() | loose) & T.whole(clock, rf"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?:\.[0-9]+)?{zone}")


@on_value("is_tax_year")
def is_tax_year(v: Value, args: dict) -> Column:
    low, high = count(args, "min", 2020), count(args, "max", 2100)
    out = false()
    if v.str is not None:
        t = T.strip(v.str)
        out = out | (T.whole(t, r"\+?[0-9]{1,18}") & t.try_cast("long").between(low, min(high, 2**32 - 1)))
    if v.int is not None:
        out = out | ((v.int >= 0) & (v.int % 2**32).between(low, high))
    return out


def bound(args: dict, name: str) -> int | None:
    """yyyymmdd of a date argument; None if there is none or it is no date."""
    import re

    text = word(args, name)
    if text is None:
        return None
    t = text.strip(T.WHITE)
    for pattern, order in ((r"(\d{2})([/-])(\d{2})\2(\d{4})", (4, 1, 3)), (r"(\d{4})(-)(\d{2})-(\d{2})", (1, 3, 4)), (r"(\d{2})()(\d{2})(\d{4})", (4, 1, 3))):
        if m := re.fullmatch(pattern, t, re.ASCII):
            y, mo, d = (int(m[k]) for k in order)
            leap = y % 4 == 0 and y % 100 != 0 or y % 400 == 0
            if 1 <= mo <= 12 and 1 <= d <= [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][mo - 1]:
                return y * 10000 + mo * 100 + d
    return None


def clock(args: dict, name: str) -> int | None:
    """Seconds of a time argument; None if there is none or it is no time."""
    import re

    text = word(args, name)
    if text is None:
        return None
    t = text.strip(T.WHITE)
    if m := re.fullmatch(r"([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?", t, re.ASCII):
        return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)
    if (m := re.fullmatch(r"(\d+):(\d+)(?::(\d+))?\s*([AP])M", t, re.ASCII | re.IGNORECASE)) and 1 <= int(m[1]) <= 12 and int(m[2]) <= 59 and int(m[3] or 0) <= 59:
        return (int(m[1]) % 12 + 12 * (m[4].upper() == "P")) * 3600 + int(m[2]) * 60 + int(m[3] or 0)
    return None


@on_text("date_in_range")
def date_in_range(s: Column, args: dict) -> Column:
    key = T.day_key(s)
    out = key.isNotNull()
    low, high = bound(args, "min"), bound(args, "max")
    out = out if low is None else out & (key >= low)
    out = out if high is None else out & (key <= high)
    year = F.floor(key / 10000)
    out = out & (year >= args["min_year"]) if isinstance(args.get("min_year"), int) else out
    return out & (year <= args["max_year"]) if isinstance(args.get("max_year"), int) else out


def _side(before: bool):
    def test(s: Column, args: dict) -> Column:
        key, limit, equal = T.day_key(s), bound(args, "date"), flag(args, "allow_equal", True)
        if limit is None:
            return key.isNotNull()
        return (key <= limit if equal else key < limit) if before else (key >= limit if equal else key > limit)

    return test


on_text("date_before")(_side(True))
on_text("date_after")(_side(False))


def _time_side(before: bool):
    def test(s: Column, args: dict) -> Column:
        key, limit, equal = T.second_key(T.strip(s)), clock(args, "time"), flag(args, "allow_equal", True)
        if limit is None:
            return key.isNotNull()
        return (key <= limit if equal else key < limit) if before else (key >= limit if equal else key > limit)

    return test


on_text("time_before")(_time_side(True))
on_text("time_after")(_time_side(False))


@on_text("time_in_range")
def time_in_range(s: Column, args: dict) -> Column:
    """Inclusive; a start after the end wraps around midnight."""
    key, low, high = T.second_key(T.strip(s)), clock(args, "min"), clock(args, "max")
    if low is not None and high is not None:
        return key.between(low, high) if low <= high else (key >= low) | (key <= high)
    return key.isNotNull() if low is None and high is None else key >= low if high is None else key <= high
