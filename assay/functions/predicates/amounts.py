"""Amounts, percentages and decimals."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.plans.values import Value, false

from .base import count, flag, on_text, on_value, word


def amount(v: Value) -> Column:
    """A number, or what number a text holds once other characters are dropped; null if none."""
    ways = [x for x in (v.num, None if v.str is None else T.loose_number(v.str)) if x is not None]
    return F.coalesce(*ways) if ways else F.lit(None).cast("double")


on_value("is_non_negative")(lambda v, a: amount(v) >= 0)
on_value("is_positive")(lambda v, a: amount(v) > 0)
on_value("is_negative")(lambda v, a: amount(v) < 0)
on_value("is_non_positive")(lambda v, a: amount(v) <= 0)


@on_value("is_percentage")
def is_percentage(v: Value, args: dict) -> Column:
    n = amount(v)
    if flag(args, "allow_over_100", False):
        return (n >= 0) & (n <= 1.7976931348623157e308)
    return n.between(0.0, 1.0 if word(args, "format") == "decimal" else 100.0)


@on_text("is_money_format")
def is_money_format(s: Column, args: dict) -> Column:
    kept, most = T.money_chars(s), count(args, "max_decimals", 2)
    decimals = F.when(kept.contains("."), F.length(kept) - F.instr(kept, ".")).otherwise(0)
    value = kept.try_cast("double")
    out = value.isNotNull() & (decimals <= most)
    return out if flag(args, "allow_negative", True) else out & (value >= 0)


@on_text("is_money_no_symbol")
def is_money_no_symbol(s: Column, args: dict) -> Column:
    most = count(args, "max_decimals", 2)
    sign = "-?" if flag(args, "allow_negative", True) else ""
    cents = rf"(?:\.[0-9]{{1,{most}}})?" if most else ""
    return T.whole(T.strip(s), rf"{sign}(?:[0-9]+|[0-9]{{1,3}}(?:,[0-9]{{3}})+){cents}")


def _argument(args: dict) -> float | None:
    """A number argument, or the number in a text argument."""
    got = args.get("value")
    if isinstance(got, str):
        kept = "".join(c for c in got if c in "0123456789.-")
        try:
            return float(kept)
        except ValueError:
            return None
    return float(got) if isinstance(got, (int, float)) and not isinstance(got, bool) else None


@on_value("is_multiple_of")
def is_multiple_of(v: Value, args: dict) -> Column:
    step = _argument(args)
    if not step:
        return false()
    ratio = amount(v) / F.lit(step)
    return F.abs(ratio - T.half_away(ratio)) < 1e-9


@on_value("less_than_or_equal")
def less_than_or_equal(v: Value, args: dict) -> Column:
    limit = _argument(args)
    return false() if limit is None else amount(v) <= F.lit(limit)


@on_value("greater_than_or_equal")
def greater_than_or_equal(v: Value, args: dict) -> Column:
    limit = _argument(args)
    return false() if limit is None else amount(v) >= F.lit(limit)


@on_value("format:decimal-2")
def decimal_2(v: Value, args: dict) -> Column:
    """Two decimals or none; values that are no texts pass."""
    if v.str is None:
        return F.lit(True)
    t = T.strip(v.str)
    whole = T.whole(t, "[+-]?[0-9]+") & t.try_cast("decimal(38,0)").between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    cents = (F.length(F.substring_index(t, ".", -1)) == 2) & T.strict_float(t).isNotNull()
    return F.when(v.str.isNull() | (t == ""), True).when(t.contains("."), F.coalesce(cents, F.lit(False))).otherwise(F.coalesce(whole, F.lit(False)))


@on_value("is_decimal_places")
def is_decimal_places(v: Value, args: dict) -> Column:
    ways = [x for x in (None if v.str is None else T.strip(v.str), None if v.num is None else T.plain_float(v.num)) if x is not None]
    if not ways:
        return false()
    t = F.regexp_replace(F.coalesce(*ways), "^-+", "")
    places = F.when(t.contains("."), F.length(F.substring_index(t, ".", -1))).otherwise(0)
    wanted = count(args, "places", 2)
    return T.strict_float(t).isNotNull() & ((places <= wanted) if flag(args, "max", False) else (places == wanted))
