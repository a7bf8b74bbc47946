"""Number types: what fits which width."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.plans.values import Value, false

from .base import on_value

#: Bounds of the integer widths.
WIDTHS = {f"is_{s}{n}": (0 if s == "u" else -(2 ** (n - 1)), 2**n - 1 if s == "u" else 2 ** (n - 1) - 1) for s in "ui" for n in (8, 16, 32, 64)}


def _big(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def _within(v: Value, low: int | None, high: int | None) -> Column:
    """An exact whole number within the bounds; texts in plain digits are compared exactly, other floats by their double."""
    fits_exact = lambda x: x.isNotNull() if low is None else x.between(_big(low), _big(high))
    bounded = lambda x: F.lit(True) if low is None else (x >= float(low)) & (x <= float(high))
    fits_double = lambda x: (x == F.rint(x)) & (F.abs(x) < float("inf")) & bounded(x)
    out = false()
    if v.str is not None:
        t = T.strip(v.str)
        plain = T.whole(t, "[+-]?[0-9]+")
        out = out | F.when(plain, F.coalesce(fits_exact(t.try_cast("decimal(38,0)")), F.lit(False))).otherwise(F.coalesce(fits_double(T.strict_float(t)), F.lit(False)))
    if v.num is not None:
        whole = F.coalesce(fits_double(v.num), F.lit(False))
        out = out | (whole if v.int is None else F.when(v.int.isNotNull(), fits_exact(v.int)).otherwise(whole))
    return F.coalesce(out, F.lit(False))


for _name, (_low, _high) in WIDTHS.items():
    on_value(_name)(lambda v, a, low=_low, high=_high: _within(v, low, high))
on_value("is_integer")(lambda v, a: _within(v, None, None))


@on_value("is_float")
def is_float(v: Value, args: dict) -> Column:
    out = false() if v.str is None else F.coalesce(T.strict_float(T.strip(v.str)).isNotNull(), F.lit(False))
    return out | v.is_num
