"""The normalizing transforms. Each takes a value and arguments and gives the new value; what one does not apply to passes unchanged."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.plans.values import Value, literal

TRANSFORMS: dict[str, Callable[[Value, dict], Value]] = {}


def _register(name: str):
    def add(fn):
        TRANSFORMS[name] = fn
        return fn

    return add


def _on_text(name: str):
    """A transform of strings to strings; null from the function leaves the text as it was."""

    def add(fn: Callable[[Column, dict], Column]):
        def run(v: Value, args: dict) -> Value:
            return v if v.str is None else v.but(str=F.coalesce(fn(v.str, args), v.str))

        TRANSFORMS[name] = run
        return fn

    return add


def _each(s: Column, mark: str) -> Column:
    return F.regexp_replace(s, mark, "")


_on_text("trim")(lambda s, a: T.strip(s))
_on_text("collapse_whitespace")(lambda s, a: F.trim(F.regexp_replace(s, rf"[{T.WHITE}]+", " ")))
_on_text("digits_only")(lambda s, a: T.digits(s))
_on_text("upper")(lambda s, a: F.upper(s))
_on_text("lower")(lambda s, a: F.lower(s))


@_on_text("replace")
def replace(s: Column, args: dict) -> Column:
    old, new = args["pattern"], args["replacement"]
    if old == "":  # between all characters
        return F.concat(F.lit(new), F.array_join(F.transform(F.split(s, ""), lambda c: F.concat(c, F.lit(new))), "")) if new else s
    return F.replace(s, F.lit(old), F.lit(new))


@_on_text("date_parse")
def date_parse(s: Column, args: dict) -> Column:
    form = args.get("format", "")
    form = {"%m/%d/%Y": "MM/DD/YYYY", "%m-%d-%Y": "MM-DD-YYYY", "%Y-%m-%d": "YYYY-MM-DD", "%d/%m/%Y": "DD/MM/YYYY", "%d-%m-%Y": "DD-MM-YYYY"}.get(form, form)
    if form == "MMDDYYYY":
        fits, parts = T.whole(s, "[0-9]{8}"), {"M": F.substring(s, 1, 2), "D": F.substring(s, 3, 2), "Y": F.substring(s, 5, 4)}
    elif form in ("MM/DD/YYYY", "MM-DD-YYYY", "YYYY-MM-DD", "DD/MM/YYYY", "DD-MM-YYYY"):
        mark = "/" if "/" in form else "-"
        number = r"\+?[0-9]{1,10}"
        fits = T.whole(s, mark.join([number] * 3))
        split = F.split(s, mark)
        parts = {part[0]: F.get(split, k) for k, part in enumerate(form.split(mark))}
    else:
        return s
    y, m, d = (parts[k].try_cast("long") for k in "YMD")
    return F.when(fits & T.valid_day(y, m, d), F.concat(F.when(y < 10000, F.lpad(y.cast("string"), 4, "0")).otherwise(y.cast("string")), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")))


@_on_text("phone_us")
def phone_us(s: Column, args: dict) -> Column:
    d = T.digits(s)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4)))


@_on_text("phone_e164")
def phone_e164(s: Column, args: dict) -> Column:
    d, plus = T.digits(s), T.strip(s).startswith("+")
    n = F.length(d)
    return (
        F.when(plus, F.when(n.between(7, 15), F.concat(F.lit("+"), d))).when(n == 10, F.concat(F.lit("+1"), d)).when((n == 11) & d.startswith("1"), F.concat(F.lit("+"), d))
    )


_on_text("normalize_flight_number")(lambda s, a: F.upper(_each(T.strip(s), r"[ \t\n\f\r\-]")))


def _compact(s: Column) -> Column:
    return F.upper(_each(s, "[^0-9A-Za-z]"))


@_on_text("normalize_icd10")
def normalize_icd10(s: Column, args: dict) -> Column:
    c = _compact(s)
    return F.when(T.whole(c, "[A-Z][0-9A-Z]{2,6}"), F.when(F.length(c) > 3, F.concat(F.substring(c, 1, 3), F.lit("."), F.substring(c, 4, 4))).otherwise(c))


_on_text("normalize_cpt")(lambda s, a: F.when(T.whole(_compact(s), "[0-9]{4}[0-9FT]"), _compact(s)))
_on_text("normalize_hcpcs")(lambda s, a: F.when(T.whole(_compact(s), "[A-V][0-9]{4}"), _compact(s)))


@_on_text("normalize_ndc11")
def normalize_ndc11(s: Column, args: dict) -> Column:
    t = T.strip(s)
    d, p = T.digits(t), F.split(t, "-")
    a, b, c = F.get(p, 0), F.get(p, 1), F.get(p, 2)
    return (
        F.when(F.length(d) == 11, d)
        .when(T.whole(t, "[0-9]{4}-[0-9]{4}-[0-9]{2}"), F.concat(F.lit("0"), a, b, c))
        .when(T.whole(t, "[0-9]{5}-[0-9]{3}-[0-9]{2}"), F.concat(a, F.lit("0"), b, c))
        .when(T.whole(t, "[0-9]{5}-[0-9]{4}-[0-9]"), F.concat(a, b, F.lit("0"), c))
    )


@_on_text("card_mask_last4")
def card_mask_last4(s: Column, args: dict) -> Column:
    d = T.digits(s)
    return F.when(F.length(d) <= 4, d).otherwise(F.concat(F.repeat(F.lit("*"), F.length(d) - 4), F.right(d, F.lit(4))))


def _nine(s: Column, *parts: Any) -> Column:
    d = T.digits(s)
    return F.when(F.length(d) == 9, F.concat(*[F.lit(p) if isinstance(p, str) else F.substring(d, *p) for p in parts]))


_on_text("format_ssn")(lambda s, a: _nine(s, (1, 3), "-", (4, 2), "-", (6, 4)))
_on_text("format_ein")(lambda s, a: _nine(s, (1, 2), "-", (3, 7)))
_on_text("mask_ssn")(lambda s, a: _nine(s, "***-**-", (6, 4)))
_on_text("mask_ein")(lambda s, a: _nine(s, "**-***", (6, 4)))


def _fours(s: Column) -> Column:
    return F.regexp_replace(s, "(.{4})(?=.)", "$1 ")


@_on_text("format_iban")
def format_iban(s: Column, args: dict) -> Column:
    c = F.upper(_each(s, rf"[{T.WHITE}]"))
    return F.when(F.octet_length(c) >= 5, _fours(c))


@_on_text("format_credit_card")
def format_credit_card(s: Column, args: dict) -> Column:
    d = T.digits(s)
    return F.when(F.length(d) >= 13, _fours(d))


@_register("default")
def default(v: Value, args: dict) -> Value:
    """The argument in place of null."""
    return v.or_else(literal(args.get("value")))


@_register("money_to_cents")
def money_to_cents(v: Value, args: dict) -> Value:
    """A money text or number as a whole number of the smallest unit; texts that are no amount stay."""
    scale = 10.0 ** int(args.get("scale", 2) if args.get("scale") is not None else 2)
    cents = lambda x: T.saturated_long(T.half_away(x * F.lit(scale)))
    out, text = [], v.str
    if v.str is not None:
        kept = T.money_chars(v.str)
        size = cents(F.regexp_replace(kept, "^-+", "").try_cast("double"))
        whole = F.when(kept.startswith("-"), -size).otherwise(size)
        out.append(whole)
        text = F.when(whole.isNull(), v.str)
    if v.num is not None:
        out.append(cents(v.num))
    if not out:
        return v
    whole = F.coalesce(*out) if len(out) > 1 else out[0]
    return v.but(str=text, num=whole.cast("double"), int=whole.cast("decimal(38,0)"))


@_register("format_thousands")
def format_thousands(v: Value, args: dict) -> Value:
    """Grouped whole part; numbers become texts."""
    mark = args.get("separator")
    mark = "," if mark is None else mark

    def run(s: Column) -> Column:
        kept = T.money_chars(s)
        size = F.regexp_replace(kept, "^-+", "")
        head = F.substring_index(size, ".", 1)
        tail = F.when(size.contains("."), F.concat(F.lit("."), size.substr(F.length(head) + 2, F.length(size)))).otherwise("")
        grouped = F.replace(F.regexp_replace(head, r"(?<=[0-9])(?=(?:[0-9]{3})+\z)", ","), F.lit(","), F.lit(mark)) if mark else head
        return F.when(T.whole(head, "[0-9]+"), F.concat(F.when(kept.startswith("-"), "-").otherwise(""), grouped, tail))

    return _as_text(v, run)


def _as_text(v: Value, run: Callable[[Column], Column]) -> Value:
    out, num, int_ = [], v.num, v.int
    if v.str is not None:
        out.append(F.coalesce(run(v.str), v.str))
    if v.num is not None:
        shown = T.plain_float(v.num) if v.int is None else F.coalesce(v.int.cast("string"), T.plain_float(v.num))
        done = run(shown)
        out.append(done)
        num = F.when(done.isNull(), v.num)
        int_ = None if v.int is None else F.when(done.isNull(), v.int)
    return v.but(str=F.coalesce(*out), num=num, int=int_) if out else v


@_register("format_decimal")
def format_decimal(v: Value, args: dict) -> Value:
    """A number or number text with that many decimals: multiplied, rounded half away from zero, written out."""
    places = int(args.get("places", 0))
    factor = 10.0**places

    def show(x: Column) -> Column:
        scaled = T.half_away(x * F.lit(factor))
        sign, size = F.when(scaled < 0, "-").otherwise(""), F.abs(scaled)
        if places == 0:
            return F.concat(sign, T.plain_float(size))
        head = F.floor(size / F.lit(factor)).cast("double")
        rest = F.lpad((size - head * F.lit(factor)).cast("long").cast("string"), places, "0")
        return F.concat(sign, T.plain_float(head), F.lit("."), rest)

    out = []
    if v.str is not None:
        out.append(F.coalesce(show(T.loose_number(v.str)), v.str))
    if v.num is not None:
        out.append(show(v.num))
    return v.but(str=F.coalesce(*out), num=None, int=None) if out else v


def apply(v: Value, transforms: list[dict]) -> Value:
    """The transforms in order; an unknown one raises."""
    for t in transforms or []:
        name = t["fn"]
        if name not in TRANSFORMS:
            raise ValueError(f"unknown transform: {name}")
        v = TRANSFORMS[name](v, t)
    return v
