"""Securities, banking, payment and product identifiers."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T

from .base import any_of, count, flag, on_text, word

def _upper(s: Column) -> Column:
    return F.upper(T.strip(s))


def _position(c: Column) -> Column:
    """0 to 9 for digits, 10 to 35 for capital letters."""
    code = F.ascii(c)
    return F.when(code < 58, code - 48).otherwise(code - 55)


@on_text("is_cusip")
def is_cusip(s: Column, args: dict) -> Column:
    u = _upper(s)
    shape = T.whole(u, "[0-9A-Z]{9}")
    if not flag(args, "validate_checksum", True):
        return shape
    doubled = [_position(T.at(u, k)) * (2 if k % 2 else 1) for k in range(8)]
    total = reduce(lambda a, b: a + b, (F.floor(x / 10) + x % 10 for x in doubled))
    return shape & T.whole(T.at(u, 8), "[0-9]") & ((10 - total % 10) % 10 == T.digit(u, 8))


@on_text("is_aba_routing")
def is_aba_routing(s: Column, args: dict) -> Column:
    d = T.digits(T.strip(s))
    district = F.substring(d, 1, 2).try_cast("int")
    known = district.between(0, 12) | district.between(21, 32) | district.between(61, 72) | (district == 80)
    return (F.length(d) == 9) & known & (T.weighted(d, [3, 7, 1] * 3) % 10 == 0)


on_text("is_mcc")(lambda s, a: T.whole(T.strip(s), "[0-9]{4}"))


@on_text("is_account_number")
def is_account_number(s: Column, args: dict) -> Column:
    low, high = count(args, "min_len", 1), count(args, "max_len", 30)
    hyphen = "-" if flag(args, "allow_hyphens", True) else ""
    t = T.strip(s)
    return F.octet_length(t).between(max(low, 1), high) & T.whole(t, f"[0-9A-Za-z{hyphen}]+")


#: Length and prefix of each network's numbers; fixed values.
NETWORKS = {"visa": "4[0-9]{15}", "mastercard": "(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}", "amex": "3[47][0-9]{13}", "discover": "(?:6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12}"}


@on_text("is_credit_card")
def is_credit_card(s: Column, args: dict) -> Column:
    d, network = T.digits(s), word(args, "network")
    pattern = NETWORKS.get(network) or "|".join(NETWORKS.values())
    return T.whole(d, pattern) & T.luhn(d)


@on_text("is_cvv")
def is_cvv(s: Column, args: dict) -> Column:
    network = word(args, "network")
    return T.whole(T.strip(s), "[0-9]{3,4}" if network is None else "[0-9]{4}" if network == "amex" else "[0-9]{3}")


@on_text("is_card_expiry")
def is_card_expiry(s: Column, args: dict) -> Column:
    """``as_of`` (yyyymm) fixes the month that expired cards are judged by; otherwise it is the current one."""
    t = T.strip(s)
    shape = T.whole(t, "(?:0[1-9]|1[0-2])/(?:[0-9]{2}|[0-9]{4})")
    if not flag(args, "reject_expired", False):
        return shape
    year = F.substring_index(t, "/", -1).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    now = F.lit(int(args["as_of"])) if "as_of" in args else F.year(F.current_date()) * 100 + F.month(F.current_date())
    return shape & (year * 100 + F.substring(t, 1, 2).try_cast("int") >= now)


#: Length of each country's account numbers; fixed values.
IBAN_LENGTHS = dict(
    x.split(":")
    for x in """AL:28 AD:24 AT:20 AZ:28 BH:22 BY:28 BE:16 BA:20 BR:29 BG:22 CR:22 HR:21 CY:28 CZ:24 DK:18 DO:28 EE:20 FO:18 FI:18 FR:27 GE:22 DE:22 GI:23 GR:27
    GL:18 GT:28 HU:28 IS:26 IQ:23 IE:22 IL:23 IT:27 JO:30 KZ:20 XK:20 KW:30 LV:21 LB:28 LI:21 LT:20 LU:20 MK:19 MT:31 MR:27 MU:30 MC:27 MD:24 ME:22 NL:18 NO:15
    PK:24 PS:29 PL:28 PT:25 QA:29 RO:24 LC:32 SM:27 SA:24 RS:22 SC:31 SK:24 SI:19 ES:24 SE:24 CH:21 TN:24 TR:26 AE:23 GB:22 VA:22 VG:24 UA:29""".split()
)


@on_text("is_iban")
def is_iban(s: Column, args: dict) -> Column:
    u = F.upper(F.regexp_replace(s, r"[ \t\n\f\r]", ""))
    land, wanted = F.substring(u, 1, 2), word(args, "country")
    by_length: dict[int, list[str]] = {}
    for code, n in IBAN_LENGTHS.items():
        by_length.setdefault(int(n), []).append(code)
    known = any_of([(F.length(u) == n) & land.isin(codes) for n, codes in sorted(by_length.items())]) | ~land.isin(list(IBAN_LENGTHS))
    turned = F.concat(F.substring(u, 5, 40), F.substring(u, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(F.ascii(c) < 58, 10).otherwise(100) + _position(c)) % 97))
    out = T.whole(u, "[A-Z]{2}[0-9]{2}[0-9A-Z]{1,30}") & known & (rest == 1)
    return out if wanted is None else out & (land == wanted.upper())


on_text("is_bic", "is_swift")(lambda s, a: T.whole(_upper(s), "[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"))


@on_text("is_vin")
def is_vin(s: Column, args: dict) -> Column:
    u = _upper(s)
    shape = T.whole(u, "[A-HJ-NPR-Z0-9]{17}")
    if not flag(args, "validate_checksum", True):
        return shape
    values = F.translate(u, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    left = T.weighted(values, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return shape & (T.at(u, 8) == F.when(left == 10, "X").otherwise(left.cast("string")))


def _product(s: Column, n: int, weights: list[int]) -> Column:
    d = F.regexp_replace(T.strip(s), rf"[{T.WHITE}\-]", "")
    return T.whole(d, f"[0-9]{{{n}}}") & (T.weighted(d, weights) % 10 == 0)


on_text("is_upc")(lambda s, a: _product(s, 12, [3, 1] * 6))
on_text("is_ean")(lambda s, a: _product(s, 13, [1, 3] * 6 + [1]))


@on_text("is_isbn")
def is_isbn(s: Column, args: dict) -> Column:
    d = F.regexp_replace(s, rf"[{T.WHITE}\-]", "")
    last = F.when(F.upper(T.at(d, 9)) == "X", 10).otherwise(T.digit(d, 9))
    ten = T.whole(d, "[0-9]{9}[0-9Xx]") & ((T.weighted(d, [10, 9, 8, 7, 6, 5, 4, 3, 2]) + last) % 11 == 0)
    thirteen = T.whole(d, "97[89][0-9]{10}") & (T.weighted(d, [1, 3] * 6 + [1]) % 10 == 0)
    version = str(args.get("version", ""))
    return ten if version == "10" else thirteen if version == "13" else ten | thirteen
