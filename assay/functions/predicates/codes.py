"""Colors, encodings and ledger addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T

from .base import flag, on_text, word


@on_text("is_hex_color")
def is_hex_color(s: Column, args: dict) -> Column:
    sizes = (3, 4, 6, 8) if flag(args, "allow_alpha", True) else (3, 6)
    mark = "#" if flag(args, "require_hash", True) else "#?"
    return T.whole(T.strip(s), mark + "(?:" + "|".join(f"[0-9A-Fa-f]{{{n}}}" for n in sizes) + ")")


def _number(t: Column, low: float, high: float) -> Column:
    x = T.strict_float(T.strip(t))
    return F.coalesce(x.between(F.lit(low), F.lit(high)), F.lit(False))


def _percent(t: Column) -> Column:
    return t.endswith("%") & _number(t.substr(F.lit(1), F.length(t) - 1), 0.0, 100.0)


def _channel(t: Column) -> Column:
    x = T.strict_float(T.strip(t))
    return F.when(t.endswith("%"), _percent(t)).otherwise(_number(t, 0.0, 255.0) & F.coalesce(x == F.rint(x), F.lit(False)))


def _alpha(t: Column) -> Column:
    return F.when(t.endswith("%"), _percent(t)).otherwise(_number(t, 0.0, 1.0))


def _hue(t: Column) -> Column:
    return _number(F.regexp_replace(t, r"deg\z", ""), 0.0, 360.0)


def _color(s: Column, name: str, three) -> Column:
    """``name(a, b, c[, alpha])``, ``name(a b c)``, ``name(a b c / alpha)``; ``three`` tests the parts before alpha."""
    t = T.strip(s)
    inner = T.strip(F.regexp_extract(t, rf"(?s)\A{name}a?\((.*)\)\z", 1))
    slash, comma = inner.contains("/"), inner.contains(",")
    blanks = lambda x: F.filter(F.split(x, rf"[{T.WHITE}]+"), lambda p: p != "")
    before, after = F.substring_index(inner, "/", 1), T.strip(inner.substr(F.instr(inner, "/") + 1, F.length(inner)))
    listed = F.transform(F.split(inner, ",", -1), T.strip)
    parts = F.when(slash, blanks(before)).when(comma, listed).otherwise(blanks(inner))
    part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    n = F.size(parts)
    body = three([part(0), part(1), part(2)])
    fourth = (n == 4) & (comma | t.startswith(f"{name}a(")) & _alpha(part(3))
    return t.rlike(rf"(?s)\A{name}a?\(.*\)\z") & body & F.when(slash, (n == 3) & _alpha(after)).otherwise((n == 3) | fourth)


def _rgb(p: list[Column]) -> Column:
    marks = [x.endswith("%") for x in p]
    return ((marks[0] & marks[1] & marks[2]) | ~(marks[0] | marks[1] | marks[2])) & _channel(p[0]) & _channel(p[1]) & _channel(p[2])


on_text("is_rgb_color")(lambda s, a: _color(s, "rgb", _rgb))
on_text("is_hsl_color")(lambda s, a: _color(s, "hsl", lambda p: _hue(p[0]) & _percent(p[1]) & _percent(p[2])))

BASE58 = "[1-9A-HJ-NP-Za-km-z]"
on_text("is_base58")(lambda s, a: T.whole(T.strip(s), f"{BASE58}+"))
on_text("is_solana_address")(lambda s, a: T.whole(T.strip(s), f"{BASE58}{{32,44}}"))


@on_text("is_base64")
def is_base64(s: Column, args: dict) -> Column:
    t = T.strip(s)
    alphabet = "[0-9A-Za-z_-]" if flag(args, "url_safe", False) else "[0-9A-Za-z+/]"
    return T.whole(t, f"{alphabet}*={{0,2}}") & (t != "") & (~t.endswith("=") | (F.length(t) % 4 == 0))


@on_text("is_bitcoin_address")
def is_bitcoin_address(s: Column, args: dict) -> Column:
    t = T.strip(s)
    segwit = "bc1q[02-9ac-hj-np-z]{38}|bc1p[02-9ac-hj-np-z]{58}"
    return T.whole(t, f"[13]{BASE58}{{24,33}}") | T.whole(F.lower(t), segwit)


on_text("is_ethereum_address")(lambda s, a: T.whole(T.strip(s), "0[xX][0-9A-Fa-f]{40}"))
on_text("is_jwt")(lambda s, a: T.whole(T.strip(s), r"[0-9A-Za-z_-]+(?:\.[0-9A-Za-z_-]+){2}"))

#: Hex digits of each digest.
DIGESTS = {"md5": 32, "sha1": 40, "sha224": 56, "sha256": 64, "sha384": 96, "sha512": 128}


@on_text("is_hash")
def is_hash(s: Column, args: dict) -> Column:
    named = word(args, "algorithm")
    if named is not None and named.lower() not in DIGESTS:
        return F.lit(False)
    sizes = [DIGESTS[named.lower()]] if named is not None else list(DIGESTS.values())
    return T.whole(T.strip(s), "|".join(f"[0-9A-Fa-f]{{{n}}}" for n in sizes))
