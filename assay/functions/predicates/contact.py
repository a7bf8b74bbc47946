"""Phones, mail, web and network addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T

from .base import any_of, flag, on_text, word

#: Domains of throw-away mailboxes; fixed values.
DISPOSABLE = "mailinator.com guerrillamail.com 10minutemail.com tempmail.com throwaway.email yopmail.com fakeinbox.com trashmail.com".split()


def us_phone(s: Column, args: dict) -> Column:
    local = "" if flag(args, "require_area_code", True) else "|[2-9][0-9]{6}"
    return T.whole(T.digits(s), f"1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}{local}")


@on_text("phone_number", "is_phone")
def phone_number(s: Column, args: dict) -> Column:
    return F.when(T.strip(s).startswith("+"), F.length(T.digits(s)).between(7, 15)).otherwise(us_phone(s, args))


on_text("phone_number_us")(lambda s, a: ~T.strip(s).startswith("+") & us_phone(s, a))


@on_text("is_email")
def is_email(s: Column, args: dict) -> Column:
    t = T.strip(s)
    name = r"(?!\.)[A-Za-z0-9._%+-]{1,64}(?<!\.)"
    out = T.whole(t, rf"{name}@(?![.-])[A-Za-z0-9.-]*\.[A-Za-z]{{2,}}") & (F.length(F.substring_index(t, "@", -1)) <= 253)
    if flag(args, "block_disposable", False):
        out = out & ~any_of([F.lower(t).endswith(d) for d in DISPOSABLE])
    return out


@on_text("is_url")
def is_url(s: Column, args: dict) -> Column:
    https = "s" if flag(args, "require_https", False) else "s?"
    return T.strip(s).rlike(rf"(?s)\Ahttp{https}://[A-Za-z0-9.-]+(?::[^/]*)?(?:/.*)?\z")


@on_text("is_uuid")
def is_uuid(s: Column, args: dict) -> Column:
    version = args.get("version")
    nibble = "[0-9a-f]" if not isinstance(version, int) else f"{version:x}" if version < 16 else "(?!)"
    return T.whole(F.lower(T.strip(s)), f"[0-9a-f]{{8}}-[0-9a-f]{{4}}-{nibble}[0-9a-f]{{3}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}")


_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"


def _v6() -> str:
    """All spellings: eight groups, or fewer around one double colon; the last two may be a v4 address."""
    group = "[0-9A-Fa-f]{1,4}"
    ways = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{V4}"]
    for before in range(8):
        head = "" if before == 0 else f"(?:{group}:){{{before - 1}}}{group}"
        room = 7 - before  # groups that may follow the double colon
        tails = [f"(?:{group}(?::{group}){{0,{room - 1}}})?"] if room else [""]
        if room >= 2:
            tails.append(f"(?:{group}:){{0,{room - 2}}}{V4}")
        ways += [f"{head}::{t}" for t in tails]
    return "|".join(ways)


V6 = _v6()


def _ip(t: Column, version: str | None) -> Column:
    return T.whole(t, V4 if version == "v4" else V6 if version == "v6" else f"{V4}|{V6}")


def _version(args: dict) -> str | None:
    got = word(args, "version")
    return got and got.lower()


on_text("is_ip")(lambda s, a: _ip(T.strip(s), _version(a)))


@on_text("is_cidr")
def is_cidr(s: Column, args: dict) -> Column:
    t, version = T.strip(s), _version(args)
    host, bits = F.substring_index(t, "/", 1), t.substr(F.instr(t, "/") + 1, F.length(t))
    n = F.when(T.whole(bits, r"\+?[0-9]{1,9}"), bits.try_cast("int"))
    four, six = T.whole(host, V4) & (n <= 32), T.whole(host, V6) & (n <= 128)
    return t.contains("/") & (four if version == "v4" else six if version == "v6" else four | six)


on_text("is_mac_address")(lambda s, a: T.whole(T.strip(s), r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{4}(?:\.[0-9A-Fa-f]{4}){2}"))
on_text("is_street_address")(lambda s, a: (F.octet_length(T.strip(s)) >= 5) & T.strip(s).rlike(r"\A[0-9]") & s.rlike("[A-Za-z]"))
