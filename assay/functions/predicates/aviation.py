"""Airports, airlines and flights."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T

from .base import flag, on_text, word

# The codes that count as known.
AIRPORTS = {
    "IATA": "SFO LAX JFK ORD DFW DEN SEA BOS MIA ATL PHX IAH EWR LHR LGW CDG FRA AMS MAD BCN NRT HND KIX SYD MEL YYZ YVR DXB SIN HKG".split(),
    "ICAO": "KSFO KLAX KJFK KORD KDFW KDEN KSEA KBOS KMIA KATL KPHX KIAH KEWR EGLL EGKK LFPG EDDF EHAM LEMD LEBL RJAA RJTT RJBB YSSY YMML CYYZ CYVR OMDB WSSS VHHH".split(),
}
AIRLINES = {"IATA": "UA AA DL WN B6 AS NK F9 AC BA LH AF KL EK SQ NH JL QF".split(), "ICAO": "UAL AAL DAL SWA JBU ASA NKS FFT ACA BAW DLH AFR KLM UAE SIA ANA JAL QFA".split()}
_SHAPES = {"airport": {"IATA": "[A-Z]{3}", "ICAO": "[A-Z]{4}"}, "airline": {"IATA": "[0-9A-Z]{2}", "ICAO": "[A-Z]{3}"}}


def _code(what: str, known: dict[str, list[str]], system: str):
    def run(s: Column, args: dict) -> Column:
        u = F.upper(T.strip(s))
        return u.isin(known[system]) if flag(args, "known_only", False) else T.whole(u, _SHAPES[what][system])

    return run


def _either(what: str, known: dict[str, list[str]]):
    def run(s: Column, args: dict) -> Column:
        system = word(args, "system", "ANY").upper()
        if system in known:
            return _code(what, known, system)(s, args)
        return _code(what, known, "IATA")(s, args) | _code(what, known, "ICAO")(s, args) if system == "ANY" else F.lit(False)

    return run


for _what, _known in (("airport", AIRPORTS), ("airline", AIRLINES)):
    on_text(f"is_iata_{_what}_code")(_code(_what, _known, "IATA"))
    on_text(f"is_icao_{_what}_code")(_code(_what, _known, "ICAO"))
    on_text(f"is_{_what}_code")(_either(_what, _known))


@on_text("is_flight_number")
def is_flight_number(s: Column, args: dict) -> Column:
    u = F.regexp_replace(F.upper(T.strip(s)), r"[ \t\n\f\r]", "")
    form, known = word(args, "carrier_format", "ANY").upper(), flag(args, "known_carrier", False)
    number = "[0-9]{1,4}[A-Z]?" if flag(args, "allow_suffix", True) else "[0-9]{1,4}"

    def by(system: str) -> Column:
        carrier = "(?:" + "|".join(AIRLINES[system]) + ")" if known else _SHAPES["airline"][system]
        return T.whole(u, carrier + number)

    return by(form) if form in AIRLINES else by("IATA") | by("ICAO")
