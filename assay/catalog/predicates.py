"""One query for each named predicate."""

from __future__ import annotations

from pyspark.sql.types import DataType, StringType

from assay.functions.predicates import aviation, contact, financial, reference, tax
from assay.plans.registry import Registry
from assay.plans.values import from_typed

from .base import checked, column_query, either, full, luhn, nines, one_of, quoted, samples, shifted, weighted

_REGISTRY = Registry.default()


def predicate(name: str, value: str, result: str, args: dict | None = None, source: str = "customer", as_: str | None = None, kind: DataType | None = None) -> None:
    test = lambda c: _REGISTRY.evaluate(name, from_typed(c, kind or StringType()), args or {})
    column_query(f"pred_{(as_ or name).replace(':', '_').replace('-', '_')}", source, value, test, result)


def texts(*values: str | None) -> str:
    return shifted(samples(*values))


NINE = nines()
DASHED = f"concat(substr({NINE}, 1, 3), '-', substr({NINE}, 4, 2), '-', substr({NINE}, 6, 4))"
SSN = "substr(d,1,3) NOT IN ('000','666') AND substr(d,1,1) <> '9' AND substr(d,4,2) <> '00' AND substr(d,6,4) <> '0000' AND d <> repeat(substr(d,1,1), 9)"
STRICT = f"{full('x', '[0-9 -]*')} AND length(d) = 9"
EIN = f"substr(d,1,2) IN ({', '.join(map(quoted, tax.EIN_PREFIXES))})"
ITIN, ATIN = full("d", "9[0-9]{2}[78][0-9]{5}"), full("d", "9[0-9]{2}93[0-9]{4}")
IDS = texts("123-45-6789", "078-05-1120", "219099999", "000-12-3456", "666-12-3456", "987-65-4321", "111111111", "12-3456789", "912-70-1234", "912-93-1234", "x123456789", "", None, " 123 45 6789 ")
predicate("is_ssn", either(IDS, DASHED), checked(STRICT, SSN))
predicate("is_ein", either(IDS, f"concat(substr({NINE}, 1, 2), '-', substr({NINE}, 3, 7))"), checked(STRICT, EIN))
predicate("is_itin", either(IDS, f"concat('9', substr({NINE}, 2, 8))"), f"coalesce({ITIN}, false)")
predicate("is_atin", either(IDS, f"concat('9', substr({NINE}, 2, 2), '9', substr({NINE}, 5, 5))"), f"coalesce({ATIN}, false)")
predicate("is_tin", either(IDS, NINE), checked(STRICT, f"d <> '000000000' AND ({SSN} OR {EIN} OR {ITIN} OR {ATIN})"))
predicate("luhn", either(texts("4111 1111 1111 1111", "4111111111111112", "79927398713", "0", "", "abc", None), nines(10)), checked("length(d) > 0", luhn("d")))

CUSIP_VALUE = lambda k: f"CASE WHEN ascii(substr(u,{k},1)) < 58 THEN ascii(substr(u,{k},1)) - 48 ELSE ascii(substr(u,{k},1)) - 55 END"
CUSIP = " + ".join(f"(({CUSIP_VALUE(k)}) * {2 - k % 2} // 10 + ({CUSIP_VALUE(k)}) * {2 - k % 2} % 10)" for k in range(1, 9))
predicate("is_cusip", either(texts("037833100", "17275R102", "38259P508", "037833101", "03783310", " 17275r102 ", "", None), NINE), checked(full("u", "[0-9A-Z]{8}[0-9]"), f"(10 - ({CUSIP}) % 10) % 10 = cast(substr(u,9,1) AS INT)"))
predicate("is_aba_routing", either(texts("021000021", "011401533", "091000019", "123456789", "12345", "021-000-021", None), NINE), checked("length(d) = 9", f"(cast(substr(d,1,2) AS INT) BETWEEN 0 AND 12 OR cast(substr(d,1,2) AS INT) BETWEEN 21 AND 32 OR cast(substr(d,1,2) AS INT) BETWEEN 61 AND 72 OR substr(d,1,2) = '80') AND ({weighted('d', [3, 7, 1] * 3)}) % 10 = 0"))
predicate("is_mcc", either(texts("5411", " 5812 ", "54a1", "123", "", None), nines(4)), f"coalesce({full('t', '[0-9]{4}')}, false)")
predicate("is_account_number", either(texts("12345678", "AB-123", "with space", "", "x" * 31, None), NINE), f"coalesce({full('t', '[0-9A-Za-z-]{1,30}')}, false)")
CARDS = texts("4111 1111 1111 1111", "5555-5555-5555-4444", "378282246310005", "4111111111111112", "1234567890123456", "6011111111111117", "2221000000000009", "6500000000000002", "", None)
VISA = f"({full('d', '4[0-9]{15}')} OR {full('d', '3[47][0-9]{13}')} OR {full('d', '(6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12}')} OR (length(d) = 16 AND (cast(substr(d,1,2) AS INT) BETWEEN 51 AND 55 OR cast(substr(d,1,4) AS INT) BETWEEN 2221 AND 2720)))"
predicate("is_credit_card", either(CARDS, f"concat('4', {nines(15, 7919)})"), checked("length(d) > 0", f"{VISA} AND {luhn('d')}"))
predicate("is_cvv", either(texts("123", "1234", "12", " 999 ", "12a", "", None), nines(3)), f"coalesce({full('t', '[0-9]{3,4}')}, false)")
predicate("is_card_expiry", either(texts("01/25", "12/2030", "13/25", "1/25", "00/25", "05-25", "", None), "concat(lpad(cast(c_custkey % 15 as string), 2, '0'), '/', lpad(cast(c_custkey % 100 as string), 2, '0'))"), checked(full("t", "[0-9]{2}/([0-9]{2}|[0-9]{4})"), "cast(substr(t,1,2) AS INT) BETWEEN 1 AND 12"))
IBANS = texts("GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "FR7630006000011234567890189", "DE89370400440532013001", "DE123", "gb29nwbk60161331926819", "", None, "NL91ABNA0417164300")
IBAN_U = "upper(replace(x, ' ', ''))"
IBAN_NUMBER = f"list_reduce(list_prepend(0, list_transform(range(1, length({IBAN_U}) + 1), lambda i: ascii(substr(substr({IBAN_U}, 5) || substr({IBAN_U}, 1, 4), i, 1))::BIGINT)), lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END)"
LENGTHS = f"list_extract([{', '.join(financial.IBAN_LENGTHS.values())}], list_position([{', '.join(map(quoted, financial.IBAN_LENGTHS))}], substr({IBAN_U},1,2)))"
predicate("is_iban", either(IBANS, "concat('DE', lpad(cast(c_custkey % 98 as string), 2, '0'), '370400440532013000')"), checked(full(IBAN_U, "[A-Z]{2}[0-9]{2}[0-9A-Z]{1,30}"), f"coalesce({LENGTHS}, length({IBAN_U})) = length({IBAN_U}) AND {IBAN_NUMBER} = 1"))
BICS = texts("DEUTDEFF", "DEUTDEFF500", "deutdeff", "DEUTDEF", "1EUTDEFF", "", None, " NEDSZAJJXXX ")
for _n in ("is_bic", "is_swift"):
    predicate(_n, either(BICS, f"concat('ABCDEF', substr({NINE}, 1, 2))"), f"coalesce({full('u', '[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?')}, false)")
VIN_T = "translate(u, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789')"
VIN_LEFT = f"({weighted(VIN_T, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])}) % 11"
predicate("is_vin", either(texts("1HGCM82633A004352", "1M8GDM9AXKP042788", "11111111111111111", "1HGCM82633A004353", "IOQ00000000000000", "", None), f"concat('1HGCM826', cast(c_custkey % 10 as string), '3A', substr({NINE}, 4, 6))"), checked(full("u", "[A-HJ-NPR-Z0-9]{17}"), f"substr(u,9,1) = CASE WHEN {VIN_LEFT} = 10 THEN 'X' ELSE cast({VIN_LEFT} AS VARCHAR) END"))
BARE = "regexp_replace(x, '[\\s-]', '', 'g')"
predicate("is_upc", either(texts("036000291452", "0-36000-29145-2", "036000291453", "12345", "", None), nines(12)), checked(full(BARE, "[0-9]{12}"), f"({weighted(BARE, [3, 1] * 6)}) % 10 = 0"))
predicate("is_ean", either(texts("4006381333931", "4006381333932", "97801", "", None), nines(13)), checked(full(BARE, "[0-9]{13}"), f"({weighted(BARE, [1, 3] * 6 + [1])}) % 10 = 0"))
ISBN10 = checked(full(BARE, "[0-9]{9}[0-9Xx]"), f"({weighted(BARE, [10, 9, 8, 7, 6, 5, 4, 3, 2])} + CASE WHEN upper(substr({BARE},10,1)) = 'X' THEN 10 ELSE try_cast(substr({BARE},10,1) AS INT) END) % 11 = 0")
ISBN13 = checked(full(BARE, "97[89][0-9]{10}"), f"({weighted(BARE, [1, 3] * 6 + [1])}) % 10 = 0")
predicate("is_isbn", either(texts("0-306-40615-2", "0\t306406152", "080442957X", "978-3-16-148410-0", "9783161484101", "0306406153", "", None), nines(10)), f"({ISBN10} OR {ISBN13})")

# ---- dates and times
DAYS = texts("01/31/2024", "02-29-2024", "2023-02-29", "12312020", "2024-13-01", "1/2/2024", "04/31/2024", " 2024-06-30 ", "06/30-2024", "2000-02-29", "1900-02-29", "", None)
MADE = "concat(cast(2000 + c_custkey % 40 as string), '-', lpad(cast(c_custkey % 14 as string), 2, '0'), '-', lpad(cast(c_custkey % 33 as string), 2, '0'))"
YMD = "CASE WHEN regexp_full_match(t, '[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}') THEN substr(t,7,4) || '-' || substr(t,1,2) || '-' || substr(t,4,2) WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN t WHEN regexp_full_match(t, '[0-9]{8}') THEN substr(t,5,4) || '-' || substr(t,1,2) || '-' || substr(t,3,2) END"
DAY = f"try_cast({YMD} AS DATE)"
predicate("is_date", either(DAYS, MADE), f"{DAY} IS NOT NULL")
predicate("date_in_range", either(DAYS, MADE), f"coalesce({DAY} BETWEEN DATE '2005-03-01' AND DATE '2024-12-31' AND year({DAY}) >= 2006, false)", {"min": "2005-03-01", "max": "12/31/2024", "min_year": 2006})
predicate("date_before", either(DAYS, MADE), f"coalesce({DAY} < DATE '2024-02-29', false)", {"date": "2024-02-29", "allow_equal": False})
predicate("date_after", either(DAYS, MADE), f"coalesce({DAY} >= DATE '2024-02-29', false)", {"date": "2024-02-29"})
TIMES = texts("09:30", "23:59:59", "24:00", "9:30", "9:30 PM", "12:00 am", "13:00 PM", "0:15 AM", "12:60", " 08:05 ", "", None)
CLOCK = "concat(lpad(cast(c_custkey % 26 as string), 2, '0'), ':', lpad(cast(c_custkey % 62 as string), 2, '0'))"
H24 = full("t", "([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?")
H12 = full("t", "(?i)(0?[1-9]|1[0-2]):[0-5]?[0-9](:[0-5]?[0-9])? *[AP]M")
SECONDS = f"CASE WHEN {H24} THEN cast(substr(t,1,2) AS INT) * 3600 + cast(substr(t,4,2) AS INT) * 60 + CASE WHEN length(t) = 8 THEN cast(substr(t,7,2) AS INT) ELSE 0 END WHEN {H12} THEN (cast(split_part(t, ':', 1) AS INT) % 12 + CASE WHEN u LIKE '%PM' THEN 12 ELSE 0 END) * 3600 + cast(regexp_extract(t, ':([0-9]+)', 1) AS INT) * 60 END"
predicate("is_time", either(TIMES, CLOCK), f"coalesce({H24} OR {H12}, false)")
predicate("time_before", either(TIMES, CLOCK), f"coalesce({SECONDS} <= 43200, false)", {"time": "12:00"})
predicate("time_after", either(TIMES, CLOCK), f"coalesce({SECONDS} > 43200, false)", {"time": "12:00 PM", "allow_equal": False})
predicate("time_in_range", either(TIMES, CLOCK), f"coalesce({SECONDS} >= 79200 OR {SECONDS} <= 21600, false)", {"min": "22:00", "max": "6:00 AM"})
STAMPS = texts("2024-01-31T09:30:00Z", "2024-02-30T09:30:00Z", "2024-01-31T09:30", "2024-01-31 09:30", "2024-01-31T09:30:00.123+05:30", "2024-01-31T25:00:00Z", "2024-01-31T09:30:00-24:00", "2024-1-5T09:30Z", "2024-01-31T09:30:00.Z", "", None)
predicate("is_iso_datetime", either(STAMPS, f"concat({MADE}, 'T', {CLOCK}, 'Z')"), f"coalesce(regexp_full_match(t, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?([.][0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?') AND try_cast(split_part(t, 'T', 1) AS DATE) IS NOT NULL, false)")
predicate("is_tax_year", either(texts("2020", "2100", "2101", "2019", " 2024 ", "20x4", "", None), "cast(1990 + c_custkey % 130 as string)"), checked(full("t", "[0-9]{1,9}"), "cast(t AS BIGINT) BETWEEN 2020 AND 2100"))

# ---- amounts and numbers
MONEY = texts("$1,234.56", "-12.5", "(5)", "abc", "", "1.2.3", "0", "100%", "99.999", "1,000", "12.30", None, "-0", " 7.10 ")
AMOUNTS = either(MONEY, "concat(cast((c_custkey * 37) % 400 - 200 as string), '.', lpad(cast(c_custkey % 100 as string), 2, '0'))")
NUM = "try_cast(regexp_replace(x, '[^0-9.-]', '', 'g') AS DOUBLE)"
for _n, _op in (("is_non_negative", ">= 0"), ("is_positive", "> 0"), ("is_negative", "< 0"), ("is_non_positive", "<= 0")):
    predicate(_n, AMOUNTS, f"coalesce({NUM} {_op}, false)")
predicate("is_percentage", AMOUNTS, f"coalesce({NUM} BETWEEN 0 AND 100, false)")
KEPT = "regexp_replace(x, '[^0-9.-]', '', 'g')"
predicate("is_money_format", AMOUNTS, f"coalesce({NUM} IS NOT NULL AND CASE WHEN contains({KEPT}, '.') THEN length({KEPT}) - strpos({KEPT}, '.') ELSE 0 END <= 2, false)")
predicate("is_money_no_symbol", AMOUNTS, f"coalesce({full('t', '-?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]{1,2})?')}, false)")
predicate("is_multiple_of", AMOUNTS, f"coalesce(abs({NUM} / 2.5 - round({NUM} / 2.5)) < 1e-9, false)", {"value": 2.5})
predicate("less_than_or_equal", AMOUNTS, f"coalesce({NUM} <= 12.3, false)", {"value": 12.3})
predicate("greater_than_or_equal", AMOUNTS, f"coalesce({NUM} >= -12.5, false)", {"value": -12.5})
predicate("format:decimal-2", AMOUNTS, f"CASE WHEN x IS NULL OR t = '' THEN true WHEN contains(t, '.') THEN {full('t', '[+-]?[0-9]*[.][0-9]{2}')} ELSE {full('t', '[+-]?[0-9]{1,18}')} END")
predicate("is_decimal_places", AMOUNTS, f"coalesce({full('t', '-*[0-9]*[.][0-9]{2}')}, false)")
NUMBERS = texts("0", "255", "256", "-1", "127", "-128", "65535", "65536", "4294967295", "2147483648", "18446744073709551615", "18446744073709551616", "9223372036854775808", "1.0", "1.5", "1e3", "+7", "x", "", None, " 42 ", "inf", ".5", "-32768")
SIZES = either(NUMBERS, "cast((c_custkey * 104729) % 5000000000 - 2500000000 as string)")
WHOLE = f"CASE WHEN {full('t', '[+-]?[0-9]+')} THEN try_cast(t AS HUGEINT) WHEN {full('t', '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?')} AND try_cast(t AS DOUBLE) = floor(try_cast(t AS DOUBLE)) THEN try_cast(try_cast(t AS DOUBLE) AS HUGEINT) END"
for _s, _b in (("u", 8), ("u", 16), ("u", 32), ("u", 64), ("i", 8), ("i", 16), ("i", 32), ("i", 64)):
    _low, _high = (0, 2**_b - 1) if _s == "u" else (-(2 ** (_b - 1)), 2 ** (_b - 1) - 1)
    predicate(f"is_{_s}{_b}", SIZES, f"coalesce({WHOLE} BETWEEN {_low}::HUGEINT AND {_high}::HUGEINT, false)")
predicate("is_integer", SIZES, f"{WHOLE} IS NOT NULL")
predicate("is_float", SIZES, f"coalesce({full('t', '(?i)[+-]?(inf|infinity|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)')}, false)")

# ---- reference data
predicate("is_country_code", either(texts("US", "gb", " de ", "XX", "USA", "", None, "JP"), "concat(chr(cast(65 + c_custkey % 26 as int)), chr(cast(65 + (c_custkey * 7) % 26 as int)))"), one_of("u", reference.COUNTRY_CODES))
predicate("is_country_name", texts("United States", "CANADA", " japan ", "Atlantis", "", None, "Hong Kong"), one_of("lower(t)", [c.lower() for c in reference.COUNTRY_NAMES]))
predicate("is_state_name", texts("Ohio", "new york", " GUAM ", "Puerto Rico", "Bavaria", "", None), one_of("lower(t)", [c.lower() for c in [*reference.STATES.values(), *reference.TERRITORIES.values()]]))
predicate("is_us_state", either(texts("CA", "ny", " DC ", "ZZ", "AE", "", None), "concat(chr(cast(65 + c_custkey % 26 as int)), chr(cast(65 + (c_custkey * 11) % 26 as int)))"), one_of("u", [*reference.STATES, *reference.TERRITORIES, *reference.MILITARY]))
predicate("is_us_zip", either(texts("12345", "12345-6789", "00000", "1234", "zip 90210", "", None), nines(5, 31)), f"coalesce(length(d) IN (5, 9) AND NOT {full('d', '0+')}, false)")
predicate("is_currency_code", either(texts("USD", "eur", " JPY ", "XXX", "", None), "concat('A', chr(cast(65 + c_custkey % 26 as int)), 'D')"), one_of("u", reference.CURRENCIES))
predicate("is_w2_box12_code", texts("A", "dd", " W ", "I", "AAA", "", None), one_of("u", reference.W2_BOX12))
predicate("is_1099b_code", texts("A", "x", "1", "P", "Q", "", None), one_of("u", [c for v in reference.FORM_1099B.values() for c in v]))
predicate("is_filing_status", texts("S", "mfj", " HOH ", "6", "5", "", None), one_of("u", reference.FILING))

# ---- contact
PHONES = texts("(212) 555-1234", "+1 212 555 1234", "1-212-555-1234", "112-555-1234", "555-1234", "+44 20 7946 0958", "+12345", "212-155-1234", "", None, "12125551234567")
US = full("d", "1?[2-9][0-9]{2}[2-9][0-9]{6}")
for _n in ("phone_number", "is_phone"):
    predicate(_n, either(PHONES, nines(10)), f"coalesce(CASE WHEN starts_with(t, '+') THEN length(d) BETWEEN 7 AND 15 ELSE {US} END, false)")
predicate("phone_number_us", either(PHONES, nines(10)), f"coalesce(NOT starts_with(t, '+') AND {US}, false)")
MAILS = texts("ada@example.com", "user.name+tag@example.org", "a@b.co", "not-an-email", "@example.com", "bad@.com", "x@y.c", ".a@b.co", "a.@b.co", "a@b@c.de", " ok@ok.io ", "a@-b.com", "a@b.c0m", "", None, "joe@mailinator.com")
EMAIL = f"{full('t', '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]*[.][A-Za-z]{2,}')} AND NOT {full('split_part(t, quote, 1)', '[.].*|.*[.]')} AND NOT {full('split_part(t, quote, 2)', '[.-].*')}".replace("quote", "'@'")
predicate("is_email", either(MAILS, "concat(lower(c_mktsegment), '@', lower(c_mktsegment), '.com')"), f"coalesce({EMAIL}, false)")
predicate("is_email", MAILS, f"coalesce({EMAIL} AND NOT ({' OR '.join(f'lower(t) LIKE {quoted('%' + d)}' for d in contact.DISPOSABLE)}), false)", {"block_disposable": True}, as_="is_email_block_disposable")
predicate("is_url", "url", f"coalesce({full('t', '(?s)https?://[A-Za-z0-9.-]+(:[^/]*)?(/.*)?')}, false)", source="pages")
predicate("is_uuid", texts("550e8400-e29b-41d4-a716-446655440000", "550E8400-E29B-41D4-A716-446655440000", "550e8400e29b41d4a716446655440000", "550e8400-e29b-41d4-a716-44665544000g", "", None), f"coalesce({full('lower(t)', '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')}, false)")
IPS = texts("192.168.0.1", "256.1.1.1", "1.2.3", "01.2.3.4", "0.0.0.0", "255.255.255.255", "", None, " 8.8.8.8 ")
OCTETS = "CASE WHEN regexp_full_match({0}, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') THEN list_bool_and(list_transform(str_split({0}, '.'), lambda p: length(p) <= 3 AND cast(p AS BIGINT) <= 255 AND (length(p) = 1 OR substr(p, 1, 1) <> '0'))) ELSE false END"
predicate("is_ip", either(IPS, "concat('10.', cast(c_custkey % 300 as string), '.0.', cast(c_custkey % 7 as string))"), f"coalesce({OCTETS.format('t')}, false)", {"version": "v4"})
predicate("is_cidr", texts("10.0.0.0/8", "10.0.0.0/33", "10.0.0.0", "10.0.0/8", "300.0.0.0/8", "", None), f"coalesce({OCTETS.format('split_part(t, chr(47), 1)')} AND try_cast(nullif(split_part(t, '/', 2), '') AS INT) <= 32, false)", {"version": "v4"})
predicate("is_mac_address", texts("00:1A:2b:3C:4D:5E", "00-1A-2B-3C-4D-5E", "001A.2B3C.4D5E", "00:1A:2B:3C:4D", "00:1A-2B:3C:4D:5E", "", None), f"coalesce({full('t', '[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(-[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{4}([.][0-9A-Fa-f]{4}){2}')}, false)")
predicate("is_street_address", either(texts("123 Main St", "Main St 123", "1 A", "12345", "", None), "concat(cast(c_custkey as string), ' ', c_name)"), "coalesce(strlen(t) >= 5 AND regexp_matches(t, '^[0-9]') AND regexp_matches(t, '[A-Za-z]'), false)")

# ---- text shapes
RTL = "[֐-׿؀-ۿ܀-ݏݐ-ݿހ-޿߀-߿ࠀ-࠿ࡀ-࡟ࢠ-ࣿיִ-ﭏﭐ-﷿ﹰ-﻿]"
MIXED = texts("שלום", "hello", "abc שלום", "123", "", None, "مرحبا world")
predicate("is_rtl", either(MIXED, "c_name"), f"coalesce(regexp_matches(x, '{RTL}'), false)")
predicate("is_ltr", either(MIXED, "c_name"), f"coalesce(t <> '' AND NOT regexp_matches(x, '{RTL}'), false)")
predicate("starts_with", "c_name", "coalesce(starts_with(x, 'Customer#'), false)", {"value": "Customer#"})
predicate("ends_with", "c_name", "coalesce(ends_with(x, '7'), false)", {"value": "7"})
predicate("contains", "c_name", "coalesce(contains(x, '42'), false)", {"value": "42"})
SHAPES = either(texts("Hello", "hello world", "HELLO", "O'Brien-Smith", "abc123", "12 34", "   ", "é", "", None, "---", " trimmed "), "c_mktsegment")
for _n, _p in (("is_alpha", "[A-Za-z]+"), ("is_digits", "[0-9]+"), ("is_alphanumeric", "[A-Za-z0-9]+"), ("is_alpha_spaces", "[A-Za-z ]+"), ("is_alphanumeric_spaces", "[A-Za-z0-9 ]+"), ("is_uppercase", "[A-Z]+"), ("is_lowercase", "[a-z]+"), ("is_title_case", "[A-Z][a-z]+")):
    predicate(_n, SHAPES, f"coalesce({full('t', _p)}, false)")
predicate("is_name_chars", SHAPES, "coalesce(regexp_full_match(t, '[A-Za-z''-]+') AND regexp_matches(t, '[A-Za-z]'), false)")

# ---- aviation
LETTERS = lambda n: "concat(" + ", ".join(f"chr(cast(65 + (c_custkey * {p}) % 26 as int))" for p in (1, 3, 7, 11)[:n]) + ")"
predicate("is_iata_airport_code", either(texts("SFO", "lhr", "SF", "S1O", "", None), LETTERS(3)), f"coalesce({full('u', '[A-Z]{3}')}, false)")
predicate("is_icao_airport_code", either(texts("KSFO", "egll", "SFO", "", None), LETTERS(4)), one_of("u", aviation.AIRPORTS["ICAO"]), {"known_only": True})
predicate("is_airport_code", either(texts("SFO", "egll", "S", "ABCDE", "", None), LETTERS(4)), f"coalesce({full('u', '[A-Z]{3,4}')}, false)")
predicate("is_iata_airline_code", either(texts("UA", "b6", "UAL", "", None), LETTERS(2)), one_of("u", aviation.AIRLINES["IATA"]), {"known_only": True})
predicate("is_icao_airline_code", either(texts("UAL", "dlh", "UA", "", None), LETTERS(3)), f"coalesce({full('u', '[A-Z]{3}')}, false)")
predicate("is_airline_code", either(texts("UAL", "b6", "U", "", None), LETTERS(2)), f"coalesce({full('u', '[A-Z0-9]{2}|[A-Z]{3}')}, false)")
predicate("is_flight_number", either(texts("UA 123", "ual1234a", "UA", "UA12345", "U2 1", "UA123AB", "", None), f"concat({LETTERS(2)}, cast(c_custkey % 30000 as string))"), "coalesce(" + full("replace(u, ' ', '')", "([A-Z0-9]{2}|[A-Z]{3})[0-9]{1,4}[A-Z]?") + ", false)")

# ---- health
predicate("is_npi", either(texts("1234567893", "1234567890", "123-456-7893", "12345", "", None), nines(10)), checked(full(BARE, "[0-9]{10}"), luhn(f"('80840' || {BARE})")))
predicate("is_dea_number", either(texts("AB1234563", "ab1234563", "AB1234560", "NB1234563", "A11234563", "", None), f"concat('FX', substr({NINE}, 1, 7))"), checked(full("u", "[A-HJ-MPR-UX][A-Z][0-9]{7}"), f"({weighted('substr(u,3)', [1, 2, 1, 2, 1, 2])}) % 10 = cast(substr(u,9,1) AS INT)"))
predicate("is_icd10_code", either(texts("A00", "S72.001A", "s72001a", "A0", "A00.", "1A0", "", None), "concat('E', cast(c_custkey % 200 as string), '.', cast(c_custkey % 9 as string))"), f"coalesce({full('u', '[A-Z][0-9A-Z]{2}([.]?[0-9A-Z]{1,4})?')}, false)")
predicate("is_cpt_code", either(texts("99213", "0001F", "0042t", "1234X", "123", "", None), nines(5)), f"coalesce({full('u', '[0-9]{4}[0-9FT]')}, false)")
predicate("is_hcpcs_code", either(texts("J1885", "a0428", "W1234", "J188", "", None), "concat(chr(cast(65 + c_custkey % 26 as int)), lpad(cast(c_custkey % 10000 as string), 4, '0'))"), f"coalesce({full('u', '[A-V][0-9]{4}')}, false)")
predicate("is_ndc_code", either(texts("0002-1433-80", "50242-040-62", "60575-4112-1", "50242-0040-62", "123", "1234567890", "", None), nines(11)), f"coalesce(length(d) = 11 OR CASE WHEN length(t) - length(replace(t, '-', '')) = 2 THEN {full('t', '[0-9]{4}-[0-9]{4}-[0-9]{2}|[0-9]{5}-[0-9]{3}-[0-9]{2}|[0-9]{5}-[0-9]{4}-[0-9]')} ELSE length(d) = 10 END, false)")

# ---- colors, encodings, ledgers
predicate("is_hex_color", either(texts("#fff", "#FFAA00", "#ffff", "fff", "#12345678", "#ggg", "#12345", "", None), "concat('#', lpad(cast(c_custkey as string), 6, '0'))"), f"coalesce({full('t', '#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})')}, false)")
RGB = "regexp_full_match(t, 'rgba?[(] *[0-9]+ *, *[0-9]+ *, *[0-9]+ *(, *[0-9.]+ *)?[)]')"
CHANNELS = "list_transform(regexp_extract_all(t, '[0-9.]+'), lambda p: cast(p AS DOUBLE))"
predicate("is_rgb_color", either(texts("rgb(1,2,3)", "rgb(256,0,0)", "rgba(1, 2, 3, 0.5)", "rgba(1,2,3,1.5)", "rgb(1,2)", "hsl(1,2,3)", "", None), "concat('rgb(', cast(c_custkey % 300 as string), ',0,', cast(c_custkey % 256 as string), ')')"), checked(RGB, f"list_max({CHANNELS}[1:3]) <= 255 AND coalesce({CHANNELS}[4], 0) <= 1"))
HSL = "regexp_full_match(t, 'hsla?[(] *[0-9.]+(deg)? *, *[0-9.]+% *, *[0-9.]+% *(, *[0-9.]+ *)?[)]')"
predicate("is_hsl_color", either(texts("hsl(120,50%,50%)", "hsl(361,50%,50%)", "hsl(120,50,50)", "hsla(120deg, 50%, 50%, 0.3)", "hsl(120,101%,50%)", "", None), "concat('hsl(', cast(c_custkey % 400 as string), ',10%,', cast(c_custkey % 120 as string), '%)')"), checked(HSL, f"{CHANNELS}[1] <= 360 AND list_max({CHANNELS}[2:3]) <= 100 AND coalesce({CHANNELS}[4], 0) <= 1"))
B58 = "[1-9A-HJ-NP-Za-km-z]"
LEDGER = texts("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "0x52908400098527886E0F7030069857D2E4169EE7", "0x52908400098527886E0F7030069857D2E4169EEg", "4Nd1mBQtrMJVYVfKf2PJy9NZUZdTAsp7D4xWLs4gDB4T", "0OIl", "abc", "", None)
predicate("is_base58", LEDGER, f"coalesce({full('t', B58 + '+')}, false)")
predicate("is_solana_address", LEDGER, f"coalesce({full('t', B58 + '{32,44}')}, false)")
predicate("is_ethereum_address", LEDGER, f"coalesce({full('t', '0[xX][0-9A-Fa-f]{40}')}, false)")
predicate("is_bitcoin_address", LEDGER, f"coalesce({full('t', '[13]' + B58 + '{24,33}')} OR {full('lower(t)', 'bc1q[02-9ac-hj-np-z]{38}|bc1p[02-9ac-hj-np-z]{58}')}, false)")
predicate("is_base64", texts("aGVsbG8=", "aGVsbG8", "aGVsbG8==", "a+/=", "a-_b", "====", "", None), f"coalesce({full('t', '[0-9A-Za-z+/]*={0,2}')} AND t <> '' AND (NOT ends_with(t, '=') OR length(t) % 4 = 0), false)")
predicate("is_jwt", texts("aaa.bbb.ccc", "aaa.bbb", "a..c", "a.b.c.d", "a.b.c!", "", None), f"coalesce({full('t', '[0-9A-Za-z_-]+[.][0-9A-Za-z_-]+[.][0-9A-Za-z_-]+')}, false)")
predicate("is_hash", either("md5(c_name)", texts("d41d8cd98f00b204e9800998ecf8427e", "xyz", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "", None)), f"coalesce({full('t', '[0-9A-Fa-f]*')} AND length(t) IN (32, 40, 56, 64, 96, 128), false)")
