"""Membership in reference lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import text as T

from .base import flag, on_text, word

# The lists that membership is decided by.
COUNTRY_NAMES = "United States,Canada,Mexico,United Kingdom,Germany,France,Italy,Spain,Japan,China,India,Australia,Brazil,South Korea,Russia,Netherlands,Switzerland,Ireland,Singapore,Hong Kong".split(",")
STATES = dict(
    x.split(":")
    for x in """AL:Alabama,AK:Alaska,AZ:Arizona,AR:Arkansas,CA:California,CO:Colorado,CT:Connecticut,DE:Delaware,DC:District of Columbia,FL:Florida,GA:Georgia,HI:Hawaii,ID:Idaho,IL:Illinois,IN:Indiana,IA:Iowa,KS:Kansas,KY:Kentucky,LA:Louisiana,ME:Maine,MD:Maryland,MA:Massachusetts,MI:Michigan,MN:Minnesota,MS:Mississippi,MO:Missouri,MT:Montana,NE:Nebraska,NV:Nevada,NH:New Hampshire,NJ:New Jersey,NM:New Mexico,NY:New York,NC:North Carolina,ND:North Dakota,OH:Ohio,OK:Oklahoma,OR:Oregon,PA:Pennsylvania,RI:Rhode Island,SC:South Carolina,SD:South Dakota,TN:Tennessee,TX:Texas,UT:Utah,VT:Vermont,VA:Virginia,WA:Washington,WV:West Virginia,WI:Wisconsin,WY:Wyoming""".split(",")
)
TERRITORIES = dict(x.split(":") for x in "AS:American Samoa,GU:Guam,MP:Northern Mariana Islands,PR:Puerto Rico,VI:U.S. Virgin Islands,UM:United States Minor Outlying Islands".split(","))
MILITARY = "AA AE AP".split()
COUNTRY_CODES = """AD AE AF AL AM AO AR AT AU AZ BA BB BD BE BF BG BH BI BJ BM BN BO BR BS BT BW BY BZ CA CD CF CG CH CI CL CM CN CO CR CU CV CY CZ DE DJ DK DO DZ EC EE EG ER ES ET FI FJ
FR GA GB GE GG GH GI GM GN GQ GR GT GW GY HK HN HR HT HU ID IE IL IM IN IQ IR IS IT JE JM JO JP KE KG KH KP KR KW KY KZ LA LB LI LR LS LT LU LV LY MA MC MD ME MG MK ML MM MN MR MT MU MV MW MX MY MZ
NA NE NG NI NL NO NP NZ OM PA PE PH PK PL PR PT QA RO RS RU RW SA SD SE SG SI SK SL SO SR SS SV SY SZ TD TG TH TJ TM TN TO TR TT TW TZ UA UG US UY UZ VE VG VI VN VU YE ZA ZM ZW""".split()
CURRENCIES = """USD EUR GBP JPY CNY CAD AUD CHF HKD SGD SEK NOK DKK NZD MXN BRL INR RUB ZAR KRW TWD THB MYR IDR PHP VND AED SAR ILS TRY PLN CZK HUF RON BGN HRK ISK CLP COP PEN ARS EGP
NGN KES PKR BDT""".split()
W2_BOX12 = "A B C D E F G H J K L M N P Q R S T V W Y Z AA BB DD EE FF GG HH".split()
FORM_1099B = {"term": "A B C D E F X".split(), "basis": "1 2 3".split(), "type": "P S C O W".split()}
FILING = "S MFJ MFS HOH QW 1 2 3 4 5".split()


def _upper_in(s: Column, codes: list[str]) -> Column:
    return F.upper(T.strip(s)).isin(codes)


def _lower_in(s: Column, names: list[str]) -> Column:
    return F.lower(T.strip(s)).isin([n.lower() for n in names])


on_text("is_country_code")(lambda s, a: _upper_in(s, [c for c in COUNTRY_CODES if not (c == "US" and flag(a, "exclude_us", False))]))
on_text("is_country_name")(lambda s, a: _lower_in(s, COUNTRY_NAMES))
on_text("is_state_name")(lambda s, a: _lower_in(s, [*STATES.values(), *(TERRITORIES.values() if flag(a, "include_territories", True) else ())]))
on_text("is_us_state")(lambda s, a: _upper_in(s, [*STATES, *TERRITORIES, *MILITARY]))
on_text("is_us_zip")(lambda s, a: T.whole(T.digits(s), "(?:[0-9]{5}|[0-9]{9})") & ~T.whole(T.digits(s), "0+"))
on_text("is_currency_code")(lambda s, a: _upper_in(s, CURRENCIES))
on_text("is_w2_box12_code")(lambda s, a: _upper_in(s, W2_BOX12))
on_text("is_1099b_code")(lambda s, a: _upper_in(s, FORM_1099B.get(word(a, "type")) or [c for codes in FORM_1099B.values() for c in codes]))
on_text("is_filing_status")(lambda s, a: _upper_in(s, FILING))
