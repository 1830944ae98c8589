"""Country reference: ISO 3166-1 alpha-2 code, English name, official name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import COUNTRY_REFERENCE

# code|English name|official name.
COUNTRY_NAMES = """
AF|Afghanistan|Islamic Republic of Afghanistan
AL|Albania|Republic of Albania
DZ|Algeria|People's Democratic Republic of Algeria
AD|Andorra|Principality of Andorra
AO|Angola|Republic of Angola
AG|Antigua and Barbuda|Antigua and Barbuda
AR|Argentina|Argentine Republic
AM|Armenia|Republic of Armenia
AU|Australia|Commonwealth of Australia
AT|Austria|Republic of Austria
AZ|Azerbaijan|Republic of Azerbaijan
BS|Bahamas|Commonwealth of the Bahamas
BH|Bahrain|Kingdom of Bahrain
BD|Bangladesh|People's Republic of Bangladesh
BB|Barbados|Barbados
BY|Belarus|Republic of Belarus
BE|Belgium|Kingdom of Belgium
BZ|Belize|Belize
BJ|Benin|Republic of Benin
BT|Bhutan|Kingdom of Bhutan
BO|Bolivia|Plurinational State of Bolivia
BA|Bosnia and Herzegovina|Bosnia and Herzegovina
BW|Botswana|Republic of Botswana
BR|Brazil|Federative Republic of Brazil
BN|Brunei|Brunei Darussalam
BG|Bulgaria|Republic of Bulgaria
BF|Burkina Faso|Burkina Faso
BI|Burundi|Republic of Burundi
KH|Cambodia|Kingdom of Cambodia
CM|Cameroon|Republic of Cameroon
CA|Canada|Canada
CV|Cape Verde|Republic of Cabo Verde
CF|Central African Republic|Central African Republic
TD|Chad|Republic of Chad
CL|Chile|Republic of Chile
CN|China|People's Republic of China
CO|Colombia|Republic of Colombia
KM|Comoros|Union of the Comoros
CG|Congo|Republic of the Congo
CD|Democratic Republic of the Congo|Democratic Republic of the Congo
CR|Costa Rica|Republic of Costa Rica
CI|Ivory Coast|Republic of Côte d'Ivoire
HR|Croatia|Republic of Croatia
CU|Cuba|Republic of Cuba
CY|Cyprus|Republic of Cyprus
CZ|Czech Republic|Czech Republic
DK|Denmark|Kingdom of Denmark
DJ|Djibouti|Republic of Djibouti
DM|Dominica|Commonwealth of Dominica
DO|Dominican Republic|Dominican Republic
EC|Ecuador|Republic of Ecuador
EG|Egypt|Arab Republic of Egypt
SV|El Salvador|Republic of El Salvador
GQ|Equatorial Guinea|Republic of Equatorial Guinea
ER|Eritrea|State of Eritrea
EE|Estonia|Republic of Estonia
ET|Ethiopia|Federal Democratic Republic of Ethiopia
FJ|Fiji|Republic of Fiji
FI|Finland|Republic of Finland
FR|France|French Republic
GA|Gabon|Gabonese Republic
GM|Gambia|Republic of the Gambia
GE|Georgia|Georgia
DE|Germany|Federal Republic of Germany
GH|Ghana|Republic of Ghana
GR|Greece|Hellenic Republic
GD|Grenada|Grenada
GT|Guatemala|Republic of Guatemala
GN|Guinea|Republic of Guinea
GW|Guinea-Bissau|Republic of Guinea-Bissau
GY|Guyana|Co-operative Republic of Guyana
HT|Haiti|Republic of Haiti
HN|Honduras|Republic of Honduras
HU|Hungary|Hungary
IS|Iceland|Republic of Iceland
IN|India|Republic of India
ID|Indonesia|Republic of Indonesia
IR|Iran|Islamic Republic of Iran
IQ|Iraq|Republic of Iraq
IE|Ireland|Ireland
IL|Israel|State of Israel
IT|Italy|Italian Republic
JM|Jamaica|Jamaica
JP|Japan|Japan
JO|Jordan|Hashemite Kingdom of Jordan
KZ|Kazakhstan|Republic of Kazakhstan
KE|Kenya|Republic of Kenya
KI|Kiribati|Republic of Kiribati
KP|North Korea|Democratic People's Republic of Korea
KR|South Korea|Republic of Korea
KW|Kuwait|State of Kuwait
KG|Kyrgyzstan|Kyrgyz Republic
LA|Laos|Lao People's Democratic Republic
LV|Latvia|Republic of Latvia
LB|Lebanon|Lebanese Republic
LS|Lesotho|Kingdom of Lesotho
LR|Liberia|Republic of Liberia
LY|Libya|State of Libya
LI|Liechtenstein|Principality of Liechtenstein
LT|Lithuania|Republic of Lithuania
LU|Luxembourg|Grand Duchy of Luxembourg
MK|North Macedonia|Republic of North Macedonia
MG|Madagascar|Republic of Madagascar
MW|Malawi|Republic of Malawi
MY|Malaysia|Malaysia
MV|Maldives|Republic of Maldives
ML|Mali|Republic of Mali
MT|Malta|Republic of Malta
MH|Marshall Islands|Republic of the Marshall Islands
MR|Mauritania|Islamic Republic of Mauritania
MU|Mauritius|Republic of Mauritius
MX|Mexico|United Mexican States
FM|Micronesia|Federated States of Micronesia
MD|Moldova|Republic of Moldova
MC|Monaco|Principality of Monaco
MN|Mongolia|Mongolia
ME|Montenegro|Montenegro
MA|Morocco|Kingdom of Morocco
MZ|Mozambique|Republic of Mozambique
MM|Myanmar|Republic of the Union of Myanmar
NA|Namibia|Republic of Namibia
NR|Nauru|Republic of Nauru
NP|Nepal|Federal Democratic Republic of Nepal
NL|Netherlands|Kingdom of the Netherlands
NZ|New Zealand|New Zealand
NI|Nicaragua|Republic of Nicaragua
NE|Niger|Republic of Niger
NG|Nigeria|Federal Republic of Nigeria
NO|Norway|Kingdom of Norway
OM|Oman|Sultanate of Oman
PK|Pakistan|Islamic Republic of Pakistan
PW|Palau|Republic of Palau
PS|Palestine|State of Palestine
PA|Panama|Republic of Panama
PG|Papua New Guinea|Independent State of Papua New Guinea
PY|Paraguay|Republic of Paraguay
PE|Peru|Republic of Peru
PH|Philippines|Republic of the Philippines
PL|Poland|Republic of Poland
PT|Portugal|Portuguese Republic
QA|Qatar|State of Qatar
RO|Romania|Romania
RU|Russia|Russian Federation
RW|Rwanda|Republic of Rwanda
KN|Saint Kitts and Nevis|Saint Kitts and Nevis
LC|Saint Lucia|Saint Lucia
VC|Saint Vincent and the Grenadines|Saint Vincent and the Grenadines
WS|Samoa|Independent State of Samoa
SM|San Marino|Republic of San Marino
ST|Sao Tome and Principe|Democratic Republic of São Tomé and Príncipe
SA|Saudi Arabia|Kingdom of Saudi Arabia
SN|Senegal|Republic of Senegal
RS|Serbia|Republic of Serbia
SC|Seychelles|Republic of Seychelles
SL|Sierra Leone|Republic of Sierra Leone
SG|Singapore|Republic of Singapore
SK|Slovakia|Slovak Republic
SI|Slovenia|Republic of Slovenia
SB|Solomon Islands|Solomon Islands
SO|Somalia|Federal Republic of Somalia
ZA|South Africa|Republic of South Africa
SS|South Sudan|Republic of South Sudan
ES|Spain|Kingdom of Spain
LK|Sri Lanka|Democratic Socialist Republic of Sri Lanka
SD|Sudan|Republic of the Sudan
SR|Suriname|Republic of Suriname
SZ|Eswatini|Kingdom of Eswatini
SE|Sweden|Kingdom of Sweden
CH|Switzerland|Swiss Confederation
SY|Syria|Syrian Arab Republic
TW|Taiwan|Taiwan
TJ|Tajikistan|Republic of Tajikistan
TZ|Tanzania|United Republic of Tanzania
TH|Thailand|Kingdom of Thailand
TL|Timor-Leste|Democratic Republic of Timor-Leste
TG|Togo|Togolese Republic
TO|Tonga|Kingdom of Tonga
TT|Trinidad and Tobago|Republic of Trinidad and Tobago
TN|Tunisia|Republic of Tunisia
TR|Turkey|Republic of Turkey
TM|Turkmenistan|Turkmenistan
TV|Tuvalu|Tuvalu
UG|Uganda|Republic of Uganda
UA|Ukraine|Ukraine
AE|United Arab Emirates|United Arab Emirates
GB|United Kingdom|United Kingdom of Great Britain and Northern Ireland
US|United States|United States of America
UY|Uruguay|Oriental Republic of Uruguay
UZ|Uzbekistan|Republic of Uzbekistan
VU|Vanuatu|Republic of Vanuatu
VA|Vatican City|Vatican City State
VE|Venezuela|Bolivarian Republic of Venezuela
VN|Vietnam|Socialist Republic of Vietnam
YE|Yemen|Republic of Yemen
ZM|Zambia|Republic of Zambia
ZW|Zimbabwe|Republic of Zimbabwe
XK|Kosovo|Republic of Kosovo
AQ|Antarctica|Antarctica
"""


def country_reference(spark: SparkSession) -> DataFrame:
    """The country reference as a DataFrame of 198 rows."""
    rows = [tuple(line.split("|")) for line in COUNTRY_NAMES.strip().splitlines()]
    return spark.createDataFrame(rows, COUNTRY_REFERENCE)
