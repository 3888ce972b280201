"""The tables that scoring reads, as text, one row a line."""

from __future__ import annotations

# Watched brands
# id | display | category | tokens | max_edit_distance | require_context | allow_affix | context_tokens | known_tlds
BRANDS = """\
dbs|DBS Bank|bank|dbs|1|true|true|bank banking ibanking digibank login secure verify account sg posb paylah|com.sg com sg
posb|POSB|bank|posb|1|false|true|bank login secure account sg dbs|com.sg
ocbc|OCBC Bank|bank|ocbc|1|false|true|bank banking velocity login secure verify account sg|com com.sg
uob|UOB|bank|uob|0|true|true|bank banking tmrw mighty login secure verify account sg group|com.sg com
stanchart|Standard Chartered|bank|stanchart standardchartered sc|2|true|true|bank banking login secure account verify token update claim wallet sg|com com.sg
maybank|Maybank Singapore|bank|maybank maybank2u|2|false|true|bank login secure account sg|com.sg com
hsbc|HSBC Singapore|bank|hsbc|1|false|true|bank banking login secure account sg|com.sg com
citibank|Citibank Singapore|bank|citibank|2|false|true|bank login secure account sg|com.sg com
trustbank|Trust Bank|bank|trust trustbank|0|true|false|bank banking card login secure account sg|sg com.sg
gxs|GXS Bank|bank|gxs|0|true|true|bank banking login secure account sg|com.sg sg
maribank|MariBank|bank|maribank|2|false|true|bank login secure account sg|sg com.sg
cimb|CIMB Singapore|bank|cimb|1|false|true|bank banking clicks login secure account sg|com.sg com
singpass|Singpass|government|singpass|2|false|true|login verify account reset app gov sg face|gov.sg
myinfo|Myinfo|government|myinfo|1|false|true|singpass login verify consent gov sg|gov.sg
govsg|gov.sg (government domain itself)|government|gov govsg|0|true|false|sg singapore singpass official portal service login notice|sg
gogovsg|go.gov.sg (official link shortener)|government|gogovsg gogov|1|false|true|gov sg link short official|gov.sg
iras|IRAS|government|iras|0|true|true|tax mytax gst refund filing assessment login singpass gov sg|gov.sg
cpf|CPF Board|government|cpf|0|true|true|board login singpass withdraw nomination retirement account gov sg|gov.sg
ica|ICA|government|ica|0|true|false|immigration checkpoint passport visa arrival card pass gov sg|gov.sg
hdb|HDB|government|hdb|0|true|true|flat bto resale housing login singpass gov sg|gov.sg
mom|Ministry of Manpower|government|mom|0|true|false|manpower workpass epass employment foreigner levy gov sg|gov.sg
lta|LTA|government|lta|0|true|false|transport vehicle road erp licence license coe gov sg|gov.sg
onemotoring|OneMotoring|government|onemotoring|2|false|true|vehicle road tax coe login gov sg|gov.sg
healthhub|HealthHub|government|healthhub|2|false|true|health login singpass record appointment gov sg|sg gov.sg
paynow|PayNow|payments|paynow|1|false|true|pay transfer qr bank sg account|sg com.sg
paylah|DBS PayLah!|payments|paylah|1|false|true|dbs pay transfer wallet login sg|com.sg
nets|NETS|payments|nets|0|true|false|pay payment click qr flashpay terminal card sg|com.sg
youtrip|YouTrip|payments|youtrip|2|false|true|card wallet topup login sg|sg com
grabpay|GrabPay|payments|grabpay|2|false|true|grab wallet topup login sg|com
wise|Wise|payments|wise|0|true|false|transfer money borderless account login remit sg|com
singtel|Singtel|telco|singtel|2|false|true|mobile bill account login dash sg broadband|com com.sg
starhub|StarHub|telco|starhub|2|false|true|mobile bill account login sg broadband tv|com
m1|M1|telco|m1|0|true|false|mobile telco sim bill postpaid account sg|com.sg
simba|Simba Telecom|telco|simba|0|true|true|mobile telco sim bill account sg|sg com.sg
myrepublic|MyRepublic|telco|myrepublic|2|false|true|mobile broadband bill account login sg|com.sg net
singpost|SingPost|logistics|singpost|2|false|true|track tracking parcel delivery redelivery customs fee sg|com.sg
ninjavan|Ninja Van|logistics|ninjavan|2|false|true|track tracking parcel delivery redelivery sg|co com.sg
jnt|J&T Express|logistics|jntexpress jnt|0|true|true|express track tracking parcel delivery sg|com.sg sg
shopeexpress|Shopee Xpress|logistics|shopeexpress spx|1|true|true|shopee track tracking parcel delivery sg|sg com
lalamove|Lalamove|logistics|lalamove|2|false|true|delivery driver track booking sg|com
qxpress|Qxpress|logistics|qxpress|1|false|true|track tracking parcel delivery qoo10 sg|com sg
shopee|Shopee|commerce|shopee|2|false|true|login order seller refund voucher wallet sg|sg com
lazada|Lazada|commerce|lazada|2|false|true|login order seller refund voucher wallet sg|sg com
carousell|Carousell|commerce|carousell|2|false|true|login listing seller buyer deal sg|sg com
qoo10|Qoo10|commerce|qoo10|1|false|true|login order seller refund voucher sg|sg com
fairprice|NTUC FairPrice|commerce|fairprice|2|false|true|ntuc login voucher linkpoints order sg|com.sg
redmart|RedMart|commerce|redmart|2|false|true|lazada order delivery login sg|sg com
grab|Grab|commerce|grab|0|true|true|pay food taxi ride driver merchant mart account login sg|com
qoo10sg|Qoo10 SG (alias)|commerce|qoo10sg|1|false|false|login order sg|sg
singaporeair|Singapore Airlines|transport|singaporeair krisflyer|2|false|true|flight booking ticket miles login checkin sg|com com.sg
scoot|Scoot|transport|scoot flyscoot|0|true|true|fly flight booking ticket air checkin sg|com
simplygo|SimplyGo|transport|simplygo|2|false|true|transit card ezlink topup login fare sg|com.sg
comfortdelgro|ComfortDelGro|transport|comfortdelgro cdgtaxi|2|false|true|taxi booking driver fare login sg|com com.sg
smrt|SMRT|transport|smrt|0|true|true|train transit mrt fare card sg|com.sg
changi|Changi Airport|transport|changi changiairport|2|false|true|airport flight shop rewards login sg|com com.sg
spgroup|SP Group|utilities|spgroup|1|false|true|utilities bill power energy meter login account sg|com.sg
cityenergy|City Energy|utilities|cityenergy|2|false|true|gas bill utilities account login sg|com.sg
greateastern|Great Eastern|insurance|greateastern|2|false|true|insurance policy claim login life sg|com com.sg
income|NTUC Income|insurance|income|0|true|false|ntuc insurance policy claim login sg|com.sg
aia|AIA Singapore|insurance|aia|0|true|false|insurance policy claim login sg vitality|com.sg com
prudential|Prudential Singapore|insurance|prudential pruadviser|2|false|true|insurance policy claim login sg|com.sg com
nus|National University of Singapore|university|nus|0|true|false|login portal canvas luminus student staff email edu sg|edu.sg
ntu|Nanyang Technological University|university|ntu|0|true|false|login portal ntulearn student staff email edu sg|edu.sg
smu|Singapore Management University|university|smu|0|true|false|login portal elearn student staff email edu sg|edu.sg
sutd|Singapore University of Technology and Design|university|sutd|0|true|false|login portal mysutd student staff edu sg|edu.sg
sit|Singapore Institute of Technology|university|singaporetech|2|false|true|login portal student staff edu sg|edu.sg
suss|Singapore University of Social Sciences|university|suss|0|true|false|login portal canvas student staff edu sg|edu.sg
singhealth|SingHealth|healthcare|singhealth|2|false|true|health clinic hospital appointment login sg|com.sg
nuhs|NUHS|healthcare|nuhs|0|true|true|health clinic hospital appointment login edu sg|edu.sg com.sg
nhg|National Healthcare Group|healthcare|nhg|0|true|true|health clinic polyclinic hospital appointment login sg|com.sg
forsg|for.sg / for.edu.sg (healthcare & education shorteners)|healthcare|forsg|0|true|false|health gov official link sg|sg edu.sg
mediacorp|Mediacorp|media|mediacorp meweb|2|false|true|login account news watch sg|sg com.sg
straitstimes|The Straits Times|media|straitstimes|2|false|true|news login subscribe account sg|com
"""

# Suspicious keywords
# token | category | affix
KEYWORDS = """\
login|credential|true
signin|credential|true
logon|credential|true
auth|credential|true
sso|credential|false
portal|credential|true
account|credential|true
password|credential|true
reset|credential|true
unlock|credential|true
recovery|credential|true
verify|verification|true
verification|verification|true
confirm|verification|true
validate|verification|true
update|verification|true
secure|verification|true
security|verification|true
otp|verification|true
2fa|verification|false
token|verification|false
bank|finance|true
banking|finance|true
ibanking|finance|true
netbanking|finance|true
ebanking|finance|true
payment|finance|true
wallet|finance|true
transfer|finance|true
refund|finance|true
billing|finance|true
parcel|delivery|true
delivery|delivery|true
redelivery|delivery|true
tracking|delivery|true
shipment|delivery|true
customs|delivery|true
courier|delivery|true
suspend|urgency|true
suspended|urgency|true
expired|urgency|true
blocked|urgency|true
alert|urgency|false
urgent|urgency|true
notice|urgency|false
official|impersonation|true
support|impersonation|true
helpdesk|impersonation|true
service|impersonation|false
customer|impersonation|true
"""

# Seasonal lures
# id | display | tokens | max_edit_distance | official_registrable | window start | window end
SCHEMES = """\
cdc_vouchers|CDC Vouchers|cdcvoucher cdcvouchers|1|cdc.gov.sg||
gst_voucher|GST Voucher|gstvoucher gstvouchers|1|gov.sg||
assurance_package|Assurance Package|assurancepackage|2|gov.sg||
majulah_package|Majulah Package|majulahpackage|2|gov.sg||
climate_vouchers|Climate Vouchers|climatevoucher climatevouchers|1|gov.sg||
skillsfuture|SkillsFuture|skillsfuture|2|skillsfuture.gov.sg||
workfare|Workfare|workfare|1|workfare.gov.sg||
silver_support|Silver Support Scheme|silversupport|2|cpf.gov.sg||
baby_bonus|Baby Bonus|babybonus|1|gov.sg||
edusave|Edusave|edusave|1|moe.gov.sg||
comcare|ComCare|comcare|1|msf.gov.sg||
"""

# Verified registrable domains
# registrable | brand | verified
ALLOWLIST = """\
dbs.com|dbs|true
dbs.com.sg|dbs|true
posb.com.sg|posb|true
ocbc.com|ocbc|true
ocbc.com.sg|ocbc|true
uob.com.sg|uob|true
uobgroup.com|uob|true
sc.com|stanchart|true
maybank.com.sg|maybank|true
maybank2u.com.sg|maybank|true
hsbc.com.sg|hsbc|true
citibank.com.sg|citibank|true
trustbank.sg|trustbank|true
gxs.com.sg|gxs|true
maribank.sg|maribank|true
cimb.com.sg|cimb|true
singpass.gov.sg|singpass|true
myinfo.gov.sg|myinfo|true
go.gov.sg|gogovsg|true
for.sg|forsg|true
for.edu.sg|forsg|true
iras.gov.sg|iras|true
cpf.gov.sg|cpf|true
ica.gov.sg|ica|true
hdb.gov.sg|hdb|true
mom.gov.sg|mom|true
lta.gov.sg|lta|true
healthhub.sg|healthhub|true
nets.com.sg|nets|true
grab.com|grab|true
singtel.com|singtel|true
singtel.com.sg|singtel|true
starhub.com|starhub|true
m1.com.sg|m1|true
myrepublic.com.sg|myrepublic|true
singpost.com.sg|singpost|true
ninjavan.co|ninjavan|true
lalamove.com|lalamove|true
shopee.sg|shopee|true
lazada.sg|lazada|true
carousell.sg|carousell|true
carousell.com|carousell|true
fairprice.com.sg|fairprice|true
singaporeair.com|singaporeair|true
flyscoot.com|scoot|true
simplygo.com.sg|simplygo|true
comfortdelgro.com|comfortdelgro|true
cdgtaxi.com.sg|comfortdelgro|true
smrt.com.sg|smrt|true
changiairport.com|changi|true
spgroup.com.sg|spgroup|true
cityenergy.com.sg|cityenergy|true
greateasternlife.com|greateastern|true
income.com.sg|income|true
aia.com.sg|aia|true
prudential.com.sg|prudential|true
nus.edu.sg|nus|true
ntu.edu.sg|ntu|true
smu.edu.sg|smu|true
sutd.edu.sg|sutd|true
singaporetech.edu.sg|sit|true
suss.edu.sg|suss|true
singhealth.com.sg|singhealth|true
nuhs.edu.sg|nuhs|true
nhg.com.sg|nhg|true
mediacorp.sg|mediacorp|true
straitstimes.com|straitstimes|true
"""

# Scoring version, severity thresholds, weights that scoring reads, cap
VERSION = 2
MEDIUM, HIGH, CRITICAL = 30, 50, 70
WEIGHTS = {
    "brand:exact": 35,
    "brand:fuzzy": 25,
    "subdomain:brand_squat": 40,
    "brand_in_path_position": 15,
    "tld:mismatch": 15,
    "kw": 10,
    "keyword_cap": 25,
    "combo_brand_keyword": 25,
    "combo_scheme_keyword": 25,
    "scheme": 45,
    "scheme_seasonal_boost": 15,
}
TOTAL_CAP = 150

# Public suffixes, a curated part of the public list (rules of one label need no row)
SUFFIXES = """\
com.sg net.sg org.sg gov.sg edu.sg per.sg
com.my net.my org.my gov.my edu.my
com.hk net.hk org.hk gov.hk edu.hk idv.hk
com.cn net.cn org.cn gov.cn edu.cn ac.cn
com.tw net.tw org.tw gov.tw edu.tw
co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk
com.au net.au org.au edu.au gov.au id.au
co.nz net.nz org.nz ac.nz govt.nz
co.jp ne.jp or.jp ac.jp go.jp ad.jp ed.jp gr.jp lg.jp
co.kr or.kr ac.kr go.kr ne.kr re.kr
co.in net.in org.in ac.in gov.in edu.in
co.id or.id ac.id go.id net.id web.id
co.th or.th ac.th go.th in.th net.th
com.ph net.ph org.ph gov.ph edu.ph
com.vn net.vn org.vn gov.vn edu.vn
com.br net.br org.br gov.br edu.br
co.za org.za ac.za gov.za net.za
com.mx org.mx gob.mx edu.mx
*.ck !www.ck *.kawasaki.jp !city.kawasaki.jp
"""

# Hand-made hosts of the labelled corpus: domain|brand|category. Malicious ones in
# forms that are hard to catch, and benign ones that look like malicious ones.
ADVERSARIAL = """
xn--dbs-9ka.com|dbs|homoglyph
xn--psb-tma.com.sg|posb|homoglyph
xn--0cbc-1ra.com|ocbc|homoglyph
xn--ub-1ia.com.sg|uob|homoglyph
xn--sngpass-wxa.com|singpass|homoglyph
xn--cp-gpa.com|cpf|homoglyph
xn--ras-tma.com|iras|homoglyph
xn--trstbank-p1a.com|trustbank|homoglyph
xn--maribank-r8a.sg|maribank|homoglyph
xn--sngpst-0wa8c.com.sg|singpost|homoglyph
dаs.com|dbs|homoglyph
oсbc.com|ocbc|homoglyph
singpаss.com|singpass|homoglyph
pоsb.com|posb|homoglyph
uоb.com.sg|uob|homoglyph
cрf.gov.sg.phish.xyz|cpf|homoglyph
irаs-portal.top|iras|homoglyph
grаbpay.xyz|grab|homoglyph
shopее.com|shopee|homoglyph
singpоst.com|singpost|homoglyph
dbsbanl.com|dbs|homoglyph
0cbc.com|ocbc|homoglyph
singpa55.com|singpass|homoglyph
u0b.com.sg|uob|homoglyph
p0sb.com|posb|homoglyph
cpff-online.com|cpf|homoglyph
1ras-tax.com|iras|homoglyph
trus1bank.com|trustbank|homoglyph
rnaybank.com|maybank|homoglyph
s1ngpost.com|singpost|homoglyph
dbs.com.sg.account-update.top|dbs|subdomain_squat
ocbc.com.portal-security.xyz|ocbc|subdomain_squat
uob.com.sg.token-auth.icu|uob|subdomain_squat
posb.com.sg.verify-device.cfd|posb|subdomain_squat
singpass.gov.sg.auth.sbs|singpass|subdomain_squat
cpf.gov.sg.payout-claim.rest|cpf|subdomain_squat
iras.gov.sg.tax-rebate.cyou|iras|subdomain_squat
trustbank.sg.activate.bond|trustbank|subdomain_squat
maribank.sg.login.click|maribank|subdomain_squat
singpost.com.track.link|singpost|subdomain_squat
dbsbanklogin.xyz|dbs|typosquat
ocbcloginportal.top|ocbc|typosquat
singpassverifyonline.icu|singpass|typosquat
posbsecuresg.cfd|posb|typosquat
uobonlinetoken.sbs|uob|typosquat
cpfportallogin.rest|cpf|typosquat
irasrefundclaim.cyou|iras|typosquat
trustbankloginauth.bond|trustbank|typosquat
maribankauthaccess.click|maribank|typosquat
singposttrackingfee.link|singpost|typosquat
dsb.com.sg|dbs|typosquat
obcc.com|ocbc|typosquat
siingpass.com|singpass|typosquat
psob.com.sg|posb|typosquat
ubogroup.com|uob|typosquat
cfppayout.com|cpf|typosquat
iars-tax.com|iras|typosquat
trutsbank.com|trustbank|typosquat
mraibank.com|maribank|typosquat
singpsto.com|singpost|typosquat
"""
# The benign ones
CONSTRUCTED = """
carousel.com|none|constructed_fixture
carouseldesigns.com|none|constructed_fixture
carousellighting.com|none|constructed_fixture
carouselhorses.com|none|constructed_fixture
theshoppe.com|none|constructed_fixture
candyshoppe.com|none|constructed_fixture
giftshoppe.com|none|constructed_fixture
bookshoppe.com|none|constructed_fixture
dbschenker-logistics.com|none|constructed_fixture
posbank-systems.com|none|constructed_fixture
grabcad-models.com|none|constructed_fixture
singpassing-history.com|none|constructed_fixture
cpfire-safety.org|none|constructed_fixture
iraselect-planning.com|none|constructed_fixture
maritime-bank-europe.org|none|constructed_fixture
singpostgraduate-research.com|none|constructed_fixture
dsb-login.xyz|none|constructed_fixture
login-dsb.top|none|constructed_fixture
secure-dsb-sg.cfd|none|constructed_fixture
cdcv0ucher.xyz|none|constructed_fixture
cdcvouchr.top|none|constructed_fixture
"""
