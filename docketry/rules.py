"""Keyword lists, patterns and lookup values.

Everything in this module is a fixed value: the words, patterns and formats are given by the court forms and the
portal, and results are only right if they are exactly these. Order matters wherever a list is searched first-hit.
Repeated groups inside patterns are bounded so that no pattern can exhaust the regex engine's stack.
"""

from __future__ import annotations

# --------------------------------------------------------------------------------------------------------------
# Case states, counties
# --------------------------------------------------------------------------------------------------------------
UPCOMING = "upcoming"
UPSET_BID = "upset_bid"
BLOCKED = "blocked"
CLOSED_SOLD = "closed_sold"
CLOSED_DISMISSED = "closed_dismissed"
STATES = [UPCOMING, UPSET_BID, BLOCKED, CLOSED_SOLD, CLOSED_DISMISSED]

COUNTY_BY_CODE = {
    "180": "Chatham",
    "310": "Durham",
    "420": "Harnett",
    "520": "Lee",
    "670": "Orange",
    "910": "Wake",
}
SOURCE_BY_COUNTY_CODE = {
    "180": "chatham_re",
    "310": "durham_re",
    "420": "harnett_re",
    "520": "lee_re",
    "670": "orange_re",
    "910": "wake_re",
}
CITIES_BY_COUNTY_CODE = {
    "910": ["raleigh", "cary", "apex", "holly springs", "fuquay", "garner", "knightdale", "wendell", "zebulon",
            "wake forest", "morrisville", "rolesville"],
    "310": ["durham"],
    "670": ["chapel hill", "hillsborough", "carrboro"],
    "180": ["pittsboro", "siler city"],
    "420": ["lillington", "dunn", "angier", "erwin", "coats"],
    "520": ["sanford", "broadway"],
}

# --------------------------------------------------------------------------------------------------------------
# Event-type rules (lower-case substrings unless used with prefix matching)
# --------------------------------------------------------------------------------------------------------------
SALE_REPORT = ["report of foreclosure sale", "report of sale", "foreclosure sale report",
               "report of foreclosure sale (chapter 45)"]
SALE_BASELINE = ["report of sale", "report of foreclosure sale"]
SALE_CONFIRMED = ["confirming sale", "confirmation of sale", "confirmation", "order confirm sale",
                  "order for confirmation", "order of confirmation", "order on confirmation", "order to confirm sale"]
SALE_CONFIRMED_NOT = ["set aside", "setting aside", "vacated", "denied"]
SET_ASIDE = ["set aside", "setting aside", "order to set aside"]
BANKRUPTCY = ["bankruptcy", "bankruptcy filed", "notice of bankruptcy", "suggestion of bankruptcy",
              "stay of proceedings", "motion for stay"]
BANKRUPTCY_NOT = ["resolved", "relief from", "relief of", "dismissal of bankruptcy", "reinstatement"]
LIFTED = ["order to reopen", "reopen", "reinstated", "case reopened", "notice of sale/resale"]
DISMISSAL = ["dismissed", "voluntary dismissal", "order of dismissal", "case dismissed", "motion to dismiss"]
DISMISSAL_NOT = ["denying motion to dismiss", "denied motion to dismiss"]
REVERSED = ["order to reopen", "reopen", "reinstated", "case reopened", "vacated"]
UPSET_FILED = ["upset bid filed", "notice of upset bid"]
INITIATED = ["foreclosure case initiated", "petition for foreclosure", "notice of hearing",
             "findings and order of foreclosure", "foreclosure (special proceeding) notice of hearing"]
INITIATED_NOT = ["cancellation", "withdrawal", "canceled", "withdrawn"]
LEGACY = ["petition", "cause of action", "other hearing"]
LEGACY_NOT = ["petitioner", "petition to sell", "petition for commissions", "petition for partition",
              "petition for gal", "petition to proceed", "petition to enjoin", "bankruptcy petition"]
FINALIZATION = ["order confirming sale", "order of confirmation", "final report of sale",
                "commissioner's final report", "final account", "order for disbursement", "settlement statement"]

# --------------------------------------------------------------------------------------------------------------
# Candidate rule for newly found cases
# --------------------------------------------------------------------------------------------------------------
NON_PROPERTY = ["adoption", "name change", "motor vehicle", "incompetent driver", "incompetency", "guardianship"]
FORECLOSURE_EVENTS = ["foreclosure (special proceeding)", "foreclosure (special proceeding) notice of hearing",
                      "findings and order of foreclosure", "foreclosure case initiated",
                      "report of foreclosure sale (chapter 45)", "notice of sale/resale", "upset bid filed"]
OPPORTUNITY_EVENTS = ["upset bid filed", "report of sale", "order allowing partition by", "partition by sale"]
SALE_TITLES = ["petition to sell", "petition for sale", "petition to lease", "petition to mortgage",
               "petition for partition", "order for sale", "ward's estate", "incompetent's estate", "minor's estate",
               "decedent's estate", "sell real property", "sale of real property", "tax lien foreclosure",
               "tax foreclosure", "delinquent tax", "receivership", "receiver's sale", "trust property sale",
               "sell trust property", "estate administration", "administration of estate",
               "personal representative", "petition for control of decedent", "quiet title", "condemnation",
               "eminent domain", "claim and delivery"]
PAGE_FALLBACK_PHRASES = ["foreclosure (special proceeding)", "foreclosure case initiated",
                         "findings and order of foreclosure", "report of foreclosure sale", "notice of sale/resale",
                         "upset bid filed"]
PARTY_TYPES = ["Respondent", "Petitioner", "Trustee", "Plaintiff", "Defendant", "Garnishee", "Applicant",
               "Attorney", "Guardian"]

# --------------------------------------------------------------------------------------------------------------
# Street vocabulary
# --------------------------------------------------------------------------------------------------------------
STREET_TYPES = ["Street", "Road", "Drive", "Lane", "Avenue", "Boulevard", "Court", "Circle", "Way", "Place",
                "Terrace", "Trail", "Parkway", "Highway", "St", "Rd", "Dr", "Ln", "Ave", "Blvd", "Ct", "Cir", "Wy",
                "Pl", "Ter", "Trl", "Pkwy", "Hwy", "St.", "Rd.", "Dr.", "Ln.", "Ave.", "Blvd.", "Ct.", "Cir.", "Wy.",
                "Pl.", "Ter.", "Trl.", "Pkwy.", "Hwy."]
DIRECTION_PREFIXES = {
    "N": "N", "N.": "N", "S": "S", "S.": "S", "E": "E", "E.": "E", "W": "W", "W.": "W",
    "NE": "NE", "N.E.": "NE", "NE.": "NE", "NW": "NW", "N.W.": "NW", "NW.": "NW",
    "SE": "SE", "S.E.": "SE", "SE.": "SE", "SW": "SW", "S.W.": "SW", "SW.": "SW",
}
KNOWN_CITIES = ["Raleigh", "Durham", "Cary", "Apex", "Holly Springs", "Morrisville", "Garner", "Wake Forest",
                "Fuquay-Varina", "Fuquay Varina", "Knightdale", "Wendell", "Zebulon", "Rolesville", "Clayton",
                "Sanford", "Pittsboro", "Hillsborough", "Chapel Hill", "Carrboro", "Lillington", "Angier"]
CLEANUP_STREET_TYPES = ["ST", "STREET", "AVE", "AVENUE", "RD", "ROAD", "DR", "DRIVE", "LN", "LANE", "CT", "COURT",
                        "CIR", "CIRCLE", "WAY", "PL", "PLACE", "BLVD", "BOULEVARD", "TRL", "TRAIL", "PKWY",
                        "PARKWAY", "HWY", "HIGHWAY", "TER", "TERRACE", "RUN", "PATH", "LOOP", "PASS", "PT", "POINT"]
CLEANUP_CITIES = ["CHAPEL HILL", "HILLSBOROUGH", "CARRBORO", "DURHAM", "MEBANE", "EFLAND", "CEDAR GROVE",
                  "HURDLE MILLS", "WHITE CROSS", "RALEIGH"]
CITY_CODES = {"raleigh": "RA", "apex": "AP", "cary": "CA", "fuquay-varina": "FV", "fuquay varina": "FV",
              "garner": "GA", "holly springs": "HS", "knightdale": "KN", "morrisville": "MO", "rolesville": "RO",
              "wake forest": "WF", "wendell": "WE", "zebulon": "ZE"}

# --------------------------------------------------------------------------------------------------------------
# Property-address patterns, best first; one or two groups each
# --------------------------------------------------------------------------------------------------------------
_STREETS = ("(?:Street|St|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Circle|Cir|Way|Avenue|Ave|Boulevard|Blvd|Place|Pl"
            "|Terrace|Ter)")
_STREETS_TRAIL = ("(?:Street|St|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Circle|Cir|Way|Avenue|Ave|Boulevard|Blvd|Place"
                  "|Pl|Terrace|Ter|Trail|Trl)")
STATE = r"(?:NC|North\s+Carolina)"
# A street name of any number of words: one run of letters and blanks, so long texts need no regex stack.
_NUMBERED = r"\d+\s+[A-Za-z][A-Za-z\s]*\s+" + _STREETS
# Words of a city up to its state and ZIP.
_CITY = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
ADDRESS_PATTERNS = [
    (2, r"The\s+address\s+for\s+the\s+real\s+property\s+is[:\s]*\n?\s*([0-9]+[^,\n]+),?\s*\n?\s*([A-Za-z\s]+,\s*" + STATE + r"\s*\d{5})"),
    (2, r"Property\s+Address\s*\(to\s+post\)[:\s]*\n?\s*([0-9]+[^,\n]+),?\s*\n?\s*([A-Za-z\s]+,\s*" + STATE + r"\s*\d{5})"),
    (1, r"real\s+property\s+located\s+at[:\s]+([0-9]+[^,]+,\s*[A-Za-z\s]+,\s*" + STATE + r"\s*\d{5})"),
    (1, r"property\s+secured\s+by[:\s]+([0-9]+[^,]+,\s*[A-Za-z\s]+,\s*" + STATE + r"\s*\d{5})"),
    (1, r"for\s+real\s+property\s+described\s+as\s+([0-9]+[^,\n]+,\s*[A-Za-z\s]+,?\s*" + STATE + r"\s*\d{5})"),
    (1, r"ADDRESS/LOCATION\s+OF\s+PROPERTY\s*(?:BEING\s+FORECLOSED)?[:\s]*\n+\s*([^\n]+" + STATE + r"\s*\d{5}(?:-\d{4})?)"),
    (2, r"ADDRESS/LOCATION\s+OF\s+PROPERTY\s*(?:BEING\s+FORECLOSED)?[:\s]*\n+\s*(\d+[^\n]+)\n+\s*([A-Z][A-Za-z\s]+,\s*NC\s*\d{5})"),
    (1, r"Address\s+of\s+Property[:\s]+(\d+[^,\n]{1,60},\s*[A-Za-z\s]+,\s*" + STATE + r"\s*\d{5}(?:-\d{4})?)"),
    (2, r"Address\s+of\s+Property[:\s]+\n*\s*(\d+[^\n]{1,50}?" + _STREETS_TRAIL + r")\s*\n+\s*([A-Z][A-Za-z\s]+,\s*NC\s*\d{5})"),
    (1, r"(?:commonly\s+known\s+as|known\s+as)[:\s]+([^.]+" + STATE + r"\s*\d{5}(?:-\d{4})?)"),
    (1, r"Property\s+Address[:\s]+([^\n]+" + STATE + r"\s*\d{5}(?:-\d{4})?)"),
    (1, r"known\s+as\s+(\d+[^,\n]+,\s*[A-Z][A-Za-z\s]+,\s*NC\s*\d{5}(?:-\d{4})?)"),
    (1, r"assessments?\s+upon\s+(" + _NUMBERED + r"[,\s]+[A-Z][A-Za-z\s]+,?\s*NC,?\s*\d{5})"),
    (1, r"lien\s+upon\s+(" + _NUMBERED + r"[,\s]+[A-Z][A-Za-z\s]+,?\s*NC,?\s*\d{5})"),
    (2, r"(?:account\s+for\s+[^.]+\s+at|familiar\s+with[^.]+\s+at)\s+(" + _NUMBERED + r")\s+(" + _CITY + r"\s+" + STATE + r"\s+\d{5}(?:-\d{4})?)"),
    (2, r"(" + _NUMBERED + r")[,.\s]+(" + _CITY + r"\s+North\s+Carolina\s+\d{5}(?:-\d{4})?)"),
    (2, r"(" + _NUMBERED + r")\s+(" + _CITY + r"\s+NC\s+\d{5}(?:-\d{4})?)"),
    (2, r"(" + _NUMBERED + r"[,.]?)\s*[,\n]\s*([A-Z][A-Za-z\s]+,\s*NC\s*\d{5})"),
]
# Every address pattern ends in a state and a ZIP, so a text without this cannot match any of them.
ADDRESS_NEEDS = r"(?:NC,?|North\s+Carolina)\s*\d{5}"
ADDRESS_REJECT_BEFORE = [
    r"Name\s+And\s+Ad[dg]?ress\s+Of\s+(?:Att?or[mn]ey|Agent|Upset\s+Bidder)",
    r"Att?or[mn]ey\s+[Oo]r\s+Agent\s+[Ff]or\s+Upset\s+Bidder",
    r"For\s+Upset\s+Bidder",
    r"Upset\s+Bidder\s*\n",
    r"Heir\s+of\s+",
    r"TO:\s*\n",
    r"Current\s+Resident",
    r"DEFENDANT[:\s]",
    r"defendant[:\s]",
    r"Unknown\s+Heirs",
    r"Unknown\s+Spouse",
    r"or\s+to\s+the\s+heirs",
    r"service\s+of\s+process",
    r"last\s+known\s+address",
    r"VIA\s+(?:FIRST\s+CLASS|CERTIFIED)\s+MAIL",
    r"CERTIFIED\s+MAIL",
    r"MAIL\s+RETURN\s+RECEIPT",
    r"Attn:",
    r"RE:\s*(?:Promissory|Note|Loan|Account)",
    r"[Gg]rantor",
    r"[Gg]rantee",
    r"[Tt]rustee",
    r"[Aa]ttorney",
    r"married\s+(?:man|woman)",
    r"sole\s+and\s+separate",
]
ATTORNEY_MARKERS = ["Brock & Scott", "Brock &: Scott", "PLLC", "P.L.L.C.", "Law Firm", "Law Office", "Attorney",
                    "Attorneys at Law", "Substitute Trustee", "Trustee Services"]
FORM_ARTIFACTS = ["summons submitted", "yes no", "yes  no"]
LEGAL_WORDS_IN_ADDRESS = [r"[Gg]rantor", r"[Gg]rantee", r"[Tt]rustee", r"married\s+(?:man|woman)",
                          r"sole\s+and\s+separate", r"his\s+sole", r"her\s+sole", r"a\s+single\s+person"]
EVENT_ADDRESS_KINDS = ["report of sale", "petition to sell", "notice of sale", "order confirming sale"]
EVENT_ADDRESS_PATTERN = (
    r"(\d+\s+[A-Za-z0-9\s\.]+(?:Street|St|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Circle|Cir|Way|Avenue|Ave|Boulevard"
    r"|Blvd|Place|Pl|Terrace|Ter|Trail|Trl|Village|Villiage)[,\s]+[A-Za-z\s]+(?:,\s*NC)?\s*\d{5}(?:-\d{4})?)")
ADDRESS_DOCUMENT_ORDER = ["notice of saleresale", "notice of sale", "amended notice", "report of foreclosure sale",
                          "report of sale", "special proceeding", "notice of hearing", "affidavit of service",
                          "return of service", "affidavit", "foreclosure"]

# --------------------------------------------------------------------------------------------------------------
# Amounts, dates and names in document text
# --------------------------------------------------------------------------------------------------------------
_MONEY = r"[\$\']?\s*(\d[\d,\.\s]+\d{2})"
GENERIC_BID = [
    r"Amount\s+Bid[:\s]*\$?\s*([\d,]+\.?\d*)",
    r"AMOUNT\s+BID[:\s]*\$?\s*([\d,]+\.?\d*)",
    r"winning\s+bid[:\s]*\$?\s*([\d,]+\.?\d*)",
]
REPORT_BID = [
    r"[Hh]ighest\s*[Bb]id\s*[Aa]mount[\s:]*\$?\s*([\d,]+\.?\d*)",
    r"[Aa]mount\s+(?:of\s+)?[Bb][il1dx]{1,2}[\s\S]{0,150}?\$([\d,]+\.?\d*)",
    r"[Aa]mount\s*[Oo]f\s*[Ss]uccessful\s*[Bb]id[\s:]*\$?\s*([\d,]+\.?\d*)",
    r"[Pp]roperty\s*(?:was\s+)?[Ss]old\s*[Ff]or[\s:]*\$?\s*([\d,]+\.?\d*)",
    r"[Ww]inning\s*[Bb]id[\s:]*\$?\s*([\d,]+\.?\d*)",
    r"[Hh]ighest\s*[Bb]id[\s\S]{1,50}?\$?\s*(\d[\d,\.\s]+\.\d{2})",
    r"for\s+the\s+sum\s+of\s*\$\s*([\d,]+\.?\d*)",
    r"(?:property\s+was\s+)?sold\s+(?:on\s+)?[^$]{0,30}?,\s*for\s*\$\s*([\d,]+\.\d{2})",
    r"sold\s+for\s*\$\s*([\d,]+\.?\d*)",
    r"offer\s+to\s+purchase[^$]{0,50}\$\s*([\d,]+\.?\d*)",
    r"[Tt]he\s+total\s+purchase\s+price\s+is\s*\$\s*([\d,]+\.?\d*)",
]
REPORT_MINIMUM = r"Minimum\s+Amount.*?(?:of\s+)?Next\s+Ups[ae]t\s+Bid[\s\S]{0,50}?\$?\s*(\d[\d,\.\s]+\.\d{2})"
REPORT_SALE_DATE = [
    r"[Dd]ate\s*[Oo]f\s*[Ss]ale[\s:]*(\d{1,2}/\d{1,2}/\d{4})",
    r"[Ss]ale\s*(?:was\s*)?[Hh]eld\s*[Oo]n[\s:]*(\d{1,2}/\d{1,2}/\d{4})",
    r"[Ss]ale\s*[Dd]ate[\s:]*(\d{1,2}/\d{1,2}/\d{4})",
    r"sold\s+on\s+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})",
]
NOTICE_NEW_BID = [
    r"AmountofNew\s*Upset\s*B[id]*[\s\S]{1,100}?" + _MONEY,
    r"Amount\s*[Oo]f\s*New\s*Upset\s*B[id]*[\s\S]{1,100}?" + _MONEY,
    r"New\s*Upset\s*B[id]*\s*" + _MONEY,
]
NOTICE_PREVIOUS_BID = [
    r"Amount\s*[Oo]f\s*Last\s*Previous\s*(?:Sale|Upset)[\s\S]{1,100}?" + _MONEY,
    r"Last\s*Previous\s*Sale\s*(?:[Oo]r)?\s*Upset[\s\S]{1,100}?" + _MONEY,
    r"Previous\s*(?:Sale|Bid)[\s\S]{1,50}?" + _MONEY,
]
NOTICE_MINIMUM = [
    r"[*\"]?[Mm]inimum\s*[Aa]m[ou\s]*[nrt]*\s*(?:[Oo]f)?\s*[Nn]ext\s*[Uu]ps[ae]t[!\s]*[Bb][adit]*[\s\S]{1,100}?" + _MONEY,
    r"Next\s*(?:Minimum)?\s*[Uu]ps[ae]t\s*B[id]*[\s\S]{1,50}?" + _MONEY,
    r"[Nn]ext\s+upset\s+bid\s+amount[:\s]*\$\s*([\d,]+\.?\d*)",
    r"[Uu]pset\s+[Bb]id\s+[Aa]mt\.?\s+[Rr]equired\s*\$\s*([\d,]+\.?\d*)",
]
NOTICE_DEPOSIT = [
    r"Deposit\s*(?:[Ff]or)?\s*[Nn]ext\s*(?:Minimum)?\s*Upset[\s\S]{1,100}?" + _MONEY,
    r"Amount\s*(?:[Oo]f)?\s*Deposit[\s\S]{1,80}?[Nn]ext[\s\S]{1,50}?" + _MONEY,
]
FORM_AMOUNT = r"[\$\']?\s*(\d[\d,\.\s]+\.\d{2})"
FORM_MINIMUM_LABEL = r"[Mm][\s]*[in]*[i]*mum\s*[Aa]mount\s*[Oo]f\s*[Nn]ext\s*[Uu]pset\s*[Bb]id"
FORM_DEPOSIT_LABEL = r"[Aa]mount\s*[Oo]f\s*[Dd]eposit\s*[Ff]or\s*[Nn]ext"
FORM_PREVIOUS = r"Last\s*Previous\s*Sale\s*[Oo]r\s*Upset\s*Bid[\s\S]{0,100}?\$?\s*(\d[\d,\.\s]+\.\d{2})"
FORM_PREVIOUS_POSITION = r"Last\s*Previous\s*Sale"
FORM_MINIMUM_POSITION = r"[Mm]inimum\s*Am|Next\s*Upset[!\s]*B"
FORM_DEADLINE_LABEL = r"Last\s*Day\s*(?:[Ff]or)?\s*[Nn]ex[ti!]\s*[Uu]pset"
DEADLINE_TEXT = [
    r"Last\s*Day\s*(?:[Ff]or)?\s*[Nn]ex[ti!]\s*[Uu]pset[\s\S]{1,50}?(\d{1,2}/\d{1,2}/\d{4})",
    r"Last\s+Date\s+(?:[Ff]or)\s+Upset\s+Bid[:\s]*(\d{1,2}/\d{1,2}/\d{4})",
    r"LAST\s+DATE\s+FOR\s+UPSET\s+BID[:\s]*(\d{1,2}/\d{1,2}/\d{4})",
    r"upset\s+bid\s+deadline[:\s]*(\d{1,2}/\d{1,2}/\d{4})",
    r"[Nn]ext\s*[Uu]pset[\s\S]{1,30}?(\d{1,2}/\d{1,2}/\d{4})",
    r"(\d{1,2}/\d{1,2}/\d{4})[\s\S]{0,30}?Last\s*Day\s*(?:to|for)?\s*Bid",
    r"Last\s+Day\s+(?:for\s+)?Upset\s+Bid[:\s]+([A-Z][a-z]{2,}\s+\d{1,2},?\s+\d{4})",
    r"Last\s+Date\s+for\s+upset\s+bids[:\s]+([A-Z][a-z]{2,}\s+\d{1,2},?\s+\d{4})",
    r"Last\s+Day\s+for\s+Upset\s+Bid\s+(\d{1,2}/\d{1,2}/\d{4})",
]
SALE_DATE_TEXT = [
    r"Date\s+Of\s+Sale[:\s]*(\d{1,2}/\d{1,2}/\d{4})",
    r"DATE\s+OF\s+SALE[:\s]*(\d{1,2}/\d{1,2}/\d{4})",
    r"sale\s+(?:was\s+)?held\s+on\s+(\d{1,2}/\d{1,2}/\d{4})",
    r"(?:on|held\s+on)\s+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})",
]
LEGAL_DESCRIPTION = [
    r"(Being\s+all\s+of\s+Lot\s+\d+[^.]+(?:Registry|Records)[^.]*\.)",
    r"(Lot\s+\d+,?\s+(?:Block\s+\w+,?\s+)?[^,]+(?:Subdivision|Phase)[^.]+\.)",
]
TRUSTEE_NAME = [
    r"([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+),?\s+Trustee",
    r"Trustee[:\s]+([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)",
]
ATTORNEY_NAME = [
    r"Bar\s+No\.?\s*(\d+)",
    r"([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+),?\s+(?:Trustee|Attorney)",
]
PHONE = r"(\d{3}[-.]?\d{3}[-.]?\d{4})"
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
NOTICE_MARKERS = ["NOTICE OF UPSET BID", "AOC-SP-403", "Amount Of New Upset Bid", "AmountofNew UpsetBid",
                  "Last Day For Next Upset", "Minimum Am.*?Next Upset"]
REPORT_MARKERS = ["AOC-SP-301", "REPORT OF FORECLOSURE SALE", "Report of Foreclosure Sale", "REPORT OF SALE",
                  "Report of Sale"]
REPORT_WEAK_MARKERS = ["Date Of Sale", "Highest Bid", "Amount Bid", "Place of Sale", "Trustee"]
EVENT_BID_KINDS = ["upset bid filed", "report of sale", "report of foreclosure sale"]
EVENT_BID = [
    r"[Bb]id\s+[Aa]m(?:oun)?t[:\s]*\$?\s*([\d,]+\.?\d*)",
    r"[Ss]old\s+for\s*\$?\s*([\d,]+\.?\d*)",
    r"[Aa]m(?:oun)?t\s+[Bb]id\s*\$?\s*([\d,]+\.?\d*)",
    r"\$\s*([\d,]+\.\d{2})\s+[Bb]id",
    r"[Uu]pset\s+[Bb]id\s+[Aa]m(?:oun)?t[:\s]*\$?\s*([\d,]+\.?\d*)",
    r"^\$\s*([\d,]+\.\d{2})\s+[A-Z]",
]
REPORT_NEXT_MINIMUM = [
    r"Minimum Amount of Next Upset Bid[\s\S]{0,200}?\$\s*([\d,]+\.?\d*)",
    r"Minimum\s+Amount\s+of\s+Next\s+Upset\s+Bid[\s\S]{0,200}?\$\s*([\d,]+\.?\d*)",
    r"Minimum\s+Amount[\s\S]{0,100}?Next[\s\S]{0,100}?Upset[\s\S]{0,100}?Bid[\s\S]{0,100}?\$\s*([\d,]+\.?\d*)",
]
PAGE_BID = [
    r"(?:bid|sale|price|amount)[^\$]*\$\s*([\d,]+(?:\.\d{2})?)",
    r"\$\s*([\d,]+(?:\.\d{2})?)",
]
CASE_NUMBER_LOOSE = r"\b(\d{2})\s*SP\s*0*(\d{3,6})(?:-(\d{3}))?\b"
CASE_NUMBER_SIX = r"\b(\d{2})\s*SP\s*(\d{6})\b"
CASE_NUMBER_FOUR = r"\b(\d{2})\s*SP\s*(\d{4})\b"
NAMED_RESPONDENT = r"(?:Respondent|Defendant):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
SECOND_SOURCE_KINDS = ["report of foreclosure sale", "report of sale", "notice of upset bid", "upset bid"]

# --------------------------------------------------------------------------------------------------------------
# Document tiers, limits, required keys and fields
# --------------------------------------------------------------------------------------------------------------
DOCUMENT_TIERS = {
    "notice of hearing": 1, "deed of trust": 1, "notice of sale": 1, "notice of resale": 1,
    "report of sale": 2, "report of foreclosure": 2, "upset bid": 2, "order": 2, "judgment": 2, "motion": 2,
    "affidavit": 3, "certificate": 3, "correspondence": 3, "othermiscellaneous": 3,
    "check": 4, "receipt": 4, "unknown": 4,
}
DEFAULT_TIER = 3
CORPUS_CHARS = 600_000
DOCUMENT_CHARS = 15_000
REQUIRED_FIELDS = ["case_number", "property_address", "current_bid_amount", "minimum_next_bid",
                   "next_bid_deadline", "sale_date"]
REQUIRED_KEYS = ["comprehensive_analysis", "financials", "confirmations"]
REQUIRED_SECTIONS = ["executive_summary", "chronological_timeline", "parties_analysis",
                     "legal_procedural_analysis", "conclusion_and_takeaways"]
SORT_COLUMNS = ["file_date", "case_number", "county_name", "classification", "current_bid_amount",
                "next_bid_deadline"]
INPUT_DOLLARS_PER_MILLION = 3.0
OUTPUT_DOLLARS_PER_MILLION = 15.0

# --------------------------------------------------------------------------------------------------------------
# Public link templates
# --------------------------------------------------------------------------------------------------------------
PARCEL_LIST_URL = "https://services.wake.gov/realestate/PinList.asp?map=%s&sheet=&block=%s&lot=%s&spg="
ADDRESS_CHECK_URL = "https://services.wake.gov/realestate/ValidateAddress.asp?stnum=%s&stname=%s&locidList=&spg="
ADDRESS_SEARCH_URL = "https://services.wake.gov/realestate/AddressSearch.asp?stnum=%s&stname=%s&locidList=&spg="
ACCOUNT_URL = "https://services.wake.gov/realestate/Account.asp?id=%s"
PROPERTY_URLS = {
    "durham_re": "https://taxcama.dconc.gov/camapwa/PropertySummary.aspx?PARCELPK=%s",
    "harnett_re": "https://cama.harnett.org/itspublicht/AppraisalCard.aspx?prid=%s",
    "orange_re": "https://property.spatialest.com/nc/orange/#/property/%s",
    "chatham_re": "https://chathamnc.devnetwedge.com/parcel/view/%s/2025",
    "wake_re": ACCOUNT_URL,
}
LEE_PROPERTY_URL = ("https://taxaccess.leecountync.gov/PT/Datalets/Datalet.aspx?mode=&UseSearch=no&pin=%s&jur=000"
                    "&taxyr=%s")
CHATHAM_SEARCH_URL = "https://chathamnc.devnetwedge.com/search/quick?q=%s"
LISTING_URL = "https://www.zillow.com/homes/%s_rb/"
MAP_URL = "https://www.google.com/maps/search/?api=1&query=%s"
DEED_URLS = {
    "910": ("https://rodrecords.wake.gov/web/web/integration/search?field_BookPageID_DOT_Volume=%s"
            "&field_BookPageID_DOT_Page=%s"),
    "420": ("https://us6.courthousecomputersystems.com/HarnettNC/Image/ShowDocImage?booktype=Deed&tif2pdf=true"
            "&BookNum=%s&PageNum=%s"),
    "670": ("https://rod.orangecountync.gov/orangenc/Image/ShowDocImage?booktype=Deed&tif2pdf=true"
            "&BookNum=%s&PageNum=%s"),
}
DEED_LANDING_URLS = {
    "310": "https://rodweb.dconc.gov/web/search/DOCSEARCH5S1",
    "520": "https://www.leencrod.org/Opening.asp",
    "180": "https://www.chathamncrod.org/",
}

# --------------------------------------------------------------------------------------------------------------
# How each county source is searched, and what it says. Methods in the order they are tried; the rule by which
# an address search counts as a match (``account``: all rows found are one account, or a single row was found, whatever its
# city; ``single``: a single row was found); the messages without anything to search for, for no match and for several.
# --------------------------------------------------------------------------------------------------------------
NOTHING_FOUND = "No matches found"
COUNTY_POLICIES = [
    ("wake_re", ["parcel_id", "address"], "account", "No parcel_id or property_address available", "%s matches found for address", "%s matches found for address"),
    ("durham_re", ["address"], "single", "No property_address available", NOTHING_FOUND, "%s matches found"),
    ("harnett_re", ["address"], "single", "No property_address available", NOTHING_FOUND, "%s matches found"),
    ("lee_re", ["address"], "single", "No property_address available", NOTHING_FOUND, "%s matches found"),
    ("orange_re", ["address"], "single", "No property_address available", NOTHING_FOUND, "%s matches found"),
    ("chatham_re", ["address"], "single", "No property_address available", NOTHING_FOUND, "%s matches found"),
]
