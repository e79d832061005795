"""Fixed values that decide results: word lists, patterns and thresholds."""

# --- number words and their values -------------------------------------------------
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}

# words that detection and verification treat as a number written out
DETECTED_NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand",
]

# --- characters that count as white space at the ends of a cell --------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- cell patterns -----------------------------------------------------------------
CURRENCY_CLEAN = r"[$€£¥₹]"
CURRENCY_DETECT = r"[$€£¥]"
FIRST_NUMBER = r"[-+]?\d+(?:[,\d]*)?(?:\.\d+)?"
TIME_AMOUNT = (
    r"(?i)(\d+(?:\.\d+)?)\s*"
    r"(?:hours?|hrs?|h|days?|d|minutes?|mins?|m|weeks?|wks?|w)"
)
MONEY_AMOUNT = r"\$?\s*(\d+(?:[,\d]*)?(?:\.\d{1,2})?)"
VAGUE_CELL = (
    r"(?i)^(not\s+much|very\s+little|n/?a|none|nothing|idk|unclear|unknown|"
    r"not\s+sure|not\s+applicable|tbd|tbc|–|—|-|\.\.\.?)$"
)
VAGUE_WORDS = ["n/a", "na", "not much", "very little", "nothing", "none", "unknown"]
EMBEDDED_TEXT = r"(?:\d+[\.\d]*\s*[a-zA-Z]+|[a-zA-Z]+\s*\d+[\.\d]*)"
DECORATION = r"[^\d\.\-]"
FORMULA_START = r"^[=+\-@\t\r]"
FINISHED_WORDS = ["true", "1", "yes"]

# --- column-name patterns ----------------------------------------------------------
DATE_NAME = r"date|time|day|month|year|created|updated|_at$"
NUMERIC_NAME = (
    r"(exp(end|ense)?|cost|fare|spend|price|amount|total|rate|fee|night|person|group|"
    r"count|number|nights?|persons?)"
)
SKIP_NUMERIC_NAME = (
    r"(id$|_id|\bname\b|email|raffle|latitude|longitude|\blat\b|\blon\b|zip|ipaddr|\bip\b|"
    r"\bdate\b|channel|language|country|origin|income|range|\btext\b|events?[0-9_]|"
    r"response.*id|recipient|external|distribution|\bstatus\b|\btype\b|\blocation\b|"
    r"visitorzipcode|opt.*rec|race|gender|finished|recorded|\bstart\b|\bend\b|"
    r"\bduration\b|\bprogress\b|\bunder\s*18\b|\buser.?lang)"
)
ID_NAME = (
    r"^(id|_id|.*_id|response_?id|recipient_?id|external_?ref|ip_?addr|ip_?address)$"
)
SURVEY_MARKERS = {
    "responseid", "startdate", "enddate", "recordeddate", "progress", "finished",
    "distributionchannel", "userlanguage", "recipientemail", "recipientfirstname",
    "recipientlastname", "externalreference", "externaldatareference",
}

# --- personal data, tried in this order --------------------------------------------
PII = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("ssn", r"\b\d{3}[-]?\d{2}[-]?\d{4}\b"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
]
EMAIL_START = r"^[a-zA-Z0-9._%+-]+@"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "y", "n"]

# --- outlier thresholds ------------------------------------------------------------
MAD_THRESHOLD = 5.0
MAD_SCALE = 0.6745
IQR_REACH = 3.0
DETECT_IQR_REACH = 15.0
DETECT_STD_REACH = 8.0
MIN_CLEANING_VALUES = 4
MIN_DETECTION_VALUES = 5

# --- parse formats for text dates --------------------------------------------------
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy",
    "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyyMMdd",
]

# --- what column names and levels say about their role ------------------------------
WEIGHT_TOKENS = {
    "weight", "weights", "wt", "wts", "wgt", "wgts", "wght", "pweight", "pwgt", "finalwt", "fwt",
}
PHYSICAL_WEIGHT_TOKENS = {
    "kg", "kgs", "lb", "lbs", "g", "gram", "grams", "oz", "ounce", "ounces",
    "pound", "pounds", "ton", "tons", "tonne", "tonnes", "kilo", "kilos",
    "birth", "body", "net", "gross", "shipping", "ship", "parcel", "package", "cargo",
}
IDENTIFIER_TOKENS = {
    "id", "ids", "uuid", "guid", "key", "respondent", "record", "case",
    "subject", "participant", "pid", "hhid", "serial",
}
ORDINAL_LABELS = [
    "strongly agree", "agree", "somewhat agree", "slightly agree",
    "neither agree nor disagree", "neutral", "neither",
    "somewhat disagree", "slightly disagree", "disagree", "strongly disagree",
    "very satisfied", "satisfied", "dissatisfied", "very dissatisfied",
    "never", "rarely", "sometimes", "often", "very often", "always",
    "not at all", "a little", "somewhat", "a lot", "very much",
    "excellent", "very good", "good", "fair", "poor", "very poor",
    "strongly approve", "approve", "disapprove", "strongly disapprove",
    "much better", "better", "about the same", "worse", "much worse",
]
LIKERT_TOPS = [4, 5, 7, 10]
