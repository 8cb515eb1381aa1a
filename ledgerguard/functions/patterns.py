"""Detection patterns and policy constants.

Fixed values (must equal the governance policy and detector definitions being re-implemented):
entity types with their reveal flag, classified columns, restricted columns, detector order,
known-value minimum length, NER settings, allow-list terms and patterns, guard mode, the four
PII regular expressions and the token format.

The regexes are the detector definitions written for Java's engine. Python's ``\\w`` is spelled
``[\\p{L}\\p{N}_]`` and ``\\d`` is ``\\p{Nd}`` so that Unicode letters and digits behave as in the
original; ``(?U)`` makes ``\\s`` Unicode-aware.
"""

# --- fixed values: policy --------------------------------------------------------------
ENTITY_TYPES = {  # entity -> reveal_to_user
    "PERSON": True, "EMAIL": True, "PHONE": True, "ADDRESS": True, "ZIP": True,
    "SSN": False, "CREDIT_CARD": False,
}
CLASSIFIED_COLUMNS = {  # (table, column), lower case -> entity
    ("customers", "firstname"): "PERSON",
    ("customers", "lastname"): "PERSON",
    ("customers", "email"): "EMAIL",
    ("customers", "phone"): "PHONE",
    ("customers", "addressline1"): "ADDRESS",
    ("customers", "addressline2"): "ADDRESS",
    ("customers", "zip"): "ZIP",
    ("customers", "ssn"): "SSN",
}
RESTRICTED_COLUMNS = {("customers", "ssn")}
REGEX_ENTITIES = ("SSN", "CREDIT_CARD", "EMAIL", "PHONE")   # detector order
KNOWN_VALUES_ENABLED = True
KNOWN_VALUE_MIN_LENGTH = 3
NER_ENABLED = True
NER_MODEL = "en_core_web_sm"
NER_ENTITIES = ("PERSON",)
NER_MIN_SCORE = 0.6
NER_TYPE_MAP = {"LOCATION": "ADDRESS", "PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL", "US_SSN": "SSN"}
ALLOW_TERMS = ("Commenced", "PaidOff", "Restructure", "Rebook", "Lease", "Loan", "Invoiced", "NotInvoiced",
               "Suppressed", "Suspended", "Paid", "Individual", "Business", "Sundry", "Contracts", "Customers",
               "Receivables")
ALLOW_PATTERNS = (r"CT-\d+",)
GUARD_MODE = "mask"
AUDIT_INCLUDE_PAYLOADS = False
VAULT_TTL_SECONDS = 3600
REDACTED = "[REDACTED]"

# Customer profile columns loaded as known values, in registration order, and their entity types.
PROFILE_TYPES = (
    ("FirstName", "PERSON"), ("LastName", "PERSON"), ("AddressLine1", "ADDRESS"), ("AddressLine2", "ADDRESS"),
    ("Zip", "ZIP"), ("Phone", "PHONE"), ("Email", "EMAIL"),
)

# --- fixed values: patterns ------------------------------------------------------------
W = r"\p{L}\p{N}_"          # Python's \w as a Java character-class body
D = r"\p{Nd}"               # Python's \d
REGEXES = {
    "SSN": rf"(?U)(?<![{W}-]){D}{{3}}[- ]{D}{{2}}[- ]{D}{{4}}(?![{W}-])",
    "CREDIT_CARD": rf"(?U)(?<![{W}-])(?:{D}[ -]?){{12,15}}{D}(?![{W}-])",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": (rf"(?U)(?<![{W}-])(?<!{D}\s)(?:\+?1[\s.-]?)?(?:\({D}{{3}}\)\s?|{D}{{3}}[\s.-])?"
              rf"{D}{{3}}[\s.-]{D}{{4}}(?![{W}-])(?!\s{D})"),
}
# The same matches in text that is all ASCII: plain classes, a look at the first character before the look-behinds, and a
# possessive start of the e-mail ('@' is not in its class, so giving back characters never helps).
_AW = "A-Za-z0-9_"
ASCII_REGEXES = {
    "SSN": rf"(?=[0-9])(?<![{_AW}-])[0-9]{{3}}[- ][0-9]{{2}}[- ][0-9]{{4}}(?![{_AW}-])",
    "CREDIT_CARD": rf"(?=[0-9])(?<![{_AW}-])(?:[0-9][ -]?){{12,15}}[0-9](?![{_AW}-])",
    "EMAIL": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": (rf"(?=[+(0-9])(?<![{_AW}-])(?<![0-9]\s)(?:\+?1[\s.-]?)?(?:\([0-9]{{3}}\)\s?|[0-9]{{3}}[\s.-])?"
              rf"[0-9]{{3}}[\s.-][0-9]{{4}}(?![{_AW}-])(?!\s[0-9])"),
}
TOKEN_PATTERN = r"<([A-Z_]+?)_(\d+)>"
WORD_CHAR = rf"[{W}]"

# DuckDB (RE2) forms used by the oracles: no lookaround, so boundaries become groups 1 and 3.
RE2_W = r"\p{L}\p{N}_"
RE2 = {
    "SSN": rf"(^|[^{RE2_W}-])(\p{{Nd}}{{3}}[- ]\p{{Nd}}{{2}}[- ]\p{{Nd}}{{4}})($|[^{RE2_W}-])",
    "CREDIT_CARD": rf"(^|[^{RE2_W}-])((?:\p{{Nd}}[ -]?){{12,15}}\p{{Nd}})($|[^{RE2_W}-])",
    "EMAIL": r"()([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})()",
    "PHONE": (rf"(^|(?:^|\P{{Nd}})\s|[^{RE2_W}\s-])"
              rf"((?:\+?1[\s.-]?)?(?:\(\p{{Nd}}{{3}}\)\s?|\p{{Nd}}{{3}}[\s.-])?\p{{Nd}}{{3}}[\s.-]\p{{Nd}}{{4}})"
              rf"($|\s(?:\P{{Nd}}|$)|[^{RE2_W}\s-])"),
}


def entity_rank(entity: str, source: str) -> int:
    """Tie-break order among spans with equal start and length: detector order, then entity order."""
    base = {"regex": 0, "known": 100, "ner": 200}[source]
    return base + (REGEX_ENTITIES.index(entity) if source == "regex" and entity in REGEX_ENTITIES else 0)
