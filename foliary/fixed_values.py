"""Fixed values.

Everything in this module is data whose exact value decides the result:
word lists, look-up tables, thresholds and text patterns.  Patterns are written
for Java's regular-expression engine (the one behind ``rlike`` and friends).
"""

# --- catalog domains -------------------------------------------------------
STATUSES = ["PENDING", "QUEUED", "PROCESSING", "COMPLETED", "FAILED"]
CONFIDENCE_LEVELS = ["HIGH", "MEDIUM", "LOW"]
VALID_YEARS = (2019, 2026)

# --- search ----------------------------------------------------------------
VECTOR_WEIGHT = 0.7
TEXT_WEIGHT = 0.3
MIN_VECTOR_CANDIDATES = 500
CANDIDATES_PER_PAGE_ROW = 20
VECTOR_QUERY_MIN_CHARS = 4
COVER_WEIGHT = 0.1
FILTER_ONLY_LABEL = "(filter only)"
QUERY_STOP_WORDS = [
    "a", "an", "and", "the", "in", "on", "of", "for", "with", "is", "are",
    "was", "were",
]
MAX_QUERY_CHARS = 500
QUERY_BLOCK_LIST = [
    "';", "')", "';--", "' OR ", "' AND ", "UNION", "SELECT", "INSERT",
    "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "<script", "</script>",
    "javascript:", "vbscript:",
]

# English stop words of the full-text configuration.
TEXT_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
""".split()

# --- processing ------------------------------------------------------------
ZOMBIE_SECONDS = 360
PROCESSING_SLOTS = 3
START_DELAY_SECONDS = 30
EMBEDDING_VERSION = 3
TRUSTED_CONFIDENCE = ["HIGH", "MEDIUM"]
MAX_ARCHIVE_IDS = 100
UNUSABLE_SUMMARY = "no summary available"

# --- files -----------------------------------------------------------------
FILE_TYPES = {
    "pdf": [".pdf"],
    "image": [".jpg", ".jpeg", ".png", ".tiff", ".bmp"],
    "text": [".txt", ".md"],
    "document": [".doc", ".docx"],
}
FORBIDDEN_NAME_TOKENS = ["..", "/", "\\", ":", "*", "?", '"', "<", ">", "|"]
ALLOWED_UPLOADS = [".pdf", ".jpg", ".jpeg", ".png", ".txt", ".docx"]
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
# leading bytes (hex) -> detected type
MAGIC_NUMBERS = [
    ("25504446", "application/pdf"),
    ("FFD8FF", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    (
        "504B0304",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ),
]
EXPECTED_TYPE = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".txt": "text/plain",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
DANGEROUS_CONTENT = [
    "<script", "javascript:", "vbscript:", "onload=", "onerror=", "<?php",
    "<%", "#!/bin/sh", "#!/bin/bash",
]

# --- states ----------------------------------------------------------------
STATE_ABBREVIATIONS = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR",
    "California": "CA", "Colorado": "CO", "Connecticut": "CT",
    "Delaware": "DE", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI",
    "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME",
    "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI",
    "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO",
    "Montana": "MT", "Nebraska": "NE", "Nevada": "NV",
    "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM",
    "New York": "NY", "North Carolina": "NC", "North Dakota": "ND",
    "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD",
    "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT",
    "Virginia": "VA", "Washington": "WA", "West Virginia": "WV",
    "Wisconsin": "WI", "Wyoming": "WY", "District of Columbia": "DC",
}
# text markers that by themselves imply a state, most specific first
STATE_MARKERS = [
    (r"\bSTATE\s+ASSEMBLY\s+\d+\b", "CA"),
    (r"\bHPISD\b|\bGCISD\b|\bFORT\s+WORTH\b|\bCISD\b", "TX"),
    (r"\bLINCOLN,\s*NE\b|\bOMAHA,\s*NE\b", "NE"),
    (r"\bOREGON\s+CITY\b|\bPORTLAND,\s*OR\b", "OR"),
    (r"\bALBUQUERQUE\b|\bSANTA\s+FE,\s*NM\b", "NM"),
    (r"\bJEFFERSON\s+CITY,\s*MO\b|\bST\.\s+LOUIS,\s*MO\b", "MO"),
    (r"\bCOLUMBUS,\s*OH\b|\bCINCINNATI,\s*OH\b", "OH"),
]
RACE_OFFICES = (
    r"senate|assembly|governor|house|congress|district|representative|state\s+rep"
)
ADDRESS_BLOCK = {"floor": 150, "limit": 600}

# --- dates -----------------------------------------------------------------
DATE_STAMP = (
    r"\b(\d{1,2}/\d{1,2}/\d{2,4})\s+(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?)"
)
DATE_CONNECTOR = (
    r"\b(on|by|since|as of|from|dated|through|until|after|before)\s*$"
)
DATE_CITATION = r"(source|footnote|\d+\]|\(\d)"
DATE_CONTEXT_CHARS = 120
DATE_CITATION_CHARS = 60

# --- payer line ------------------------------------------------------------
FRANK_PHRASES = [
    "official funds authorized by the house",
    "official funds authorized by the senate",
    "official funds authorized by the",
    "official funds of",
]
PAYER_LINE = r"paid\s+for\s+by\s+(.+)"
# (pattern, ignore case) removed one after another, trimming in between
PAYER_LINE_NOISE = [
    (r"\s*\|.*$", False),
    (r"[.*]+$", False),
    (r"\s+and\s*$", True),
]
PAYER_TAILS = [
    (r"[\.,]\s*not\s+authorized\s+by\s+any\s+candidate.*$", True),
    (
        r"\.\s*(?:registered\s+agent\s*:?\s*\S.*"
        r"|[A-Z][A-Za-z]+\s+[A-Z][A-Za-z]+,?\s*registered\s+agent.*)$",
        True,
    ),
    (
        r",\s*[A-Z][A-Za-z]+\s+[A-Z][A-Za-z]+(?:\s*,?\s*(?:Treasurer|Chairman|Chair"
        r"|Secretary|Registered\s+Agent|Agent|Director|President))?\s*$",
        True,
    ),
    (
        r",\s*[A-Z]{2,}\s+[A-Z]{2,}(?:\s*,?\s*(?:TREASURER|CHAIRMAN|CHAIR"
        r"|SECRETARY|REGISTERED\s+AGENT|AGENT|DIRECTOR|PRESIDENT))?\s*$",
        False,
    ),
    (
        r",\s*(?:Treasurer|Chairman|Chair|Secretary|Registered\s+Agent|Agent|Director)\s*$",
        True,
    ),
]

# --- committee -> person ---------------------------------------------------
ORGANISATION_WORDS = (
    r"\b(party|republican|democrat|democratic|pac|fund|action|leadership"
    r"|coalition|association|future|strong|alliance|patriots|citizens"
    r"|victory|freedom|liberty|values|trust|neighbors|families|voters"
    r"|workers|taxpayers|teachers|parents|seniors|veterans|iec)\b"
)
COMMITTEE_OFFICES = (
    r"congress|u\.?s\.?\s+congress|senate|u\.?s\.?\s+senate|assembly"
    r"|governor|attorney\s+general|state\s+(?:representative|rep|senate|senator)"
    r"|county|district|judge|sheriff|mayor|city\s+council|school\s+board"
    r"|treasurer|comptroller|clerk|commissioner|house|representative"
    r"|[a-z]+\s+\d+"
)
COMMITTEE_LEAD = (
    r"^(?:(?:the\s+)?committee\s+to\s+(?:re-?)?elect\s+"
    r"|(?:the\s+)?(?:re-?)?elect\s+|friends?\s+of\s+)"
)
COMMITTEE_TAIL = (
    r"\s+(?:for\s+(?:\w+\s+)*(?:" + COMMITTEE_OFFICES + r")"
    r"|\bcampaign\b|\bpac\b|\bfund\b|\bcommittee\b)\s*\d*\s*$"
)
COMMITTEE_PLACE = r"\s+for\s+(?:[A-Z]{2}|\w+)\s*(?:\(R\)|\(D\)|\d+)?\s*$"
COMMITTEE_PARTY = r"\s*\([RD]\)\s*$"
COMMITTEE_YEAR = r"\s+\d{4}\s*$"

# --- candidate name in the body --------------------------------------------
VOTE_FOR_NAME = [
    r"(?:Vote|Re-?Elect|Elect)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})(?=\s+(?:for\b|$|\n))",
    r"(?:VOTE|RE-?ELECT|ELECT)\s+([A-Z]{2,}(?:\s+[A-Z]{2,}){1,2})(?=\s+FOR|\s*\n)",
]
CAPITALS_PHRASE = r"\b([A-Z]{3,}(?:\s+[A-Z]{3,}){1,2})\b"
EARLY_PHRASE_CHARS = 800
NAME_FOR_OFFICE = (
    r"(?<!\bfor\s)(?<!\bvote\s)"
    r"\b([A-Z][a-z]{3,}\s+[A-Z][a-z]{3,}(?:\s+[A-Z][a-z]{3,})?)\s+[Ff]or\s+"
    r"(?:Congress|Senate|Assembly|Governor|Attorney|State|County|District|Mayor|Judge|School)"
)
NAME_IN_DOMAIN = r"(?:www\.)?([A-Z][a-z]{2,})(?:For|4)[A-Z]"
SLOGAN_WORDS = [
    "NEED", "NEEDS", "WORK", "WORKS", "WORKING", "TRUST", "SAFE", "SAFETY",
    "TOLD", "LIES", "LIE", "STOP", "FIGHT", "FIGHTS", "PROTECT", "SAVE",
    "HELP", "HELPS", "FAIL", "FAILS", "FAILED", "RAISE", "RAISED", "COST",
    "COSTS", "WRONG", "RIGHT", "KNOW", "KNEW", "MAKE", "MAKES", "KEEP",
    "KEEPS", "BRING", "BRINGS", "LEAD", "LEADS", "STAND", "STANDS", "BOLD",
    "WANT", "WANTS", "CARE", "CARES", "GIVE", "GIVES", "TAKE", "TAKES",
    "PLAN", "PLANS", "MORE", "LESS", "REAL", "TRUE", "JUST", "ONLY",
]
GENERIC_CAPITALS = [
    "VOTE", "FOR", "STATE", "ELECT", "THE", "AND", "OR", "IN", "OF", "TO",
    "A", "AN", "IS", "ON", "AT", "BY", "US", "OUR", "WE", "YOU", "HE", "SHE",
    "IT", "NOT", "NO", "YES", "PAID", "AUTHORIZED", "COMMITTEE", "REPUBLICAN",
    "DEMOCRAT", "DEMOCRATIC", "PARTY", "CONGRESS", "SENATE", "HOUSE",
    "ASSEMBLY", "GOVERNOR", "PRESIDENT", "POLITICAL", "AD", "OFFICIAL",
    "FUNDS", "PRIMARY", "ELECTION", "GENERAL", "DISTRICT", "COUNTY", "CITY",
    "JOIN", "SIGN", "SEND", "STAND", "FIGHT", "BACK", "UP", "NOW", "READY",
    "TRUST", "RESULTS", "CONSERVATIVE", "LIBERAL", "FREEDOM", "LIBERTY",
    "AMERICA", "AMERICAN", "NORTH", "SOUTH", "EAST", "WEST", "UNITED",
    "STATES", "FEDERAL", "LOCAL", "PUBLIC", "SAFE", "SAFETY", "SECURE",
    "BORDER", "TAX", "TAXES", "CRIME", "BALLOT", "EARLY", "REFORM", "PLAN",
    "POLICY", "PEOPLE", "COMMUNITY", "PRESORT", "PRSRT", "POSTAGE", "PERMIT",
    "STD", "PRST",
]

# --- review score ----------------------------------------------------------
REVIEW_POINTS = {
    "date": {"HIGH": 2, "MEDIUM": 1},
    "client": {"HIGH": 3, "MEDIUM": 1},
    "state": {"HIGH": 2, "MEDIUM": 1},
}
REVIEW_THRESHOLD = 5

# --- client clean-up -------------------------------------------------------
MIN_CLIENT_TOKENS = 2
GARBAGE_NAMES = [
    "THE", "AND", "OR", "A", "AN", "FOR", "OF", "IN", "ON", "AT", "TO",
    "COMMITTEE", "COMMITTEE TO", "COMMITTEE TO ELECT", "THE COMMITTEE TO ELECT",
    "REPUBLICAN", "DEMOCRAT", "DEMOCRATIC", "PARTY",
]
GARBAGE_PATTERNS = [
    r"^not\s+authorized\b",
    r"\bnot\s+authorized\s+by\s+any\s+candidate\b",
    r"^official\s+funds\s+(authorized|of)\b",
    r"^the\s+u\.?s\.?\s+chamber\s+of\s+commerce\s+and\s+not",
    r"^challenger\s+jay\s+chen",
    r"^but\s+disappears",
    r"^socialists\s+warnock",
    r"^vote\s*\n*vote",
    r"^no\s+on\s+allred",
    r"^no\s*\n+on\b",
    r"^(yes|no)\s+(on|off)\s*$",
    r"^meeks\s*\n+for\s+judge",
    r"^licensed\s+registered\s+trademark",
    r"^regular\s+unleaded",
    r"^late\s+past\s+due",
    r"^new\s+location",
    r"^by\s+mail\b",
    r"^candidates\s+this\s+november",
    r"^place\s+first\s+class",
    r"^ccs\s+scs\s+hcs",
    r"^sided\s+with\s+them",
    r"^lying\s+about",
    r"^too\s+much\b",
    r"^office\s+(locations\s+)?washington",
    r"^him\s+here\s+kulkarni",
    r"^unpaid\s+(late|overdue)",
    r"^past\s+due\s+late",
    r"^constitutional\s+term\s+limits",
    r"^insight\s+(what|will|ted|jay|sugar|wendy|waylon|martha|anthony)\b",
    r"^(behind|against|insight)\s+\w+",
]
# offices and campaign words that end a candidate name
NAME_OFFICE_TAIL = (
    r"\s+(?:for\s+)?(?:"
    r"u\.?s\.?\s+congress|congress(?:man|woman)?"
    r"|u\.?s\.?\s+senate|senate|senator"
    r"|u\.?s\.?\s+house|house(?:\s+of\s+representatives?)?"
    r"|state\s+(?:senate|house|assembly|representative|rep)"
    r"|assembly(?:man|woman)?"
    r"|governor|lt\.?\s+governor|lieutenant\s+governor"
    r"|attorney\s+general"
    r"|comptroller|treasurer|secretary\s+of\s+state"
    r"|(?:county\s+)?(?:district\s+)?(?:superior\s+)?(?:appellate\s+)?judge"
    r"|sheriff|mayor|city\s+council(?:man|woman|member)?"
    r"|school\s+board(?:\s+member)?"
    r"|supervisor|commissioner|clerk"
    r"|district\s+\d+"
    r"|[a-z]+\s+\d+(?:th|st|nd|rd)?"
    r")\s*(?:\d{4})?\s*$"
)
NAME_CAMPAIGN_TAIL = r"\s+(?:Campaign|For\s+\w+)\s*$"
COMMITTEE_PERSON_TAIL = (
    r"\s*[-–—,]\s*(?:[A-Z][a-z]+\s+[A-Z][a-z]+|[A-Z]{2,}\s+[A-Z]{2,}"
    r"|treasurer|chairman|chair|registered\s+agent)\s*$"
)

# --- names found by the external model -------------------------------------
TITLE_PREFIX = (
    r"^(?:Congressman|Congresswoman|Senator|Representative|Rep\."
    r"|Assemblywoman|Assemblyman|Sheriff|Mayor|Judge|Dr\."
    r"|Governor|Lt\.\s+Governor|Attorney\s+General"
    r"|Councilman|Councilwoman|Commissioner|Supervisor|Trustee)\s+"
)
SUMMARY_OFFICE_TAIL = (
    r"\s+(?:for|of)\s+(?:Congress|Senate|Assembly|Governor|Mayor|Sheriff|Judge"
    r"|County|District|State|City|School\s+Board|Clackamas|Texas|California"
    r"|\w+\s+County|\w+\s+District).*$"
)
MERGE_OFFICE_TAIL = (
    r"\s+(?:for\s+)?(?:u\.?s\.?\s+)?(?:"
    r"congress(?:man|woman)?|senate|senator|assembly(?:man|woman)?"
    r"|governor|attorney\s+general|mayor|sheriff|judge"
    r"|state\s+\w+|county\s+\w+|city\s+\w+|school\s+board"
    r"|district\s+\d+|house|representative"
    r")\s*(?:\d{4})?\s*$"
)
NAME_END_WORDS = ["for", "in", "and", "or", "to", "at", "by", "with"]
AI_NAME_STOP_WORDS = ["the", "and", "for", "of", "in"]
COMPOUND_PREFIX = r"\b(Mc|Mac|O')([a-z])"
MAPPING_CATEGORY = "Candidate & Entity Identifiers"
MAPPING_CANDIDATE = "Candidate Elements"
MAPPING_OPPONENT = "Opposition Elements"
MAPPING_NAME_TERM = "Name (Exact)"
_NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
# tried in this order; all ignore case
SUMMARY_PATTERNS = [
    (r"support(?:ing)?\s+" + _NAME + r"\s+for\s+\w", "HIGH"),
    (
        r"promot(?:es|ing)\s+(?:Republican\s+|Democratic\s+)?" + _NAME
        + r"'s?\s+(?:re-?election|campaign|bid|run)",
        "HIGH",
    ),
    (r"re-?election\s+of\s+" + _NAME, "HIGH"),
    (r"elect(?:ing)?\s+" + _NAME + r"\s+(?:as\s+|for\s+|\w)", "HIGH"),
    (r"(?:campaign\s+)?mailer\s+(?:for|promoting)\s+" + _NAME, "HIGH"),
    (r"urging\s+voters\s+to\s+(?:support|elect|vote\s+for)\s+" + _NAME, "HIGH"),
    (
        _NAME + r"\s+for\s+(?:Congress|Senate|Governor|Mayor|Assembly|House|Sheriff|Judge"
        r"|County|District|State\s+\w+|City\s+\w+|School\s+Board)",
        "MEDIUM",
    ),
    (
        r"promot(?:es|ing)\s+(?:Republican\s+|Democratic\s+)?" + _NAME
        + r"(?:\s+as|\s+for|,)",
        "MEDIUM",
    ),
    (r"candidate\s+" + _NAME, "MEDIUM"),
    (r"(?:highlights?|featuring)\s+" + _NAME + r"(?:'s?\s+|\s+as\s+)", "MEDIUM"),
    (r"vot(?:e|ing)\s+for\s+" + _NAME, "MEDIUM"),
]
SUMMARY_REJECT_WORDS = [
    "democrat", "republican", "amendment", "proposition", "measure", "ballot",
    "they", "this", "that", "their", "these", "those",
]
ATTACK_PATTERNS = [
    r"(?:mailer|ad|piece|flyer)\s+(?:from|by|for)\s+" + _NAME + r"\s+attack",
    r"(?:paid\s+for|sponsored)\s+by\s+([A-Z][a-z\s&,]+?)(?:\.|,|\n|$)",
    r"^([A-Z][A-Za-z\s&]+?)\s+mailer\s+(?:attack|criticiz|oppos)",
]
AGREEMENT_RATIO = 0.85
NEAR_DUPLICATE_THRESHOLD = 0.6
