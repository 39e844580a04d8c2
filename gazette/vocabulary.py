"""Fixed values.

Word lists, lookup tables, patterns and constants that decide results, kept
together and stated as plain text.  Patterns are written in the common regex
subset (ASCII word boundaries, no flags); `gazette.functions.text.rx` turns one
into a Java pattern for Spark.
"""

# --- time and size limits -------------------------------------------------
PAGE_SIZE = 12
MAX_PAGE = 10_000
CLOSING_DAYS = 7
SEARCH_LIMITS = {"query": 120, "category": 100, "location": 200}
MAX_HTML_BYTES = 5_000_000
MAX_PDF_BYTES = 15_000_000
MIN_DRAFT_CONFIDENCE = "0.60"
HIGH_CONFIDENCE = "0.82"
RUN_LEASE_MINUTES = 30
MAX_INT = 2_147_483_647
LOG_LIMITS = {"candidate_title": 300, "source_name": 200, "reason": 2_000, "error": 4_000}

# --- enumerations -----------------------------------------------------------
LISTING_STATUSES = ["DRAFT", "PUBLISHED", "EXPIRED", "ARCHIVED"]
SOURCE_TYPES = [
    "GOVERNMENT", "PSU", "BANKING", "RAILWAY", "UNIVERSITY", "HOSPITAL",
    "PRIVATE_COMPANY", "OTHER_OFFICIAL",
]
PARSER_TYPES = ["GENERIC_HTML", "GOVERNMENT_HTML", "PDF_NOTIFICATION"]
REVIEW_STATUSES = ["PENDING", "APPROVED", "REJECTED"]
SECTOR_WORDS = ["government", "banking", "railway", "university", "hospital", "psu"]

# --- listing columns ----------------------------------------------------------
CARD_COLUMNS = [
    "id", "title", "department", "qualification", "vacancy", "location",
    "category", "last_date", "expires_at", "featured",
]
PUBLIC_COLUMNS = [
    "id", "title", "department", "qualification", "vacancy", "salary",
    "age_limit", "location", "application_fee", "selection_process",
    "description", "how_to_apply", "important_dates",
    "application_start_date", "last_date", "apply_link",
    "notification_link", "official_website", "category", "status",
    "featured", "source_name", "source_url", "posted_date",
    "published_at", "created_at", "updated_at",
]
CSV_COLUMNS = [
    ("ID", "id"), ("Job Title", "title"), ("Department", "department"),
    ("Qualification", "qualification"), ("Vacancy", "vacancy"),
    ("Salary", "salary"), ("Age Limit", "age_limit"), ("Location", "location"),
    ("Application Fee", "application_fee"),
    ("Selection Process", "selection_process"), ("Last Date", "last_date"),
    ("Apply Link", "apply_link"), ("Notification Link", "notification_link"),
    ("Official Website", "official_website"), ("Category", "category"),
    ("Status", "status"), ("Featured", "featured"),
    ("Created At", "created_at"), ("Updated At", "updated_at"),
]
# Field comparison order of the change detector.
COMPARABLE_FIELDS = [
    "title", "department", "qualification", "vacancy", "salary", "age_limit",
    "location", "application_fee", "selection_process", "description",
    "how_to_apply", "application_start_date", "last_date", "apply_link",
    "notification_link", "official_website",
]
TEXT_FACTS = [
    "department", "qualification", "vacancy", "salary", "age_limit",
    "location", "application_fee", "selection_process", "description",
    "how_to_apply",
]
CORRECTION_FIELDS = [
    "department", "qualification", "vacancy", "salary", "age_limit",
    "location", "application_fee", "selection_process",
    "application_start_date", "last_date", "apply_link",
    "notification_link", "official_website",
]
LISTING_LENGTH_CAPS = {
    "department": 300, "qualification": 4_000, "vacancy": 300, "salary": 1_000,
    "age_limit": 1_000, "location": 500, "application_fee": 1_000,
    "selection_process": 4_000, "description": 10_000, "how_to_apply": 5_000,
    "apply_link": 2_000, "notification_link": 2_000, "official_website": 2_000,
}

# --- scoring weights (hundredths) -------------------------------------------
BASE_SCORE = "0.10"
TRUSTED_SCORE = "0.18"
FACT_SCORES = [
    ("department", "0.08"), ("qualification", "0.08"), ("vacancy", "0.07"),
    ("salary", "0.05"), ("location", "0.05"), ("age_limit", "0.03"),
    ("selection_process", "0.03"), ("how_to_apply", "0.02"),
]
NOTICE_ID_SCORE = "0.09"
LONG_TEXT_SCORE, LONG_TEXT_CHARS = "0.05", 500
LINK_SCORE = "0.12"
DEADLINE_SCORE = "0.16"

# --- identity ------------------------------------------------------------------
CORRIGENDUM_STOP_WORDS = [
    "corrigendum", "correction", "extension", "extended", "last", "date",
    "recruitment", "notification", "advertisement", "advt", "vacancy", "vacancies",
]
CORRIGENDUM_OVERLAP_PERCENT = 60
TRACKING_PARAM = r"^(utm_|fbclid$|gclid$|mc_)"
CORRECTION_TRACKING_PARAM = r"^(utm_.*|fbclid|gclid|dclid|msclkid)$"
NOTICE_ID = (
    r"(?:advertisement|advt\.?|notification|notice)\s*(?:no\.?|number|#)?\s*[:\-]?\s*"
    r"([a-z0-9][a-z0-9/&_.\-]{2,80})"
)
NOTICE_ID_STOP_WORDS = [
    "PUBLISHED", "DATE", "START", "END", "DUE", "LAST", "VIEW", "MORE",
    "DOWNLOAD", "APPLY", "ONLINE", "NOT", "AVAILABLE", "NIL", "N/A",
]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
]

# --- classification ------------------------------------------------------------
RECOGNIZABLE_TITLE = (
    r"\b(?:recruit(?:ment|ing)?|engagement|appointment|vacanc(?:y|ies)|applications?|apprentices?|"
    r"fellowships?|junior research fellow|\bjrf\b|research associate|officers?|managers?|engineers?|"
    r"scientists?|consultants?|assistants?|associates?|clerks?|trainees?|posts?|walk[- ]?in interview for)\b"
)
BARE_TITLE = r"^(?:walk[- ]?in interview|recruitment|vacanc(?:y|ies)|advertisement|notification)$"
UNREADABLE = r"(?:\x{FFFD}|à[¤¥]|ï¿½|â|class\s*=|views-field|next page|last page)"
QUALITY_RESULT_TITLE = (
    r"\b(?:result|call letter|admit card|answer key|marks secured|qualified for interview|"
    r"selected candidates?|provisionally selected|wait ?list|no candidate)\b"
)
RESULT_ONLY_TITLE = (
    r"\b(?:result|marks secured|call letter|admit card|interview schedule|qualified for interview|"
    r"provisionally selected|selected candidates|selected and waitlisted|wait ?list|circle allotment|"
    r"no candidate|nil selection|stands withdrawn)\b"
)
NOTICE_NOISE = (
    r"\b(?:answer keys?|admission certificate|city of examination|exam(?:ination)? schedule|"
    r"exam(?:ination)? date|allocation|cancellation|postponed|representation|response sheet|"
    r"document verification)\b"
)
NOTICE_AMENDMENT = r"\b(?:corrigendum|revised dates?|date extension)\b"
NOTICE_POSITIVE = (
    r"\b(?:recruitment|advertisement|applications? (?:are )?invited|filling up|selection posts?|engagement|"
    r"vacanc(?:y|ies)|notice of .{0,100} examination)\b"
)
API_AMENDMENT = (
    r"\b(?:addendum|corrigendum|revised vacancies?|final vacancies?|date extension|extended date)\b"
)
LISTING_AMENDMENT = (
    r"\b(?:addendum|corrigendum|revised vacancies?|final vacancies?|date extension|"
    r"extended (?:closing|last) date)\b"
)
HTML_AMENDMENT = r"corrigendum|date extension|extended"
DOCUMENT_AMENDMENT = (
    r"\b(?:corrigendum|addendum|extension of (?:the )?(?:closing|last) date|"
    r"(?:closing|last) date (?:has been )?extended|revised (?:closing|last) date)\b"
)
RECRUITMENT_LABEL = (
    r"\b(?:recruitment|notice of|appointment|engagement|applications?|invites?|walk[- ]?in|fellow|officer|"
    r"engineer|apprentice|vacanc(?:y|ies))\b"
)
TRANSIENT_ERROR = (
    r"HTTP (?:429|5\d\d)|aborted|fetch failed|timed out|ECONNRESET|ETIMEDOUT|"
    r"UND_ERR_(?:CONNECT_)?TIMEOUT|socket (?:hang up|closed)"
)
EMAIL_SHAPE = r"^[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+\-]@(?:[A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}$"

# --- pages ----------------------------------------------------------------------
ANCHOR = r"<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>([\s\S]*?)</a>"
JSON_LD_SCRIPT = r"<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>([\s\S]*?)</script>"
PDF_LINK = r"\.pdf(?:/|$|\?)"
DOCUMENT_LINK_WORDS = r"(recruit|vacanc|notification|advertisement|advt|corrigendum|extension|career|job)"
DISCOVERY_TERMS = (
    r"\b(careers?|jobs?|recruitments?|vacanc(?:y|ies)|opportunities|join[-\s]?us|work[-\s]?with[-\s]?us)\b"
)
GENERIC_TITLE = (
    r"^(home|about|contact|careers?|jobs?|recruitment|vacanc(?:y|ies)|latest|details|read more|view more|"
    r"know more(?: about vacancies)?|click here|apply|apply now|apply online|current openings|"
    r"download(?: revised)? advertisement|advertisement|biodata|ctc negotiation format|corrigendum|result)$"
)
JOB_SIGNAL = (
    r"\b(?:recruit(?:ment|ing)?|engagement|vacanc(?:y|ies)|invites?|applications?|apprentices?|fellowships?|"
    r"jrf|research associates?|internships?|officers?|managers?|engineers?|scientists?|consultants?|"
    r"assistants?|associates?|clerks?|trainees?|appointment|posts?|walk[- ]?in|interview|employment|cadre)\b"
)
SUPPORTING_DOCUMENT = (
    r"\b(?:biodata|undertaking|ctc negotiation|acquaint yourself|scribe guidelines?|call letter|result|"
    r"marks secured|interview schedule|list of candidates|provisionally selected)\b"
)
RECRUITMENT_TEXT = (
    r"(recruit|engagement|appointment|applications?|apprentice|fellowship|walk[- ]?in|vacanc|qualification|"
    r"salary|pay scale|last date|closing date|apply|position|post)"
)
CONTEXT_POSITIVE = (
    r"\b(?:recruit(?:ment|ing)?|engagement|appointment|filling up|applications?|invites?|apprenticeship|"
    r"apprentices?|fellowships?|jrf|research associates?|post of|position|walk[- ]?in)\b"
)
NOTICE_NUMBER_PREFIX = r"^(?:advertisement|advt\.?|notification|notice)\s*(?:no\.?|number|#)?\b"
TITLE_TAIL = r"\b(?:ADVERTISEMENT|ADVT\.?|NOTIFICATION)\s*(?:NO\.?|NUMBER|#)\s*[:\-]?"
TITLE_ACTION = r"\s+(?:DOWNLOAD|APPLY ONLINE|APPLY NOW|VIEW MORE)\s*$"
DOWNLOAD_ADVERTISEMENT = r"download(?: revised| old)? advertisement"
SIBLING_DOMAINS = r"(^|\.)sbi\.(?:co\.in|bank\.in)$"
OPEN_ONLY_DOMAINS = SIBLING_DOMAINS
# Sources whose notices are completed from their documents; the first also from their detail pages.
DETAIL_DOMAINS = r"^drdo\.gov\.in$"
API_DOMAIN, API_ORGANISATION = "ssc.gov.in", "Staff Selection Commission"
PAGE_WARNINGS = {
    "no notice": "Page was accessible, but no link had enough recruitment evidence to create a notice.",
    "no link": (
        "SSC returned a client-rendered page shell without notice links. Zero is not evidence that SSC has no notices; "
        "an official data endpoint is required before enabling this source."
    ),
}
ROBOTS_AGENT = "noticebot"
TITLE_DATE = r"\b(\d{1,2}[/.\-]\d{1,2}[/.\-]20\d{2})\b"

# --- notice API ------------------------------------------------------------------
API_TITLE_KEYS = ["title", "headline", "noticeTitle", "noticeHeading", "heading", "subject"]
API_ID_KEYS = ["noticeId", "noticeBoardId", "id", "_id"]
API_DESCRIPTION_KEYS = ["examDescription", "description", "summary"]
API_LAST_DATE_KEYS = ["endDate", "lastDate", "closingDate", "applicationEndDate"]
API_START_DATE_KEYS = ["startDate", "applicationStartDate"]
API_POSTED_KEYS = ["publishedAt", "publishDate", "createdAt"]
API_EXAM_KEYS = ["examName", "examinationName"]
API_ATTACHMENT_KEY = r"file|attachment|document"
API_ATTACHMENT_PATH = "/api/attachment/uploads/masterData/NoticeBoards/"
API_REDIRECT = r"apply|redirect|candidate|application"

# --- labelled values ---------------------------------------------------------------
NEXT_LABELS = (
    r"published date|start date|end date|due date|last date|closing date|salary|pay scale|qualification|"
    r"vacanc(?:y|ies)|location|age limit|application fee|selection process|view more|download|apply online|"
    r"biodata|undertaking|ctc negotiation"
)
LABELS = {
    "department": ("text", r"department|organisation|organization|company"),
    "qualification": ("qualification", r"qualification|education|eligibility"),
    "vacancy": ("vacancy", r"total vacancies|vacancies|vacancy|openings"),
    "salary": ("salary", r"salary|pay scale|pay"),
    "age_limit": ("age", r"age limit|age"),
    "location": ("location", r"job location|location|place of posting"),
    "application_fee": ("fee", r"application fee|fee"),
    "selection_process": ("selection", r"selection process|selection"),
    "application_start_date": ("date", r"start date|application start date"),
    "last_date": (
        "date",
        r"end date|due date|last date(?: to apply)?|closing date|application deadline|apply before",
    ),
    "posted_date": ("date", r"published date|publication date"),
}
LAYOUT_TEXT = (
    r"(?:class\s*=|href\s*=|views-field|content[\"']?>|</?[a-z]|next page|last page|know more about)"
)
PLAUSIBLE = {
    "vacancy": r"\b\d{1,6}\b|\b(?:various|multiple)\b",
    "age": r"\b(?:\d{1,3}\s*(?:years?|yrs?)|age\s*(?:limit|as on)|not exceeding|between\s+\d{1,3})\b",
    "salary": (
        r"(?:₹|\brs\.?\b|rupees?|pay\s*(?:level|scale|matrix)|salary|stipend|remuneration|emoluments?|"
        r"per month|monthly|ctc)"
    ),
    "fee": r"(?:₹|\brs\.?\b|rupees?|\bfee\b|no fee|nil|exempt)",
    "qualification": (
        r"\b(?:graduate|postgraduate|degree|diploma|b\.?e\.?|b\.?tech|m\.?e\.?|m\.?tech|ph\.?d|master|"
        r"bachelor|matric|10th|12th|iti|education|qualification|experience)\b"
    ),
    "selection": (
        r"\b(?:interview|examination|exam|test|merit|shortlist|screening|selection|document verification)\b"
    ),
}

# --- long documents -------------------------------------------------------------------
COMMON_STOPS = (
    r"general (?:conditions|instructions)|(?:upper )?age limit|how to apply|selection (?:process|procedure)|"
    r"application fee|closing date|last date|important dates|tenure|note|place of posting"
)
# field: (labels, stop labels, length cap)
SEGMENTS = {
    "qualification": (
        r"essential qualifications?|minimum (?:educational )?qualifications?|educational qualifications?|"
        r"eligibility criteria",
        COMMON_STOPS,
        420,
    ),
    "salary": (
        r"salary|pay scale|scale of pay|remuneration|emoluments?|stipend",
        r"(?:upper )?age limit|qualification|eligibility|how to apply|selection (?:process|procedure)|"
        r"application fee|closing date|last date|tenure|note|general (?:conditions|instructions)",
        240,
    ),
    "age_limit": (
        r"age limit|upper age limit|maximum age|minimum age",
        r"how to apply|selection (?:process|procedure)|application fee|closing date|last date|tenure|note|"
        r"general (?:conditions|instructions)",
        260,
    ),
    "location": (r"place of posting|job location|location|posting at", COMMON_STOPS, 180),
    "application_fee": (
        r"application fee|examination fee|fee payable",
        r"how to apply|selection (?:process|procedure)|closing date|last date|important dates|note|"
        r"general (?:conditions|instructions)",
        220,
    ),
    "selection_process": (
        r"selection process|selection procedure|mode of selection",
        r"how to apply|application fee|closing date|last date|important dates|"
        r"general (?:conditions|instructions)|note",
        420,
    ),
    "how_to_apply": (
        r"how to apply|application procedure|procedure to apply",
        r"selection (?:process|procedure)|application fee|closing date|last date|important dates|"
        r"general (?:conditions|instructions)|note",
        600,
    ),
}
# field: (characters of the value that must hold the evidence, evidence)
SEGMENT_EVIDENCE = {
    "qualification": (
        180,
        r"\b(?:10th|12th|iti|graduate|post[ -]?graduate|degree|diploma|b\.?e\.?|b\.?tech|m\.?e\.?|m\.?tech|"
        r"ph\.?d|master|bachelor|net|gate|education|qualification)\b",
    ),
    "salary": (
        240,
        r"(?:₹|\brs\.?\b|rupees?|pay\s*(?:level|scale|matrix)|salary|stipend|remuneration|emoluments?|"
        r"per month|monthly)",
    ),
    "age_limit": (
        240,
        r"\b(?:\d{1,3}\s*(?:years?|yrs?)|(?:age\s*(?:limit|as on)|not exceeding|between|min(?:imum)?\.? age|"
        r"max(?:imum)?\.? age)\D{0,35}\d{1,3}|\d{1,3}\s*(?:-|to)\s*\d{1,3}\s*(?:years?|yrs?)?)\b",
    ),
    "location": (
        240,
        r"\b(?:delhi|mumbai|kolkata|hyderabad|bengaluru|bangalore|chennai|kochi|mysuru|kanpur|ahilyanagar|"
        r"india|state|city|posting|laboratory|lab|office)\b",
    ),
    "application_fee": (240, r"(?:₹|\brs\.?\b|rupees?|\bfee\b|no fee|nil|exempt)"),
    "selection_process": (
        240,
        r"\b(?:interview|examination|exam|test|merit|shortlist|screening|document verification)\b",
    ),
    "how_to_apply": (
        240,
        r"\b(?:apply|application|submit|send|email|online|offline|prescribed form)\b",
    ),
}
COUNTED_THINGS = r"(?:vacanc(?:y|ies)|posts?|positions?|fellowships?|seats?)"
VACANCY_COUNTS = [
    r"\btotal\s+(?:(?:number|no\.?)\s+of\s+)?(?:the\s+)?" + COUNTED_THINGS
    + r"\s*(?:is|are|:|-)?\s*(\d{1,5})\b",
    r"\b(?:number|no\.?)\s+of\s+(?:the\s+)?" + COUNTED_THINGS + r"\s*(?:is|are|:|-)?\s*(\d{1,5})\b",
    r"\b" + COUNTED_THINGS + r"\s*(?:is|are|:|-)\s*(\d{1,5})\b",
    r"\b(?:vacanc(?:y|ies)|posts?|positions?|fellowships?)\s+(\d{2,5})\b",
]
DOCUMENT_DATE = (
    r"(?:\d{1,2}(?:st|nd|rd|th)?[/.\-]\d{1,2}[/.\-]20\d{2}|\d{1,2}(?:st|nd|rd|th)?\s+"
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
    r"Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+20\d{2})"
)
START_DATE_LABELS = r"opening date|application start date|start date|online application begins"
LAST_DATE_LABELS = (
    r"last date|closing date|application deadline|apply before|"
    r"closing date of receipt of applications(?: is)?"
)
ORGANISATION_HEADING = (
    r"\b([A-Z][A-Z0-9 &(),.'/\-]{5,}?(?:LABORATORY|ORGANISATION|ORGANIZATION|COMMISSION|BANK OF INDIA))\b"
)
APPLY_URL = r"https?://[^\s)\]>]+"
APPLY_CONTEXT = r"\b(?:apply online|online application|submit applications?|candidate portal)\b"
APPLY_URL_WORDS = r"\b(?:apply|application|recruitment|candidate[-_/]?portal|ibps)\b"
WEAK_DOCUMENT_TITLE = (
    r"^(?:walk[- ]?in interview|recruitment|vacanc(?:y|ies)|advertisement|notification|"
    r"of vacancies?\b|actual number of vacancies?\b)"
)
BROKEN_TITLE_TEXT = r"(?:\x{FFFD}|à[¤¥]|ï¿½|â|Â)"
TABLE_TITLE = (
    r"\b(?:actual number of vacancies|vacancies may vary|no\.? of vacancies|discipline|"
    r"general instructions?|eligibility criteria|selection procedure)\b"
)
STRONG_TITLE = (
    r"\b(?:recruitment of|advertisement for|applications? (?:are )?invited|invites? applications?|"
    r"engagement of|appointment to|walk[- ]?in interview for|junior research fellow|research associate|"
    r"apprentices?)\b"
)
HEADING_STARTS = (
    r"\b(?:(?:advertisement|notification)\s+for\s+(?:the\s+)?"
    r"(?:recruitment|selection|engagement|award|appointment)|recruitment\s+of|"
    r"applications?\s+(?:are\s+)?invited)\b"
)
HEADING_STOP = (
    r"\s+(?:advertisement|advt\.?|notification)\s*(?:no\.?|number|#)|"
    r"\s+(?:essential|educational|minimum)\s+qualifications?|\s+eligibility criteria|"
    r"\s+general (?:conditions|instructions)|\s+part[- ]?\d+|\.\s+"
)
GENERIC_LISTING_TITLE = r"^(?:walk in interview|recruitment|vacancies|advertisement|notification)$"

# --- field cleaning ------------------------------------------------------------------------
# (broken sequence, repaired text)
MOJIBAKE_REPAIRS = [
    (r"â\x{0082}¹", "₹"),
    (r"â\x{0080}¢", " "),
    (r"â\x{0080}[\x{0093}\x{0094}]", "-"),
    (r"â\x{0080}[\x{0098}\x{0099}]", "'"),
    (r"â\x{0080}[\x{009c}\x{009d}]", '"'),
    (r"â\x{0080}¦", "..."),
    (r"[^ ]*(?:\x{FFFD}|à[¤¥]|ï¿½)[^ ]*", " "),
    (r"Â", " "),
    (r"\\([.@/])", "$1"),
]
RESIDUAL_MOJIBAKE = r"(?:\x{FFFD}|à[¤¥]|ï¿½|â[\x{0080}-\x{00bf}]|Â)"
EDUCATION = (
    r"\b(?:10th|12th|matric|iti|ncvt|scvt|graduate|post[ -]?graduate|b\s*\.\s*e\.?|b\s*\.\s*tech|"
    r"m\s*\.\s*e\.?|m\s*\.\s*tech|ph\s*\.\s*d|degree|diploma|master|bachelor|net|gate)\b"
)
BEFORE_EDUCATION = (
    r"(?:date|time|walk[- ]?in|anticipated|name of the post|vacanc|discipline|experience)"
)
QUALIFICATION_CUTS = [
    r"\s+(?:date\s*&\s*time|date and time) of walk[- ]?in",
    r"\s+(?:selection (?:process|procedure)|general (?:conditions|instructions)|how to apply|"
    r"application procedure|age limit|upper age limit|salary|stipend)\b",
    r"\s+\d{1,2}[./-]\d{1,2}[./-]20\d{2}\b",
]
NUMBERED_HEADING_CUT = r"\s+\d{1,2}\s*\.\s+[A-Z]"          # case sensitive
SALARY_CUTS = [
    r"\s+(?:any additional information|education(?:al)? qualification|upper age limit|age limit|"
    r"contingency grant|general (?:conditions|instructions))\b",
    r"\s+\([ivx]+\)\s+(?:education|age|nationality)\b",
]
NARRATIVE_CUTS = [
    r"\s+(?:duration|period)\s+of\s+(?:internship|engagement|training)\b",
    r"\s+(?:location|place)\s+of\s+(?:internship|engagement|training|work)\b",
    r"\s+\b(?:selected students?|joining procedures?|joining formalities?)\b",
]
BULLET_CUT = r"\s+\b[a-h]\.\s+[A-Z]"                       # case sensitive
AGE_CUTS = [
    r"\s+(?:nationality|selection (?:process|procedure)|how to apply|application procedure|"
    r"general (?:conditions|instructions)|candidates who are not|no ta/da)\b",
    r"\s+\([ivx]+\)\s+(?:nationality|selection|application)\b",
    r"\s+(?:[a-z][.)]\s+)?(?:selected students?|joining procedures?|caste certificate|application form)\b",
]
SELECTION_CUTS = [
    r"\s+(?:application procedure|how to apply|general (?:conditions|instructions)|appendix|no ta/da)\b",
]
VACANCY_VALUE = r"^(?:\d{1,6}|various|multiple)$"
SINGLE_VACANCY = (
    r"\b(?:total(?: number)? of vacanc(?:y|ies)|total vacanc(?:y|ies)|number of vacanc(?:y|ies)|"
    r"no\.? of vacanc(?:y|ies))\s*(?::|-|is)\s*0*1\b"
)
PAY_TABLE = (r"\btotal vacanc(?:y|ies)\b", r"^\(?rs\.?\)?\s*\d+\s*[.)]")
AMOUNT = (
    r"(?:₹\s*\.?\s*[\d,]+(?:\.\d+)?|\brs\.?\s*\.?\s*[\d,]+(?:\.\d+)?|rupees?\s*[\d,]+|"
    r"\bpay\s*(?:level|scale|matrix)\s*[-:]?\s*\d+|"
    r"\b(?:salary|stipend|emoluments?|remuneration)\D{0,25}\d[\d,]*)"
)
OPEN_AGE_REFERENCE = r"\bas on(?:\s+the)?\s*$"
AGE_EVIDENCE = SEGMENT_EVIDENCE["age_limit"][1]
FEE_EVIDENCE = PLAUSIBLE["fee"]
NAVIGATION = (
    r"\b(?:search here|home organisation|about drdo|our team|technology clusters|corporate clusters|"
    r"offerings|schemes and services|industry support)\b",
    r"\b(?:search here|about drdo|our team|technology clusters|corporate clusters|schemes and services|"
    r"industry support)\b",
)
SELECTION_START = r"\bselection\s*(?:process|procedure|method)?\s*[:\-]?"
APPLICATION_START = r"\b(?:application procedure|how to apply)\b"
SELECTION_EVIDENCE = SEGMENT_EVIDENCE["selection_process"][1]
TITLE_PREFIX = r"^([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)?)(?:,\s+|\s+[-–]\s+)"
TITLE_PREFIX_STOP = r"^(?:THE|POST|JOB|NOTICE|ADVT?)$"
NO_LOCATION = r"^(?:not specified|n/a|na)$"
CITIES = [
    "Bengaluru", "Bangalore", "Chennai", "Hyderabad", "Kochi", "Mysuru", "Mysore",
    "Ahilyanagar", "Delhi", "Mumbai", "Kolkata", "Pune", "Bhopal", "Jaipur", "Lucknow",
    "Kanpur", "Gurugram", "Noida", "Visakhapatnam", "Thiruvananthapuram",
]
CITY_RENAMES = {"bangalore": "Bengaluru", "mysore": "Mysuru"}
FIELD_CAPS = {
    "title": 240, "qualification": 420, "salary": 220, "age_limit": 240,
    "application_fee": 200, "department": 180, "location": 180,
    "selection_process": 360, "description": 2_000, "how_to_apply": 800,
}

# --- messages ------------------------------------------------------------------------------
SCORE_REASONS = {
    "trusted": "trusted official source",
    "untrusted": "untrusted source requires review",
    "text": "substantial official source text found",
    "future": "future application deadline found",
    "past": "deadline has passed",
    "none": "application deadline not reliably found",
    "draft": "saved as draft unless manually verified",
}
QUALITY_REASONS = {
    "title": "The notice does not yet have a recognizable recruitment title.",
    "layout": "One or more extracted fields contain unreadable or page-layout text.",
    "expired": "The official application deadline has passed.",
    "result": "Result, admit-card, call-letter, or other non-recruitment item.",
    "url": "No stable official notice or apply URL was found.",
    "text": "Not enough official recruitment text was found; manual review required.",
    "pass": "Official recruitment notice passed the draft quality gate; it remains unverified.",
    "amendment": "Amendment-only notice has no matching persistent Job; it cannot become a new Job.",
}
DRAFT_REASONS = {
    "locked": "Manual draft creation is locked by the server environment.",
    "identity": "The review identity is incomplete or invalid.",
    "allowed": "Eligible for an explicit admin-approved DRAFT only.",
}
ITEM_REASONS = {
    "failed": "Source collection failed; remaining sources continued",
    "unchanged": "Source and linked notification content is unchanged since the last successful write run",
    "published": "Trusted high-confidence source was eligible for publishing",
    "metrics": "V5 collection metrics",
    "matched": "Matched by ",
    "same": "; no supported field changed",
    "updated": "Updated: ",
    "would update": "Would update: ",
}
METRICS_SOURCE_NAME = "Run metrics"
STALE_RUN_MESSAGE = "Run exceeded its lock lease and was marked failed during recovery."
MATCH_KINDS = [
    "source job ID", "corrigendum title/source", "official apply URL",
    "notification URL", "source fingerprint", "title/department/location/date",
]
METADATA_TAIL = "Official notification, eligibility and application details."
STATIC_PAGES = [  # (path, change frequency, priority)
    ("", "daily", 1.0), ("/jobs", "daily", 0.9), ("/government-jobs", "daily", 0.9),
    ("/private-jobs", "daily", 0.9), ("/about", "monthly", 0.5), ("/contact", "monthly", 0.5),
    ("/privacy-policy", "monthly", 0.5), ("/terms", "monthly", 0.5),
    ("/disclaimer", "monthly", 0.5), ("/job-alerts", "monthly", 0.5),
]
