"""Fixed values.

Everything in this module is a fixed value: word lists, patterns, formats,
limits and lookup tables whose exact content decides the results.
"""

# --- search and comparison keys -------------------------------------------
VOWEL_POINT_RANGE = (0x0591, 0x05C7)
FINAL_LETTERS = "ךםןףץ"
PLAIN_LETTERS = "כמנפצ"
SEARCH_PUNCTUATION = "\"'`׳״.,-–—()[]/\\"
DIRECTION_MARKS = "‎‏‪‫‬‭‮"
DOUBLE_QUOTES = "\"״“”„«»"
SINGLE_QUOTES = "’׳"
LONG_DASHES = "–—―"
STEM_PREFIX_LETTERS = "הבלמכוש"

# --- typography -------------------------------------------------------------
BANNED_DASHES = "—–―‒⸻⸺"
BANNED_SINGLE_QUOTES = "‘’"
BANNED_DOUBLE_QUOTES = "“”"
FORBIDDEN_CHARACTERS = {
    "—": "EM DASH (—)",
    "–": "EN DASH (–)",
    "―": "HORIZONTAL BAR (―)",
}

# --- preservation check -----------------------------------------------------
PARAGRAPH_MATCH_THRESHOLD = 0.95
NEAR_MATCH_THRESHOLD = 0.80
SAME_TEXT_THRESHOLD = 0.999
DRIFT_TOLERANCE = 0.10
QUOTE_MIN_CHARS = 12
QUOTE_MIN_WORDS = 4
ALLOWED_CONNECTORS = [
    "בנוסף,",
    "בנוסף לאמור,",
    "לעניין זה,",
    "מנגד,",
    "כפי שצוין לעיל,",
    "ראו לעניין זה,",
    "מן הכלל אל הפרט,",
    "ובענייננו,",
    "סיכומו של דבר,",
    "אכן,",
    "יחד עם זאת,",
    "נקדים ונציין כי,",
    "ודוק,",
    "נחדד כי,",
    "היינו,",
    "ללמדך כי,",
    "הנה כי כן,",
    "דא עקא,",
    "למעלה מן הצורך,",
    "טרם סיום נבקש לציין כי,",
]
OPERATIVE_MARKERS = [
    "סוף דבר",
    "סיכומו של דבר",
    "אשר על כן אנו מחליטים",
    "אשר על כן, אנו מחליטים",
    "לסיכום",
    "התוצאה",
]
LEGAL_REFERENCE_PATTERNS = [
    r'עע"?מ\s*\d+/\d+',
    r'בג"?ץ\s*\d+/\d+',
    r'רע"?א\s*\d+/\d+',
    r'ע"?א\s*\d+/\d+',
    r'ע"?פ\s*\d+/\d+',
    r'עת"?מ\s*\d+/\d+',
    r'ערר\s*\d+/\d+',
    r'ה"?פ\s*\d+/\d+',
    r'סעיף\s+\d+[א-ת]?(?:\([^)]{1,6}\))*\s+לחוק',
    r'תקנה\s+\d+[א-ת]?\s+לתקנות',
    r'תב"?ע\s*[א-ת]{0,3}[/\-]?\d+',
    r'תכנית\s+[א-ת]{1,4}[/\-]\d+[א-ת]?',
    r'מי[/\-]\d+[א-ת]?',
]
SEVERITY_ORDER = ["DOUBLE_RED", "RED", "ORANGE", "GREEN"]

# --- detectors --------------------------------------------------------------
DETECTOR_PATTERNS = {
    "PHONE": r"(?:\+?972[-\s.]?|0)(?:\d[-\s.]?){7,9}\d",
    "EMAIL": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "IBAN": r"(?i)IL\d{2}(?:[\s]?\d){16,20}",
    "CREDIT_CARD": r"\b\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{2,4}\b",
    "CAR_PLATE": r"\b\d{2,3}-\d{2,3}-\d{2,3}\b",
    "DATE": r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b",
    "ISRAELI_ID": r"\d{5,9}",
}
ID_LABEL_PATTERN = "(זהות|תעודת|ת[\"״'.\\s]?ז|ז[\"״'.\\s]?ת)"
ID_LABEL_REACH = 18
PHONE_MIN_DIGITS = 9
IDENTITY_TYPES = ["name", "id", "address", "account"]
IDENTITY_CATEGORIES = ["NAME", "ID", "ISRAELI_ID", "ADDRESS", "ACCOUNT", "MANUAL"]
IDENTITY_MIN_LENGTH = 4
PUBLIC_ALLOW_LIST = [
    "04-8812345",
    "02-6755594",
    "073-3927788",
    "6050",
    "1-222-6050",
    "*6050",
    "www.btl.gov.il",
]
ENTITY_MATCH_THRESHOLD = 0.82
ENTITY_MAX_WORDS = 8
ALLOW_OVERLAP = 0.5
DEDUPE_OVERLAP = 0.6
MASK_OVERLAP = 0.3
MASK_CHARACTER = "█"

# --- appendix references and labels ----------------------------------------
APPENDIX_PATTERNS = [
    ("A", r"מצ\"ב\s*ומסומ[נן](?:ת|ים|ות)?\s*(?:יחדיו\s*)?נספח\s*([א-ת]{1,2}['])"),
    ("A", r"מצ\"ב\s*ומסומ[נן](?:ת|ים|ות)?\s*(?:יחדיו\s*)?נספח\s*(\d+)"),
    ("A", r"מסומ[נן](?:ת|ים|ות)?\s*כנספח\s*([א-ת]{1,2}['])"),
    ("A", r"מסומ[נן](?:ת|ים|ות)?\s*כנספח\s*(\d+)"),
    ("A", r"ומסומ[נן](?:ת|ים|ות)?\s*כנספח\s*([א-ת]{1,2}['])"),
    ("A", r"ומסומ[נן](?:ת|ים|ות)?\s*כנספח\s*(\d+)"),
    ("A", r"ראו\s*נספח\s*([א-ת]{1,2}['])"),
    ("A", r"ראו\s*נספח\s*(\d+)"),
    ("A", r"ר[']\s*נספח\s*([א-ת]{1,2}['])"),
    ("A", r"נספח\s+([א-ת]{1,2}['])\s+הנ\"ל"),
    ("A", r"נספח\s+(\d+)\s+הנ\"ל"),
    ("A", r"בנספח\s*([א-ת]{1,2}['])"),
    ("A", r"בנספח\s*(\d+)"),
    ("B", r"מצ\"ב\s*ומסומ[נן](?:ת|ים|ות)?\s*(?:יחדיו\s*)?([א-ת]{1,2}['])"),
    ("B", r"ומסומ[נן](?:ת|ים|ות)?\s*(?:יחדיו\s*)?([א-ת]{1,2}['])"),
    ("C", r"נספח\s*([א-ת]{1,2}['])"),
    ("C", r"נספח\s*(\d+)"),
]
APPENDIX_FALSE_POSITIVES = ["עמ'", "עמ", "תוכן", "תוכן'"]
APPENDIX_CONTEXT = 50
APPENDIX_LETTER_PATTERN = r"נספח\s+[א-ת]{1,2}[']"
APPENDIX_NUMBER_PATTERN = r"נספח\s+\d+"
APPENDIX_LETTERS = [
    "א'", "ב'", "ג'", "ד'", "ה'", "ו'", "ז'", "ח'", "ט'", "י'",
    "יא'", "יב'", "יג'", "יד'", "טו'", "טז'", "יז'", "יח'", "יט'", "כ'",
    "כא'", "כב'", "כג'", "כד'", "כה'", "כו'", "כז'", "כח'", "כט'", "ל'",
]

# --- pages, units, quality --------------------------------------------------
PAGE_MARKER = r"=====\s*PAGE\s+(\d+)\s*====="
UNIT_PAGE_MARKER = r"(?m)^=+\s*עמוד\s+\d+\s*=+\s*$"
UNIT_CHARS = 3500
READ_LIMIT_CHARS = 24000
VISION_MIN_CHARS = 30
TEXT_PAGE_CHARS = 20
TEXT_RATIO_HIGH = 0.8
TEXT_RATIO_LOW = 0.2
PAGE_CONFIDENCE_THRESHOLD = 75.0
MIN_MEAN_CONFIDENCE = 60.0
MIN_CHARS_PER_PAGE = 80
MIN_VALID_CHAR_RATIO = 0.75
VALID_CHARACTERS = r"[֐-׿A-Za-z0-9\s\.\,\;\:\!\?\(\)\[\]\{\}\-\–\"'\/\\%&@#\*\+=°₪$]"
INTERNAL_FOLDERS = ["__pycache__", ".git", "_ocr_out", ".DS_Store"]
DERIVED_EXTENSIONS = [".md", ".txt", ".tsv", ".json"]
DROP_EXTENSIONS = ["plugin", "skill"]

# --- writing metrics --------------------------------------------------------
WRITING_PHRASES = {
    "roadmap": [
        "נקדים", "ונפרט;", "בטרם נפנה", "נפנה עתה", "נזכיר כי", "מן הכלל אל הפרט",
        "כפי שנפרט להלן", "נדון גם בכל אחת",
    ],
    "not_deciding": [
        "איננו נדרשים", "אין צורך להכריע", "איננו קובעים מסמרות", "למעלה מן הצורך",
        "אין אנו נדרשים", "לא נקבע מסמרות",
    ],
    "interim": [
        "מצטרף למסקנתנו", "אף מטעם זה", "גם בכך יש תמיכה", "מחזקת את מסקנתנו",
        "מסקנתנו עומדת בעינה", "מצטרפת לתמונה", "מצטרף לתמונה",
    ],
    "source_hedge": [
        "אין זו הלכה", "ולא הלכה", "אינו הלכה", "אינו פסק דין", "מעמדו של המסמך",
        "נאמרו אמנם למעלה",
    ],
    "concede": [
        "אינה מבוטלת", "יש משקל של ממש", "יש ממש בחלק", "אכן, המליאה", "אכן, איננו מתעלמים",
    ],
}
WRITING_WORDS = {"leil": "לעיל", "achen": r"(^|\s)אכן[ ,]"}
RESTATE_PATTERN = (
    "^(העוררת טוענת|המשיבות טוענות|המועצה טוענת|הוועדה המקומית טוענת|לטענת "
    "|המשיבות מבקשות|המועצה מבקשת|העוררת מבקשת)"
)
WRITING_LIMITS = {
    "words": 4000, "headings": 3, "roadmap": 0, "not_deciding": 1, "interim": 1, "source_hedge": 0,
    "concede": 0, "leil": 3, "achen": 3, "restate": 2, "scattered": 2,
}
SCATTER_GAP = 4
# terms whose places in a text are followed, and those that naturally run through all of it
WRITING_TERMS = r"סעיף \d+(?:\.\d+)*[א-ת]?(?:\([^)]{1,4}\))*|התכנית הכוללנית|תנאי \d+|\d+ עד \d+ בקשות|עניין [א-ת\"']{3,}"
WRITING_FRAME_TERMS = ["סעיף 62", "סעיף 62א", "סעיף 62א(א)"]

# --- instructions -----------------------------------------------------------
INSTRUCTION_REWRITE = ["תנסח מחדש", "תערוך", "נסח מחדש"]
INSTRUCTION_EXPAND = ["תרחיב", "הרחב"]
INSTRUCTION_MOVE = ["תכניס לתוך", "הפנה"]
INSTRUCTION_ADD = ["פה אני רוצה שנוסיף", "תוסיף"]
INSTRUCTION_WRITE = ["תנסח", "תכתוב", "נסח", "כתוב"]
INSTRUCTION_LABELS = {
    "rewrite_expand": "ניסוח מחדש + הרחבה",
    "rewrite": "ניסוח מחדש",
    "expand": "הרחבה",
    "move": "הפניה / הכנסה לסעיף אחר",
    "add": "הוספת תוכן ספציפי",
    "write": "כתיבה חדשה מאפס",
    "other": "אחר / כללי",
}

# --- statute markup ---------------------------------------------------------
MARKUP_DROPPED = [
    "ח:התחלה", "ח:סוף", "ח:סוגר", "ח:מפריד", "ח:פתיח-התחלה", "ח:פתיח-סוף",
    "ח:מבוא", "ח:חתימות", "ח:מאגר", "ח:סוף-טור", "ח:טור", "ח:ת",
]
MARKUP_INDENTS = {"ח:תת": 1, "ח:תתת": 2, "ח:תתתת": 3, "ח:תתתתת": 4, "ח:תתתתתת": 5}
MARKUP_FIRST_ARGUMENT = ["ח:כותרת", "ח:תיבה"]
MARKUP_LAST_ARGUMENT = ["ח:פנימי", "ח:חיצוני"]
MARKUP_HEADING = r"ח:קטע[2-5]"
MARKUP_SECTION = r"ח:סעיף\*?"
MARKUP_NOTE = "ח:הערה"
MARKUP_BLOCK_START = r"^\{\{(ח:סעיף\*?|ח:קטע[2-5])\|?"
MARKUP_NAMED_ARGUMENT = r"[\w֐-׿\- ]+="
# what is cleaned from rendered markup, in this order: bold, italics, tags, trailing blanks, empty lines
MARKUP_CLEANING = [
    (r"(?s)'''(.+?)'''", "$1"),
    (r"(?s)''(.+?)''", "$1"),
    (r"<[^>\n]{0,80}>", ""),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
]
SOURCE_URL = "https://he.wikisource.org/wiki/"
FRESH_DAYS = 7
NEAR_SECTION_LIMIT = 30

# --- case tables ------------------------------------------------------------
SUBFOLDER_KIND = 77
MAX_FOLDER_DEPTH = 12
CLOSED_STATUS = "סגור"
SIMILAR_MIN = 0.5
SIMILAR_GUARD = 0.6
SIMILAR_LIMIT = 5
TITLE_MAX = 99
DOCS_FOLDER = "tmpDocs"
TORT_VALUE_ITEMS = ["nzSueTotal", "nzSueReal", "nzSueOutcome", "nzRisk"]
# case type -> (opening node, opening caption, has value rows)
CASE_TYPES = {
    22: (38, "פתיחת תיק", True),
    20: (38, "פתיחת תיק", True),
    98: (38, "פתיחת תיק", True),
    102: (38, "פתיחת תיק", True),
    24: (57, "כללי", False),
}
# kind -> (type, product, colour, alarm minutes)
EVENT_TEMPLATES = {
    14: ("cal", 3, 7, 30),
    3: ("cal", 4, 16, 0),
    4: ("cal", 3, 4, 30),
    11: ("cal", 3, 1, 0),
    7: ("task", 2, None, 10),
    15: ("call", 5, None, 10),
    39: ("note", None, None, 0),
    66: ("note", None, None, 0),
    52: ("damage", 8, None, 0),
}
# group -> (type, product, colour, alarm minutes)
GROUP_TEMPLATES = {2: ("cal", 3, 4, 30), 5: ("cal", 3, 7, 30)}
EVENT_MINUTES = 30
# Minutes after midnight at which an event and a task begin unless told otherwise.
EVENT_START, TASK_START = 540, 480
DAMAGE_DEFAULT = "250.00"
BACKUP_TABLE_PATTERN = "_ts$|_Bak|_BAK|_ORG|_FUT|^aaa$|^AAA"
TOKEN_MINUTES = 15

# --- holdings ---------------------------------------------------------------
STALE_DAYS = 90
# how a citing case treats a decision: those that count against it, and the others
NEGATIVE_TREATMENTS = ["אובחן", "צומצם", "נדחה"]
PLANTED_TEXT = [
    "ההתיישבות העותומנית [נוסח ישן] 1916",
    "12-34-56-78 צ'כוב נ' מדינת ישראל, פ'ד נא (2)",
    "הועתק מנבו",
    "בעניין עריכה ושינויים במסמכי פסיקה, חקיקה ועוד באתר נבו – הקש כאן",
]
AUTHORITY_TIERS = [(1, "approved"), (2, "pending"), (3, "unverified")]

# --- rubric (item, lowest answer code, points) ------------------------------
RUBRIC_MAX_POINTS = {
    "attention": 3, "impulsive": 3, "learning": 3, "conduct": 3, "sleep": 1, "substance": 3,
    "framework": 2, "academic": 3, "social": 3, "comorbidity": 3, "medication": 2, "follow_up": 1,
    "therapies": 1,
}
RUBRIC_BANDS = [(0, 9, 0), (10, 18, 50), (19, 31, 100)]
CRITERIA_POINTS = [(0, 5, 0), (6, 6, 1), (7, 7, 2), (8, 9, 3)]
PERMANENT_AGE = 14
TEMPORARY_YEARS = 2

# --- fee caps ---------------------------------------------------------------
FEE_MONTHS = 60
OPENING_FEE = "961.00"
LOW_BASE = "1440.00"
# service -> percent under tables a, b, c
PENSION_PERCENT = {
    "claim_only": ("10.25", "11.25", "12.25"),
    "claim_and_committee": ("12.75", "13.75", "15.00"),
    "claim_and_committee_work_injury_20": ("14.75", "15.75", "17.00"),
    "labor_court_with_claim": ("23.00", "24.00", "25.50"),
    "labor_court_without_claim": ("11.00", "12.00", "13.50"),
}
# service -> percent with the opening fee, percent without
GRANT_PERCENT = {
    "claim_work_injury_9_19": ("13.00", "14.00"),
    "claim_and_committee_work_injury_9_19": ("16.00", "17.00"),
}
FIXED_FEES = {
    "injury_allowance": "1922.00",
    "severe_disability": "1922.00",
    "vocational_rehab": "1922.00",
    "mobility_loan": "961.00",
}

# --- document classes -------------------------------------------------------
# class -> phrases that mark it
DOCUMENT_CLASSES = {
    "מסמכי ערר": ["כתב ערר", "כתב תשובה", "שומה נגדית", "שומת מקרקעין", "תגובת העורר", "תגובת המשיבה"],
    "מסמכים מנהליים": ["בקשה להארכת מועד", "בקשה לפטור", "החלטת ביניים", "הזמנה לדיון", "טיוטת החלטה", "הודעה על"],
    "פרוטוקולים": ["פרוטוקול"],
    "רפואי": ["סיכום ביקור", "שחרור מבית חולים", "תעודת מחלה", "חוות דעת רפואית"],
    "ביטוח לאומי": ["ועדה רפואית", "פקיד תביעות", "נכות כללית", "אבטלה"],
    "מעסיק ועבודה": ["תלוש שכר", "מכתב פיטורים", "שימוע", "טופס 161"],
    "בית דין / בית משפט": ["כתב תביעה", "כתב הגנה", "פסק דין"],
    "רשויות נוספות": ["מס הכנסה", "הוצאה לפועל", "משטרה"],
    "אישי ופיננסי": ["תעודת זהות", "דפי בנק", "חוזה שכירות"],
    "התכתבויות": ["דואר אלקטרוני", "מסרון"],
}
CLASS_FOLDERS = {
    "מסמכי ערר": "מסמכי ערר", "מסמכים מנהליים": "מסמכים מנהליים", "פרוטוקולים": "פרוטוקולים",
    "רפואי": "01 - רפואי", "ביטוח לאומי": "02 - ביטוח לאומי", "מעסיק ועבודה": "03 - מעסיק ועבודה",
    "בית דין / בית משפט": "04 - בית דין / בית משפט", "רשויות נוספות": "05 - רשויות נוספות",
    "אישי ופיננסי": "06 - אישי ופיננסי", "התכתבויות": "07 - התכתבויות",
}

# --- questions and forms ----------------------------------------------------
QUESTION_MAX = 200
# the template whose question may name a court
COURT_TEMPLATE = 1
# template -> passages asked of case law, statutes, literature; analyse query; rerank
QUESTION_TEMPLATES = {
    1: (3, 5, 0, False, True),
    2: (4, 2, 1, False, True),
    3: (4, 3, 1, False, True),
    4: (3, 3, 2, False, True),
    5: (4, 3, 1, False, True),
    6: (3, 1, 3, True, True),
    7: (2, 4, 1, False, True),
    8: (3, 3, 0, False, True),
    9: (4, 2, 1, False, True),
    10: (4, 2, 1, False, True),
    11: (3, 2, 2, False, True),
    12: (6, 0, 0, True, False),
}
RESERVED_QUESTION_SUFFIX = "__more"
RESERVED_CHAPTER = "zz_completion"
QUESTION_TYPES = ["text", "long", "date", "number", "yesno", "choice", "multi"]
OPTION_TYPES = ["choice", "multi"]
CHECKED, UNCHECKED = "☒", "☐"
PLACEHOLDER_PATTERN = r"\$\{(\w+)\}"
CHECKBOX_PREFIX = "chk_"
CHECKBOX_GROUPS = {
    "דחיפות ההליך": ["chk_urgency_regular", "chk_urgency_urgent", "chk_urgency_emergency"],
    "מהות הסיוע": [
        "chk_aid_appeal", "chk_aid_consulting", "chk_aid_additional_ni", "chk_aid_additional_other", "chk_aid_none",
    ],
    "תקינות הקשר": ["chk_contact_ok", "chk_contact_bad"],
    "מיצוי זכויות": ["chk_no_additional", "chk_additional_ni", "chk_additional_other"],
}
