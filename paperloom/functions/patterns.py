"""Patterns, word lists and replacement tables that results depend on.

Patterns are written for Java's dialect as ``rx`` completes it and are also
valid for Python's ``re``; flags are given by name where they are used.
"""

# Metadata extraction
URL = r"(?:https?|ftp)://\S+|www\.\S+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
HEADING_LINES = (
    ("", r"\A[A-Z][A-Z\s]{5,}$"),
    ("i", r"\A(?:Chapter|Section|Part)\s+\d+[:\s]"),
    ("", r"\A\d+\.\s+[A-Z][a-zA-Z\s]{3,}$"),
    ("", r"\A\d+\.\d+\s+[A-Z][a-zA-Z\s]{3,}$"),
)
TOC = (("i", r"table\s+of\s+contents"), ("", r"\.{3,}"), ("m", r"^\d+\.\d+\s+.+\s+\d+\s*$"))

# Stand-alone normaliser
HYPHEN_BREAK = r"(\w+)-\s*\n\s*(\w+)"
HYPHEN_BREAKS = r"(\w+)-\s*\n+\s*(\w+)"
SPACES = r"[ \t]+"
BLANK_LINES = r"\n\s*\n\s*\n+"
PAGE_NUMBER_LINES = (("m", r"^\s*-?\s*\d+\s*-?\s*$"), ("mi", r"^\s*Page\s+\d+\s*$"), ("mi", r"^\s*\d+\s+of\s+\d+\s*$"))
HEADER_LINES = (("mi", r"^\s*(?:confidential|proprietary|draft|internal use only)\s*$"), ("m", r"^\s*©\s*\d{4}.*$"), ("m", r"^\s*\d{4}\s*©.*$"))
URL_OR_DOTTED = r"(?:https?://|www\.)[^\s]+|\b[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?\b"
TOC_LINES = (r"^.{5,}\.{3,}\s*\d+\s*$", r"^\d+\.\d+\s+.{5,}\s+\.{3,}\s*\d+\s*$", r"^.{5,}\s{3,}\d+\s*$")
BROKEN_SENTENCE = r"([a-z,])\n+([A-Z])"
COLUMN_GAP = r"\s{4,}"
BULLETS = (("", r"^\s*[•·∙●○◦▪▫■□]\s*"), ("", r"^\s*[*\-+]\s+"), ("", r"^\s*\d+[.)]\s+"), ("i", r"^\s*[a-z][.)]\s+"))
SECTION_TITLE = r"\A(?:[A-Z][A-Z\s]{5,}|(?:Chapter|Section|Part|Article)\s+\d+[:\s]+[A-Z][^.!?]*|\d+\.\s+[A-Z][^.!?]*)$"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ꜳ": "AA", "ꜳ": "aa", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe"}
OCR_CONFUSIONS = (
    (r"\b0(?=[a-zA-Z])", "O"),
    (r"(?<=[a-zA-Z])0\b", "O"),
    (r"\b1(?=[a-zA-Z])", "I"),
    (r"\b5(?=[a-zA-Z])", "S"),
    (r"\b8(?=[a-zA-Z])", "B"),
    (r"(?<=[a-zA-Z])1(?=[a-zA-Z])", "l"),
)
WEIRD_CHARS = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]|[■□●○▪▫](?![•\s])|[‗‾⁓∼∽⁀⁔〰]|[┌┐└┘├┤┬┴┼│─═║╔╗╚╝╠╣╦╩╬]"
DISCLAIMERS = (
    r"(?:^|\n)\s*(?:disclaimer|legal notice|confidentiality notice)[:\s]*.{0,500}?(?=\n\n|\n[A-Z]|\Z)",
    r"(?:^|\n)\s*this (?:document|email|message) is (?:confidential|proprietary).{0,300}?(?=\n\n|\n[A-Z]|\Z)",
    r"(?:^|\n)\s*(?:please consider the environment|think before you print).{0,200}?(?=\n\n|\n[A-Z]|\Z)",
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATES = (
    ("", r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", "$1/$2/$3"),
    ("i", rf"\b({MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", "$1 $2, $3"),
    ("i", rf"\b(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})\b", "$1 $2 $3"),
)

# Page normaliser
CODE_BLOCKS = (
    ("", r"```[\s\S]*?```"),
    ("", r"`[^`\n]+`"),
    ("m", r"^(?: {4}|\t).+$"),
    ("m", r"^(?:def|class|function|var|const|let|import|from|#include|public|private)\s+.+$"),
)
TABLE_BLOCKS = (
    ("m", r"^\|.+\|$"),
    ("m", r"^\+[-+]+\+$"),
    ("ms", r"^--- TABLES ---$.*?(?=\n\n|\Z)"),
    ("ms", r"^\[Table \d+\]$.*?(?=\n\n|\Z)"),
    ("m", r"^(?:\S+\s{2,}){2,}\S+$"),
)
BULLET_BLOCK = ("m", r"^\s*[•·∙●○◦▪▫■□*\-+]\s+.+$")
HEADING_BLOCKS = (
    ("m", r"^#{1,6}\s+.+$"),
    ("m", r"^[A-Z][A-Z\s]{5,}$"),
    ("m", r"^\d+(?:\.\d+)*\s+[A-Z].+$"),
    ("mi", r"^(?:Chapter|Section|Part|Article|Appendix)\s+\d+[:\s]+.+$"),
    ("m", r"^.+\n[=\-]{3,}$"),
    ("m", r"^--- SECTION BREAK ---$"),
)
HIERARCHY = (
    (1, "m", r"^#\s+(.+)$"),
    (2, "m", r"^##\s+(.+)$"),
    (3, "m", r"^###\s+(.+)$"),
    (1, "m", r"^[A-Z][A-Z\s]{8,}$"),
    (1, "mi", r"^(?:Chapter|Part)\s+\d+"),
    (2, "mi", r"^Section\s+\d+"),
    (2, "m", r"^\d+\.\s+[A-Z]"),
    (3, "m", r"^\d+\.\d+\s+[A-Z]"),
)
PAGE_HEADER_LINES = HEADER_LINES[:2]
PAGE_NUMBER_TEMPLATES = (("m", r"^\s*-?\s*<n>\s*-?\s*$"), ("mi", r"^\s*Page\s+<n>\s*$"), ("mi", r"^\s*<n>\s+of\s+\d+\s*$"))
PAGE_LIGATURES = {k: v for k, v in LIGATURES.items() if k not in ("Ꜳ", "ꜳ")}
SAFE_OCR = ((r"\b0(?=bject|utput|pen)\b", "O"), (r"\bl(?=icense|etter)", "L"))
SAFE_SENTENCE = ("m", r"([a-z,;:])\s*\n+\s*([a-z])")
PAGE_BULLETS = (("m", r"^\s*[·∙●○◦▪▫■□]\s+"), ("m", r"^\s*[*\-+]\s+"))

# chunker
PAGE_MARK = r"<<<PAGE_(\d+)>>>"
SECTIONS = (
    ("m", r"^<<<HIERARCHY_L1>>>$"),
    ("m", r"^<<<HIERARCHY_L2>>>$"),
    ("m", r"^<<<HIERARCHY_L3>>>$"),
    ("m", r"^[A-Z][A-Z\s]{8,}$"),
    ("mi", r"^(?:Chapter|Section|Part)\s+\d+"),
    ("m", r"^\d+\.\s+[A-Z]"),
    ("m", r"^#{1,6}\s+"),
)
PARAGRAPH_END = r"\n\n+"
SENTENCE_END = r"[.!?]\s+(?=[A-Z])"
CHUNK_TABLES = (("m", r"^\|.+\|$"), ("m", r"^--- TABLES ---$"), ("m", r"^\[Table \d+\]$"))
CHUNK_CODE = (("", r"```[\s\S]*?```"), ("m", r"^(?: {4}|\t).+$"))
CHUNK_BULLET = ("m", r"^\s*[•·∙●○◦▪▫■□*\-+]\s+")

# Embedding input
MARKS = (r"<<<PAGE_\d+>>>", r"<<<HIERARCHY_L\d+>>>", r"<<<PROTECTED_\w+_\d+>>>")
CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]"
MARKDOWN = ((r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`(.+?)`", "$1"), (r"\.{3,}", "..."), (r"-{3,}", "---"))
