"""Fixed values. These must equal the reference behaviour for equal results.

Keyword lists, regular expressions and placeholders are stated exactly as the
reference uses them, in its order. Regexes are written in the common
Python/Java syntax; ``java()`` adds the flags that make Java's engine behave
like Python's Unicode-aware ``re`` (``U`` = Unicode classes, word boundaries
and case folding).
"""

# ---- fixed values (keyword lists) ----
MONEY_KEYWORDS = [
    "refund", "transfer", "pay", "voucher", "gift card",
    "fee", "amount", "bank", "account", "payment",
]

REQUEST_KEYWORDS = [
    "provide", "confirm", "send", "transfer", "give",
    "enter", "click", "call me", "verify",
    "confirm your", "please provide",
]

# ---- fixed values (patterns) ----
URL_PATTERN = r"https?://\S+|www\.\S+"  # case-insensitive
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{3,4}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
AMOUNT_PATTERN = (  # case-insensitive
    r"\$\s*\d+(?:,\d{3})*(?:\.\d+)?|\b\d+(?:,\d{3})*(?:\.\d+)?\s*(USD|NZD|dollars|dollar|bucks)\b"
)
REQUEST_PHRASE_PATTERN = r"\b(can you|could you|please)\b"
SPEAKER_MARKERS = ["caller:", "receiver:"]

# ---- fixed values (placeholders, in redaction order) ----
EMAIL_PLACEHOLDER = "[REDACTED_EMAIL]"
PHONE_PLACEHOLDER = "[REDACTED_PHONE]"
SSN_PLACEHOLDER = "[REDACTED_SSN]"
AMOUNT_PLACEHOLDER = "[REDACTED_AMOUNT]"

# ---- fixed values (feature contract) ----
STRUCTURAL_FEATURES = [
    "turn_count",
    "aggregate_num_urls",
    "aggregate_money_terms",
    "ratio_request_messages",
]
UNKNOWN_SPEAKER = "unknown"
NULL_TEXT = "nan"  # text of a missing dialogue, as str(NaN)
SEED = 42

# Python's str.strip()/isspace() set: Unicode White_Space plus U+001C..U+001F.
PY_WHITESPACE = "".join(
    chr(c)
    for c in [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def java(pattern: str, ignore_case: bool = False) -> str:
    """Java regex equal to Python's ``re`` on str patterns (Unicode classes)."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def marker_alternation() -> str:
    return "|".join(SPEAKER_MARKERS)
