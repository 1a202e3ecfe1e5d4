"""Closed value sets, limits, labels and patterns.

Everything in this module is a fixed value: results only agree with the
reference when these agree, so they are stated plainly and in natural order.
"""

import string

# --- enums -----------------------------------------------------------------
CATEGORIES = (
    "fasteners",
    "plumbing",
    "electrical",
    "building-hardware",
    "general-repair",
    "unknown",
)
EVIDENCE_LEVELS = ("observed", "estimated", "unconfirmed")
IDENTIFICATION_STATUSES = ("identified", "partial", "unidentifiable")
IMAGE_QUALITIES = ("good", "usable", "poor", "unusable")

# --- providers: code, model, label, note; the order is the display order ----
PROVIDERS = (
    ("gemini", "gemini-3.7-flash", "Gemini", "Gemini 3.7 Flash"),
    ("openai", "gpt-5.6-sol", "OpenAI", "GPT-5.6 Sol"),
    ("grok", "grok-4.6", "Grok", "Grok 4.6"),
)
PROVIDER_CODES = tuple(p[0] for p in PROVIDERS)

# --- code -> label ----------------------------------------------------------
CATEGORY_LABELS = {
    "fasteners": "緊固／固定件",
    "plumbing": "水管／管件",
    "electrical": "電氣／配線",
    "building-hardware": "裝潢／建築五金",
    "general-repair": "通用維修件",
    "unknown": "其他／不明",
}
EVIDENCE_LABELS = {"observed": "可見", "estimated": "目測", "unconfirmed": "未確認"}
NAME_SEPARATOR = "／"

# --- category -> folder of its reference text --------------------------------
PACK_FOLDERS = {
    "fasteners": "fasteners",
    "plumbing": "plumbing",
    "electrical": "electrical",
    "building-hardware": "building-hardware",
    "general-repair": "general-repair",
    "unknown": "general-repair",
}
CORE_FOLDER = "core"

# --- images -----------------------------------------------------------------
MIME_BY_FORMAT = {
    "JPEG": "image/jpeg",
    "PNG": "image/png",
    "WEBP": "image/webp",
    "GIF": "image/gif",
}
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".avif", ".gif")
MIN_EDGE_PX = 200
MAX_EDGE_PX = 1800

# --- limits -----------------------------------------------------------------
MAX_PAYLOAD_CHARS = 7_000_000
LOG_TEXT_CHARS = 12_000
SHORT_HASH_CHARS = 12
MAX_ATTEMPTS = 3
OUTPUT_BUDGET = {1: 900, 2: 2400}
NAME_OVERLAP = 0.5
ABSENT_SPEC = "<not provided>"

# --- patterns ---------------------------------------------------------------
# Letter by letter: a class of single letters is one look into a table, ranges are tried in turn.
PAYLOAD_PATTERN = rf"^[{string.ascii_letters}{string.digits}+/=]+\z"
ATTR_NAMES = ("src", "data-src", "data-original", "href", "content")

# White space, as code points.  Python's str.split()/str.strip() and JavaScript's
# String.prototype.trim() differ in a few; Spark's own trim knows the blank only,
# and Java's \s is ASCII only.
PYTHON_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
JAVASCRIPT_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)

# --- contract of the structured replies -------------------------------------
ROUTING_FIELDS = {"category": CATEGORIES, "reason": str}
SPEC_ITEM_FIELDS = {"label": str, "value": str, "evidence_level": EVIDENCE_LEVELS}
# A tuple is an enum, ``str`` a string, ``[str]`` a list of strings and
# ``[{...}]`` a list of closed objects.
IDENTIFICATION_FIELDS = {
    "identification_status": IDENTIFICATION_STATUSES,
    "image_quality": IMAGE_QUALITIES,
    "category": CATEGORIES,
    "item_name": str,
    "common_names": [str],
    "subtype": str,
    "material": str,
    "visible_features": [str],
    "specifications": [SPEC_ITEM_FIELDS],
    "most_likely_identification": str,
    "confusable_candidate": str,
    "key_differentiator": str,
    "uncertain_fields": [str],
    "typical_use": str,
    "purchase_description": str,
    "safety_note": str,
}
# The guard that decides whether a reply is used looks at these fields only.
GUARD_STRINGS = ("item_name", "most_likely_identification", "purchase_description")
GUARD_ARRAYS = ("common_names", "visible_features", "specifications", "uncertain_fields")
