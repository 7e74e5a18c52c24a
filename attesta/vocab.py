"""Word lists, lookup tables, patterns and limits.

Everything in this module is a value that has to be identical for results to
agree with the published behaviour of the evidence-graph data model; there is
no logic here.  Lists keep their natural order.
"""

from __future__ import annotations

# --- enumerations -----------------------------------------------------------

TIER_VERIFIED = "VERIFIED"
TIER_CONSENSUS = "COMMUNITY_CONSENSUS"
TIER_ANECDOTAL = "ANECDOTAL"
TIER_CONTRADICTED = "CONTRADICTED"
TIERS = (TIER_VERIFIED, TIER_CONSENSUS, TIER_ANECDOTAL, TIER_CONTRADICTED)
CURATABLE_TIERS = (TIER_VERIFIED, TIER_CONSENSUS, TIER_ANECDOTAL)

AGREE_MULTI = "multi_source"
AGREE_SINGLE = "single_source"
AGREE_DISPUTED = "disagreement"
EDGE_COLORS = {AGREE_MULTI: "green", AGREE_SINGLE: "amber", AGREE_DISPUTED: "red"}

ROLES = ("female", "male", "parent")
SEXED_ROLES = ("female", "male")

GATE_UNRESOLVED = "UNRESOLVED_PARENT"
GATE_APPROVED = "HUMAN_APPROVED"

# --- URL rules --------------------------------------------------------------

SYNTHESIZED_SCHEMES = ("tavily", "perplexity")

# Public suffixes whose registrable domain has three labels.
THREE_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk",
    "com.au", "net.au", "org.au", "edu.au",
    "co.nz", "net.nz", "org.nz",
    "com.br", "com.mx", "com.ar", "com.co",
    "co.jp", "or.jp", "ne.jp", "ac.jp",
    "com.cn", "com.tw", "com.hk", "com.sg",
    "co.in", "co.za", "com.tr",
)

# --- alias dictionaries -----------------------------------------------------

# alias slug -> canonical slug; attached only to entities that already exist.
SAFE_ALIASES = {
    "gsc": "girl-scout-cookies",
    "gs-cookies": "girl-scout-cookies",
    "girl-scout-cookie": "girl-scout-cookies",
    "chem-dog": "chemdawg",
    "chem-d": "chemdawg",
    "chemdog": "chemdawg",
    "chemdawg-d": "chemdawg",
    "sour-d": "sour-diesel",
    "sour-deisel": "sour-diesel",
    "gdp": "granddaddy-purple",
    "grandaddy-purple": "granddaddy-purple",
    "grand-daddy-purple": "granddaddy-purple",
    "granddaddy-purps": "granddaddy-purple",
    "northen-lights": "northern-lights",
    "northern-light": "northern-lights",
    "ak47": "ak-47",
    "thin-mint": "thin-mints",
}

# folded lookup key -> display name; used while ingesting extracted names.
DISPLAY_ALIASES = {
    "gsc": "Girl Scout Cookies",
    "gs cookies": "Girl Scout Cookies",
    "girl scout cookie": "Girl Scout Cookies",
    "girl scout cookies": "Girl Scout Cookies",
    "thin mint": "Thin Mints",
    "gdp": "Granddaddy Purple",
    "grandaddy purple": "Granddaddy Purple",
    "grand daddy purple": "Granddaddy Purple",
    "granddaddy purps": "Granddaddy Purple",
    "chemdawg": "Chemdawg",
    "chem dog": "Chemdawg",
    "chem d": "Chemdawg",
    "chemdawg d": "Chemdawg",
    "sour d": "Sour Diesel",
    "sour deisel": "Sour Diesel",
    "northen lights": "Northern Lights",
    "northern light": "Northern Lights",
    "ak47": "AK-47",
}

# --- word lists -------------------------------------------------------------

JUNK_CHILD_WORDS = (
    "hybrid", "unknown", "unnamed", "mystery", "various", "modern",
    "crosses", "characteristics",
)
JUNK_PARENT_WORDS = (
    "as", "of", "unknown", "sources", "source", "referred", "known",
    "called", "named", "also", "some",
)
NOT_A_NAME_WORDS = (
    "the", "this", "that", "with", "from", "and", "for", "are", "was",
    "has", "had", "have", "been", "they", "their", "its", "into",
    "such", "some", "any", "all", "most", "more", "less", "very",
    "cross", "bred", "strain",
)
TOPIC_HINTS = (
    "cannabis", "marijuana", "hemp", "thc", "cbd", "terpene",
    "indica", "sativa", "ruderalis", "strain", "cultivar", "kush",
    "haze", "genetics", "breed", "hybrid",
)
STRONG_TOPIC_HINTS = (
    "cannabis", "marijuana", "hemp", "thc", "cbd", "cannabinoid",
    "terpene", "indica", "sativa", "ruderalis", "kush", "haze",
    "strain", "cultivar", "pot strain", "bud", "weed", "cannabies",
)
ARTICLE_HINTS = (
    "cannabis", "marijuana", "hemp", "strain", "kush", "haze",
    "indica", "sativa", "hybrid", "thc", "cbd",
)
ARTICLE_NEGATIVES = (
    "film", "movie", "song", "album", "tv", "drama",
    "cruise ship", "video game", "rapper", "music",
    "spider", "venom", "spider-man",
)
FOLLOW_UP_SUFFIX = "parents lineage genetics cross"

# --- extraction patterns ----------------------------------------------------

NAME = r"[A-Z][A-Za-z0-9&'\-#]*(?:[ \t]+[A-Z][A-Za-z0-9&'\-#]*){0,2}"

# (pattern with {NAME} placeholders, ignore case?) in the order they are tried.
CROSS_PATTERNS = (
    (r"hybrid\s*=\s*({NAME})[ \t\n]+[×xX][ \t\n]+({NAME})", True),
    (r"({NAME})[ \t]+[×xX][ \t]+({NAME})", False),
    (r"cross[ \t]+of[ \t]+({NAME})[ \t]+and[ \t]+({NAME})", True),
    (r"crossing[ \t]+({NAME})[ \t]+(?:with|and|x)[ \t]+({NAME})", True),
    (r"bred[ \t]+from[ \t]+({NAME})[ \t]+(?:/|and|with)[ \t]+({NAME})", True),
    (r"({NAME})[ \t]+crossed[ \t]+with[ \t]+({NAME})", True),
    (r"(?:by|via)[ \t]+crossing[ \t]+({NAME})[ \t]+(?:with|and|x)[ \t]+({NAME})", True),
    (r"hybrid[ \t]+of[ \t]+({NAME})[ \t]+and[ \t]+({NAME})", True),
    (r"descended[ \t]+from[ \t]+({NAME})[ \t]+and[ \t]+({NAME})", True),
    (r"(?:parents|genetics|lineage|breeders?)\s*:[ \t]*({NAME}(?:[ \t]*(?:,|/|and)[ \t]+{NAME}){0,3})", True),
    (r"\([ \t]*({NAME})[ \t]+[×xX][ \t]+({NAME})[ \t]*\)", False),
    (r"is[ \t]+a[ \t]+cross[ \t]+of[ \t]+({NAME})[ \t]+and[ \t]+({NAME})", True),
)
LIST_SPLIT = r"\s*(?:,|/| and |&)\s*"

# Role cues; {N} is the escaped parent name.
FEMALE_CUE = r"(?:female\s+parent|seed\s+parent|mother|dam)"
MALE_CUE = r"(?:male\s+parent|pollen\s+(?:parent|donor)|father|sire)"
ROLE_CUES = (
    (r"{N}\s*\(\s*(?:female|mother|dam|seed\s*parent)\s*\)", "female"),
    (r"{N}\s*\(\s*(?:male|father|sire|pollen\s*(?:parent|donor))\s*\)", "male"),
    (FEMALE_CUE + r"\s*[:\s]+{N}\b", "female"),
    (MALE_CUE + r"\s*[:\s]+{N}\b", "male"),
    (r"{N}\s+(?:is|as)\s+the\s+" + FEMALE_CUE, "female"),
    (r"{N}\s+(?:is|as)\s+the\s+" + MALE_CUE, "male"),
    (r"(?:mothered|mother)\s+by\s+{N}\b", "female"),
    (r"fathered\s+by\s+{N}\b", "male"),
)

# --- "page describes this entity" patterns ----------------------------------

CLASS_NOUN = r"(?:cannabis\s+strain|cannabis|cultivar|strain|hybrid|indica|sativa|variety)"
RELATION_WORDS = (
    "of|for|in|into|on|onto|among|amongst|with|by|from|to|the|this|that|"
    "these|those|our|their|its|as|at|than|via|per|between|across|after|"
    "about|not|only|just|parent|parents|cross|crossing"
)
OTHER_WORK = (
    r"(?:tv\s+series|song|film|movie|album|band|series|novel|book|"
    r"episode|single|soundtrack)"
)
OTHER_WORK_IN_TITLE = (
    r"\b(?:song|film|movie|album|band|series|novel|book|episode|single|"
    r"soundtrack|disambiguation)\b"
)
CLOSING_QUOTES = r"[\"“”'’)\]]*"
MODIFIER = rf"(?:(?!(?:{RELATION_WORDS})\b)[\w'’-]+\s+)"
ALSO_KNOWN_AS = r"(?:\s*,\s*also\s+known\s+(?:simply\s+)?as\s+[\w'’-]+(?:\s+[\w'’-]+){0,3}\s*,)?"

# The name belongs to a different kind of work: (side of the name, pattern).
OTHER_WORK_RULES = (
    ("before", rf"\b{OTHER_WORK}\b(?:\s+(?:called|named|titled))?\s*[,:]?\s*{CLOSING_QUOTES}$"),
    ("after", rf"\bis\s+(?:an?|the)\s+(?:{MODIFIER}){{0,4}}{OTHER_WORK}\b"),
    ("after", r"\bis\s+the\s+title(?:\s+character)?\s+of\b"),
    ("after", rf"^{CLOSING_QUOTES}\s*,\s*(?:an?|the)\s+(?:{MODIFIER}){{0,4}}{OTHER_WORK}\b"),
)
OF_OTHER_WORK = rf"\s+of\s+(?:an?\s+|the\s+)?(?:{MODIFIER}){{0,3}}{OTHER_WORK}\b"
# What follows the name when it is said to be of the class.
CLASS_AFTER_NAME = (
    ALSO_KNOWN_AS + rf"{CLOSING_QUOTES}\s+is\s+(?:(?:an?|the)\s+(?:{MODIFIER}){{0,6}})?{CLASS_NOUN}\b",
    rf"{CLOSING_QUOTES}\s*,\s*(?:an?|the)\s+(?:{MODIFIER}){{0,6}}{CLASS_NOUN}\b",
)
# What stands directly before the name when it is.
CLASS_BEFORE_NAME = (
    rf"{CLASS_NOUN}\b(?:\s*,)?(?:\s+(?!(?:{RELATION_WORDS})\b)[\w'’-]+){{0,6}}\s*,?\s*"
    rf"(?:named|called|known\s+(?:simply\s+)?as)\s+(?:simply\s+|the\s+)?{CLOSING_QUOTES}?",
    rf"\b(?:call(?:ed)?|named)\s+(?:this\s+|the\s+|an?\s+)?(?:{MODIFIER}){{0,4}}{CLASS_NOUN}\s+{CLOSING_QUOTES}?",
)
CLASS_BESIDE_NAME = rf"\b(?:an?|the|this)\s+(?:{MODIFIER}){{0,4}}{CLASS_NOUN}\s*,?\s*{CLOSING_QUOTES}?"
CROSS_TALK = r"\b(?:parent|parents|cross|crossing)\b"
CROSS_TALK_CHARS = 48

# --- relevance of an encyclopedia hit ---------------------------------------

# points for a word of the list in the title, or else in the text
ARTICLE_HINT_POINTS = (3, 1)
ARTICLE_QUERY_POINTS = (5, 1)
ARTICLE_MARK = "(cannabis"
ARTICLE_MARK_POINTS = 25
ARTICLE_STUB_TITLE, ARTICLE_STUB_TEXT = "disambiguation", "may refer to"
ARTICLE_STUB_CHARS, ARTICLE_STUB_POINTS = 200, -30
ARTICLE_NEGATIVE_CHARS, ARTICLE_NEGATIVE_POINTS = 300, -8

# --- markup -----------------------------------------------------------------

# Entities in the order in which they are decoded.
PAGE_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"),
                 ("&lt;", "<"), ("&gt;", ">"))
LABEL_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"),
                  ("&quot;", '"'), ("&nbsp;", " "))
# Markup of an HTML result page.
RESULT_BLOCK = r'<[^>]*\bclass\s*=\s*"[^"]*\bresults_links[^"]*"[^>]*>'
RESULT_LINK = (r'(?s)<a[^>]*\bclass\s*=\s*"[^"]*result__a[^"]*"[^>]*\bhref\s*=\s*"([^"]+)"[^>]*>'
               r'((?:(?!</a>).)*)</a>')
RESULT_SNIPPET = r'(?s)<a[^>]*\bclass\s*=\s*"[^"]*result__snippet[^"]*"[^>]*>((?:(?!</a>).)*)</a>'
# Header of one result in an evidence text, and what parts two of them.
EVIDENCE_HEADER = ("--- result[", "] url=", " ---\n")
EVIDENCE_BREAK = "\n\n"

# --- limits -----------------------------------------------------------------

EDGE_SOURCE_CAP = 10        # URLs kept on a derived edge
RUN_EDGE_SOURCE_CAP = 5     # URLs kept on a run-graph edge
CLAIM_BUDGET = 24           # claims shown with a neighbourhood
TOP_CLAIMS = 6              # claims shown on the wheel
LEAD_SENTENCES = 3
LEAD_CHARS = 400
TEMPLATE_LEVELS = 10
LEAD_MIN_FRAGMENT = 12
EXCERPT_CHARS = 220
PACK_TEXT_CHARS = 2400
PACK_TOTAL_CHARS = 14000
ARCHIVE_LOOKUPS = 10
DOSSIER_CARDS = 12        # of one page; not a fixed value of the data model
MAX_HOPS = 3
