"""Vocabularies, thresholds and patterns.

Everything here is a default: each job takes the value as an argument.
"""

# --- Fixed values: results depend on these exact texts, orders and numbers ---

ACTIVE_VOTES = ["Pour", "Contre", "Abstained"]
EXCUSED_ABSENCES = [
    "Ill",
    "Out of the Island",
    "Excused attendance",
    "Parental responsibilities",
    "Declared an interest",
    "Suspended",
    "Presiding",
]
UNEXCUSED_ABSENCES = ["Not present for vote", "En défaut"]

LEGACY_POSITIONS = {
    "Mr.": "Deputy",
    "Mrs.": "Deputy",
    "Miss.": "Deputy",
    "Advocate": "Deputy",
    "Senators": "Senator",
}
DEFAULT_POSITION = "Member"

STAGES = [
    "principles",
    "third_reading",
    "articles",
    "amendment",
    "paragraph",
    "regulations",
    "procedural",
    "other",
]
ALIGNMENT_STAGES = ["principles", "third_reading"]
DIVISIVE_STAGES = ["principles", "third_reading", "amendment"]
PROCEDURAL_WORDS = ["closure", "motion", "refer back", "standing order"]

TERM_START = "2022-07-01"
ACTIVE_YEARS = [2025, 2026]
ELECTION_YEAR = 2026

TOPICS = [
    "Government & Administration",
    "Constitutional & Electoral",
    "Finance & Taxation",
    "Employment & Social Security",
    "Transport & Infrastructure",
    "Planning & Environment",
    "Financial Services & Regulation",
    "Health & Wellbeing",
    "Property & Land",
    "Housing",
    "Justice & Policing",
    "Consumer & Commercial",
    "Children, Education & Families",
    "International & Trade",
    "Equality & Human Rights",
    "Agriculture, Fisheries & Rural",
]
FALLBACK_TOPIC = "Government & Administration"

STANCES = ["agree", "disagree", "neutral", "not_addressed"]
ANSWERS = ["agree", "disagree", "neutral"]

RANK_WEIGHTS = [5, 4, 3, 2, 1]
TOPIC_BLEND = 0.4
STANCE_BLEND = 0.6
LOW_COVERAGE = 0.4
FULL_CREDIT_AT = 8

LOW_CONTENT_WORDS = 150
MAX_LINKS = 40
MAX_LINK_TEXT = 80
MAX_DOCUMENT_CHARS = 200_000
MAX_OFFERED_URLS = 25
MAX_NOTE_CHARS = 500
MAX_TAGS = 5
NEAR_MISS_RATIO = 0.85

# A parish, and the constituencies its voters can vote in.
AREA_CONSTITUENCIES = {
    "St Helier": ["St Helier", "St Helier South", "St Helier Central", "St Helier North"],
    "St Saviour": ["St Saviour"],
    "St Brelade": ["St Brelade"],
    "St Clement": ["St Clement"],
    "St Lawrence": ["St Lawrence", "St John, St Lawrence and Trinity"],
    "Trinity": ["Trinity", "St John, St Lawrence and Trinity"],
    "Grouville": ["Grouville", "Grouville and St Martin"],
    "St Peter": ["St Peter", "St Mary, St Ouen and St Peter"],
    "St Ouen": ["St Ouen", "St Mary, St Ouen and St Peter"],
    "St John": ["St John", "St John, St Lawrence and Trinity"],
    "St Martin": ["St Martin", "Grouville and St Martin"],
    "St Mary": ["St Mary", "St Mary, St Ouen and St Peter"],
}
ISLAND_WIDE_ROLE = "Senator"

# Patterns
REFERENCE_PATTERN = r"^P\.\d+/\d{4}"
REISSUE_PATTERN = r"[Rr]e-?issue"
AMENDMENT_PATTERN = r"\(Amd\)(?:\((\d+)\))?"
ARTICLES_PATTERN = r"articles?\s+\d"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"(\+?44[\s\d]{8,}|\(?0?1534\)?[\s\d]{6,}|07\d{2}\s?\d{6})"
PARTY_PATTERN = r"(?:Party|Affiliation)\s*[:\-]\s*([^\n]+)"
NO_PARTY_WORDS = ["none", "independent", "n/a", "-"]
NO_PARTY_LABELS = ["none", "n/a", "-", ""]
CONVICTION_ANCHORS = ["No previous convictions", "Previous convictions"]
PROPOSER_ANCHORS = ["Names of Proposers and Seconders", "Proposers and Seconders"]
PROPOSITION_URL = "https://statesassembly.je/publications/propositions/{year}/p-{number}-{year}"

# Page formats; a plain \s stands for any white space that the page's readers know.
SCRIPT_ELEMENTS = [r"(?isU)<script\b.*?</script>", r"(?isU)<style\b.*?</style>"]
BLOCK_ENDS = r"</(p|h[1-6]|div|li|tr)>"
ARTICLE_PATTERN = "(?s)<article[^>]*>(.*?)</article>"
STYLE_LEFTOVERS = [r"body\s*\{[^}]*\}", r"p\s*\{[^}]*\}", r"li,\s*table\s*\{[^}]*\}", r"\.awlist\d+[^}]*\}"]
PAGE_LABELS = {"lodged_by": "Lodged by", "published_date": "Published on", "debate_date": "Debate date"}
MAIN_BLOCK_PATTERN = (
    r'(?s)<div class="main-content inline-col[^"]*"[^>]*>(.*?)'
    r'(?=<div id="js-main-content"|<aside|Names of Proposers and Seconders)'
)
EMBED_PATTERNS = ["(?s)<iframe.*?</iframe>", '(?s)<div class="embed[^"]*"[^>]*>.*?</div>']
CARD_PATTERN = r'(?s)<figure[^>]*data-testid="profile-card"[^>]*>(.*?)</figure>'
CARD_LINK_PATTERN = r'<a[^>]+href="(https?://[^"]*?/candidates/\d+/[^"?#]+)'
CARD_KEY_PATTERN = r"^.*/candidates/\d+/([^/]+)"
CARD_HEADING_PATTERN = r'(?s)<h5[^>]*data-testid="profile-card-heading"[^>]*>(.*?)</h5>'
CARD_NAME_PATTERN = "<a[^>]*>([^<]+)</a>"
CARD_ITEM_PATTERN = "(?s)<li[^>]*>(.*?)</li>"
CARD_PHOTO_PATTERN = r'<img[^>]+src="([^"]+)"'
STANDING_PATTERN = r"^Standing for\s+(.+?)\s*$"

# Replies
FENCE_PATTERN = r"(?U)```\w*\n?"
OPENING_FENCE_PATTERN = r"(?U)^```\w*\n?"
CLOSING_FENCE_PATTERN = r"\n?```\n?\z"
OBJECT_PATTERN = r"(?s)\{.*\}"
BARE_QUOTE_PATTERN = r'(:\s*"(?:[^"\\]++|\\.)*+)"((?:[^"\\]++|\\.)*+)("\s*[,}\]])'

# --- End of fixed values ---
