"""Fixed values that results depend on: phrase lists, patterns, enumerations and defaults. All are parameters of the
operators; these are the defaults."""

SHINGLE_SIZE = 3
BUCKET_MODULO = 1000

VAGUE_PHRASES = ("it depends", "generally", "usually", "may vary", "check online", "do your own research")
ACTION_VERBS = ("apply", "bring", "contact", "verify", "call", "visit", "check", "document", "submit", "prepare", "obtain", "book", "schedule", "require")
TIME_SENSITIVE_MARKERS = ("visa", "entry requirement", "fees", "price", "customs", "border", "as of", "currently")
STRONG_CERTAINTY_PHRASES = ("definitely", "guaranteed", "always", "never", "no need to verify")

GATE_KEYWORDS = (
    "visa", "entry requirement", "entry requirements", "border", "fees", "fee", "price", "cost", "opening hours", "opening hour", "regulations", "regulation", "embassy", "consulate", "airport",
    "customs", "safety advisory", "safety advisories", "travel advisory", "travel advisories", "as of", "current", "currently", "now", "requirements", "requirement", "permit", "permits", "vaccination",
    "vaccinations", "quarantine", "covid", "insurance requirement",
)
GATE_OVERCONFIDENT = (
    "guaranteed", "definitely", "always", "never", "no need to verify", "no need to check", "don't need to verify", "don't need to check", "absolutely", "certainly will", "100%", "for sure", "without exception",
)
ALWAYS_ALLOWED = ("always verify", "always check", "always confirm", "always consult", "always refer", "always observe", "always see ")

TAG_OVERCONFIDENT = ("guaranteed", "definitely", "always", "never", "no need to verify", "no need to check", "don't need to verify", "100%", "for sure", "without exception")
TAG_GENERIC_STEPS = (r"check\s+online", r"verify\s+online", r"search\s+the\s+web", r"look\s+it\s+up")

ASSUMPTION_PATTERNS = (r"\bassumption", r"\bi assume", r"\bmight\b", r"\bmay\b", r"\bdepends?\b", r"\bif you\b", r"\bunknown\b", r"\bnot sure\b", r"\bprobably\b", r"\blikely\b", r"\bunsure\b")
VERIFICATION_PATTERNS = (r"\bverif", r"\bcheck.*(?:official|website|embassy|airline|government)", r"\bconfirm with\b", r"\blatest rules?\b", r"\bup.?to.?date\b", r"\bconsult\b", r"\bas of\b", r"\bcurrent\b.*\bpolicy\b")
CLARIFYING_PATTERNS = (r"\bwhich\s+\w+\s+(?:are you|do you|will you)", r"\bwhat\s+(?:is your|are your)", r"\bwhen\s+(?:are you|will you)", r"\bwhere\s+(?:are you|will you)", r"\bwhat\s+country\b", r"\bhow\s+(?:long|many)")

PAYLOAD_TYPES = ("itinerary", "checklist", "decision_tree", "procedure")
TRANSPORT_MODES = ("walk", "transit", "train", "taxi", "rideshare", "flight", "ferry", "car")
PAYLOAD_ALIASES = {"budget_checklist": "checklist", "budgeting_checklist": "checklist", "one_day_itinerary": "itinerary"}
ENVELOPE_KEYS = ("summary", "assumptions", "uncertainty_notes", "next_steps", "verification_steps", "payload_type", "payload")
MAX_CANDIDATE = 200_000
