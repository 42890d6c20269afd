"""Word lists, tables, patterns and formats that results depend on."""

# Kinds of items by category, in the order in which reports list them.
CATEGORIES = {
    "deadline": ["response_due", "questions_due", "conference", "other_deadline"],
    "submission": ["submission_method", "submission_contents"],
    "format": ["page_limit", "formatting"],
    "eligibility": ["set_aside", "naics", "registration", "certification", "insurance", "participation_goal", "other_eligibility"],
    "evaluation": ["basis_of_award", "evaluation_factor"],
    "requirement": ["required_content", "work_requirement"],
}
CATEGORY_TITLES = {
    "deadline": "Deadlines",
    "submission": "How to submit",
    "format": "Format and page limits",
    "eligibility": "Eligibility",
    "evaluation": "How it is evaluated",
    "requirement": "What the response must include",
}
KINDS = [k for kinds in CATEGORIES.values() for k in kinds]
DEADLINE_KINDS = ["response_due", "questions_due", "conference"]
FACT_KINDS = ["response_due", "questions_due", "submission_method", "page_limit", "basis_of_award", "set_aside", "naics"]
GENERAL_KINDS = ["required_content", "work_requirement", "other_eligibility", "registration", "certification"]

# Words that don't count as content when a quote is sought in a table.
STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "by", "with", "is", "are", "be", "as", "at", "that", "this", "from", "its", "their", "will", "shall", "must", "all", "any"]

# Patterns of dates and times.
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
DATE_REVISED = MONTH + r"\s+(\d{1,2})(?:st|nd|rd|th)?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
DATE_NAMED = MONTH + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
DATE_DAY_FIRST = r"\b(\d{1,2})\s+" + MONTH + r",?\s+(\d{4})"
DATE_NUMERIC = r"\b(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\b"
DATE_ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
TIME_12 = r"\b(\d{1,2})(?::(\d{2}))?\s*(a\.?\s?m\.?|p\.?\s?m\.?)(?![a-z])"
TIME_24 = r"\b([01]?\d|2[0-3]):([0-5]\d)\b(?!\s*(?:a\.?m|p\.?m))"
TIME_MILITARY = r"\b([01]\d|2[0-3])([0-5]\d)\s*(?:hrs\b|hours\b|[ECMP][SD]?T?\b)"
NOON = r"\bnoon\b"
NUMERIC_REVISION = r"\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}/\d{1,2}/\d{2,4}"

# Keyword predicates on sentences.
KEYWORDS = {
    "obligation": r"\b(shall|must|required|will not be (accepted|considered)|no later than|is due|are due)\b",
    "due": r"\b(due|deadline|no later than|must be received|closing date|response date|submission deadline)\b",
    "response": r"\b(proposals?|quotes?|quotations?|responses?|offers?|submission|bids?|closing)\b",
    "submit": r"\b(submit\w*|sent to|upload\w*|deliver\w*)\b",
    "channel": r"(e-?mail|portal|dropbox|online form|@|upload)",
    "page_limit": r"\b(\d+)\s+pages?\b",
    "limit_word": r"\b(limit\w*|not (to )?exceed|no more than|maximum)\b",
    "basis": r"(best value|lowest price technically acceptable|\blpta\b|highest (aggregate|combined|total|overall)|lowest (evaluated )?price)",
    "set_aside": r"\bset[- ]?aside\b",
    "naics": r"naics[^0-9]{0,40}(\d{6})",
    "questions": r"\bquestions?\b",
    "points": r"\(?(\d{1,3})\s*(points?|pts\.?|%)\)?",
    "evaluation": r"\b(evaluat|criteri|score|factor|points)\w*",
}
# Words by which kinds are corrected and candidates ranked.
RESPONSE_WORDS = r"\b(proposals?|bids?|quotes?|quotations?|offers?|responses?|submissions?)\b"
CHANNEL_WORDS = r"\b(e-?mail\w*|portal|dropbox|online form|upload\w*|electronic\w*|in person|mail(ed)?|hand[- ]deliver\w*)\b"
NOT_THE_RESPONSE = r"\b(debrief\w*|protest\w*|questions?|invoic\w*|vendrep|vendor responsibility|reports?|disclosure|waiver|deficienc\w*)\b"
SET_ASIDE_WORDS = r"\bset[- ]?aside\b|\bunrestricted\b"
NAICS_CODE = r"\bnaics\b[^.]{0,40}?\b\d{6}\b"
GOALS = r"\bgoals?\b"
AWARD_WORDS = r"best value|lowest price|technically acceptable|lpta|highest"

# Patterns of contact details.
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?:\+?1[-. ]?)?\(?\b\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b(?:\s*(?:x|ext\.?)\s*\d+)?"
NAME = r"(?:[A-Z][a-zA-Z.'-]+\s){1,2}[A-Z][a-zA-Z'-]+"
CONTACT_LABEL = r"((?i:(?:primary|secondary|designated)\s+)?(?i:contacts?|contracting officer|contract specialist|contract manager|poc|attn)(?:\s*\((?:CO|CS|CM|POC)\))?)"

# Page furniture.
FOOTER = r"[^\S\n]*(?:page[^\S\n]*)?\d{1,3}(?:[^\S\n]*of[^\S\n]*\d{1,3})?[^\S\n]*|[^\n]{0,60}\bpage[^\S\n]+\d{1,3}(?:[^\S\n]+of[^\S\n]+\d{1,3})?[^\S\n]*"
RENDERING_BREAK = "\nzzrenderingbreakzz\n"
PAGE_MARKER = "<<<PAGE %d>>>"
BLANK_CHARS = 40
CHUNK_CHARS = 9000
CHUNK_OVERHEAD = 20
LEAST_KEY = 12
OVERLAP_FLOOR = 0.8
FUZZY_FLOOR = 0.9
