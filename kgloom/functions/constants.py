"""Fixed values that results depend on: word lists, type tables, weights and thresholds."""

from __future__ import annotations

# --- mentions that carry no name ------------------------------------------------------
PRONOUNS = ("he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "theirs")
GENERIC_PHRASES = (
    "the mathematician", "the scientist", "the school", "the laboratory", "the machine", "the university", "the model",
    "the paper", "the theory", "the concept", "the method", "this model", "this theory", "this paper", "that model",
    "the work", "the result", "the idea", "the problem",
)

# --- types ----------------------------------------------------------------------------
MENTION_LABELS = ("PER", "ORG", "LOC", "WORK", "CONCEPT", "MACHINE", "AWARD")
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "PLACE", "WORK", "CONCEPT", "MACHINE", "AWARD", "EVENT")
LABEL_TO_TYPE = {
    "PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "PLACE", "WORK": "WORK", "CONCEPT": "CONCEPT", "MACHINE": "MACHINE", "AWARD": "AWARD",
    "PERSON": "PERSON", "ORGANIZATION": "ORGANIZATION", "ORGANISATION": "ORGANIZATION", "PLACE": "PLACE", "LOCATION": "PLACE", "EVENT": "EVENT",
}
NOT_PERSON = tuple(t for t in ENTITY_TYPES if t != "PERSON")
ANAPHOR_TYPES = (
    dict.fromkeys(("he", "him", "his", "she", "her", "hers"), ("PERSON",))
    | dict.fromkeys(("it", "its"), NOT_PERSON)
    | dict.fromkeys(("they", "them", "their", "theirs"), ("PERSON", "ORGANIZATION"))
    | dict.fromkeys(("the mathematician", "the scientist"), ("PERSON",))
    | dict.fromkeys(("the school", "the laboratory", "the university"), ("ORGANIZATION",))
    | {"the machine": ("MACHINE",), "the concept": ("CONCEPT",)}
    | dict.fromkeys(("the model", "this model", "that model"), ("MACHINE", "CONCEPT", "WORK"))
    | dict.fromkeys(("the paper", "this paper", "the work"), ("WORK",))
    | dict.fromkeys(("the theory", "this theory", "the method", "the result", "the idea", "the problem"), ("CONCEPT", "WORK"))
)

# --- relations ------------------------------------------------------------------------
#: relation: (subject types, object types), as in the ontology's domains and ranges.
RELATION_TYPES = {
    "BORN_IN": (("PERSON",), ("PLACE",)), "DIED_IN": (("PERSON",), ("PLACE",)), "STUDIED_AT": (("PERSON",), ("ORGANIZATION",)),
    "WORKED_AT": (("PERSON",), ("ORGANIZATION",)), "AUTHORED": (("PERSON",), ("WORK",)), "PROPOSED": (("PERSON",), ("CONCEPT",)),
    "DESIGNED": (("PERSON",), ("MACHINE",)), "WORKED_WITH": (("PERSON",), ("PERSON",)), "AWARDED": (("PERSON",), ("AWARD",)),
    "LOCATED_IN": (("ORGANIZATION",), ("PLACE",)), "INFLUENCED": (("PERSON",), ("PERSON",)),
}
PREDICATE_ALIASES = {
    "BORN_AT": "BORN_IN", "DIED_AT": "DIED_IN", "EDUCATED_AT": "STUDIED_AT", "EMPLOYED_BY": "WORKED_AT", "COLLABORATED_WITH": "WORKED_WITH",
    "COOPERATED_WITH": "WORKED_WITH", "CREATED": "DESIGNED", "KNOWN_FOR": "PROPOSED", "AWARD_RECEIVED": "AWARDED", "INFLUENCED_BY": "INFLUENCED", "INSPIRED": "INFLUENCED",
}
RELATION_PATTERNS = {
    "BORN_IN": ("born in", "born at", "birthplace"),
    "DIED_IN": ("died in", "death in", "passed away in"),
    "STUDIED_AT": ("studied at", "educated at", "attended", "graduated from", "went to", "study"),
    "WORKED_AT": ("worked at", "worked for", "joined", "employed by", "served at", "appointment"),
    "WORKED_WITH": ("worked with", "collaborated with", "cooperated with", "collaboration with"),
    "AUTHORED": ("wrote", "authored", "published", "paper by"),
    "PROPOSED": ("proposed", "introduced", "outlined", "formulated", "devised"),
    "DESIGNED": ("designed", "built", "developed", "invented"),
    "AWARDED": ("awarded", "received", "won", "elected fellow"),
    "INFLUENCED": ("influenced", "inspired", "shaped", "had an influence on", "influence on", "was influenced by"),
    "LOCATED_IN": ("located in", "based in", "situated in"),
}
#: Single words too common to be a trigger by themselves.
GENERIC_TRIGGERS = ("in", "at", "to", "of", "by", "for")
TRIGGER_LEMMAS = {
    "BORN_IN": ("bear", "birth"), "DIED_IN": ("die", "death", "dead"), "STUDIED_AT": ("study", "attend", "educate", "graduate", "matriculate"),
    "WORKED_AT": ("work", "join", "serve", "teach", "research", "employ", "appointment"), "AUTHORED": ("author", "write", "publish", "coauthor"),
    "PROPOSED": ("propose", "introduce", "devise", "formulate", "present"), "DESIGNED": ("design", "build", "develop", "invent"),
    "AWARDED": ("award", "receive", "win", "honor", "elect"), "LOCATED_IN": ("locate", "base", "situate"),
}
#: Phrases of several words, by their base forms; all but the last hold a lemma as well.
TRIGGER_PHRASES = {
    "BORN_IN": ("be bear in", "be bear at", "bear in", "bear at"), "DIED_IN": ("die in", "pass away in", "death in"), "STUDIED_AT": ("study at", "attend", "educate at", "graduate from"),
    "WORKED_AT": ("work at", "work for", "join", "serve at", "employ by"), "AUTHORED": ("write", "author", "publish"), "PROPOSED": ("propose", "introduce", "formulate", "devise"),
    "DESIGNED": ("design", "build", "invent"), "AWARDED": ("be award", "receive", "win", "elect fellow"), "LOCATED_IN": ("locate in", "base in", "situate in"),
}
#: Surfaces that no rule makes from their base form.
IRREGULAR = {
    "bore": "bear", "borne": "bear", "born": "bear", "wrote": "write", "written": "write", "won": "win", "winning": "win", "built": "build", "taught": "teach", "dying": "die",
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be",
}
#: Words of the triggers that aren't inflected.
UNINFLECTED = ("be", "in", "at", "from", "for", "by", "away", "dead")


def _inflected(base: str) -> dict[str, str]:
    """The regular surfaces of a base form, as verb and as noun."""
    y, e = base[-1] == "y" and base[-2] not in "aeiou", base[-1] == "e"
    if base in IRREGULAR.values():  # the past is irregular
        return dict.fromkeys((base, base + "s", base[:-1] + "ing" if e else base + "ing"), base)
    s = base[:-1] + "ies" if y else base + "es" if base.endswith(("s", "x", "z", "ch", "sh")) else base + "s"
    ed = base[:-1] + "ied" if y else base + "d" if e else base + "ed"
    ing = base[:-1] + "ing" if e and not base.endswith(("ie", "be")) else base + "ing"
    return dict.fromkeys((base, s, ed, ing), base)


#: surface: base form, of every word of the triggers.
LEMMAS = (
    {w: w for w in UNINFLECTED}
    | {x: b for ws in (*TRIGGER_LEMMAS.values(), *TRIGGER_PHRASES.values()) for phrase in ws for w in phrase.split() if w not in UNINFLECTED for x, b in _inflected(w).items()}
    | IRREGULAR
    | {"died": "die", "wining": "wine"}
)

# --- events ---------------------------------------------------------------------------
#: relation: (event type, subject role, object role, subject type, object type).
EVENT_SPECS = {
    "BORN_IN": ("BirthEvent", "person", "birth_place", "PERSON", "PLACE"), "DIED_IN": ("DeathEvent", "person", "death_place", "PERSON", "PLACE"),
    "STUDIED_AT": ("EducationEvent", "student", "institution", "PERSON", "ORGANIZATION"), "WORKED_AT": ("EmploymentEvent", "employee", "employer", "PERSON", "ORGANIZATION"),
    "WORKED_WITH": ("CollaborationEvent", "person_a", "person_b", "PERSON", "PERSON"), "AUTHORED": ("PublicationEvent", "author", "work", "PERSON", "WORK"),
    "PROPOSED": ("ProposalEvent", "proposer", "concept", "PERSON", "CONCEPT"), "DESIGNED": ("DesignEvent", "designer", "machine", "PERSON", "MACHINE"),
    "AWARDED": ("HonorEvent", "recipient", "award", "PERSON", "AWARD"), "INFLUENCED": ("InfluenceEvent", "source_person", "target_person", "PERSON", "PERSON"),
}
#: Synonyms of event types, for the way back to relations.
EVENT_SYNONYMS = {"AuthorshipEvent": "PublicationEvent", "AwardEvent": "HonorEvent"}
SYMMETRIC_EVENTS = ("CollaborationEvent",)
#: (event type, words, left role, right role, passive, pattern id, confidence), longest words first.
EVENT_TRIGGERS = (
    ("CollaborationEvent", "collaborated with", "person_a", "person_b", False, "collaboration_collaborated_with", 0.86),
    ("InfluenceEvent", "was influenced by", "target_person", "source_person", True, "influence_passive_was_influenced_by", 0.88),
    ("CollaborationEvent", "worked with", "person_a", "person_b", False, "collaboration_worked_with", 0.86),
    ("InfluenceEvent", "influenced", "source_person", "target_person", False, "influence_active_influenced", 0.80),
)

# --- scores and thresholds ------------------------------------------------------------
LINK_WEIGHTS = {"alias": 0.30, "context": 0.20, "type": 0.20, "topic": 0.10, "mention": 0.10, "prior": 0.10}
LINK_MULTI, LINK_SINGLE, LINK_EASY, LINK_REVIEW, LINK_MARGIN, LINK_TOP_K, TFIDF_TOP_K = 0.82, 0.88, 0.80, 0.65, 0.05, 5, 8
#: Names of several words that are found otherwise than whole; the least and most that a likeness of texts counts as an alias.
LINK_OTHER, TFIDF_SCORES = 0.85, (0.35, 0.85)
ANCHOR_SCORE, SUPPORT_SURFACE, SUPPORT_ANCHOR, SUPPORT_ANCHOR_CAP, SUPPORT_TITLE, SUPPORT_CAP = 0.88, 0.05, 0.02, 0.06, 0.03, 0.15
ALIAS_SCORES = {"exact": 1.0, "normalized": 0.96, "abbreviation": 0.95, "short_name": 0.90, "place_variant": 0.90, "surname": 0.88}
FACT_REVIEW, FACT_FINAL, FACT_BONUS, FACT_BONUS_CAP = 0.50, 0.75, 0.05, 0.10
FUNCTIONAL = ("BORN_IN", "DIED_IN")
MAX_TOKEN_DISTANCE, WINDOW_MARGIN, COREF_WINDOW, BAG_EVIDENCE, BRIDGE_SCORE = 24, 4, 3, 16, 0.88

# --- entity types from words ----------------------------------------------------------
INSTANCE_TYPES = {
    "Q5": "Person", "Q43229": "Organization", "Q2385804": "Organization", "Q17334923": "Place", "Q2221906": "Place", "Q618123": "Place", "Q571": "Work",
    "Q7725634": "Work", "Q386724": "Work", "Q151885": "Concept", "Q7184903": "Concept", "Q11012": "Machine", "Q170978": "Machine", "Q618779": "Award",
}
#: Words of a title, first match wins.
TITLE_WORDS = (
    ("Award", ("fellow", "prize", "award", "medal", "order of")), ("Machine", ("machine", "engine", "computer")), ("Concept", ("test", "theory")), ("Work", ("proof", "report")),
    ("Organization", ("school", "university", "college", "laboratory", "headquarters", "museum")), ("Place", ("district", "borough", "municipality", "town", "village", "city", "park")),
)
DESCRIPTION_WORDS = (
    ("Award", ("fellow of the royal society", "elected fellow", "honorary fellow", "foreign fellow", "royal fellow", "order of chivalry", "rank of the order", "award", "prize", "medal")),
    ("Work", ("report", "paper", "book", "proof")), ("Machine", ("device", "machine", "computer")),
    ("Organization", ("school", "university", "college", "agency", "headquarters", "museum", "laboratory")),
    ("Place", ("district", "municipality", "borough", "civil parish", "town", "village", "city", "county town", "nursing home", "building")),
    ("Concept", ("theory", "concept", "test of", "statistical technique")),
)
SIMILARITY_STOP = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")

#: Stop words of the linking features.
LINK_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with")

# --- sentences and pages --------------------------------------------------------------
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "e.g", "i.e", "fig", "al", "no", "vol", "pp", "inc", "jr", "sr", "u.s", "u.k")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
TAIL_TITLES = ("references", "external links", "see also", "notes", "citations", "bibliography", "further reading", "sources", "works cited", "参考文献", "外部链接", "延伸阅读", "注释")
NOISE_WORDS = ("nav", "navbar", "menu", "breadcrumb", "footer", "sidebar", "advert", "cookie", "subscribe", "newsletter", "related", "comment", "share", "social", "promo", "banner")
#: Always dropped, whatever they hold; navigation only within a header.
NOISE_TAGS = ("script", "style", "noscript", "iframe", "svg", "canvas", "form", "button", "footer", "aside")
NOISE_CLASSES = ("navbox", "metadata", "reference", "references", "reflist", "infobox", "toc", "mw-editsection", "sidebar", "advert", "ads", "cookie-banner")
HIDDEN_STYLES = ("display:none", "visibility:hidden", "opacity:0")
PROTECTED_TAGS = ("article", "main", "section")
DISCARDED_STARTS = ("Jump up to:", "Archived from the original", "Retrieved ")
#: Patterns of references, marks and numbered contents.
LEADING_REFERENCES = r"^(?:\[\s*\d+(?:\s*[-–]\s*\d+)?\s*\]\s*)+(?=(?:[A-Z\"'“‘(]|\Z))"
TRAILING_REFERENCES = r"([,.;:!?%)\]}\"'”’])\s*(?:\[\s*\d+(?:\s*[-–]\s*\d+)?\s*\]\s*)+(?=(?:\s|$))"
ONLY_REFERENCES = r"^(?:\[\s*\d+(?:\s*[-,–]\s*\d+)?\s*\]\s*)+$"
NUMBERED = r"\b\d+(?:\.\d+)+\b"
SECTION_PREFIX = r"^\s*(?:chapter|section|part)?\s*(?:\d+(?:\.\d+)*|[ivxlcdm]+)[.)]?\s+"
#: Starts and marks of sentences without content.
SKIPPED_STARTS = ("Retrieved ", "Archived from the original", "^", "Author:", "Useful Links", "Related articles", "Other on-line publications")
SOURCE_MARKS = ("ISBN", "doi", "Vol.", "pp.", "BBC News", "The Guardian")
#: Single letters that are words or names of their own.
LETTER_WORDS, LETTER_NAMES = ("a", "A", "i", "I"), ("A", "B", "C", "I", "Q", "X", "Y")
CONTENT_CLASSES = ("mw-parser-output", "article-body", "entry-content", "post-content", "content", "main-content")
CONTENT_IDS = ("content", "main-content", "mw-content-text")
BLOCK_TAGS = ("p", "li", "blockquote", "h1", "h2", "h3", "h4", "article", "section")
