"""Trigger words and patterns used by the facet operators.

Every operator takes a ``Lexicon``; the defaults below are fixed values that results depend on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# URL words that mark a key page.
KEY_PAGE_TERMS = ("about", "home", "index", "who-we-are", "company")

# Words around which service phrases are cut from key pages.
SERVICE_WORDS = ("service", "solution", "consulting", "development", "support")

# Words that make an h2 heading a service.
HEADING_WORDS = ("service", "solution", "product", "offering")

# Words that make an internal link a service.
LINK_WORDS = (
    "service", "solution", "product", "consulting", "development",
    "support", "training", "implementation", "integration",
)

# Openings of exclusion statements, matched on lower-case text.
EXCLUSION_PATTERNS = (
    r"we do not (offer|provide|support|work with)",
    r"not (available|offered|supported)",
    r"outside (our|the) scope",
    r"we don't",
    r"we cannot",
    r"not included",
)

# Audience phrases, group 1 is the audience.
AUDIENCE_PATTERNS = (
    r"for (businesses|companies|organizations|individuals|professionals|enterprises)",
    r"designed for ([^.]+)",
    r"perfect for ([^.]+)",
    r"ideal for ([^.]+)",
    r"serving ([^.]+)",
    r"we help ([^.]+)",
    r"our clients include ([^.]+)",
)

# Audience labels and their substrings. The upper-case "SME" of the declared
# list never matches lower-cased text, so it is left out here without changing any result.
AUDIENCE_LABELS = (
    ("SMB", ("small business", "small and medium")),
    ("Enterprise", ("enterprise", "fortune 500", "large organization")),
    ("B2B", ("business to business", "b2b", "companies")),
    ("B2C", ("consumers", "individuals", "personal", "b2c")),
    ("Startups", ("startup", "early stage", "emerging")),
    ("Government", ("government", "public sector", "federal", "municipal")),
    ("Non-profit", ("nonprofit", "charity", "ngo", "foundation")),
    ("Healthcare", ("healthcare", "medical", "hospital", "clinic")),
    ("Education", ("education", "schools", "universities", "academic")),
    ("Financial", ("financial", "banking", "insurance", "fintech")),
)

# Value propositions; a pattern's group is kept when it has one, else the match.
VALUE_PATTERNS = (
    r"what (sets us apart|makes us different|distinguishes us)",
    r"why choose us",
    r"our unique approach",
    r"unlike (our competitors|other)",
    r"the only ([^.]+)",
    r"first to ([^.]+)",
    r"pioneering ([^.]+)",
    r"industry-leading ([^.]+)",
    r"award-winning ([^.]+)",
)

# Openings after which services and locations are named.
SERVICE_TRIGGERS = (
    r"we (?:offer|provide|deliver|specialize)",
    r"our (?:services|solutions|products)(?:\s+(?:include|are))?",
)
LOCATION_TRIGGERS = (r"(?:based|located|headquartered) in", r"serving")

# Entity words that make an organisation or product a product.
PRODUCT_WORDS = ("product", "solution")

# Words trimmed from both ends of a noun phrase.
NOUN_STOPWORDS = (
    "a", "an", "the", "this", "that", "these", "those", "any", "some", "all", "our", "your", "their", "its",
    "of", "in", "on", "at", "to", "for", "from", "by", "with", "as", "is", "are", "be", "was", "were",
    "and", "or", "but", "also", "not", "it", "we", "you", "they",
)

# Frequent function words per language, for the language gate of main text.
LANGUAGE_STOPWORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "für", "von", "den", "ein", "eine", "auf", "zu"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "on", "are", "this"),
    "es": ("el", "los", "las", "que", "y", "del", "una", "por", "con", "para", "se", "es", "su", "al"),
    "fr": ("le", "les", "des", "et", "une", "que", "qui", "dans", "pour", "pas", "est", "sur", "du", "au"),
}


@dataclass(frozen=True)
class Lexicon:
    """Pattern data of one analysis run. Patterns must stay in the common Java/RE2 subset."""

    key_page_terms: tuple = KEY_PAGE_TERMS
    service_words: tuple = SERVICE_WORDS
    heading_words: tuple = HEADING_WORDS
    link_words: tuple = LINK_WORDS
    exclusion_patterns: tuple = EXCLUSION_PATTERNS
    audience_patterns: tuple = AUDIENCE_PATTERNS
    audience_labels: tuple = AUDIENCE_LABELS
    word_boundary_labels: bool = False
    value_patterns: tuple = VALUE_PATTERNS
    service_triggers: tuple = SERVICE_TRIGGERS
    location_triggers: tuple = LOCATION_TRIGGERS
    product_words: tuple = PRODUCT_WORDS
    noun_stopwords: tuple = NOUN_STOPWORDS


DEFAULT = Lexicon()

# Opt-in labels matched as whole words; includes the abbreviation the substring list cannot hold.
WHOLE_WORD_LABELS = tuple(
    (label, terms + ("sme",) if label == "SMB" else terms) for label, terms in AUDIENCE_LABELS
)


def group_count(pattern: str) -> int:
    """Number of capture groups of a pattern."""
    return re.compile(pattern).groups
