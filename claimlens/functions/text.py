"""Text rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Patterns and keyword lists that decide results.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # besides the plain one
URL = r"https?://[^\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
MENTION = r"@[\p{L}\p{N}_]+"
EMOJI = "[\U0001f300-\U0001faff\U00002600-\U000027bf\U0001f1e6-\U0001f1ff]+"
REPEATED_PUNCTUATION = r"([!?.,])\1+"
OPPOSING_WORDS = ("not true", "debunk", "false", "incorrect", "myth")
NEUTRAL_WORDS = ("unrelated",)
NEGATIVE_WORDS = ("hidden tax", "secretly", "scam", "corrupt", "toxic")
POSITIVE_WORDS = ("great", "thank", "approve", "improve", "happy")
OUTRAGE_PHRASES = ("hidden tax", "secretly")
TOPIC_WORDS = (
    ("Road Pricing & Transit", ("erp", "congestion", "toll")),
    ("Transit Construction", ("tree", "mrt", "monas")),
    ("Flooding & Waterways", ("flood", "banjir", "ciliwung")),
    ("Waste & Pollution", ("waste", "sunter", "smoke")),
)
DEFAULT_TOPIC = "General"
LOCATION_WORDS = (
    "jakarta", "dki", "sudirman", "thamrin", "kampung pulo", "penjaringan", "muara angke", "muara baru", "sunter",
    "cakung", "kota tua", "monas", "blok m", "kampung melayu", "ciliwung",
)
HAZARD_WORDS = ("hujan", "petir", "badai", "angin kencang")
FALSE_RATING_WORDS = ("false", "hoax", "salah", "palsu", "keliru", "menyesatkan", "misleading", "fake")
HOAX_PREFIX = r"(?i)^\[(SALAH|HOAX|PENIPUAN|DISINFORMASI|MANIPULASI)\]\s*"
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "this", "that", "it", "in", "on", "for", "of", "to", "and", "with",
)


def contains_any(text: Column, words) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def collapse_spaces(text: Column) -> Column:
    """Runs of any spaces become one plain space, none at the ends. Only runs of two or more are matched: a class of
    many characters, matched at every word, takes three times as long."""
    return F.trim(F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), " {2,}", " "))


def strip_html(text: Column, entities: bool = False) -> Column:
    out = F.regexp_replace(text, r"<[^>]+>", " ")
    if entities:
        for code, char in (("&amp;", "&"), ("&nbsp;", " "), ("&quot;", '"'), ("&#039;", "'")):
            out = F.replace(out, F.lit(code), F.lit(char))
    return collapse_spaces(out)


def normalize_text(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), URL, "<url>")
    out = F.regexp_replace(out, MENTION, "<mention>")
    out = F.regexp_replace(out, EMOJI, "")
    out = F.regexp_replace(out, REPEATED_PUNCTUATION, "$1")
    return collapse_spaces(out)


def stance(text: Column) -> Column:
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(contains_any(text, OPPOSING_WORDS), "opposing")
        .when(contains_any(text, NEUTRAL_WORDS), "neutral")
        .otherwise("supporting")
    )


def sentiment(text: Column) -> Column:
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(contains_any(text, NEGATIVE_WORDS), "negative")
        .when(contains_any(text, POSITIVE_WORDS), "positive")
        .otherwise("neutral")
    )


def outrage(text: Column) -> Column:
    return F.when(contains_any(text, OUTRAGE_PHRASES), 0.8).otherwise(0.4)


def lexicon_density(text: Column, lexicon) -> Column:
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    hits = F.size(F.filter(tokens, lambda t: t.isin(*lexicon)))
    return F.when(F.size(tokens) > 0, hits / F.size(tokens)).otherwise(0.0)


def topic(text: Column) -> Column:
    out = F
    for name, words in TOPIC_WORDS:
        out = out.when(contains_any(text, words), name)
    return out.otherwise(DEFAULT_TOPIC)


def character_grams(text: Column, n: int = 4) -> Column:
    """Distinct n-character windows of a short text such as a profile line."""
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    )
