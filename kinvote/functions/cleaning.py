"""Text cleaners as ordered replacement steps on a lower-cased column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement) in order of application. "Unwanted character to
# space" followed by "run of space to one space" is one step here: a run of unwanted
# characters and spaces becomes one space, in a single pass over the text.
_URL_WORDS = (r"http\S+|www\.\S+", " ")

LETTERS_STEPS = [_URL_WORDS, (r"[^a-z]+", " ")]
ALNUM_STEPS = [_URL_WORDS, (r"[^a-z0-9]+", " ")]
SOCIAL_STEPS = [
    (r"(?i)\b(?:https?://|www\.)\S+\b", " "),
    (r"&amp;", " and "),
    (r"&quot;|&lt;|&gt;", " "),
    (r"&#39;", "'"),
    (r"(?i)^\s*rt\s+", " "),
    (r"@[A-Za-z0-9_]+", " "),
    (r"#(\w+)", "$1"),
    # a-z, 0-9, _ and ' stay; after lower-casing \w is exactly the first three, and this
    # spelling of the class runs several times faster in java.util.regex
    (r"[^\w']+", " "),
]
ASCII_STEPS = [(r"https?://\S+", " "), (r"&\w+;", " "), (r"[^\x00-\x7F]+", " ")]


def _apply(col: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, F.lower(col))


def clean_letters(col: Column) -> Column:
    """URLs and everything but a-z to spaces, runs of space collapsed, trimmed."""
    return F.trim(_apply(col, LETTERS_STEPS))


def clean_alnum(col: Column) -> Column:
    """Like :func:`clean_letters`, but digits stay."""
    return F.trim(_apply(col, ALNUM_STEPS))


def clean_social(col: Column) -> Column:
    """Social-media cleaner: entities, retweet marks and mentions go, hashtags keep the word."""
    return F.trim(_apply(col, SOCIAL_STEPS))


def clean_ascii(col: Column) -> Column:
    """URLs, entities and non-ASCII runs to spaces; neither collapsed nor trimmed."""
    return _apply(col, ASCII_STEPS)
