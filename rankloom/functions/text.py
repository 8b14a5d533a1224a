"""Text functions as Column expressions: trimming, wiki-text cleaning, tokenizing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning patterns and what replaces a match, in the order in which they apply.
CLEANING: tuple[tuple[str, str], ...] = (
    (r"(?s)\{\{.*?\}\}", " "),
    (r"(?s)<ref[^>]*>.*?</ref>", " "),
    (r"<ref[^>]*/>", " "),
    (r"\[\[([^\]\|]*)\|([^\]]*)\]\]", "$2"),
    (r"\[\[([^\]]*)\]\]", "$1"),
    (r"<[^>]+>", " "),
    (r"https?://\S+", " "),
    (r"www\.\S+", " "),
    (r"[^a-z0-9 ]", " "),
    (r"\s+", " "),
)
TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"
INTEGER = r"\A-?[0-9]+\z"


def jtrim(c: Column) -> Column:
    """Strip every character up to U+0020 from both ends (``F.trim`` strips spaces only)."""
    return F.regexp_replace(c, TRIM, "")


def is_integer(c: Column) -> Column:
    """Digits with at most a leading minus; null is false."""
    return F.coalesce(c.rlike(INTEGER), F.lit(False))


def clean_text(c: Column, stopwords: Iterable[str] = ()) -> Column:
    """Lower case, markup and URLs out, words of two or more letters that aren't stop-words; null gives the empty string."""
    out = F.lower(F.coalesce(c, F.lit("")))
    for pattern, replacement in CLEANING:
        out = F.regexp_replace(out, pattern, replacement)
    words = F.filter(F.split(F.trim(out), " "), lambda w: F.length(w) >= 2)
    known = sorted(set(stopwords))
    if known:
        words = F.filter(words, lambda w: ~w.isin(known))  # planned as a look into a hash set
    return F.array_join(words, " ")


def _tokens(c: Column, kept: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), f"[^{kept}]", " "), r"\s+"), lambda w: F.length(w) > 1)


def tokens_alpha(c: Column) -> Column:
    """Runs of a-z longer than one letter, of the lower-cased text."""
    return _tokens(c, "a-z")


def tokens_alnum(c: Column) -> Column:
    """Runs of a-z and 0-9 longer than one character, of the lower-cased text."""
    return _tokens(c, "a-z0-9")


def page_text(title: str = "title", text: str = "clean_text") -> Column:
    """What is tokenized of a page: title and text; the title is never cleaned."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
