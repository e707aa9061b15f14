"""Text cleaning, tokenising and n-grams as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.stopwords import ENGLISH

# Character classes. Java's \s, \d and \b are ASCII-only by default, so the
# Unicode meaning of "space", "digit" and "word edge" is spelled out.
SPACE_CHARS = r"\p{IsWhite_Space}\x1C-\x1F"
SPACE = f"[{SPACE_CHARS}]"
DIGIT = r"\p{Nd}"
EDGE_BEFORE = r"(?<![\p{L}\p{N}_])"
EDGE_AFTER = r"(?![\p{L}\p{N}_])"

# What counts as a page mark, a part number and a standard.
PAGE_OR_SECTION = f"page{SPACE}+{DIGIT}+|section{SPACE}+[ivx]+"
PART_NUMBER = f"{DIGIT}+-{DIGIT}+"
STANDARD_NAMES = ("IEC", "ISO", "DIN")
STANDARD = f"(?:{'|'.join(STANDARD_NAMES)}){SPACE}+{DIGIT}+"
NOT_LETTER_OR_SPACE = f"[^a-zA-Z{SPACE_CHARS}]+"
PART_TOKEN = "PARTNUM"
STANDARD_TOKEN = "STANDARD"

PROFILES = ("replace", "delete")


def _whole(pattern: str, first: str) -> str:
    """Between word edges; ``first`` is a cheap test of the first character."""
    return f"(?=[{first}]){EDGE_BEFORE}(?:{pattern}){EDGE_AFTER}"


def clean_replace(text: Column) -> Column:
    """Drop page marks, put tokens for part numbers and standards, keep letters, lower-case."""
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, F.lit("(?iu)" + _whole(PAGE_OR_SECTION, "ps")), F.lit(""))
    # Looking for a fixed string is far cheaper than a pattern; what is dropped or put in makes no new ones.
    hyphen, named = F.contains(text, F.lit("-")), reduce(or_, [F.contains(text, F.lit(x)) for x in STANDARD_NAMES])
    out = F.when(hyphen, F.regexp_replace(out, F.lit(_whole(PART_NUMBER, DIGIT)), F.lit(PART_TOKEN))).otherwise(out)
    out = F.when(named, F.regexp_replace(out, F.lit(_whole(STANDARD, "ID")), F.lit(STANDARD_TOKEN))).otherwise(out)
    return F.lower(F.regexp_replace(out, F.lit(NOT_LETTER_OR_SPACE), F.lit("")))


def clean_delete(text: Column) -> Column:
    """Delete page marks, part numbers and standards alike, keep letters, lower-case."""
    marks = f"{PAGE_OR_SECTION}|{PART_NUMBER}|{STANDARD}"
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, F.lit("(?iu)" + _whole(marks, f"psid{DIGIT}")), F.lit(""))
    return F.lower(F.regexp_replace(out, F.lit(NOT_LETTER_OR_SPACE), F.lit("")))


def clean(text: Column, profile: str) -> Column:
    if profile == "replace":
        return clean_replace(text)
    if profile == "delete":
        return clean_delete(text)
    raise ValueError(f"profile must be one of {PROFILES}, got {profile!r}")


def tokens(text: Column) -> Column:
    """Tokens between runs of white space, without empty ones."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def without_stopwords(toks: Column, words: Sequence[str] = ENGLISH) -> Column:
    """Keep order and repeats; long literal lists become one hash-set probe per token."""
    return F.filter(toks, lambda t: ~t.isin(list(words))) if words else toks


def joined(toks: Column) -> Column:
    return F.array_join(toks, " ")


def text_hash(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def long_tokens(toks: Column) -> Column:
    """Tokens of two characters or more, the ones that become terms."""
    return F.filter(toks, lambda t: F.length(t) >= 2)


def bigrams(toks: Column) -> Column:
    n = F.size(toks)
    left = F.slice(toks, F.lit(1), F.greatest(n - 1, F.lit(0)))
    right = F.slice(toks, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))


def terms(toks: Column) -> Column:
    """Unigrams, then bigrams of neighbours."""
    return F.concat(toks, bigrams(toks))
