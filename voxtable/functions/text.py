"""Text columns: five normalisers, sentence-end tests and content-word predicates (kept apart on purpose)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed

CLOSE1, CLOSE_ANY = "[\"')\\]]?$", "[\"')\\]]*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def norm_match(col, contractions: bool = True) -> Column:
    """Lower case, letters and digits only, then the contraction map."""
    n = F.regexp_replace(F.lower(_c(col)), r"[^\p{L}\p{N}]", "")
    if not contractions:
        return n
    table = F.create_map(*[F.lit(x) for kv in fixed.CONTRACTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, n), n)


def norm_surface(col) -> Column:
    """Lower case, straight quotes, outer punctuation stripped; inner points stay ("5.5." -> "5.5")."""
    straight = F.translate(F.lower(_c(col)), "‘’", "''")
    return F.regexp_replace(straight, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def norm_apos(col) -> Column:
    return F.regexp_replace(F.lower(_c(col)), r"[^\p{L}\p{N}']", "")


def norm_value(col) -> Column:
    return F.regexp_replace(F.lower(_c(col)), r"[^a-z0-9.%]", "")


def strip_outer(col) -> Column:
    return F.regexp_replace(_c(col), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def strip_title(col) -> Column:
    """Outer punctuation off, keeping a currency or percent sign and a closing question mark."""
    return F.trim(F.regexp_replace(_c(col), r"^[^\p{L}\p{N}$%]+|[^\p{L}\p{N}$%?]+$", ""))


def ends_sentence(col, strict: bool = True) -> Column:
    """Strict allows one closing quote or bracket after the mark, loose any number."""
    return _c(col).rlike("[.!?]" + (CLOSE1 if strict else CLOSE_ANY))


def ends_comma(col) -> Column:
    return _c(col).rlike("," + CLOSE1)


def is_content(norm, purpose: str) -> Column:
    """Content test on an already normalised token; each purpose has its own list and minimum length."""
    words, least = {
        "retake": (fixed.STOP_RETAKE, 3), "takes": (fixed.STOP_TAKES, 1),
        "verify": (fixed.STOP_VERIFY, 2), "emphasis": (fixed.STOP_EMPHASIS, 3),
    }[purpose]
    return (F.length(_c(norm)) >= least) & ~_c(norm).isin(words)


def content_count(col) -> Column:
    """Words left in a text after fillers, stop words and vague words (ASCII tokens)."""
    tokens = F.split(F.regexp_replace(F.lower(_c(col)), r"[^a-z0-9']+", " "), " ")
    drop = F.array(*[F.lit(w) for w in [""] + fixed.FILLER_STRUCTURE + fixed.STOP_STRUCTURE])
    return F.size(F.filter(tokens, lambda t: ~F.array_contains(drop, t)))


def is_promotable(col) -> Column:
    return content_count(col) >= 3


def clamp_words(col, most) -> Column:
    """At most ``most`` words; a text that fits only loses its outer blanks."""
    trimmed = F.regexp_replace(_c(col), r"^\s+|\s+$", "")
    parts = F.split(trimmed, r"\s+")
    n = F.lit(most) if isinstance(most, int) else most
    return F.when(F.size(parts) <= n, trimmed).otherwise(F.array_join(F.slice(parts, 1, n), " "))


def tidy(col) -> Column:
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def plain_word(col) -> Column:
    """Upper-case letters of a 3 to 12 letter word, else NULL."""
    letters = F.regexp_replace(_c(col), r"[^\p{L}]", "")
    return F.when(F.length(letters).between(3, 12), F.upper(letters))


def clock(us) -> Column:
    """m:ss.s"""
    s = _c(us) / 1e6
    return F.format_string("%d:%04.1f", F.floor(s / 60), s - 60 * F.floor(s / 60))
