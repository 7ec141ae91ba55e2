"""Column helpers for cleaning and matching text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\r\\n\\f]+"


def strip_html(c: Column) -> Column:
    """Tags become a space, white space collapses; null becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), SPACE, " "))


def normalize_spaces(c: Column) -> Column:
    """No-break spaces become spaces, zero-width ones go, runs of space and tab collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, " ", " "), "[​﻿]", ""), "[ \\t]+", " "))


def hash_form(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def fingerprint(c: Column, chars: int | None = None) -> Column:
    """SHA-256 of the hash form, whole or (where ``chars`` is given) of its first characters."""
    form = hash_form(c)
    return F.sha2(form if chars is None else F.substring(form, 1, chars), 256)


def clean_bullets(c: Column) -> Column:
    return F.regexp_replace(c, "(?m)^[ \\t]*[•●▪◦*·]+[ \\t]*", "- ")


def unwrap_hyphens(c: Column) -> Column:
    """Joins words that a line break cut at a hyphen."""
    return F.regexp_replace(c, "([A-Za-z])-\\r?\\n([a-z])", "$1$2")


def clean_resume_text(c: Column) -> Column:
    """Line ends, hyphenation, control characters, bullets, at most one blank line, collapsed spaces."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\\r\\n?", "\n")
    c = clean_bullets(unwrap_hyphens(c))
    c = F.regexp_replace(normalize_spaces(F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")), " ?\\n ?", "\n")
    return F.trim(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def split_list(c: Column, separator: str = ",") -> Column:
    """Items of a delimited string, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{separator}]"), lambda x: F.trim(x)), lambda x: x != "")


def ordered_unique(c: Column) -> Column:
    """Case-insensitive dedup of an array that keeps the first spelling."""
    return F.aggregate(
        c,
        F.slice(c, 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
PHONE = "\\+?[0-9][0-9 ().-]{8,16}[0-9]"


def emails(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), 0)


def phones(c: Column) -> Column:
    """Matches with 10 to 15 digits."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PHONE), 0)
    return F.filter(found, lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(10, 15))


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{EMAIL}$"), F.lit(False))


def is_phone(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, "[^0-9]", "")).between(7, 15), F.lit(False))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike("^https?://[A-Za-z0-9.-]+(:[0-9]+)?([/?#].*)?$"), F.lit(False))
