"""Ordered rule tables as CASE expressions: the first rule that fits gives the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first (pattern, label) whose pattern occurs in c."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def all_matches(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Labels of all rules that fit, in order; the default where none does."""
    found = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(label)) for p, label in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def banded(c: Column, bands: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first band (lower bound, label) that c reaches."""
    out = F.lit(default)
    for bound, label in reversed(bands):
        out = F.when(c >= bound, F.lit(label)).otherwise(out)
    return out


def upper_band(c: Column, bands: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first band (upper bound, label) that c does not exceed."""
    out = F.lit(default)
    for bound, label in reversed(bands):
        out = F.when(c <= bound, F.lit(label)).otherwise(out)
    return out


# Labels of a match score in percent.
FIT_BANDS = ((80, "Strong Match"), (65, "Potential Candidate"), (50, "Moderate Match"), (35, "Needs Skill Development"))
FIT_BELOW = "Not Currently Suitable"
JD_BANDS = ((80, "Strong Match"), (60, "Good Match"), (30, "Partial Match"))
SALARY_BANDS = ((1, "entry"), (2, "junior"), (4, "mid"))

# Levels of seniority, the first that fits.
SENIORITY = (
    (r"\b(intern|internship|co-op|coop|student)\b", "Intern"),
    (r"\b(trainee|graduate trainee|apprentice)\b", "Trainee"),
    (r"\b(entry[- ]level|associate|graduate|level 1|l1|junior 1)\b", "Entry Level"),
    (r"\b(junior|jr)\b", "Junior"),
    (r"\b(senior|sr|level 3|l3|iii|ii)\b", "Senior"),
    (r"\b(lead|team lead|tech lead|leader)\b", "Lead"),
    (r"\bstaff\b", "Staff"),
    (r"\bprincipal\b", "Principal"),
    (r"\b(architect|enterprise architect|solutions architect)\b", "Architect"),
    (r"\b(director|head of|vp|vice president)\b", "Director"),
    (r"\b(manager|engineering manager|em)\b", "Manager"),
)


def jd_label(overall: Column, matched: Column) -> Column:
    """Band of a match with a job description; without a matched skill there is none."""
    return F.when((matched == 0) | (overall == 0), "No Match").otherwise(banded(overall, JD_BANDS, "Low Match"))


def category_label(c: Column) -> Column:
    """Upper-case label out of "best fits the X category" or "category: X"; null where there is none."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.upper(F.trim(x)), r"[\s/]+", "-"), "^-+|-+$", "")
    out = F.lit(None).cast("string")
    for pattern in (r"(?i)category\s*[:\-]\s*([A-Z0-9\- /]+)", r"(?i)best fits the\s+([A-Z0-9\-\s/]+?)\s+category"):
        label = clean(F.regexp_extract(c, pattern, 1))
        out = F.when((F.length(label) >= 3) & ~label.startswith("FOLLOWING"), label).otherwise(out)
    return out
