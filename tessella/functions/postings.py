"""What a job description asks for: experience, education."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers as words, and the forms in which experience is asked for.
NUMBERS = {"one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0, "eleven": 11.0, "twelve": 12.0, "half": 0.5}
_N, _ANY = r"(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?|[a-z]+)"
_WORD = r"(\d+(?:\.\d+)?|" + "|".join(NUMBERS) + ")"
BOTH = _ANY + r"\s*(?:years?|yrs?)\s*(?:and)?\s*" + _ANY + r"\s*(?:months?|mos?)"
YEAR_RANGE = _N + r"\s*(?:to|-|–)\s*" + _N + r"\s*\+?\s*(?:years?|yrs?)"
MONTH_RANGE = _N + r"\s*(?:to|-|–)\s*" + _N + r"\s*\+?\s*(?:months?|mos?)"
_IN = r"(?:\s*(?:of)?\s*(?:[a-zA-Z0-9\+\#\.\/]+\s+)?experience)?\b"
MONTHS = r"\b" + _WORD + r"\s*(\+)?\s*(?:months?|mos?)" + _IN
YEARS = r"\b" + _WORD + r"\s*(\+)?\s*(?:years?|yrs?)" + _IN
LINE = r"(?:required\s*experience|minimum\s*experience|experience\s*required|experience|exp\.)\s*[:\-–]\s*([^\n\r]+)"
# Degrees, the first that occurs.
DEGREES = (
    (r"\b(?:master(?:'s)?|m\.?tech|m\.?s|mca)\b", "Master's Degree"),
    (r"\b(?:bachelor(?:'s)?|b\.?e|b\.?tech|b\.?sc|bca|b\.?com|degree\s+in)\b", "Bachelor's Degree"),
)
NO_DEGREE = "Not specified in JD"


def _number(c: Column, default: float) -> Column:
    words = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.coalesce(c.try_cast("double"), F.try_element_at(words, c), F.lit(default))


def _short(c: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def _asked(t: Column) -> Column:
    """(years, display) of a lower-case text; null without a duration."""
    part = lambda pattern, n: F.regexp_extract(t, pattern, n)
    plus = lambda pattern: F.when(part(pattern, 0).contains("+"), "+").otherwise("")  # noqa: E731  also one in the skill's name

    def found(years: Column, display: Column) -> Column:
        return F.struct(years.alias("years"), display.alias("display"))

    in_years = lambda months: F.bround(months / 12.0, 4)
    both = F.bround(_number(part(BOTH, 1), 0.0) * 12 + _number(part(BOTH, 2), 0.0))
    both_text = F.when(in_years(both) >= 1.0, F.concat(F.bround(in_years(both), 1).cast("string"), F.lit(" years"))).otherwise(F.concat(_short(both), F.lit(" months")))
    span = lambda p, unit: F.concat(part(p, 1), F.lit("-"), part(p, 2), F.lit(unit))
    months, years = F.bround(_number(part(MONTHS, 1), 1.0)), F.bround(_number(part(YEARS, 1), 1.0), 4)
    months_text = F.concat(_short(months), plus(MONTHS), F.lit(" month"), F.when(months == 1, "").otherwise("s"))
    years_text = F.concat(_short(years), F.when(plus(YEARS) == "+", "+ years").when(years == 1, " year").otherwise(" years"))
    return (
        F.when(t.rlike(BOTH), found(in_years(both), both_text))
        .when(t.rlike(YEAR_RANGE), found(part(YEAR_RANGE, 1).try_cast("double"), span(YEAR_RANGE, " years")))
        .when(t.rlike(MONTH_RANGE), found(in_years(part(MONTH_RANGE, 1).try_cast("double")), span(MONTH_RANGE, " months")))
        .when(t.rlike(MONTHS), found(in_years(months), months_text))
        .when(t.rlike(YEARS), found(years, years_text))
    )


def experience_asked(c: Column) -> Column:
    """(years, display) that a description asks for: its line on experience first, then the whole text; 0 and "Not specified" without."""
    low = F.lower(F.coalesce(c, F.lit("")))
    none = F.struct(F.lit(0.0).alias("years"), F.lit("Not specified").alias("display"))
    return F.coalesce(_asked(F.regexp_extract(low, LINE, 1)), _asked(low), none)


# How a title is given, what follows it, words of titles in the first lines, and the title of last resort.
TITLES = (
    r"(?im)(?:job\s*title|position|role|designation)\s*[:\-–]\s*([^\n\r]+)",
    r"(?im)(?:we\s*are\s*looking\s*for\s*(?:a|an)?|hiring\s*for)\s*([^\n\r,;.]+)",
    r"(?im)^([A-Z][a-zA-Z0-9\s\+\#\.\/]+(?:Developer|Engineer|Architect|Specialist|Analyst|Consultant|Scientist|Designer|Lead|Manager))",
)
WANTED = r"(?i)\s*(?:required|needed|wanted|opening).*$"
TITLE_WORDS, NO_TITLE = "developer|engineer|analyst|scientist|designer|architect", "Software Engineer"


def title_asked(c: Column) -> Column:
    """The title of a posting: the first form that gives 4 to 59 characters, else one of its first three lines that reads like a title."""
    text = F.coalesce(c, F.lit(""))
    clean = lambda x: F.trim(F.regexp_replace(F.trim(x), WANTED, ""))
    fits = lambda x: F.when(F.length(x).between(4, 59), x)
    given = F.coalesce(*[fits(clean(F.regexp_extract(text, p, 1))) for p in TITLES])
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    read = F.filter(F.transform(F.filter(F.slice(lines, 1, 3), lambda x: F.lower(x).rlike(TITLE_WORDS)), clean), lambda x: F.length(x).between(4, 59))
    return F.when(given.isNotNull() & (given != NO_TITLE), given).otherwise(F.coalesce(F.get(read, F.lit(0)), F.lit(NO_TITLE)))


def education_asked(c: Column) -> Column:
    """The degree that a description asks for."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(NO_DEGREE)
    for pattern, name in reversed(DEGREES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out
