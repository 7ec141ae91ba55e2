"""Durations between dates; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def months_between_days(start: Column, end: Column) -> Column:
    """Whole months of 30.44 days, one at least; null where the end lies before the start."""
    days = F.datediff(end, start)
    return F.when(days >= 0, F.greatest(F.lit(1), F.bround(days / 30.44).cast("int")))


def years_of(months: Column) -> Column:
    return F.bround(months / 12, 2)


def display(months: Column) -> Column:
    years, rest = F.floor(months / 12), months % 12
    unit = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    return (
        F.when(months.isNull(), "Duration not specified")
        .when(years == 0, unit(rest, "month"))
        .when(rest == 0, unit(years, "year"))
        .otherwise(F.concat(unit(years, "year"), F.lit(" "), unit(rest, "month")))
    )


# Month names, one date, a range of dates, and words for the present.
MONTHS = ("jan|january", "feb|february", "mar|march", "apr|april", "may", "jun|june", "jul|july", "aug|august", "sep|sept|september", "oct|october", "nov|november", "dec|december")
NOW = ("present", "current", "now", "ongoing")
DATE = r"(?:(?:\d{1,2}[\s\/\.-]+)?(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?|\d{1,2})[\s\/\.-]+)?(?:19|20)\d{2}"
DATE_RANGE = rf"(?i)({DATE})\s*(?:-|–|—|to|until)\s*({DATE}|Present|Current|Now|Ongoing)"


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("int")


def parse_date(c: Column, as_of: Column) -> Column:
    """The day that a text names: year, month and day in numbers in either order, month and year in numbers, or a year
    with or without a month's name and a day beside it; what is not named is 1; ``present`` is as_of; else null."""
    low = F.lower(F.trim(c))
    ymd, dmy, my = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", r"^(\d{1,2})[-/.](\d{4})$"
    names = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    named = F.coalesce(*[F.when(low.rlike(rf"\b(?:{m})\b"), i + 1) for i, m in enumerate(MONTHS)])
    number = _part(low, r"\b(\d{1,2})[-/.]\d{4}\b")
    month = F.coalesce(named, F.when(number.between(1, 12), number), F.lit(1))
    around = rf"\b(\d{{1,2}})\s*(?:st|nd|rd|th)?[\s/.-]+(?:{names})", rf"\b(?:{names})[a-z]*[\s/.-]+(\d{{1,2}})\b", r"\b(\d{1,2})[/.-]\d{1,2}[/.-](?:19|20)\d{2}\b"
    day = F.greatest(F.lit(1), F.least(F.lit(31), F.coalesce(*[_part(low, p) for p in around], F.lit(1))))

    def date(year: Column, month: Column, day: Column) -> Column:
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d")))

    one = F.lit(1)
    tried = [date(_part(low, ymd), _part(low, ymd, 2), _part(low, ymd, 3)), date(_part(low, dmy, 3), _part(low, dmy, 2), _part(low, dmy)), date(_part(low, my, 2), _part(low, my), one)]
    free = date(_part(low, r"\b(19\d{2}|20\d{2})\b"), month, day)
    return F.when(low.isin(*NOW), as_of).otherwise(F.coalesce(*[F.when(low.rlike(p), d) for p, d in zip((ymd, dmy, my), tried)], free))


def date_ranges(c: Column) -> Column:
    """Ranges of dates in a text, in order, as (start, end) texts."""
    c = F.coalesce(c, F.lit(""))
    starts, ends = (F.regexp_extract_all(c, F.lit(DATE_RANGE), g) for g in (1, 2))
    return F.zip_with(starts, ends, lambda s, e: F.struct(F.trim(s).alias("start"), F.trim(e).alias("end")))


def months_of_text(c: Column) -> Column:
    """Months out of texts like "2 years 3 months" or "1.5 years"; null where no unit is named."""
    years = F.nullif(F.regexp_extract(F.lower(c), r"([0-9]+(?:[.][0-9]+)?) *\+? *(?:years|year|yrs|yr)", 1), F.lit("")).cast("double")
    months = F.nullif(F.regexp_extract(F.lower(c), r"([0-9]+) *(?:months|month|mos|mo)", 1), F.lit("")).cast("double")
    return F.when(years.isNotNull() | months.isNotNull(), F.bround(F.coalesce(years, F.lit(0.0)) * 12 + F.coalesce(months, F.lit(0.0))).cast("int"))


def required_years(c: Column) -> Column:
    """Years that a job description asks for: the lower end of a range, or the number before "years"; null where none is named."""
    low = F.regexp_extract(F.lower(c), r"([0-9]+) *(?:-|to) *[0-9]+ *\+? *(?:years|year|yrs|yr)", 1)
    one = F.regexp_extract(F.lower(c), r"([0-9]+(?:[.][0-9]+)?) *\+? *(?:years|year|yrs|yr)", 1)
    return F.coalesce(F.nullif(low, F.lit("")), F.nullif(one, F.lit(""))).cast("double")
