"""Documents of lines: sections by header lines, records by opening lines, terms of a taxonomy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes of a period, a degree, a place and a person's name on one line.
PERIOD = "(?i)((?:[a-z]{3,9}\\.? )?(?:19|20)[0-9]{2}) ?(?:-|–|to) ?((?:[a-z]{3,9}\\.? )?(?:19|20)[0-9]{2}|present|current)"
DEGREE = "(?i)\\b(b\\.?tech|b\\.?e|b\\.?sc|bca|m\\.?tech|m\\.?sc|mca|mba|ph\\.?d|bachelor[a-z']*|master[a-z']*|diploma)\\b"
PLACE = "^[A-Z][A-Za-z .]+, ?[A-Z][A-Za-z .]+$"
NAME = "^[A-Z][A-Za-z.'-]*( [A-Z][A-Za-z.'-]*){1,3}$"
BULLET = "^[-•●▪*·] ?"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): trimmed lines that are not blank; a null text has none."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n"), "\n")
    rows = docs.select(key, F.posexplode(parts).alias("line_no", "line"))
    return rows.select(key, "line_no", F.regexp_replace("line", "^ +| +$", "").alias("line")).where("line <> ''")


def header_of(line: Column, headers: Mapping[str, str]) -> Column:
    """Section that a line of at most 60 characters heads, else null; spaced-out letters are drawn together."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[^a-z& ]+", " "), " +", " "))
    plain = F.when(plain.rlike("^([a-z] )+[a-z]$"), F.regexp_replace(plain, " ", "")).otherwise(plain)
    known = F.create_map(*[F.lit(x) for pair in headers.items() for x in pair])
    return F.when(F.length(line) <= 60, F.element_at(known, plain))


def split_sections(lines: DataFrame, key: str, section: Column, lead: str = "personal_info_header") -> DataFrame:
    """Body lines by section, repeated sections appended; lines before the first header are in ``lead``."""
    order = Window.partitionBy(key).orderBy("line_no")
    placed = lines.withColumn("head", section).withColumn("section", F.coalesce(F.last("head", True).over(order), F.lit(lead)))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    body = F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
    return placed.where("head IS NULL").groupBy(key, "section").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), body.alias("body"))


def records_by_head(lines: DataFrame, key: str, head: Column) -> DataFrame:
    """Numbers records: one opens at a head line that follows no head line; lines before the first are dropped."""
    order = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("is_head", F.coalesce(head, F.lit(False)))
    opens = F.col("is_head") & ~F.coalesce(F.lag("is_head").over(order), F.lit(False))
    return marked.withColumn("opens", opens).withColumn("record", F.sum(F.col("opens").cast("long")).over(order)).where("record > 0").drop("opens")


def _first(value: Column) -> Column:
    """The value of the first line that has one."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _found(pattern: str, group: int = 0) -> Column:
    return F.nullif(F.trim(F.regexp_extract("line", pattern, group)), F.lit(""))


def _details() -> Column:
    rows = F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line_no", F.regexp_replace("line", BULLET, "").alias("line")))))
    return F.transform(rows, lambda x: x["line"])


def experience(lines: DataFrame, key: str, titles: Sequence[str]) -> DataFrame:
    """Jobs of a section: heads carry a title or a period; the first value of each field stands."""
    title = "(?i)\\b(" + "|".join(sorted(titles, key=len, reverse=True)) + ")\\b"
    bullet = F.col("line").rlike(BULLET)
    head = ~bullet & (F.col("line").rlike(title) | F.col("line").rlike(PERIOD))
    company = F.coalesce(_found("(?i) at ([^|,(]+)", 1), _found("\\|([^|]+)", 1))
    return records_by_head(lines, key, head).groupBy(key, "record").agg(
        _first(_found(title)).alias("title"),
        _first(company).alias("company"),
        _first(_found(PERIOD)).alias("period"),
        F.coalesce(F.bool_or(F.col("is_head") & F.lower("line").contains("intern")), F.lit(False)).alias("internship"),
        _details().alias("responsibilities"),
    )


def education(lines: DataFrame, key: str, as_of: int) -> DataFrame:
    """Degrees of a section, one row for each spelling; pursuing where the last year is as_of or later."""
    found = records_by_head(lines, key, F.col("line").rlike(DEGREE)).groupBy(key, "record").agg(
        _first(_found(DEGREE)).alias("degree"),
        _first(_found("([A-Z][A-Za-z .]*(?:University|College|Institute|School)[A-Za-z .]*)", 1)).alias("institution"),
        F.max(F.expr("try_cast(array_max(regexp_extract_all(line, '(19|20)[0-9]{2}', 0)) AS int)")).alias("year"),
        _first(_found("(?i)c?gpa[: ]*([0-9]+(?:\\.[0-9]+)?)", 1)).alias("gpa"),
    )
    merged = found.withColumn("degree_key", F.regexp_replace(F.lower("degree"), "[^a-z]", "")).groupBy(key, "degree_key").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record"))).alias(c) for c in ("degree", "institution", "year", "gpa")])
    return merged.withColumn("status", F.when(F.col("year") >= as_of, "pursuing").when(F.col("year") < as_of, "completed"))


def projects(lines: DataFrame, key: str) -> DataFrame:
    """Projects of a section: a head is no bullet and no tech line; ``Title: description`` is cut at the colon."""
    tech = F.col("line").rlike("(?i)^(tech[a-z ]*|tools|stack) ?:")
    head = ~F.col("line").rlike(BULLET) & ~tech
    rows = records_by_head(lines.withColumn("tech", F.when(tech, F.regexp_replace("line", "^[^:]*: ?", ""))), key, head)
    return rows.groupBy(key, "record").agg(_first(_found("^(?:[0-9]+[.)] ?)?([^:|]+)", 1)).alias("title"), _first(F.col("tech")).alias("technologies"), F.count_if(~F.col("is_head")).alias("n_details"))


def list_items(lines: DataFrame, key: str) -> DataFrame:
    """Items of a plain section (certificates, languages, interests): bullets off, split at commas and semicolons, first spelling of each."""
    items = F.split(F.regexp_replace("line", BULLET, ""), "[,;]")
    rows = lines.select(key, "line_no", F.posexplode(items).alias("n", "item")).withColumn("item", F.trim("item")).where("item <> ''")
    first = F.min(F.struct("line_no", "n", "item")).alias("first")
    return rows.groupBy(key, F.lower("item").alias("item_key")).agg(first).select(key, F.col("first.item").alias("item"), F.col("first.line_no").alias("line_no"))


def name_and_place(lines: DataFrame, key: str) -> DataFrame:
    """Name from the first five lines, place from the first fifteen; null where none fits."""
    line = F.col("line")
    return lines.groupBy(key).agg(
        _first(F.when((F.col("line_no") < 5) & line.rlike(NAME), line)).alias("name"),
        _first(F.when((F.col("line_no") < 15) & line.rlike(PLACE), line)).alias("location"),
    )


def find_terms(lines: DataFrame, key: str, taxonomy: DataFrame, longest: int = 3) -> DataFrame:
    """Terms of taxonomy(term, skill) that occur as whole words: (key, skill, first_line, n)."""
    words = F.filter(F.split(F.lower("line"), "[^a-z0-9+#]+"), lambda w: w != "")
    rows = lines.select(key, "line_no", words.alias("w"))

    def grams(n: int) -> Column:
        last = F.size("w") - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    spread = rows.select(key, "line_no", F.explode(F.concat(*[grams(n) for n in range(1, longest + 1)])).alias("term"))
    known = spread.join(taxonomy.select("term", "skill").distinct(), "term")  # first the join: most word sequences are no term
    return known.groupBy(key, "skill").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"))
