"""Sections of a document by header lines: one line or two, letters drawn together, repeated headers suppressed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sections and the patterns of their headers, in order, the marks
# around a header, the longest header, and where a declaration begins.
SECTIONS = {
    "summary": (
        r"(?:C\s*\.?\s*AREER|professional|executive|career|personal|candidate|profile)?\s*(?:summary|objec\s*tive|profile|overview|about\s*me|bio|statement|goals?)\b",
        r"c\s*\.?\s*areer\s+objec\s*tive\b", r"profile\s+summary\b", r"professional\s+summary\b", r"career\s+summary\b", r"summary\s+of\s+qualifications\b",
        r"career\s+objec\s*tive\b", r"career\s+goals?\b", r"professional\s+profile\b", r"personal\s+profile\b", r"about\s*me\b", r"about\b", r"who\s+i\s+am\b",
    ),
    "skills": (
        r"(?:technical|core|key|professional|relevant|it|computer|software)?\s*(?:skills?|competencies|proficiencies|technologies|expertise|technology\s*stack|tools\s*&\s*technologies|toolkit|arsenal)\b",
        r"areas\s+of\s+expertise\b",
        r"(?:my\s+)?(?:toolkit|arsenal|tech\s*stack|tools)(?:\s*(?:&|and|\/)\s*(?:arsenal|tools|technologies|stack))?\b",
        r"programming\s+languages\b", r"technical\s+skills?\b", r"technical\s+skill\b", r"technical\s+competencies\b", r"core\s+skills?\b", r"soft\s+skills?\b",
        r"key\s+skills?\b", r"software\s+skills?\b", r"it\s+skills?\b", r"web\s+technologies\b", r"database\b", r"tools\s+(?:&|and)\s+technologies\b", r"basic\s+computer\s+skills\b",
    ),
    "experience": (
        r"(?:work|professional|employment|career|relevant|industry|job)\s+(?:experience|history|background|appointments|engagements)\b",
        r"experience\s+and\s+employment\b", r"work\s+history\b",
        r"(?:career|professional|work)\s+(?:story|journey|history)(?:\s*(?:&|and|\/)\s*(?:journey|story|history))?\b", r"^experience\b",
    ),
    "internship": (r"(?:internships?|internship\s+experience|industrial\s+training|internship\s*(?:\/|&|and)\s*training|trainings?|internship\s+and\s+trainings?)\b",),
    "education": (
        r"(?:academic|educational)?\s*(?:education|background|qualifications|academics|degrees|details)\b", r"education\s+and\s+training\b",
        r"(?:where\s+i\s+studied|academic\s+qualifications|academic\s+details?|educational\s+details?|academic\s+journey|schooling)\b",
    ),
    "projects": (
        r"(?:academic|personal|key|selected|technical|software|college|mini|final\s+year)?\s*(?:projects|project\s+experience|portfolio|applications)\b",
        r"(?:things\s+(?:i\s+have\s+|i've\s+)?built|selected\s+works|creations)\b",
    ),
    "certifications": (
        r"(?:certifications?|certificates?|licenses?|accreditations?|training\s*&\s*certifications?|licenses\s*&\s*certifications?|certifications\s*&\s*courses|courses\s*&\s*certifications?|courses?)\b",
    ),
    "achievements": (
        r"(?:achievements?|acheivements?|achievments?|acheivments?|awards?|honors?|recognitions?|accomplishments?|awards\s*&\s*achievements?|honors\s*&\s*awards?|honors\s*&\s*recognition|extracurricular\s+activities|competitions?)\b",
        r"(?:honors|awards|achievements?|acheivements?|recognition)(?:\s*(?:&|and|\/)\s*(?:awards|honors|recognition|achievements?|acheivements?))\b",
    ),
    "publications": (r"(?:publications?|research\s+publications?|papers?|published\s+papers?|research\s+papers?|conference\s+proceedings?)\b",),
    "strengths": (r"(?:strengths?|key\s+strengths?|core\s+strengths?|personal\s+traits?|competencies)\b",),
    "additional_qualifications": (r"(?:additional\s+qualifications?|other\s+qualifications?)\b",),
    "personal_details": (r"(?:personal\s+details?|personal\s+information|personal\s+profile)\b",),
    "languages": (r"(?:languages?|languages?\s+known|spoken\s+languages?|language\s+proficiency)\b",),
    "interests": (r"(?:interests?|areas\s+of\s+interest|hobbies|hobby|extracurricular\s+interests?)\b",),
    "declaration": (r"(?:declaration|statement\s+of\s+truth)\b",),
}
MARKS = r"[\d\.\-\*#_~=:\s·?•●▪▫◆◇➢►✓✔\[\]\(\)\{\}\<\>\|\/\\^]+"
LONGEST_HEADER = 60
DECLARES = r"\b(?:I\s+hereby\s+declare|hereby\s+declare)\b"
MAY_DECLARE = ("interests", "languages", "personal_details")
LEAD, WHOLE, DECLARATION = "personal_info_header", "full_text", "declaration"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def whole(patterns: Sequence[str]) -> str:
    """A pattern that fits what any of the patterns fits as a whole, in either case."""
    return "(?iu)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"


def all_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of every line, blank ones too; a null or empty text has none."""
    held = docs.where(F.length(text) > 0)
    return held.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def header_kind(line: Column, patterns: Mapping[str, Sequence[str]] = SECTIONS) -> Column:
    """The first section one of whose patterns fits the line without its marks, as it is or with short broken-off ends drawn together; else null."""
    def first(forms: Column) -> Column:
        kind = F.lit(None).cast("string")
        for section, of in reversed(patterns.items()):
            kind = F.when(forms["plain"].rlike(whole(of)) | forms["drawn"].rlike(whole(of)), section).otherwise(kind)
        return F.when(forms["plain"] != "", kind)

    plain = F.regexp_replace(F.regexp_replace(strip(line), f"^{MARKS}", ""), f"{MARKS}$", "")
    # a transform of one item evaluates the forms once for all patterns
    forms = F.transform(F.array(plain), lambda x: F.struct(x.alias("plain"), F.regexp_replace(x, r"(\b[a-zA-Z]{2,})\s+([a-zA-Z]{1,5}\b)", "$1$2").alias("drawn")))
    return F.when(F.length(strip(line)).between(1, LONGEST_HEADER), F.get(F.transform(forms, first), F.lit(0)))


def mark_headers(lines: DataFrame, key: str, patterns: Mapping[str, Sequence[str]] = SECTIONS) -> DataFrame:
    """Lines with ``ordinal`` (sections begun so far), and at the first line of each header ``kind`` and ``header``; ``in_header`` on its lines.

    A line that heads no section may head one together with the next line, which it then takes:
    of a run of such lines every second one is taken.  A header that names the section already open is text.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    joined = strip(F.concat_ws(" ", strip(F.col("line")), strip(F.lead("line").over(order))))
    rows = lines.withColumn("joined", F.when(F.lead("line").over(order).isNotNull(), joined))
    rows = rows.withColumn("one", header_kind(F.col("line"), patterns)).withColumn("two", F.when(F.col("one").isNull(), header_kind(F.col("joined"), patterns)))
    other = F.last(F.when(F.col("two").isNull(), F.col("line_no")), True).over(order)
    rows = rows.withColumn("pair", F.col("two").isNotNull() & ((F.col("line_no") - F.coalesce(other, F.lit(-1)) - 1) % 2 == 0))
    rows = rows.withColumn("taken", F.coalesce(F.lag("pair").over(order), F.lit(False)))
    found = F.when(~F.col("taken"), F.coalesce("one", F.when(F.col("pair"), F.col("two"))))
    rows = rows.withColumn("found", found)
    before = F.last("found", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("kind", F.when(F.col("found").isNotNull() & ~F.col("found").eqNullSafe(before), F.col("found")))
    second = F.coalesce(F.lag(F.col("kind").isNotNull() & F.col("pair")).over(order), F.lit(False))
    return rows.select(
        key, "line_no", "line", "kind",
        F.when(F.col("kind").isNotNull(), F.when(F.col("pair"), F.col("joined")).otherwise(strip(F.col("line")))).alias("header"),
        (F.col("kind").isNotNull() | second).alias("in_header"),
        F.count("kind").over(order).alias("ordinal"),
    )


def detect_sections(docs: DataFrame, key: str, text: str, patterns: Mapping[str, Sequence[str]] = SECTIONS, declares: str = DECLARES) -> DataFrame:
    """(key, section, header, first_line, body): what stands under each kind of header, several of a kind one after the other.

    Lines before the first header are ``personal_info_header``; a text without headers is ``full_text``.
    A declaration at the end of interests, languages or personal details is a section of its own.
    """
    marked = mark_headers(all_lines(docs, key, text), key, patterns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("in_header"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    parts = marked.groupBy(key, "ordinal").agg(F.max("kind").alias("kind"), F.max("header").alias("header"), F.min("line_no").alias("first_line"), body.alias("raw"))
    parts = parts.withColumn("sections", F.max("ordinal").over(Window.partitionBy(key))).withColumn("body", strip(F.col("raw")))
    at = F.when(F.col("kind").isin(*MAY_DECLARE), F.regexp_instr("body", F.lit(f"(?iu){declares}"))).otherwise(F.lit(0))
    parts = parts.withColumn("at", at)
    kind = F.coalesce("kind", F.when(F.col("sections") == 0, WHOLE).otherwise(LEAD))

    def piece(section, header, sub, text):
        return F.struct(section.alias("section"), header.alias("header"), F.lit(sub).alias("sub"), text.alias("body"))

    own = piece(kind, F.col("header"), 0, F.when(F.col("sections") == 0, F.col("raw")).when(F.col("at") > 0, strip(F.expr("substring(body, 1, at - 1)"))).otherwise(F.col("body")))
    declared = F.when(F.col("at") > 0, piece(F.lit(DECLARATION), F.lit(None).cast("string"), 1, strip(F.expr("substring(body, at)"))))
    pieces = parts.select(key, "ordinal", "first_line", F.explode(F.array_compact(F.array(own, declared))).alias("p")).select(key, "ordinal", "first_line", "p.*")
    pieces = pieces.where((F.col("section") != LEAD) | (F.col("body") != ""))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "sub", "header", "first_line", "body")))
    rows = pieces.groupBy(key, "section").agg(listed.alias("s"))
    # a declaration cut out of another section stands only where there is none yet
    rows = rows.withColumn("first", F.array_min(F.transform(F.filter("s", lambda x: x["body"] != ""), lambda x: F.struct(x["ordinal"], x["sub"]))))
    kept = F.filter("s", lambda x: (x["sub"] == 0) | (F.struct(x["ordinal"], x["sub"]) == F.col("first")))
    said = F.filter(kept, lambda x: F.col("first").isNotNull() & (F.struct(x["ordinal"], x["sub"]) >= F.col("first")))
    return rows.select(
        key, "section",
        F.get(F.filter(F.transform("s", lambda x: x["header"]), lambda h: h.isNotNull()), F.lit(0)).alias("header"),
        F.array_min(F.transform(kept, lambda x: x["first_line"])).alias("first_line"),
        F.array_join(F.transform(said, lambda x: x["body"]), "\n").alias("body"),
    )
