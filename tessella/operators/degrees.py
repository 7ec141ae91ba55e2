"""Degrees out of the lines of a document: signals of every line, a state carried from line to line, a merge by tiers.

A degree opens at every line that names one.  It takes the institution of its line, else one that
waits from an earlier line of the same kind (college or school), and a school degree else the last
school.  An institution on a line of its own goes to the open degree if that lacks
one and is of its kind, else it waits.  Other lines fill what the open degree lacks; a percentage replaces
its score.  Degrees of one document are then merged: schools by tier, others by the
letters of their name, bachelors also where one name holds the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.folds import scan

# Degrees, their names and tiers in order; fields of study; words of schools and colleges.
DEGREE, HIGHER, SECONDARY = "Degree", "Higher Secondary", "SSLC / Secondary"
DEGREES = (
    (r"\b(?:Ph\.?D\.?|Doctor of Philosophy|Doctorate)\b", "Ph.D.", DEGREE),
    (r"\b(?:M\.?Tech\.?|Master of Technology)\b", "M.Tech", DEGREE),
    (r"\b(?:M\.?Sc\.?|Master of Science|Master's degree|Masters)\b", "M.Sc.", DEGREE),
    (r"\b(?:M\.?S\.?)\b", "M.S.", DEGREE),
    (r"\b(?:M\.?B\.?A\.?|Master of Business Administration)\b", "MBA", DEGREE),
    (r"\b(?:M\.?C\.?A\.?|Master of Computer Applications)\b", "MCA", DEGREE),
    (r"\b(?:M\.?Com\.?|Master of Commerce)\b", "M.Com", DEGREE),
    (r"\b(?:B\.?Tech\.?|Bachelor of Technology)\b", "B.Tech", DEGREE),
    (r"\b(?:B\.?E\.?|Bachelor of Engineering)\b", "B.E.", DEGREE),
    (r"\b(?:BACHELORS?\s+OF\s+SCIENCE|Bachelor of Science)\b", "Bachelor of Science", DEGREE),
    (r"\b(?:B\.?Sc\.?)\b", "B.Sc.", DEGREE),
    (r"\b(?:B\.?Com(?:\s*\([^)]*\))?|Bachelor of Commerce)\b", "B.Com", DEGREE),
    (r"\b(?:B\.?S\.?|Bachelor of Arts|Bachelor's degree|Bachelors)\b", "B.S.", DEGREE),
    (r"\b(?:B\.?C\.?A\.?|Bachelor of Computer Applications)\b", "BCA", DEGREE),
    (r"\b(?:B\.?B\.?A\.?|Bachelor of Business Administration)\b", "BBA", DEGREE),
    (r"\b(?:B\.?A\.?)\b", "B.A.", DEGREE),
    (r"\b(?:Class\s*(?:XII|12(?:th)?)|HSLC)\b", "Class XII (HSLC)", HIGHER),
    (r"\b(?:HSE\s*(?:\(Class\s*12\))?|Higher\s*Secondary\s*Certificate|Higher\s*Secondary(?!\s*Schoo?l)|HSC|12th(?:\s*Grade|\s*Standard)?)\b", "Higher Secondary", HIGHER),
    (r"\b(?:Class\s*(?:X|10(?:th)?))\b", "Class X (SSLC)", SECONDARY),
    (r"\b(?:SSLC\s*(?:\(Class\s*10\))?|Secondary\s*School\s*Leaving\s*Certificate|SSLC|10th(?:\s*Grade|\s*Standard)?|Secondary\s*Education|Secondary\s*Certificate)\b", "SSLC", SECONDARY),
)
INSTITUTION = r"\b(?:University|College|Institute|School|Academy|Polytechnic|IIT|NIT|BITS|MIT|Matriculation|Matric|Vidya|Vidhyalaya|Campus|Arts\s*&\s*Science|Arts\s+and\s+Science)\b"
SCHOOL_WORDS = ("school", "matric", "hr. sec.", "higher secondary", "high school", "vidya", "public school", "academy")
COLLEGE_WORDS = ("university", "college", "institute", "iit", "nit", "bits", "mit", "stanford", "harvard", "polytechnic", "arts & science", "arts and science", "campus")
PURSUING, COMPLETED = "Currently Pursuing", "Completed"
PURSUES = r"(?i)\b(?:expected|pursuing|current|present|ongoing)\b"
COMPLETES = r"(?i)\b(?:graduated|completed|passed|batch|class\s+of|passing)\b"
YEARS = r"(?i)\b(19\d{2}|20\d{2})\s*(?:[-–—∣|~]|to)\s*(19\d{2}|20\d{2}|Present|Current|Expected\s*\d{4})\b"
YEARS_DRAWN = r"\b(19\d{2}|20\d{2})[a-zA-Z\-_–—~∣|\s]*(19\d{2}|20\d{2})\b"
YEAR = r"\b(19\d{2}|20\d{2})\b"
SCORES = (
    ("CGPA", r"(?i)\bCGPA\s*[:\-]?\s*(\d{1,2}(?:\.\d{1,3})?)\b"),
    ("GPA", r"(?i)\bGPA\s*[:\-]?\s*(\d{1,2}(?:\.\d{1,3})?%?)"),
    ("Aggregate Score", r"(?i)\b(?:Aggregate\s+Score|Aggregate)\s*[:\-]?\s*(\d{1,2}(?:\.\d{1,3})?%?)"),
    ("Grade", r"(?i)\b(?:Scored|Percentage|Score|Marks|Grade)\s*[:\-]?\s*(\d{1,2}(?:\.\d{1,3})?%?)"),
    ("Percentage", r"\b(\d{1,2}(?:\.\d{1,3})?%)(?!\w)"),
    ("Grade", r"(?i)\bGrade\s*[:\-]?\s*([A-Za-z\+\-]+)\b"),
)


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def _institution(line: Column, university: Column, majors) -> Column:
    """The institution's name: the line without years, degrees, fields of study, university and scores, and without its place."""
    c = F.regexp_replace(line, r"(?i)\b(?:19|20)\d{2}\s*(?:[-–—]|to)\s*(?:19|20)\d{2}\b", "")
    c = F.regexp_replace(c, r"\b(?:19|20)\d{2}\b", "")
    for pattern, _, _ in DEGREES:
        c = F.regexp_replace(c, f"(?i){pattern}", "")
    c = F.regexp_replace(c, r"(?i)\b(?:" + "|".join(majors) + r")\b", "") if majors else c
    c = F.when(university.isNotNull(), F.regexp_replace(c, F.concat(F.lit(r"(?i)\([^)]*\Q"), university, F.lit(r"\E[^)]*\)")), F.lit(""))).otherwise(c)
    c = F.regexp_replace(c, r"(?i)(?:GPA|CGPA|Percentage|Score|Grade)?\s*:?\s*\d{1,2}(?:\.\d{1,2})?\s*(?:\/\s*\d{1,2}(?:\.\d{1,2})?|\%)?", "")
    return F.trim(F.regexp_replace(c, r"(?i),?\s*(?:Expected|Passing|Batch|Graduation|Class\s+of)\b.*", ""))


def degree_signals(lines: DataFrame, as_of: int, majors: tuple[str, ...] = ()) -> DataFrame:
    """Lines (line_no, line) with what each says of a degree; ``as_of`` is the present year, ``majors`` the known fields of study in order."""
    line = F.col("line")
    low = F.lower(line)
    hits = [F.when(line.rlike(f"(?i){p}"), F.struct(F.lit(n).alias("degree"), F.lit(t).alias("tier"))) for p, n, t in DEGREES]
    school_name = line.rlike(r"(?i)^\s*(?:Government|Govt|Girls|Boys|Matriculation)\b") & line.rlike(r"(?i)\b(?:School|College|Institute)\b")
    rows = lines.withColumn("hit", F.coalesce(*hits)).withColumn("hit", F.when(~(F.col("hit.degree").isin("Higher Secondary", "SSLC") & school_name), F.col("hit")))
    major = F.coalesce(*[F.when(line.rlike(rf"(?i)\b{m}\b"), m) for m in majors], F.when(F.col("hit").isNotNull() & low.contains("general"), "General"))
    university = F.coalesce(_found(line, r"(?i)\((?:Affiliated\s+to\s+)?(University of [^)]+|[A-Z][a-zA-Z\s]+ University)\)"), _found(line, r"(?i)(?:Affiliated\s+to|Affiliated\s+with)\s+([A-Z][a-zA-Z\s]+(?:University|Institute))"))
    rows = rows.withColumn("university", university)
    rows = rows.withColumn("bare", F.when(line.rlike(f"(?i){INSTITUTION}"), _institution(line, F.col("university"), majors)))
    place = _found(F.col("bare"), r",\s*([A-Z][a-zA-Z\s]+,\s*[A-Z][a-zA-Z\s]+|[A-Z][a-zA-Z\s]{3,20})\s*$")
    place = F.when(~F.lower(place).rlike("college|university|school|arts"), place)
    rows = rows.withColumn("place", place)
    name = F.when(F.col("place").isNotNull(), F.regexp_replace("bare", r",\s*([A-Z][a-zA-Z\s]+,\s*[A-Z][a-zA-Z\s]+|[A-Z][a-zA-Z\s]{3,20})\s*$", "")).otherwise(F.col("bare"))
    for pattern, put in ((r"[\-\|\•\*\(\)]", " "), (r"[\s,\.\-]+$", ""), (r"^[:\-\s,]+", ""), (r"(?i)^\s*in\s+", ""), (r"\s+", " ")):
        name = F.regexp_replace(name, pattern, put)
    name = F.when((F.length(name) > 3) & ~F.lower(name).isin("education", "academic background", "qualifications"), name)
    rows = rows.withColumn("institution", name)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower("institution").contains(w))
    start, last = (F.coalesce(_found(line, YEARS, g), F.when(_found(line, YEARS_DRAWN) != _found(line, YEARS_DRAWN, 2), _found(line, YEARS_DRAWN, g))) for g in (1, 2))
    rows = rows.withColumns({"from": start.cast("int"), "last": last, "pursues": line.rlike(PURSUES)})
    ends = F.when(F.col("last").rlike("(?i)present|current"), as_of).otherwise(_found(F.col("last"), YEAR).cast("int"))
    one = F.when(F.col("from").isNull(), _found(line, YEAR).cast("int"))
    rows = rows.withColumns({"ranged": F.col("from").isNotNull(), "year": F.coalesce(ends, one)})
    pursues = F.col("pursues") | (F.col("year") >= as_of)
    pursues = F.coalesce(pursues, F.col("pursues"), F.lit(False))
    expected = F.when(F.coalesce(F.col("year") >= as_of, F.lit(False)) | (~F.col("ranged") & F.col("pursues")), F.col("year"))
    completed = F.when(expected.isNull() & (F.col("ranged") | line.rlike(COMPLETES)), F.col("year"))
    score = F.coalesce(*[F.when(_found(line, p).isNotNull(), F.struct(F.lit(k).alias("kind"), _found(line, p).alias("value"))) for k, p in SCORES])
    rows = rows.withColumns({"pursues": pursues, "expected": expected, "completed": completed, "scored": score})
    value, kind = F.col("scored.value"), F.col("scored.kind")
    share = (kind != "CGPA") & (value.endswith("%") | (value.rlike(r"^\d") & (F.expr("try_cast(scored.value AS double)") > 10)))
    return rows.withColumns({
        "degree": F.col("hit.degree"), "tier": F.col("hit.tier"), "major": major, "school": F.coalesce(has(SCHOOL_WORDS) & ~has(COLLEGE_WORDS), F.lit(False)),
        "score": F.when(F.coalesce(share, F.lit(False)), F.concat(F.regexp_replace(value, "%$", ""), F.lit("%"))).otherwise(value),
        "score_kind": F.when(F.coalesce(share, F.lit(False)), "Percentage").otherwise(kind), "started": F.col("from"), "ended": F.col("year"),
    }).drop("hit", "bare", "scored", "from", "last")


SIGNALS = ("line_no", "degree", "tier", "major", "institution", "university", "place", "school", "started", "ended", "expected", "completed", "ranged", "pursues", "score", "score_kind")


def _step(s: Column, x: Column) -> Column:
    """The state after a line; ``at`` counts lines, and institutions are remembered by the count of their line."""
    at = s["at"] + 1
    opens, named = x["degree"].isNotNull(), x["institution"].isNotNull()
    schools = F.when(opens, x["tier"] != DEGREE).otherwise(s["schools"])
    waits = opens & ~named & (s["waiting"] > 0) & (s["waiting_school"] == schools)
    own = F.when(named, at).when(waits, s["waiting"]).when(schools & (s["last_school"] > 0), s["last_school"]).otherwise(0)
    fills = ~opens & named & (s["n"] > 0) & (s["held"] == 0)
    fits = fills & (s["schools"] | ~x["school"])
    parks = ~opens & named & ~fills
    given = F.when(opens, own).when(fits, at).otherwise(0)
    remembers = ((opens | parks) & named & x["school"]) | (fits & s["schools"])
    taken = (fills | (~opens & ~named)) & (s["n"] > 0)
    status = (
        F.when(opens & (x["pursues"] | F.coalesce(x["expected"].isNotNull(), F.lit(False))), PURSUING)
        .when(opens & x["completed"].isNotNull(), COMPLETED)
        .when(taken & ~s["schools"] & x["pursues"], PURSUING)
        .when(taken & ~fills & ~s["has_completed"] & x["completed"].isNotNull(), COMPLETED)
    )
    return F.struct(
        at.alias("at"), (s["n"] + opens.cast("int")).alias("n"), schools.alias("schools"), F.when(opens | fits, given).otherwise(s["held"]).alias("held"),
        F.when(parks, at).when(opens & (named | waits), 0).otherwise(s["waiting"]).alias("waiting"), F.when(parks, x["school"]).otherwise(s["waiting_school"]).alias("waiting_school"),
        F.when(remembers, at).when(waits & schools, s["waiting"]).otherwise(s["last_school"]).alias("last_school"),
        F.when(opens, x["completed"].isNotNull()).otherwise(s["has_completed"] | (taken & x["completed"].isNotNull())).alias("has_completed"),
        given.alias("given"), (waits | named).alias("with_place"), F.when(opens, "opens").when(fills, "fills").when(parks, "waits").when(s["n"] > 0, "adds").otherwise("none").alias("role"), status.alias("status"),
    )


def fold_degrees(signals: DataFrame, key: str) -> DataFrame:
    """One row for each degree of a document, in order, before the merge."""
    lines = signals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*SIGNALS))).alias("lines"))
    no, none = F.lit(False), F.lit(0)
    zero = F.struct(none.alias("at"), none.alias("n"), no.alias("schools"), none.alias("held"), none.alias("waiting"), no.alias("waiting_school"), none.alias("last_school"), no.alias("has_completed"), none.alias("given"), no.alias("with_place"), F.lit("none").alias("role"), F.lit(None).cast("string").alias("status"))
    states = lines.withColumn("states", scan(F.col("lines"), zero, _step))
    source = F.try_element_at("lines", F.nullif(F.col("z.states.given"), F.lit(0)))
    rows = states.select(key, "lines", F.explode(F.arrays_zip("lines", "states")).alias("z")).select(key, "z.lines.*", "z.states.*", source.alias("source"))
    rows = rows.where((F.col("n") > 0) & (F.col("role") != "waits"))
    other = F.col("role") == "opens"
    rows = rows.withColumns({"university": F.coalesce("university", F.when(other & F.col("with_place") & ~F.col("schools"), F.col("source.university"))), "place": F.coalesce("place", F.when(other & F.col("with_place"), F.col("source.place")))})

    def first(c):
        return F.min(F.when(F.col(c).isNotNull(), F.struct("line_no", c)))[c].alias(c)

    share = F.max(F.when((F.col("role") == "adds") & (F.col("score_kind") == "Percentage"), F.struct("line_no", "score", "score_kind")))
    score = F.coalesce(share, F.min(F.when(F.col("score").isNotNull(), F.struct("line_no", "score", "score_kind"))))
    return rows.groupBy(key, "n").agg(
        F.min("line_no").alias("first_line"), F.max("degree").alias("degree"), F.max("tier").alias("tier"), first("major"),
        F.max(F.when(F.col("source").isNotNull(), F.struct("line_no", "source.institution")))["institution"].alias("institution"), first("university"), first("place"),
        first("started"), first("ended"), first("expected"), first("completed"), score["score"].alias("score"), score["score_kind"].alias("score_kind"),
        F.max(F.when(F.col("status").isNotNull(), F.struct("line_no", "status")))["status"].alias("status"),
    )


def merge_degrees(degrees: DataFrame, key: str) -> DataFrame:
    """Degrees of a document that are the same one become one: the first value of each field stands, and pursuing outweighs completed."""
    letters = F.lower(F.regexp_replace("degree", r"[.\s]", ""))
    listed = degrees.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", letters.alias("letters"), "tier"))).alias("d"))

    def alike(a: Column, b: Column) -> Column:
        bachelors = a["letters"].startswith("b") & b["letters"].startswith("b") & (a["letters"].contains(b["letters"]) | b["letters"].contains(a["letters"]))
        return F.when(b["tier"] != DEGREE, a["tier"] == b["tier"]).otherwise((a["letters"] == b["letters"]) | bachelors)

    def join(heads: Column, x: Column) -> Column:
        head = F.get(F.filter(heads, lambda a: (a["n"] == a["head"]) & alike(a, x)), F.lit(0))["n"]
        return F.concat(heads, F.array(F.struct(x["n"].alias("n"), x["letters"].alias("letters"), x["tier"].alias("tier"), F.coalesce(head, x["n"]).alias("head"))))

    none = F.slice(F.transform("d", lambda x: F.struct(x["n"].alias("n"), x["letters"].alias("letters"), x["tier"].alias("tier"), x["n"].alias("head"))), 1, 0)
    heads = listed.select(key, F.explode(F.aggregate("d", none, join)).alias("h")).select(key, "h.n", "h.head")
    rows = degrees.join(heads, [key, "n"])
    fields = [c for c in degrees.columns if c not in (key, "n", "first_line", "status")]
    order = Window.partitionBy(key).orderBy("head")
    merged = rows.groupBy(key, "head").agg(
        F.min("first_line").alias("first_line"), *[F.min(F.when(F.col(c).isNotNull(), F.struct("n", c)))[c].alias(c) for c in fields],
        F.coalesce(F.max(F.when(F.col("status") == PURSUING, PURSUING)), F.min(F.when(F.col("status").isNotNull(), F.struct("n", "status")))["status"]).alias("status"),
    )
    return merged.select(key, F.row_number().over(order).alias("entry"), "first_line", *fields, "status")
