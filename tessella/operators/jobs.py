"""Jobs out of the lines of a document: signals of every line, then a state carried from line to line.

A job opens at a line with a signal (title, employer, period, or a stated duration in a
section of internships) that the open job has already; a line that brings what the open job lacks
fills it.  A job without an employer takes it from the next plain line, or its place
where the line reads like one.  Other lines are duties: bullets stand alone, lines that go on where
the last duty has not ended are joined to it.  A line that heads another section closes the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import dates
from tessella.operators import headers
from tessella.operators.folds import scan

# Bullets, verbs that begin a duty, words that go on with a sentence, legal forms and roles
# that tell an employer from a title, places, numbers in words, lines that are no employer.
BULLETS = "-•*●▪▫◆◇➢►✓✔·・∙"
DUTY = r"^(?:[\-\•\*\●\▪\▫\◆\◇\➢\►\✓\✔\·\・\∙\s]*)(?:gained|worked|developed|designed|implemented|conducted|created|managed|assisted|led|built|supported|contributed|participated|explored|analyzed|presented|responsible\s+for|in\s+charge\s+of|studied|handled|performed)\b"
GOES_ON = r"^(?:while|and|with|in|for|to|of|from|where|during|completing|working|gaining)\b"
JOINS = r"^(?:and|with|using|for|via|enabling|in|to|of|from|where)\b"
LEGAL = ("ltd", "limited", "pvt", "private", "pivate", "inc", "corp", "corporation", "llc", "gmbh", "co.", "co ")
ROLES = ("intern", "trainee", "engineer", "developer", "tester", "testing", "analyst", "specialist", "consultant", "manager", "lead", "designer", "architect", "marketing", "sales", "operations", "researcher")
PLACES = r",\s*(?:India|USA|UK|Tamil\s*Nadu|California|CA|TX|NY|MA|WA)\b"
CITIES = ("chennai", "bangalore", "hyderabad", "mumbai", "delhi", "pune")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
NO_EMPLOYER = (
    "certifications & courses", "certifications and courses", "courses & certifications", "certifications", "courses", "additional qualification", "additional qualifications",
    "awards & achievements", "awards and achievements", "honors & awards", "achievements", "achievement", "acheivement", "acheivements", "achievment", "achievments",
    "summary", "professional summary", "career objective", "objective", "education", "experience", "work experience", "internship", "internships", "skills",
    "technical skills", "core skills", "projects", "declaration", "statement of truth", "interests", "areas of interest", "hobbies", "hobby", "languages", "languages known",
    "contact", "personal details",
)
NO_ROLE = ("internship", "internships", "internship / training", "industrial training")
EMPLOYER_PLACE = r"^([A-Z][a-zA-Z0-9\s\.&]{2,35})[ \t]*,[ \t]*([A-Z][a-zA-Z0-9\s]{2,25})$"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def _has_any(c: Column, words: Sequence[str]) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))


def title_in(c: Column, titles: Sequence[str]) -> Column:
    """The longest known title in a text, with " Intern" where the text says so; else null."""
    ordered = sorted(titles, key=len, reverse=True)
    known = F.array(*[F.lit(t) for t in ordered])
    low = F.lower(c)
    named = F.get(F.filter(known, lambda t: F.regexp_like(low, F.concat(F.lit(r"\b\Q"), F.lower(t), F.lit(r"\E\b")))), F.lit(0))
    intern = F.regexp_like(low, F.concat(F.lit(r"\b\Q"), F.lower(named), F.lit(r"\E\s+intern(?:ship)?\b")))
    return F.when(intern & ~named.endswith("Intern"), F.concat(named, F.lit(" Intern"))).otherwise(named)


def stated_duration(c: Column) -> Column:
    """"two months" or "1 year" as it is written, in digits; the unit agrees with the number."""
    words = "|".join(NUMBERS)
    pattern = rf"(?i)\b(?:completed\s+)?({words}|\d+)\s+(months?|years?)\b"
    number = F.lower(F.regexp_extract(c, pattern, 1))
    spelled = F.array_position(F.array(*[F.lit(w) for w in NUMBERS]), number).cast("string")
    value = F.when(spelled != "0", spelled).otherwise(number)
    unit = F.when(F.lower(F.regexp_extract(c, pattern, 2)).contains("month"), "month").otherwise("year")
    return F.when(number != "", F.concat(value, F.lit(" "), unit, F.when(value.cast("decimal(38,0)") > 1, "s").otherwise("")))


def job_signals(lines: DataFrame, titles: Sequence[str], internship: Column, stops: Column | None = None) -> DataFrame:
    """Lines (line_no, line, trimmed, not blank) with what each says of a job.

    ``stops`` marks lines that head another section: by default names of sections and lines that begin like their headers.
    """
    line = F.col("line")
    low = F.lower(line)
    head = F.lit("(?i)^(?:" + "|".join(f"(?:{p})" for k, of in headers.SECTIONS.items() if k not in ("experience", "internship") for p in of) + ")")
    stop = stops if stops is not None else low.isin(*NO_EMPLOYER) | F.regexp_like(line, head)
    parts = F.filter(F.transform(F.split(line, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    duty = line.rlike(f"(?i){DUTY}")
    short = (F.size(F.split(F.trim(line), r"\s+")) <= 6) | line.contains("|") | line.contains(" - ") | line.contains(" at ")
    rows = lines.withColumns({"stop": F.coalesce(stop, F.lit(False)), "parts": F.when(line.contains("|"), parts), "duty": duty, "intern_section": internship})
    bare = F.trim(F.regexp_replace(line, r"^[\d\.\-\*•]+\s*", ""))
    intern = F.when(F.col("intern_section") & ~duty & line.rlike(r"(?i)\bintern(?:ship)?\b") & (F.length(bare) >= 3) & ~F.lower(bare).isin(*NO_ROLE), bare)
    rows = rows.withColumn("named", F.coalesce(F.when(~duty & short, title_in(line, titles)), intern)).withColumn("ranges", dates.date_ranges(line))

    def cleaned(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, r"(?i)\bPivate\b", "Private"), "[.,;]+$", "")

    one, two = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    legal, role = (_has_any(one, LEGAL), _has_any(two, LEGAL)), (_has_any(one, ROLES), _has_any(two, ROLES))
    second = (legal[1] & ~legal[0]) | ((legal[0] == legal[1]) & role[0] & ~role[1])
    first = (legal[0] & ~legal[1]) | ((legal[0] == legal[1]) & role[1] & ~role[0])
    sided = F.when(F.size("parts") == 2, F.when(second, F.struct(cleaned(two).alias("employer"), one.alias("title"))).when(first, F.struct(cleaned(one).alias("employer"), two.alias("title"))))
    rows = rows.withColumn("sided", sided)
    placed = F.filter("parts", lambda p: p.rlike(EMPLOYER_PLACE) & ~F.lower(F.regexp_extract(p, EMPLOYER_PLACE, 1)).isin(*NO_EMPLOYER))
    in_parts = F.get(F.filter(F.transform(F.reverse("parts"), lambda p: title_in(p, titles)), lambda x: x.isNotNull()), F.lit(0))
    rows = rows.withColumn("title", F.coalesce("sided.title", in_parts, "named")).withColumn("placed", F.when(F.col("sided").isNull(), F.element_at(F.when(F.size(placed) > 0, placed), -1)))
    free = F.filter("parts", lambda p: ~p.rlike(EMPLOYER_PLACE) & ~p.eqNullSafe(F.col("title")) & (F.size(dates.date_ranges(p)) == 0) & (F.length(p) < 50) & ~F.lower(p).isin(*NO_EMPLOYER) & ~p.rlike(r"^\d+$"))
    alone = F.when(line.rlike(EMPLOYER_PLACE) & (F.size("ranges") == 0) & F.col("title").isNull() & ~F.lower(F.regexp_extract(line, EMPLOYER_PLACE, 1)).isin(*NO_EMPLOYER), line)
    both = F.coalesce(F.when(F.col("sided.employer").rlike(EMPLOYER_PLACE), F.col("sided.employer")), F.col("placed"), F.when(F.col("sided").isNull() & (F.size(F.coalesce(free, F.array())) == 0), alone))
    at = _found(line, r"\b(?:at|@)\s+([A-Z][a-zA-Z0-9\s,\.&]{2,30})\b")
    employer = F.coalesce(_found(both, EMPLOYER_PLACE), F.col("sided.employer"), F.get(free, F.lit(0)), at)
    plain = ~F.substring(line, 1, 1).isin(*BULLETS) & ~line.rlike("^[Dd]uration")
    text = F.trim(F.regexp_replace(line, f"^[{BULLETS.replace('-', chr(92) + '-')} ]+", ""))
    heads = low.isin(*NO_EMPLOYER) | F.regexp_like(line, F.lit("(?i)^(?:" + "|".join(f"(?:{p})" for of in headers.SECTIONS.values() for p in of) + ")"))
    return rows.withColumns({
        "employer": employer, "place": F.when(both.isNotNull(), _found(both, EMPLOYER_PLACE, 2)),
        "start": F.get("ranges", F.lit(0))["start"], "end": F.get("ranges", F.lit(0))["end"], "duration": F.when(F.size("ranges") == 0, stated_duration(line)),
        "intern": F.col("intern_section") | low.contains("intern"), "may_employ": plain & (F.length(line) < 60) & ~heads,
        "reads_place": line.rlike(f"(?i){PLACES}") | low.isin(*CITIES), "may_place": plain & line.rlike(r"^[A-Z][a-zA-Z0-9\s,]{2,35}$") & (F.length(line) < 35) & ~heads,
        "goes_on": low.contains("fresher") | line.rlike(f"(?i){GOES_ON}"), "bullet": F.substring(line, 1, 1).isin(*BULLETS), "text": text,
        "joins": text.rlike(f"(?i){JOINS}"),
    }).drop("parts", "duty", "named", "ranges", "sided", "placed")


SIGNALS = ("line_no", "line", "stop", "intern_section", "title", "employer", "place", "start", "end", "duration", "intern", "may_employ", "reads_place", "may_place", "goes_on", "bullet", "text", "joins")


def _step(s: Column, x: Column) -> Column:
    """The state after a line: the job it belongs to, what the job has, what the line gave and its role."""
    has = {"t": x["title"].isNotNull(), "c": x["employer"].isNotNull(), "u": x["duration"].isNotNull(), "d": x["start"].isNotNull()}
    live = s["open"] & ~x["stop"]
    gives = {k: live & ~s[k] & v for k, v in has.items()}
    fills = gives["t"] | gives["c"] | gives["u"] | gives["d"]
    opens = ~x["stop"] & ~fills & (has["t"] | has["d"] | has["c"] | (x["intern_section"] & has["u"]))
    rest = live & ~fills & ~opens
    plain = rest & ~x["goes_on"]
    employs = plain & ~s["c"] & x["may_employ"] & ~x["reads_place"]
    places = plain & ((~s["c"] & x["may_employ"] & x["reads_place"]) | (s["c"] & ~s["p"] & x["may_place"]))
    duty = plain & ~employs & ~places
    joins = duty & s["told"] & (s["unended"] | x["joins"]) & ~x["bullet"]
    new = (rest & x["goes_on"]) | (duty & ~joins & (x["bullet"] | (F.length(x["text"]) > 3)))
    role = F.when(x["stop"], "stop").when(opens, "opens").when(fills, "fills").when(employs, "employer").when(places, "place").when(joins, "joins").when(new, "duty").otherwise("none")
    place = x["place"].isNotNull()
    return F.struct(
        (s["job"] + opens.cast("int")).alias("job"), (~x["stop"] & (s["open"] | opens)).alias("open"),
        F.when(opens, has["t"]).otherwise(s["t"] | gives["t"]).alias("t"), F.when(opens, has["c"]).otherwise(s["c"] | gives["c"] | employs).alias("c"),
        F.when(opens, place).otherwise(s["p"] | (gives["c"] & place) | places).alias("p"), F.when(opens, has["u"] | has["d"]).otherwise(s["u"] | gives["u"] | gives["d"]).alias("u"),
        F.when(opens, has["d"]).otherwise(s["d"] | gives["d"]).alias("d"), (~opens & (s["told"] | new | joins)).alias("told"),
        F.when(new | joins, ~x["text"].endswith(".")).otherwise(~opens & s["unended"]).alias("unended"), role.alias("role"),
        *[((opens & has[k]) | gives[k]).alias(f"gave_{k}") for k in has],
        ((opens & place) | (gives["c"] & place & ~s["p"])).alias("gave_p"),
    )


def fold_jobs(signals: DataFrame, key: str) -> DataFrame:
    """Lines of ``job_signals`` with their job (0: none), role and which of their values the job takes."""
    lines = signals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*SIGNALS))).alias("lines"))
    no = F.lit(False)
    zero = F.struct(F.lit(0).alias("job"), *[no.alias(k) for k in ("open", "t", "c", "p", "u", "d", "told", "unended")], F.lit("none").alias("role"), *[no.alias(f"gave_{k}") for k in "tcudp"])
    both = F.arrays_zip(F.col("lines").alias("lines"), F.col("states"))
    return lines.withColumn("states", scan(F.col("lines"), zero, _step)).select(key, F.explode(both).alias("z")).select(key, "z.lines.*", "z.states.job", "z.states.role", *[f"z.states.gave_{k}" for k in "tcudp"])


def jobs(signals: DataFrame, key: str, as_of: Column) -> DataFrame:
    """One row for each job: title, employer, place, start, end, duration, months, internship and duties in order."""
    order = Window.partitionBy(key).orderBy("line_no")
    rows = fold_jobs(signals, key).where((F.col("job") > 0) & ~F.col("role").isin("stop", "none"))
    rows = rows.withColumn("piece", F.when(F.col("role").isin("duty", "joins"), F.count_if(F.col("role") == "duty").over(order)))
    taken = {
        "title": F.when(F.col("gave_t"), F.col("title")),
        "employer": F.when(F.col("gave_c"), F.col("employer")).when(F.col("role") == "employer", F.regexp_replace(F.regexp_replace("line", r"(?i)\bPivate\b", "Private"), "[.,;]+$", "")),
        "start": F.when(F.col("gave_d"), F.col("start")), "end": F.when(F.col("gave_d"), F.col("end")), "duration": F.when(F.col("gave_u"), F.col("duration")),
        "intern": F.when((F.col("role") == "opens") | F.col("gave_t"), F.col("intern")),
    }
    town = F.when(F.col("role") == "place", F.col("line")).when(F.col("gave_p"), F.col("place"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    pieces = rows.groupBy(key, "job", "piece").agg(*[F.max(v).alias(k) for k, v in taken.items()], F.max(F.when(town.isNotNull(), F.struct("line_no", town.alias("place")))).alias("town"), F.min("line_no").alias("line_no"), text.alias("text"))
    duties = F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("piece", "text")))), lambda x: x["text"])
    found = pieces.groupBy(key, "job").agg(*[F.max(k).alias(k) for k in taken], F.max("town").alias("town"), F.min("line_no").alias("first_line"), duties.alias("duties"))
    months = dates.months_between_days(dates.parse_date(F.col("start"), as_of), dates.parse_date(F.col("end"), as_of))
    intern = F.coalesce(F.col("intern"), F.lit(False)) | F.coalesce(F.lower("title").contains("intern"), F.lit(False))
    return found.select(key, "job", "first_line", "title", "employer", F.col("town.place").alias("place"), "start", "end", "duration", months.alias("months"), intern.alias("internship"), "duties")
