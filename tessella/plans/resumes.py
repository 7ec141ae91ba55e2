"""Queries on documents of lines: sections, jobs and degrees, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import education
from tessella.operators import degrees, headers, jobs
from tessella.plans.registry import _LINES, _lines, query

# Fixed values of these bindings: the documents' words are invented, so headers go by the shape of a line.
_SHAPES = {
    "summary": (r"[a-z]{2,9}", r"the\s+and"),
    "skills": (r"[a-z]{2,5}\.?\s+[a-z]{2,7}", r"all\s+rights\s+reserved"),
    "experience": (r"[a-z]+\.\s+[a-z]+\.\s+[a-z]+", r"[a-z]+\s+was\s+.*"),
    "interests": (r"(?:[a-z]+\s+){2}[a-z]+",),
    "languages": (r"(?:[a-z]+\s+){4,5}[a-z]+", r"licensed\s+under\s+.*"),
}
# Accents go, as the engines differ in what ends a word after an accented letter.
_ACCENTS = ("ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜàáâäçèéêëíîïñóôöùúûüß", "AAAACEEEEIIINOOOUUUUaaaaceeeeiiinooouuuus")
_DECLARES = r"\b(?:Of\s+the|La\s+de|Released\s+under)\b"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _kind(line: str) -> str:
    marks = headers.MARKS
    plain = f"regexp_replace(regexp_replace({_strip(line)}, '^{marks}', ''), '{marks}$', '')"
    drawn = rf"regexp_replace({plain}, '(\b[a-zA-Z]{{2,}})\s+([a-zA-Z]{{1,5}}\b)', '\1\2', 'g')"
    fits = [(k, "^(?:" + "|".join(f"(?:{p})" for p in of) + ")$") for k, of in _SHAPES.items()]
    arms = " ".join(f"WHEN regexp_matches({plain}, '(?i){p}') OR regexp_matches({drawn}, '(?i){p}') THEN '{k}'" for k, p in fits)
    return f"CASE WHEN length({_strip(line)}) BETWEEN 1 AND 60 AND {plain} <> '' THEN CASE {arms} END END"


_MARKED = f"""raw AS (SELECT doc_id, i - 1 AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT doc_id, string_split(translate(text, '{_ACCENTS[0]}', '{_ACCENTS[1]}'), chr(10)) AS parts FROM documents WHERE length(text) > 0))),
pairs AS (SELECT *, {_strip(f"{_strip('line')} || ' ' || {_strip('lead(line) OVER (PARTITION BY doc_id ORDER BY line_no)')}")} AS joined FROM raw),
kinds AS (SELECT *, {_kind('line')} AS one, {_kind('joined')} AS joint FROM pairs),
twos AS (SELECT *, CASE WHEN one IS NULL THEN joint END AS two FROM kinds),
runs AS (SELECT *, coalesce(max(line_no) FILTER (two IS NULL) OVER (PARTITION BY doc_id ORDER BY line_no), -1) AS other FROM twos),
picked AS (SELECT *, two IS NOT NULL AND (line_no - other - 1) % 2 = 0 AS pair FROM runs),
freed AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS taken FROM picked),
found AS (SELECT *, CASE WHEN NOT taken THEN coalesce(one, CASE WHEN pair THEN two END) END AS f FROM freed),
opened AS (SELECT *, CASE WHEN f IS DISTINCT FROM last_value(f IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN f END AS kind FROM found),
marked AS (SELECT *, CASE WHEN kind IS NOT NULL THEN CASE WHEN pair THEN joined ELSE {_strip('line')} END END AS header,
  kind IS NOT NULL OR coalesce(lag(kind IS NOT NULL AND pair) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS in_header,
  count(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS ordinal FROM opened)"""


@query(rf"""WITH {_MARKED},
parts AS (SELECT doc_id, ordinal, max(kind) AS kind, max(header) AS header, min(line_no) AS first_line,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT in_header), '') AS raw, max(max(ordinal)) OVER (PARTITION BY doc_id) AS n FROM marked GROUP BY doc_id, ordinal),
stripped AS (SELECT *, {_strip('raw')} AS body FROM parts),
cut AS (SELECT *, CASE WHEN kind IN ('interests', 'languages', 'personal_details') AND regexp_matches(body, '(?i){_DECLARES}') THEN
  length(regexp_extract(body, '(?is)^(.*?){_DECLARES}', 1)) END AS pos FROM stripped),
pieces AS (
  SELECT doc_id, ordinal, 0 AS sub, coalesce(kind, CASE WHEN n = 0 THEN 'full_text' ELSE 'personal_info_header' END) AS section, header, first_line,
    CASE WHEN n = 0 THEN raw WHEN pos IS NOT NULL THEN {_strip('substring(body, 1, pos)')} ELSE body END AS body FROM cut
  UNION ALL SELECT doc_id, ordinal, 1, 'declaration', NULL, first_line, {_strip('substring(body, pos + 1)')} FROM cut WHERE pos IS NOT NULL),
held AS (SELECT *, min(ordinal * 2 + sub) FILTER (body <> '') OVER (PARTITION BY doc_id, section) AS first FROM pieces WHERE section <> 'personal_info_header' OR body <> '')
SELECT doc_id, section, arg_min(header, ordinal * 2 + sub) FILTER (header IS NOT NULL) AS header, min(first_line) FILTER (sub = 0 OR ordinal * 2 + sub = first) AS first_line,
  sha256(coalesce(string_agg(body, chr(10) ORDER BY ordinal, sub) FILTER (ordinal * 2 + sub >= first AND (sub = 0 OR ordinal * 2 + sub = first)), '')) AS body_sha256
FROM held GROUP BY doc_id, section""")
def detected_sections(t):
    """Sections of every document under headers of one line or two, with equal neighbours suppressed and declarations cut out."""
    docs = t.documents.select("doc_id", F.translate("text", *_ACCENTS).alias("text"))
    found = headers.detect_sections(docs, "doc_id", "text", _SHAPES, _DECLARES)
    return found.select("doc_id", "section", "header", "first_line", F.sha2("body", 256).alias("body_sha256"))


# What a line says of a job, by its length and marks; the rules that carry the state are the library's.
_SIGNALS = {
    "stop": "regexp_like(line, '^(Licensed|All rights|Released)')",
    "intern_section": "doc_id % 3 = 0",
    "title": "CASE WHEN length(line) % 7 = 0 THEN substring(line, 1, 9) END",
    "employer": "CASE WHEN length(line) % 5 = 1 THEN substring(line, 5, 9) END",
    "place": "CASE WHEN length(line) % 10 = 1 THEN substring(line, 15, 9) END",
    "start": "CASE WHEN length(line) % 11 = 3 THEN '2001' END",
    "end": "CASE WHEN length(line) % 11 = 3 THEN '2003' END",
    "duration": "CASE WHEN length(line) % 11 = 4 THEN '2 months' END",
    "intern": "doc_id % 3 = 0 OR line LIKE '%in%'",
    "may_employ": "length(line) < 60",
    "reads_place": "length(line) % 4 = 2",
    "may_place": "length(line) < 90",
    "goes_on": "regexp_like(line, '^(Of|In|De|To) ')",
    "bullet": "length(line) % 3 = 0",
    "text": "line",
    "joins": "regexp_like(line, '^(The|La|Of) ')",
}


@query(rf"""WITH RECURSIVE {_LINES},
x AS MATERIALIZED (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, {", ".join(f'{v.replace("regexp_like", "regexp_matches")} AS "{k}"' for k, v in _SIGNALS.items())} FROM lines),
s AS (
  SELECT doc_id, 0::BIGINT AS i, 0 AS job, false AS open, false AS t, false AS c, false AS p, false AS u, false AS d, false AS told, false AS unended, 'none' AS role, false AS gt, false AS gc, false AS gu, false AS gd, false AS gp FROM x WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN role = 'opens' THEN job + 1 ELSE job END, open AND NOT stop OR role = 'opens',
    CASE WHEN role = 'opens' THEN ht ELSE t OR gt END, CASE WHEN role = 'opens' THEN hc ELSE c OR gc OR role = 'employer' END,
    CASE WHEN role = 'opens' THEN hp ELSE p OR gc AND hp OR role = 'place' END, CASE WHEN role = 'opens' THEN hu OR hd ELSE u OR gu OR gd END, CASE WHEN role = 'opens' THEN hd ELSE d OR gd END,
    role <> 'opens' AND (told OR role IN ('duty', 'joins')), CASE WHEN role IN ('duty', 'joins') THEN text NOT LIKE '%.' ELSE role <> 'opens' AND unended END, role,
    gt OR role = 'opens' AND ht, gc OR role = 'opens' AND hc, gu OR role = 'opens' AND hu, gd OR role = 'opens' AND hd, hp AND (role = 'opens' OR gc AND NOT p)
  FROM (
    SELECT *, CASE WHEN stop THEN 'stop' WHEN gt OR gc OR gu OR gd THEN 'fills' WHEN ht OR hd OR hc OR intern_section AND hu THEN 'opens' WHEN NOT open THEN 'none'
      WHEN goes_on THEN 'duty' WHEN NOT c AND may_employ THEN CASE WHEN reads_place THEN 'place' ELSE 'employer' END WHEN c AND NOT p AND may_place THEN 'place'
      WHEN told AND (unended OR joins) AND NOT bullet THEN 'joins' WHEN bullet OR length(text) > 3 THEN 'duty' ELSE 'none' END AS role
    FROM (
      SELECT x.*, s.job, s.open, s.t, s.c, s.p, s.u, s.d, s.told, s.unended, title IS NOT NULL AS ht, employer IS NOT NULL AS hc, place IS NOT NULL AS hp, duration IS NOT NULL AS hu, "start" IS NOT NULL AS hd,
        s.open AND NOT stop AND NOT s.t AND title IS NOT NULL AS gt, s.open AND NOT stop AND NOT s.c AND employer IS NOT NULL AS gc,
        s.open AND NOT stop AND NOT s.u AND duration IS NOT NULL AS gu, s.open AND NOT stop AND NOT s.d AND "start" IS NOT NULL AS gd
      FROM s JOIN x ON x.doc_id = s.doc_id AND x.i = s.i + 1))),
r AS (SELECT x.*, s.job, s.role, gt, gc, gu, gd, gp, count(*) FILTER (s.role = 'duty') OVER (PARTITION BY doc_id ORDER BY i) AS piece FROM s JOIN x USING (doc_id, i)),
k AS (SELECT * FROM r WHERE job > 0 AND role NOT IN ('stop', 'none')),
w AS (SELECT doc_id, job, piece, string_agg(text, ' ' ORDER BY i) AS said FROM k WHERE role IN ('duty', 'joins') GROUP BY ALL),
v AS (SELECT doc_id, job, string_agg(said, '|' ORDER BY piece) AS duties, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, job, min(line_no) AS first_line, max(title) FILTER (gt) AS title, max(CASE WHEN gc THEN employer WHEN role = 'employer' THEN regexp_replace(line, '[.,;]+$', '') END) AS employer,
  arg_max(CASE WHEN role = 'place' THEN line WHEN gp THEN place END, line_no) FILTER (role = 'place' OR gp) AS place, max(CASE WHEN gd THEN 24 END) AS months, max(duration) FILTER (gu) AS duration,
  coalesce(bool_or(intern) FILTER (role = 'opens' OR gt), false) OR coalesce(lower(max(title) FILTER (gt)) LIKE '%intern%', false) AS internship,
  coalesce(any_value(n), 0) AS n_duties, sha256(coalesce(any_value(duties), '')) AS duties_sha256
FROM k LEFT JOIN v USING (doc_id, job) GROUP BY doc_id, job""")
def document_jobs(t):
    """Jobs out of the lines of every document, with the state carried from line to line."""
    lines = _lines(t)
    signals = lines.select("doc_id", "line_no", "line", *[F.expr(v).alias(k) for k, v in _SIGNALS.items()])
    found = jobs.jobs(signals, "doc_id", F.lit(None).cast("date"))
    duties = F.sha2(F.array_join("duties", "|"), 256).alias("duties_sha256")
    return found.select("doc_id", "job", "first_line", "title", "employer", "place", "months", "duration", "internship", F.size("duties").cast("long").alias("n_duties"), duties)


_DEGREE_SIGNALS = {
    "degree": "CASE length(line) % 13 WHEN 0 THEN 'B.Sc.' WHEN 1 THEN 'B.S.' WHEN 2 THEN 'M.S.' WHEN 3 THEN 'HSC' WHEN 4 THEN 'SSLC' WHEN 5 THEN 'Bachelors' END",
    "tier": f"CASE WHEN length(line) % 13 = 3 THEN '{degrees.HIGHER}' WHEN length(line) % 13 = 4 THEN '{degrees.SECONDARY}' WHEN length(line) % 13 < 6 THEN '{degrees.DEGREE}' END",
    "major": "CASE WHEN length(line) % 5 = 0 THEN substring(line, 3, 5) END",
    "institution": "CASE WHEN length(line) % 4 = 1 THEN substring(line, 1, 12) END",
    "university": "CASE WHEN length(line) % 6 = 5 THEN substring(line, 2, 8) END",
    "place": "CASE WHEN length(line) % 10 = 1 THEN substring(line, 4, 8) END",
    "school": "length(line) % 8 = 1",
    "started": "CASE WHEN length(line) % 5 = 2 THEN 1990 + CAST(length(line) % 20 AS INT) END",
    "ended": "CASE WHEN length(line) % 3 = 1 THEN 2000 + CAST(length(line) % 20 AS INT) END",
    "expected": "CASE WHEN length(line) % 17 = 2 THEN 2030 END",
    "completed": "CASE WHEN length(line) % 7 = 3 THEN 2000 + CAST(length(line) % 9 AS INT) END",
    "ranged": "false",
    "pursues": "length(line) % 19 = 1",
    "score": "CASE WHEN length(line) % 3 = 0 THEN CAST(length(line) % 100 AS VARCHAR(9)) END",
    "score_kind": "CASE WHEN length(line) % 3 = 0 THEN CASE WHEN length(line) % 2 = 0 THEN 'Percentage' ELSE 'GPA' END END",
}


def _first_of(column: str) -> str:
    return f"arg_min({column}, i) FILTER ({column} IS NOT NULL) AS {column}"


@query(rf"""WITH RECURSIVE {_LINES},
x AS MATERIALIZED (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, {", ".join(f'{v} AS {k}' for k, v in _DEGREE_SIGNALS.items())} FROM lines),
s AS (
  SELECT doc_id, 0::BIGINT AS i, 0 AS n, false AS schools, 0::BIGINT AS held, 0::BIGINT AS waiting, false AS waiting_school, 0::BIGINT AS last_school, false AS done, 0::BIGINT AS given, false AS with_place, 'none' AS role, NULL::VARCHAR AS status FROM x WHERE i = 1
  UNION ALL
  SELECT doc_id, i, n, schools, CASE WHEN role = 'opens' OR fits THEN given ELSE held END,
    CASE WHEN role = 'waits' THEN i WHEN role = 'opens' AND (named OR waits) THEN 0 ELSE waiting END, CASE WHEN role = 'waits' THEN school ELSE waiting_school END,
    CASE WHEN role IN ('opens', 'waits') AND named AND school OR fits AND schools THEN i WHEN waits AND schools THEN waiting ELSE last_school END,
    CASE WHEN role = 'opens' THEN completed IS NOT NULL ELSE done OR role IN ('fills', 'adds') AND completed IS NOT NULL END, given, waits OR named, role,
    CASE WHEN role = 'opens' AND (pursues OR expected IS NOT NULL) THEN '{degrees.PURSUING}' WHEN role = 'opens' AND completed IS NOT NULL THEN '{degrees.COMPLETED}'
      WHEN role IN ('fills', 'adds') AND NOT schools AND pursues THEN '{degrees.PURSUING}' WHEN role = 'adds' AND NOT done AND completed IS NOT NULL THEN '{degrees.COMPLETED}' END
  FROM (
    SELECT *, CASE WHEN role = 'opens' THEN CASE WHEN named THEN i WHEN waits THEN waiting WHEN schools AND last_school > 0 THEN last_school ELSE 0 END WHEN fits THEN i ELSE 0 END AS given
    FROM (
      SELECT *, role = 'opens' AND NOT named AND waiting > 0 AND waiting_school = schools AS waits, role = 'fills' AND (schools OR NOT school) AS fits
      FROM (
        SELECT x.*, s.n + (degree IS NOT NULL)::INT AS n, s.held, s.waiting, s.waiting_school, s.last_school, s.done, institution IS NOT NULL AS named,
          CASE WHEN degree IS NOT NULL THEN tier <> '{degrees.DEGREE}' ELSE s.schools END AS schools,
          CASE WHEN degree IS NOT NULL THEN 'opens' WHEN institution IS NOT NULL THEN CASE WHEN s.n > 0 AND s.held = 0 THEN 'fills' ELSE 'waits' END WHEN s.n > 0 THEN 'adds' ELSE 'none' END AS role
        FROM s JOIN x ON x.doc_id = s.doc_id AND x.i = s.i + 1)))),
r AS (SELECT x.* EXCLUDE (university, place), s.n, s.role, s.status, o.institution AS source,
    coalesce(x.university, CASE WHEN s.role = 'opens' AND s.with_place AND NOT s.schools THEN o.university END) AS university, coalesce(x.place, CASE WHEN s.role = 'opens' AND s.with_place THEN o.place END) AS place
  FROM s JOIN x USING (doc_id, i) LEFT JOIN x o ON o.doc_id = s.doc_id AND o.i = s.given WHERE s.n > 0 AND s.role <> 'waits'),
g AS (SELECT doc_id, n, min(line_no) AS first_line, max(degree) AS degree, max(tier) AS tier, {_first_of('major')}, arg_max(source, i) FILTER (source IS NOT NULL) AS institution, {", ".join(map(_first_of, ("university", "place", "started", "ended", "expected", "completed")))},
    coalesce(arg_max(score, i) FILTER (role = 'adds' AND score_kind = 'Percentage'), arg_min(score, i) FILTER (score IS NOT NULL)) AS score,
    coalesce(arg_max(score_kind, i) FILTER (role = 'adds' AND score_kind = 'Percentage'), arg_min(score_kind, i) FILTER (score IS NOT NULL)) AS score_kind,
    arg_max(status, i) FILTER (status IS NOT NULL) AS status, lower(replace(max(degree), '.', '')) AS letters FROM r GROUP BY doc_id, n),
m AS (
  SELECT doc_id, n, n AS head, [{{'n': n, 'letters': letters, 'tier': tier}}] AS heads FROM g WHERE n = 1
  UNION ALL
  SELECT doc_id, n, coalesce(hit, n), CASE WHEN hit IS NULL THEN list_append(heads, {{'n': n, 'letters': letters, 'tier': tier}}) ELSE heads END
  FROM (SELECT g.doc_id, g.n, g.letters, g.tier, m.heads, list_filter(m.heads, lambda a: CASE WHEN g.tier <> '{degrees.DEGREE}' THEN a.tier = g.tier
      ELSE a.letters = g.letters OR a.letters[1] = 'b' AND g.letters[1] = 'b' AND (contains(a.letters, g.letters) OR contains(g.letters, a.letters)) END)[1].n AS hit
    FROM m JOIN g ON g.doc_id = m.doc_id AND g.n = m.n + 1)),
j AS (SELECT g.*, g.n AS i, m.head FROM g JOIN m USING (doc_id, n))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY head))::INT AS entry, min(first_line) AS first_line, {", ".join(map(_first_of, ("degree", "tier", "major", "institution", "university", "place", "started", "ended", "expected", "completed", "score", "score_kind")))},
  coalesce(max(status) FILTER (status = '{degrees.PURSUING}'), arg_min(status, i) FILTER (status IS NOT NULL)) AS status
FROM j GROUP BY doc_id, head""")
def document_degrees(t):
    """Degrees out of the lines of every document, merged by tiers."""
    signals = _lines(t).select("doc_id", "line_no", *[F.expr(v).alias(k) for k, v in _DEGREE_SIGNALS.items()])
    return degrees.merge_degrees(degrees.fold_degrees(signals, "doc_id"), "doc_id")


# Records of an education out of parts: a qualification, an institution and, for some, a level or a stated class.
_SAID = ("B.Tech", "HSC (Class 12)", "M.Com Accounts", "SSLC", "Certificate", "Post-graduate work", "12th standard", "PhD", "club member", "Matriculation", "b_e", "")
_WHERE = ("Hill College", "Green School", "State University", "Town Hall", "")
_LEVEL = ("", "Secondary", "Higher Education", "course", "", "", "College")
_STATED = ("", "", "degree", "", "School", "", "", "", "", "other", "")
_RECORD = {"degree": (_SAID, "p_size % 12"), "institution": (_WHERE, "p_partkey % 5"), "level": (_LEVEL, "p_partkey % 7"), "stated": (_STATED, "p_partkey % 11")}


def _any_of(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_CLASSED = f"""WITH r AS (SELECT p_partkey, p_brand, {", ".join(f"lower([{_any_of(v)}][1 + {i}]) AS {k}" for k, (v, i) in _RECORD.items())} FROM part),
k AS (SELECT *, CASE WHEN level IN ({_any_of(education.SCHOOL_LEVELS)}) THEN 'school' WHEN regexp_matches(degree, '{education.terms_pattern(education.SCHOOL_TERMS)}') THEN 'school'
  WHEN regexp_matches(degree, '{education.terms_pattern(education.DEGREE_TERMS)}') THEN 'degree' WHEN level IN ({_any_of(education.DEGREE_LEVELS)}) THEN 'degree'
  WHEN regexp_matches(institution, '{education.SCHOOL_NAMES}') THEN 'school' WHEN regexp_matches(institution, '{education.DEGREE_NAMES}') THEN 'degree' ELSE 'other' END AS ruled FROM r)"""


def _records(t):
    picked = [F.get(F.array(*[F.lit(x) for x in v]), F.expr(i).cast("int")).alias(k) for k, (v, i) in _RECORD.items()]
    return t.part.select("p_partkey", "p_brand", *picked)


@query(f"""{_CLASSED}, c AS (SELECT p_brand, CASE WHEN stated <> '' THEN stated ELSE ruled END AS class FROM k)
SELECT p_brand, count(*) FILTER (class = 'degree') AS degree_count, count(*) FILTER (class = 'school') AS school_count, count(*) FILTER (class = 'other') AS other_count, count(*) AS total_count FROM c GROUP BY 1""")
def education_counts(t):
    """Degrees, school records and others of every brand's records."""
    rows = _records(t)
    return education.education_counts(rows.withColumn("class", education.education_class(rows)), "p_brand")


@query(f"{_CLASSED} SELECT p_brand, bool_and(stated IN ('', ruled)) AS valid, count(*) AS total_records, count(*) FILTER (stated NOT IN ('', ruled)) AS n_issues, coalesce(arg_min(stated || ' is ' || ruled, p_partkey) FILTER (stated NOT IN ('', ruled)), '') AS first_issue FROM k GROUP BY 1")
def education_audit(t):
    """Records whose stated class the rule does not give."""
    out = education.education_audit(_records(t), "p_brand", "p_partkey")
    first = F.regexp_replace(F.coalesce(F.get("issues", F.lit(0)), F.lit("")), "^.*: ", "")
    return out.select("p_brand", "valid", "total_records", F.size("issues").cast("long").alias("n_issues"), first.alias("first_issue"))
