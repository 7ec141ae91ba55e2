"""Queries on titles, evidence, employment, durations, wrapped lines, links and readiness, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import careers, labels, postings, rules
from tessella.operators import profiles, skills
from tessella.plans.bindings import CANDIDATES
from tessella.plans.registry import query

# Fixed values of these bindings: what is put beside the part names.
_HEADS = ("Senior Data Analyst ", "Frontend ", "back-end ", "QA ", "Cloud Engineer ", "ML Engineer ", "sales analyst ", "developer of ", "data ", "")
_SAYS = ("never used ", "I want to learn to use ", "currently learning ", "never used it, but ", "uses ", "Developed over many years and in many places, with many others and alone, a lot of ", "a long time ago and in a place that is far from here somebody may have spoken once of ")
_SECTIONS = ("", "Technical Skills", "Work Experience", "Projects", "Courses", "Academic", "Tools", "Hobbies")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _title_case(column: int, default: str) -> str:
    rows = [(f"'{r[0]}'", r[column]) for r in (*careers.TITLES, *careers.TITLE_WORDS)]
    return "CASE " + " ".join(f"WHEN regexp_matches(low, {p}) THEN '{v}'" for p, v in rows) + f" ELSE {default} END"


_SURE = "CASE WHEN " + " OR ".join(f"regexp_matches(low, '{r[0]}')" for r in careers.TITLES) + " THEN 0.9::DOUBLE WHEN " + " OR ".join(f"regexp_matches(low, '{r[0]}')" for r in careers.TITLE_WORDS) + " THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END"


@query(f"""SELECT p_partkey, {_title_case(1, 'raw')} AS title, {_title_case(2, "'General Technology'")} AS family, {_title_case(3, "'Technology'")} AS category, {_SURE} AS confidence
FROM (SELECT *, lower(raw) AS low FROM (SELECT p_partkey, trim({_sql_list(_HEADS)}[1 + p_partkey % 10] || p_name, ' ') AS raw FROM part))""")
def title_roles(t):
    """Title, family and category of every part name with a job title before it."""
    raw = F.concat(_pick(_HEADS, F.col("p_partkey") % 10), F.col("p_name"))
    return t.part.select("p_partkey", careers.title_role(raw).alias("r")).select("p_partkey", "r.*")


def _any(patterns) -> str:
    return "(" + " OR ".join("regexp_matches(low, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


_BY_SECTION = " ".join(f"WHEN regexp_matches(sec, '{p}') THEN '{n}'" for p, n in careers.SECTION_EVIDENCE)


@query(f"""WITH s AS (SELECT p_partkey, lower(p_name) AS skill, trim({_sql_list(_SAYS)}[1 + p_partkey % 7] || CASE WHEN p_partkey % 7 = 3 THEN 'others' ELSE p_name END, ' ') AS said, lower({_sql_list(_SECTIONS)}[1 + (p_partkey // 7) % 8]) AS sec FROM part),
l AS (SELECT *, lower(said) AS low, regexp_matches(' ' || lower(said) || ' ', '[^a-z0-9_]' || regexp_escape(skill) || '[^a-z0-9_]') AS named FROM s),
k AS (SELECT p_partkey, CASE WHEN {_any(rules.NEGATED)} AND named THEN 'NEGATED_MENTION' WHEN {_any(rules.ASPIRATION)} THEN 'ASPIRATION' WHEN {_any(rules.LEARNING)} AND named THEN 'LEARNING'
  WHEN list_contains({_sql_list(careers.SKILL_SECTIONS)}, sec) THEN 'EXPLICIT_SKILL' {_BY_SECTION} WHEN regexp_matches(low, '{careers.USED}') THEN 'EXPERIENCE_USAGE' WHEN length(said) < 80 THEN 'EXPLICIT_SKILL' ELSE 'CONTEXTUAL_MENTION' END AS type FROM l)
SELECT p_partkey, type, type NOT IN ('NEGATED_MENTION', 'ASPIRATION', 'LEARNING', 'CONTEXTUAL_MENTION') AS confirmed FROM k""")
def evidence_types(t):
    """What a sentence and its section show about the skill named in it."""
    k = F.col("p_partkey")
    said = F.concat(_pick(_SAYS, k % 7), F.when(k % 7 == 3, "others").otherwise(F.col("p_name")))
    found = careers.skill_evidence(F.col("p_name"), said, _pick(_SECTIONS, F.floor(k / 7) % 8))
    return t.part.select("p_partkey", found.alias("e")).select("p_partkey", "e.*")


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN years > 6 THEN 'Experienced' WHEN projects % 3 = 1 THEN 'Fresher with Internship Experience' WHEN nation % 4 = 0 OR nation % 4 = 2 THEN 'Student / Fresher' ELSE 'Not specified' END AS status FROM ({CANDIDATES})) GROUP BY 1""")
def employment_statuses(t):
    """Candidates by employment status; the texts are made of their nation."""
    said = _pick(("A final year pupil", "A students' friend", "Fresher.", "A baker"), F.col("nation") % 4)
    status = careers.employment_status((F.col("years") > 6).cast("int"), (F.col("projects") % 3 == 1).cast("int"), said)
    return t.candidates.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_U = lambda n, w: f"{n} || ' {w}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate::DATE + ((o_orderkey * 37) % 1500 - 40)::INT)::DATE AS b FROM orders),
d AS (SELECT *, b - a AS days, day(b) - day(a) AS raw, (year(b) - year(a)) * 12 + month(b) - month(a) - (day(b) < day(a))::INT AS total, day(last_day((b - INTERVAL 1 MONTH)::DATE)) AS before FROM o),
e AS (SELECT *, CASE WHEN raw < 0 THEN raw + before ELSE raw END AS spare, total // 12 AS y, total % 12 AS m FROM d)
SELECT o_orderkey, CASE WHEN days < 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'two weeks' ELSE 'Duration not specified' END WHEN days < 25 THEN {_U('days', 'day')} WHEN total = 0 THEN '1 month'
  WHEN y = 0 AND spare <= 3 THEN {_U('m', 'month')} WHEN y = 0 AND spare >= 25 THEN {_U('(m + 1)', 'month')} WHEN y = 0 THEN {_U('m', 'month')} || ' ' || spare || ' days'
  WHEN m > 0 THEN {_U('y', 'year')} || ' ' || {_U('m', 'month')} ELSE {_U('y', 'year')} END AS duration FROM e""")
def calendar_durations(t):
    """Calendar time from every order's date to a date made of its key."""
    a = F.col("o_orderdate").cast("date")
    b = F.date_add(a, ((F.col("o_orderkey") * 37) % 1500 - 40).cast("int"))
    said = F.when(F.col("o_orderkey") % 2 == 0, " two weeks ").otherwise("None")
    return t.orders.select("o_orderkey", careers.calendar_duration(a, b, said).alias("duration"))


@query("""WITH r AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS intern, o_orderkey % 9 AS m, CASE WHEN o_custkey % 4 = 0 THEN 2.5::DOUBLE ELSE 0 END AS stated FROM orders),
s AS (SELECT o_custkey, coalesce(sum(CASE WHEN m = 0 THEN 1 ELSE m END) FILTER (intern), 0)::BIGINT AS im, coalesce(sum(m) FILTER (NOT intern), 0)::BIGINT AS fm, max(stated) AS stated,
  coalesce(sum(round_even(CASE WHEN m = 0 THEN 1 ELSE m END / 12.0::DOUBLE, 4)) FILTER (intern), 0) AS iy, coalesce(sum(round_even(m / 12.0::DOUBLE, 4)) FILTER (NOT intern), 0) AS fy FROM r GROUP BY 1),
u AS (SELECT o_custkey, im, round(iy, 4) AS internship_years, round(CASE WHEN stated > 0 THEN stated ELSE fy END, 4) AS full_time_years, CASE WHEN stated > 0 THEN (stated * 12)::BIGINT ELSE fm END AS fm FROM s),
w AS (SELECT *, CASE WHEN full_time_years = 1 THEN '1 year' WHEN full_time_years > 1 THEN round_even(full_time_years, 1)::DOUBLE || ' years' WHEN fm > 0 THEN fm || ' month' || CASE WHEN fm = 1 THEN '' ELSE 's' END ELSE '0 years' END AS f,
  im || ' month' || CASE WHEN im = 1 THEN '' ELSE 's' END || ' internship' AS i FROM u)
SELECT o_custkey, full_time_years, internship_years, round(full_time_years + internship_years, 4) AS total_years,
  CASE WHEN full_time_years > 0 AND im > 0 THEN f || ' (+ ' || i || ')' WHEN full_time_years > 0 THEN f WHEN im > 0 THEN i ELSE 'Fresher (0 years)' END AS display FROM w""")
def experience_rollup(t):
    """Entries of candidates added up; urgent orders stand for internships, every fourth candidate states 2.5 years."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "internship").otherwise("full_time")
    rows = t.orders.select("o_custkey", kind.alias("kind"), (F.col("o_orderkey") % 9).alias("months"), F.when(F.col("o_custkey") % 4 == 0, 2.5).alias("stated"))
    return profiles.experience_rollup(rows, "o_custkey")


_ITEMS = r"""WITH l AS (SELECT doc_id, i, regexp_replace(p[i], '^\s+|\s+$', '', 'g') AS x FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))),
f AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l WHERE x <> ''),
g AS (SELECT *, b IS NULL OR NOT (regexp_matches(x, '^\p{Ll}') OR regexp_matches(x, '""" + careers.GOES_ON + r"""') OR regexp_matches(b, '""" + careers.LEFT_OPEN + r"""')) AS opens FROM f),
h AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
m AS (SELECT doc_id, k, regexp_replace(string_agg(x, ' ' ORDER BY i), '\s+', ' ', 'g') AS item FROM h GROUP BY ALL)
SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, chr(10) ORDER BY k)) AS items_sha256 FROM m GROUP BY 1"""


@query(_ITEMS)
def unwrapped_lines(t):
    """Lines of every document, wrapped ones joined."""
    rows = t.documents.select("doc_id", careers.unwrapped_text(F.col("text")).alias("items")).where("items <> ''")
    return rows.select("doc_id", F.size(F.split("items", "\n")).cast("long").alias("n_items"), F.sha2("items", 256).alias("items_sha256"))


@query("""SELECT c_custkey AS k, array_to_string(list_filter([CASE WHEN lower(c_name) IS DISTINCT FROM lower(s_name) THEN 'name' END, CASE WHEN CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END IS DISTINCT FROM s_nationkey THEN 'nation' END,
  CASE WHEN (c_acctbal > 0) IS DISTINCT FROM (s_acctbal > 0) THEN 'sign' END], lambda x: x IS NOT NULL), ',') AS differing FROM customer JOIN supplier ON c_custkey = s_suppkey""")
def record_differences(t):
    """Fields in which two records of one key differ."""
    k = F.col("c_custkey")
    first = t.customer.select(k.alias("k"), F.lower("c_name").alias("name"), F.when(k % 5 != 0, F.col("c_nationkey")).alias("nation"), (F.col("c_acctbal") > 0).alias("sign"))
    second = t.supplier.select(F.col("s_suppkey").alias("k"), F.lower("s_name").alias("name"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("sign"))
    return profiles.record_differences(first, second, "k", ["name", "nation", "sign"]).select("k", F.array_join("differing", ",").alias("differing"))


@query("""SELECT page_id, coalesce(regexp_matches(trim(url, ' '), '^https?://') AND NOT regexp_matches(trim(url, ' '), '\\s') AND regexp_matches(trim(url, ' '), '(?i)^https?://[a-z0-9-]+([.][a-z0-9-]+)+([/#?].*)?$'), false) AS is_link,
  page_id % 3 = 0 AS is_profile FROM pages""".replace("\\\\", "\\"))
def profile_links(t):
    """Whether a page's url is a link, and whether links made of its id are profiles of their platform."""
    k = F.col("page_id")
    made = F.when(k % 3 == 0, F.concat(F.lit("https://www.github.com/u"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("github.com/u"), k.cast("string"))).otherwise("https://www.kaggle.com/u")
    return t.pages.select("page_id", careers.valid_profile_url(F.lit("portfolio"), F.col("url")).alias("is_link"), careers.valid_profile_url(F.lit("GitHub"), made).alias("is_profile"))


@query(f"""WITH c AS (SELECT candidate_id, nation, years, projects, least(96.0::DOUBLE, greatest(15.0::DOUBLE, 40 + 4 * nation::DOUBLE)) AS base, CASE WHEN nation % 2 = 0 THEN 10 * years END AS te, CASE WHEN nation % 3 = 0 THEN 60.0::DOUBLE END AS ta FROM ({CANDIDATES})),
w AS (SELECT *, CASE WHEN te IS NULL THEN 0 ELSE 0.2 END::DOUBLE + CASE WHEN ta IS NULL THEN 0 ELSE 0.1 END::DOUBLE AS w FROM c),
o AS (SELECT *, least(0.75::DOUBLE, w * 1.25::DOUBLE) AS s, (coalesce(0.2::DOUBLE * te, 0) + coalesce(0.1::DOUBLE * ta, 0)) / nullif(w, 0) AS mean, CASE nation % 5 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN -5.0::DOUBLE ELSE 0 END AS extra FROM w),
r AS (SELECT candidate_id, least(98.0::DOUBLE, greatest(10.0::DOUBLE, round_even(coalesce((1.0::DOUBLE - s) * base + s * mean, base) + extra, 1))) AS overall,
  least(98.0::DOUBLE, greatest(20.0::DOUBLE, round_even(0.7::DOUBLE * coalesce(te, base) + 0.3::DOUBLE * (50.0::DOUBLE + least(15.0::DOUBLE, 2 * projects * 1.5::DOUBLE)), 1))) AS technical,
  CASE WHEN ta IS NOT NULL THEN ta ELSE least(92.0::DOUBLE, 65 + least(20.0::DOUBLE, years * 4)) END AS communication,
  least(95.0::DOUBLE, greatest(25.0::DOUBLE, round_even(0.6::DOUBLE * base + 0.4::DOUBLE * (55.0::DOUBLE + least(25.0::DOUBLE, projects * 6.0::DOUBLE)), 1))) AS problem FROM o)
SELECT *, CASE WHEN overall >= 85 THEN 'High Readiness' WHEN overall >= 75 THEN 'Target Ready' WHEN overall >= 60 THEN 'Moderate' ELSE 'Needs Preparation' END AS badge FROM r""")
def readiness_scores(t):
    """Readiness of candidates; the regressed score and the assessments are made of their nation and years, without halves of the last digit."""
    nation, years = F.col("nation"), F.col("years")
    scores = {"technical": F.when(nation % 2 == 0, 10 * years), "communication": F.when(nation % 3 == 0, 60.0)}
    level = F.when(nation % 5 == 0, "High").when(nation % 5 == 1, " low").otherwise("Medium")
    found = careers.readiness(40 + 4 * nation.cast("double"), scores, level, 2 * F.col("projects"), years, F.col("projects"))
    return t.candidates.select("candidate_id", found.alias("r")).select("candidate_id", "r.*")


@query(f"""SELECT candidate_id, round(least(98.0::DOUBLE, greatest(10.0::DOUBLE, 0.5::DOUBLE * (4 * nation) + 0.25::DOUBLE * least(100.0::DOUBLE, projects * 10) + 0.25::DOUBLE * least(100.0::DOUBLE, years * 10))), 4) AS readiness,
  round(least(20.0::DOUBLE, greatest(2.8::DOUBLE, CASE nation % 3 WHEN 0 THEN 2.8 WHEN 1 THEN 3.2 ELSE 3.0 END::DOUBLE + CASE WHEN years <= 1 THEN years * 0.45::DOUBLE WHEN years <= 3 THEN 0.45::DOUBLE + (years - 1) * 0.75::DOUBLE ELSE 1.95::DOUBLE + (years - 3) * 1.15::DOUBLE END
  + least(0.3::DOUBLE, projects * 0.06::DOUBLE) + CASE nation % 5 WHEN 0 THEN 0.2 WHEN 1 THEN 0.25 WHEN 2 THEN 0.7 ELSE 0.1 END::DOUBLE)), 4) AS salary FROM ({CANDIDATES})""")
def model_targets(t):
    """What the readiness and salary models learn, for every candidate."""
    nation = F.col("nation")
    base = F.when(nation % 3 == 0, 2.8).when(nation % 3 == 1, 3.2)
    school = _pick(("M.Sc", "MBA", "PhD", "B.Sc", "other"), nation % 5)
    ready = careers.readiness_target(4 * nation, F.col("projects"), F.col("years"))
    pay = careers.salary_target(base, F.col("years"), F.col("projects"), school)
    return t.candidates.select("candidate_id", F.round(ready, 4).alias("readiness"), F.round(pay, 4).alias("salary"))


_ASKS = ("'Experience: ' || n || ' years and 6 months'", "'needs ' || n || '-' || (n + 2) || ' yrs'", "n || ' to ' || (n + 3) || ' months of work'", "n || '+ months'", "n || ' years of work' || chr(10) || 'Required experience - two years'", "'twelve months, Bachelor''s'", "'none'")


@query("""SELECT p_partkey, CASE k WHEN 0 THEN n + 0.5 WHEN 1 THEN n WHEN 2 THEN round_even(n / 12.0::DOUBLE, 4) WHEN 3 THEN round_even(n / 12.0::DOUBLE, 4) WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END::DOUBLE AS years,
  CASE k WHEN 0 THEN n || '.5 years' WHEN 1 THEN n || '-' || (n + 2) || ' years' WHEN 2 THEN n || '-' || (n + 3) || ' months' WHEN 3 THEN n || '+ month' || CASE WHEN n = 1 THEN '' ELSE 's' END WHEN 4 THEN '2 years' WHEN 5 THEN '12 months' ELSE 'Not specified' END AS display,
  CASE WHEN k = 5 THEN 'Bachelor''s Degree' ELSE 'Not specified in JD' END AS education FROM (SELECT p_partkey, p_partkey % 7 AS k, p_size AS n FROM part)""")
def posting_requirements(t):
    """Experience and degree that descriptions ask for; the texts are made of the parts' sizes."""
    said = F.element_at(F.array(*[F.expr(x.replace("chr(10)", "char(10)").replace("''", "\\'")) for x in _ASKS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    rows = t.part.select("p_partkey", F.col("p_size").alias("n")).withColumn("said", said)
    return rows.withColumn("x", postings.experience_asked(F.col("said"))).select("p_partkey", "x.*", postings.education_asked(F.col("said")).alias("education"))


@query(f"""WITH v AS (SELECT p_partkey, p_partkey % 6 AS k, lower(p_name) AS name FROM part), p AS (SELECT regexp_replace(name, '[^a-z0-9]', '', 'g') AS packed, min('k_' || name) AS found FROM v GROUP BY 1)
SELECT p_partkey, CASE WHEN k = 5 THEN 'zz ' || name WHEN k = 3 THEN found WHEN k = 4 AND right(name, 1) = 's' THEN name || 's' ELSE 'k_' || name END AS canonical
FROM v JOIN p ON packed = regexp_replace(name, '[^a-z0-9]', '', 'g')""")
def resolved_skills(t):
    """Part names in six spellings, resolved by a vocabulary of all names."""
    name, k = F.lower("p_name"), F.col("p_partkey") % 6
    raw = F.when(k == 0, F.concat(F.lit("• "), F.upper("p_name"), F.lit("’s"))).when(k == 1, F.concat(F.lit("2. ("), name, F.lit(")"))).when(k == 2, F.concat(name, F.lit(" Basics")))
    raw = raw.when(k == 3, F.regexp_replace(name, "[^a-z0-9]", "")).when(k == 4, F.concat(name, F.lit("s"))).otherwise(F.concat(F.lit("zz "), name))
    aliases = t.part.select(name.alias("alias"), F.concat(F.lit("k_"), name).alias("canonical")).distinct()
    return skills.resolve_skills(t.part.select("p_partkey", raw.alias("raw")), "raw", aliases).select("p_partkey", "canonical")


def _first(rules_, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for p, n in rules_) + f" ELSE '{default}' END"


_NAMES = ("Python ", "html5 ", "Node server ", "PostgreSQL ", "gRPC ", "Azure ", "Jenkins ", "OAuth ", "Figma ", "pytest ", "Excel ", "Jira ", "scikit ", "powerpoint ", "")


@query(f"SELECT p_partkey, {_first(skills.CATEGORIES, skills.OTHER_CATEGORY)} AS category, {_first(skills.KINDS, skills.OTHER_KIND)} AS kind FROM (SELECT p_partkey, lower({_sql_list(_NAMES)}[1 + p_partkey % 15] || p_brand) AS s FROM part)")
def skill_categories(t):
    """Category and kind of names by the words in them."""
    name = F.lower(F.concat(_pick(_NAMES, F.col("p_partkey") % 15), F.col("p_brand")))
    return t.part.select("p_partkey", labels.first_match(name, skills.CATEGORIES, skills.OTHER_CATEGORY).alias("category"), labels.first_match(name, skills.KINDS, skills.OTHER_KIND).alias("kind"))
