"""Queries on single rules of profiles, postings and records, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import dates, labels, rules
from tessella.operators import metrics, skills
from tessella.operators.audit import Window
from tessella.plans.bindings import CANDIDATE_SKILLS, CANDIDATES, JOB_SKILLS
from tessella.plans.registry import _PRED, _predicted, query


@query("SELECT conv_id, turn, trim(coalesce(role, 'user')) AS role, sha256(trim(coalesce(text, 'n/a'), ' ')) AS text_sha256 FROM conversations")
def null_fill(t):
    filled = F.sha2(F.trim(F.coalesce("text", F.lit("n/a"))), 256)
    return t.conversations.select("conv_id", "turn", F.trim(F.coalesce("role", F.lit("user"))).alias("role"), filled.alias("text_sha256"))


# Fixed values of this binding: openings of the invented prose; the first line's full stop becomes a question mark.
_ASKS = "(?:the|of|la|le|der|en) [a-z]+,?"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SPLIT = rf"""WITH x AS (SELECT doc_id, {_STRIP.format("replace(text, '.' || chr(10), '?' || chr(10))")} AS x FROM documents),
h AS (SELECT *, string_split(x, chr(10))[1] AS head, regexp_extract(x, '^({_ASKS})', 1, 'is') AS f FROM x),
l AS (SELECT *, {_STRIP.format('head')} AS line FROM h),
w AS (SELECT *, contains(x, chr(10)) AND length(line) < 120 AND (regexp_matches(line, '[?:]$') OR regexp_matches(lower(line), '{"|".join(rules.INSTRUCTS)}')) AS by_line FROM l)
SELECT doc_id, CASE WHEN f <> '' OR by_line THEN regexp_replace({_STRIP.format("CASE WHEN f <> '' THEN f ELSE line END")}, '[:\-\s]+$', '') ELSE 'Read this.' END AS instruction,
  sha256(CASE WHEN f <> '' THEN {_STRIP.format("substr(x, length(f) + 1)")} WHEN by_line THEN {_STRIP.format("substr(x, length(head) + 1)")} ELSE x END) AS body_sha256 FROM w"""


@query(_SPLIT)
def instruction_split(t):
    s = rules.instruction_body(F.replace("text", F.lit(".\n"), F.lit("?\n")), [_ASKS], "Read this.")
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", "s.instruction", F.sha2("s.body", 256).alias("body_sha256"))


@query("SELECT o_orderkey FROM orders WHERE lower(coalesce(nullif(o_orderstatus, 'P'), 'f')) = 'f'")
def status_default(t):
    return t.orders.where(F.lower(F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("F"))) == "f").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 3 OR (l_partkey = 5 AND l_suppkey = 4)")
def foreign_key_filter(t):
    return t.lineitem.where("l_suppkey = 3 OR (l_partkey = 5 AND l_suppkey = 4)").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 50)")
def known_classes(t):
    known = t.documents.groupBy("lang").agg(F.count("*").alias("n")).where("n >= 50")
    return t.documents.join(known, "lang", "left_semi").select("doc_id")


_said = lambda patterns: " OR ".join("regexp_matches(s, '" + p.replace("'", "''") + "')" for p in patterns)
_HINTS = "['I want to learn ', 'never used ', 'currently learning ', 'expert in ', 'Looking for a role: ']"


@query(f"""SELECT p_partkey, CASE WHEN {_said(rules.ASPIRATION)} THEN 'aspiration' WHEN {_said(rules.NEGATED)} THEN 'negated' WHEN {_said(rules.LEARNING)} THEN 'learning' ELSE 'plain' END AS said
FROM (SELECT p_partkey, lower({_HINTS}[1 + p_partkey % 5] || p_name) AS s FROM part)""")
def sentence_classes(t):
    hints = F.array(*[F.lit(x) for x in ("I want to learn ", "never used ", "currently learning ", "expert in ", "Looking for a role: ")])
    return t.part.select("p_partkey", rules.sentence_class(F.concat(F.get(hints, (F.col("p_partkey") % 5).cast("int")), F.col("p_name"))).alias("said"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT doc_id, trim(regexp_replace(trim(unnest(regexp_split_to_array(line, '(?i){rules.LABEL_INSIDE}')), ' '), '(?i){rules.LABEL_BEFORE}', ''), ' ') AS x FROM l),
i AS (SELECT doc_id, trim(unnest(string_split(x, ',')), ' ') AS item FROM p), h AS (SELECT doc_id, item, list_filter(list_transform(string_split(item, '/'), lambda y: trim(y, ' ')), lambda y: y <> '') AS halves FROM i WHERE item <> ''),
a AS (SELECT doc_id, unnest(CASE WHEN len(halves) > 1 THEN halves ELSE [item] END) AS x FROM h),
r AS (SELECT *, trim(regexp_replace(x, '(?i){rules.LABEL_BEFORE}', ''), ' ') AS rest FROM a)
SELECT doc_id, count(*) AS n_atoms, max(x) AS last FROM r WHERE length(x) BETWEEN 1 AND 80 AND len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) <= 7
  AND NOT regexp_matches(x, '\w+\s*:\s*\w') AND NOT regexp_matches(lower(x), '{rules.NOT_A_SKILL}') AND NOT (regexp_matches(x, '(?i){rules.LABEL_BEFORE}') AND rest = '') GROUP BY 1""")
def atomic_parts(t):
    """Parts of the documents' lines that could each name one skill."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", F.explode(rules.atoms(F.col("line"))).alias("x")).groupBy("doc_id").agg(F.count("*").alias("n_atoms"), F.max("x").alias("last"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(p_name, 'Unknown job') AS job, coalesce(c_name, 'Unknown candidate') AS candidate
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey""")
def application_enrichment(t):
    jobs, people = t.part.where("p_partkey % 7 <> 0"), t.customer.where("c_custkey % 5 <> 0")
    rows = t.lineitem.join(jobs, F.col("l_partkey") == F.col("p_partkey"), "left").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("Unknown job")).alias("job"), F.coalesce("c_name", F.lit("Unknown candidate")).alias("candidate"))


@query("""WITH titles AS (SELECT p_partkey AS row_no, unnest([p_type, p_name]) AS title, unnest([1, 2]) AS pos FROM part WHERE p_partkey % 3 = 0),
first AS (SELECT lower(title) AS title, arg_min(row_no, {'pos': pos, 'row_no': row_no}) AS row_no FROM titles GROUP BY 1)
SELECT c_custkey, row_no FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN p_type WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' x' ELSE p_name END AS asked FROM customer JOIN part ON p_partkey = c_custkey) LEFT JOIN first ON lower(asked) = title""")
def title_lookup(t):
    """The row of the first matching title; titles earlier in a row's list win, then earlier rows."""
    titles = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("row_no"), F.posexplode(F.array("p_type", "p_name")).alias("pos", "title"))
    first = titles.groupBy(F.lower("title").alias("title")).agg(F.min_by("row_no", F.struct("pos", "row_no")).alias("row_no"))
    k = F.col("c_custkey") % 4
    asked = F.when(k == 0, F.col("p_type")).when(k == 1, F.upper("p_name")).when(k == 2, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    own = t.customer.join(t.part, F.col("p_partkey") == F.col("c_custkey")).select("c_custkey", asked.alias("asked"))
    return own.join(first, F.lower("asked") == F.col("title"), "left").select("c_custkey", "row_no")


@query("""WITH asked AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE upper(n_name) END AS q FROM nation)
SELECT k, coalesce(a.n_nationkey, b.n_nationkey) AS found FROM asked LEFT JOIN nation a ON a.n_nationkey::VARCHAR = q LEFT JOIN nation b ON lower(b.n_name) = lower(q)""")
def id_or_name_lookup(t):
    asked = t.nation.select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(F.upper("n_name")).alias("q"))
    by_id = t.nation.select(F.col("n_nationkey").cast("string").alias("q"), F.col("n_nationkey").alias("a"))
    by_name = t.nation.select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("b"))
    joined = asked.join(by_id, "q", "left").join(by_name, F.lower("q") == F.col("name"), "left")
    return joined.select("k", F.coalesce("a", "b").alias("found"))


@query("SELECT count(*) AS total, count(*) - count(DISTINCT sha256(coalesce(role, '') || '|||' || coalesce(text, ''))) AS duplicates FROM conversations")
def exact_duplicates(t):
    key = F.sha2(F.concat_ws("|||", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    once = t.conversations.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return once.agg(F.sum("n").alias("total"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query("SELECT count(*) AS candidates, round(avg(n), 4) AS mean_records FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def records_per_candidate(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.count("*").alias("candidates"), F.round(F.avg("n"), 4).alias("mean_records"))


@query("SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text)) AS joined_sha256 FROM conversations GROUP BY 1")
def text_per_group(t):
    """The texts of every conversation as one, in order of turns."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return t.conversations.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n"), 256).alias("joined_sha256"))


@query(f"""WITH r AS ({_PRED}), c AS (SELECT DISTINCT y AS cls FROM r UNION SELECT DISTINCT p FROM r), m AS (SELECT cls, (SELECT count(*) FROM r WHERE y = cls) AS support,
  (SELECT count(*) FROM r WHERE p = cls) AS said, (SELECT count(*) FROM r WHERE y = cls AND p = cls) AS tp FROM c),
q AS (SELECT *, round(coalesce(tp / nullif(said, 0), 0.0), 6) AS pr, round(coalesce(tp / nullif(support, 0), 0.0), 6) AS re,
  round(coalesce(2 * (tp / nullif(said, 0)) * (tp / nullif(support, 0)) / nullif(tp / nullif(said, 0) + tp / nullif(support, 0), 0), 0.0), 6) AS f1 FROM m)
SELECT round(sum(re * support) / sum(support), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM q""")
def class_summary(t):
    return metrics.class_summary(_predicted(t), "y", "p")


@query(f"SELECT y AS label, p AS predicted, count(*) AS n FROM ({_PRED}) GROUP BY 1, 2")
def confusion_matrix(t):
    return metrics.confusion(_predicted(t), "y", "p")


@query("""SELECT round(avg((contains(lower(c_name), lower(a)) OR contains(lower(a), lower(c_name)))::INT), 6) AS name_accuracy, round(avg((right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) = right(a, 4))::INT), 6) AS digits_accuracy, round(avg((c_nationkey = c_custkey % 25)::INT), 6) AS exact
FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'CUSTOMER' ELSE lpad(c_custkey::VARCHAR, 9, '0') END AS a FROM customer)""")
def field_accuracy(t):
    """Share of fields that agree with gold: one within the other, last digits, equality."""
    a = F.when(F.col("c_custkey") % 3 == 0, "CUSTOMER").otherwise(F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    rows = t.customer.withColumn("a", a).withColumn("low", F.lower("c_name"))
    within = F.contains("low", F.lower("a")) | F.contains(F.lower("a"), F.col("low"))
    digits = F.right(F.regexp_replace("c_name", "[^0-9]", ""), F.lit(4)) == F.right("a", F.lit(4))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.agg(share(within).alias("name_accuracy"), share(digits).alias("digits_accuracy"), share(F.col("c_nationkey") == F.col("c_custkey") % 25).alias("exact"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS repeated FROM events")
def occurrence_flags(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.select("event_id", (F.row_number().over(w) > 1).alias("repeated"))


_FIRST = f"""WITH cs AS (SELECT candidate_id, list(skill) AS held FROM ({CANDIDATE_SKILLS}) GROUP BY 1), js AS (SELECT job_id, list(skill) AS req FROM ({JOB_SKILLS}) WHERE tier = 'required' GROUP BY 1)
SELECT candidate_id, job_id, array_to_string(list_slice(list_sort(list_filter(req, lambda x: list_contains(held, x))), 1, 4), ',') AS first_matched,
  array_to_string(list_slice(list_sort(list_filter(req, lambda x: NOT list_contains(held, x))), 1, 3), ',') AS first_missing
FROM cs JOIN js ON job_id = 1 + candidate_id % (SELECT count(*) FROM supplier)"""


@query(_FIRST)
def prefix_slices(t):
    """The first four matched and three missing skills of every candidate against one job."""
    held = t.candidate_skills.groupBy("candidate_id").agg(F.collect_set("skill").alias("held"))
    req = t.job_skills.where("tier = 'required'").groupBy("job_id").agg(F.collect_set("skill").alias("req"))
    total = t.supplier.agg(F.count("*").alias("total"))
    own = held.join(F.broadcast(total)).withColumn("job_id", 1 + F.col("candidate_id") % F.col("total"))
    g = own.join(req, "job_id").withColumn("g", skills.gap(F.col("held"), F.col("req")))
    first = lambda c, n: F.array_join(F.slice(c, 1, n), ",")
    return g.select("candidate_id", "job_id", first("g.matched", 4).alias("first_matched"), first("g.missing", 3).alias("first_missing"))


@query(f"""WITH js AS (SELECT job_id, list(skill ORDER BY n) FILTER (tier = 'required') AS core, list(skill ORDER BY n) FILTER (tier = 'preferred') AS imp FROM ({JOB_SKILLS}) GROUP BY 1)
SELECT job_id, array_to_string(list_slice(list_concat(list_slice(core, 1, 4), coalesce(imp, [])), 1, 5), ',') AS gaps, len(list_filter(coalesce(imp, []), lambda x: NOT list_contains(core, x))) AS only_preferred FROM js""")
def capped_gaps(t):
    """At most four core gaps, filled up to five; and how many preferred skills are not required."""
    of = lambda tier: F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == tier, F.struct("n", "skill")))), lambda x: x["skill"])
    rows = t.job_skills.groupBy("job_id").agg(of("required").alias("core"), of("preferred").alias("imp"))
    return rows.select("job_id", F.array_join(rules.capped_gaps(F.col("core"), F.col("imp")), ",").alias("gaps"), F.size(F.array_except("imp", "core")).alias("only_preferred"))


@query(f"""WITH cs AS ({CANDIDATE_SKILLS}), a AS (SELECT candidate_id, list(upper(skill) ORDER BY skill) AS l FROM cs WHERE length(skill) % 2 = 0 GROUP BY 1), b AS (SELECT candidate_id, list(skill ORDER BY skill) AS r FROM cs GROUP BY 1),
j AS (SELECT candidate_id, coalesce(l, []) AS l, r FROM b LEFT JOIN a USING (candidate_id))
SELECT candidate_id, array_to_string(list_concat(l, list_filter(r, lambda x: NOT list_contains(l, upper(x)))), ',') AS merged FROM j""")
def merged_lists(t):
    """Two lists in order, letter case aside; the left spelling wins."""
    listed = lambda c: F.transform(F.array_sort(F.collect_set("skill")), c)
    left = t.candidate_skills.where("length(skill) % 2 = 0").groupBy("candidate_id").agg(listed(F.upper).alias("l"))
    right = t.candidate_skills.groupBy("candidate_id").agg(listed(lambda x: x).alias("r"))
    merged = rules.merge_lists(F.col("l"), F.col("r"))
    return right.join(left, "candidate_id", "left").select("candidate_id", F.array_join(merged, ",").alias("merged"))


_LEVELS = "['Senior ', 'jr. ', 'Team Lead ', 'Intern, ', 'Associate ', 'Head of ', 'Staff ', '']"
_RULES = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for p, n in labels.SENIORITY) + " ELSE 'Unknown' END"


@query(f"SELECT p_partkey, {_RULES} AS level FROM (SELECT p_partkey, lower({_LEVELS}[1 + p_partkey % 8] || p_name) AS s FROM part)")
def seniority_levels(t):
    words = F.array(*[F.lit(x) for x in ("Senior ", "jr. ", "Team Lead ", "Intern, ", "Associate ", "Head of ", "Staff ", "")])
    title = F.lower(F.concat(F.get(words, (F.col("p_partkey") % 8).cast("int")), F.col("p_name")))
    return t.part.select("p_partkey", labels.first_match(title, labels.SENIORITY, "Unknown").alias("level"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(upper(p_brand), '#', '-') WHEN 1 THEN regexp_replace(upper(p_type), '[ ]+', '-', 'g') END AS label FROM part""")
def category_labels(t):
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat(F.lit("It best fits the "), F.translate("p_brand", "#", "/"), F.lit(" category."))).when(k == 1, F.concat(F.lit("Job category: "), "p_type")).otherwise("Fits the FOLLOWING category")
    return t.part.select("p_partkey", labels.category_label(said).alias("label"))


@query(f"""SELECT candidate_id, round(least(1.0::DOUBLE, (0.15 + 0.10 * (nation % 2) + 0.05 * (projects > 3)::INT + 0.05 * (nation > 5)::INT + 0.20 * (projects >= 5)::INT + 0.10 * (projects BETWEEN 1 AND 4)::INT + 0.20 * (years > 2)::INT + 0.15 * (years > 5)::INT)::DOUBLE), 2) AS quality,
  least(100.0::DOUBLE, (20 + 15 + 10 * (nation % 2) + 10 * (projects > 3)::INT + 15 * (nation > 5)::INT + 15 * (projects > 0)::INT + 15 * (years > 2)::INT)::DOUBLE) AS completion FROM ({CANDIDATES})""")
def profile_scores(t):
    """Completeness of an extraction (0 to 1) and of a profile (percent), points by part."""
    yes, mail, phone, place = F.lit(True), F.col("nation") % 2 == 1, F.col("projects") > 3, F.col("nation") > 5
    many, some, school, work = F.col("projects") >= 5, F.col("projects").between(1, 4), F.col("years") > 2, F.col("years") > 5
    quality = {"name": (yes, 0.15), "email": (mail, 0.10), "phone": (phone, 0.05), "location": (place, 0.05), "many": (many, 0.20), "some": (some, 0.10), "education": (school, 0.20), "experience": (work, 0.15)}
    done = {"base": (yes, 20.0), "name": (yes, 15.0), "email": (mail, 10.0), "phone": (phone, 10.0), "summary": (place, 15.0), "skills": (F.col("projects") > 0, 15.0), "education": (school, 15.0)}
    return t.candidates.select("candidate_id", F.round(rules.additive_score(quality, 1.0), 2).alias("quality"), rules.additive_score(done, 100.0).alias("completion"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 12 + 3 WHEN 1 THEN p_size WHEN 2 THEN round_even(p_size * 12.0 + 6, 0)::INT END AS months, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 2 THEN p_size + 0.5 END AS years FROM part""")
def duration_texts(t):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(n, F.lit(" Years 3 months"))).when(k == 1, F.concat(n, F.lit(" mos"))).when(k == 2, F.concat(n, F.lit(".5+ yrs"))).otherwise("a while")
    return t.part.select("p_partkey", dates.months_of_text(said).alias("months"), dates.required_years(said).alias("years"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE END AS years FROM part""")
def jd_years(t):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(F.lit("Needs "), n, F.lit(" to 60 years of work"))).when(k == 1, F.concat(n, F.lit("+ years"))).otherwise("no number")
    return t.part.select("p_partkey", dates.required_years(said).alias("years"))


@query("SELECT p_partkey, p_type || '=Expert,' || p_brand || '=Basic' AS found FROM part")
def proficiency_levels(t):
    said = F.concat("p_type", F.lit(": Expert; "), "p_brand", F.lit(" (Basic)"))
    found = F.transform(rules.proficiency(said), lambda x: F.concat(x["skill"], F.lit("="), x["level"]))
    return t.part.select("p_partkey", F.array_join(found, ",").alias("found"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE p_name || ' (Basic) x' END AS canonical FROM part")
def canonical_names(t):
    """A name as it is known, with or without a remark in brackets; unknown texts stay."""
    raw = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("  (Basic)"))).otherwise(F.concat("p_name", F.lit(" (Basic) x"))).alias("raw"))
    names = t.part.select(F.col("p_name").alias("alias"), F.lower("p_name").alias("canonical"))
    return rules.canonical_name(raw, "raw", names).select("p_partkey", "canonical")


@query(f"""WITH cs AS ({CANDIDATE_SKILLS}), base AS (SELECT candidate_id, skill, 'held' AS origin FROM cs UNION ALL SELECT s_suppkey, p_name, 'seed' FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT origin, count(*) AS n, count(DISTINCT skill) AS skills FROM base GROUP BY 1""")
def pooled_sources(t):
    """Two sources of candidates' skills as one bag, each row with its origin."""
    held = t.candidate_skills.select("candidate_id", "skill", F.lit("held").alias("origin"))
    seed = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("candidate_id"), F.col("p_name").alias("skill"), F.lit("seed").alias("origin"))
    return held.unionByName(seed).groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("skill").alias("skills"))
