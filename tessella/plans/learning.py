"""Queries on class profiles and trained models; what is trained has no SQL and is judged on held-out rows in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import careers, rules
from tessella.operators import boosting, calibration, centroids, models, preparation, profile_json
from tessella.plans.registry import query
from tessella.sources.cuts import checkpointed

_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2)"


@query(rf"""WITH d AS MATERIALIZED (SELECT doc_id, source AS label, {_TERMS} AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, label, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM d),
c AS (SELECT label, term, count(*) AS tf FROM g WHERE label IS NOT NULL GROUP BY ALL), n AS (SELECT count(DISTINCT label) AS n FROM d),
kept AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c, n GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 15000),
raw AS (SELECT label, term, idf, (1 + ln(tf)) * idf AS w FROM c JOIN kept USING (term)), norm AS (SELECT label, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1),
own AS (SELECT doc_id, term, (1 + ln(count(*))) * idf AS v FROM g JOIN kept USING (term) GROUP BY doc_id, term, idf), l AS (SELECT doc_id, sqrt(sum(v * v)) AS length FROM own GROUP BY 1),
s AS (SELECT doc_id, label, round(sum(v * w / norm) / any_value(length), 9) AS cosine FROM own JOIN raw USING (term) JOIN norm USING (label) JOIN l USING (doc_id) GROUP BY ALL)
SELECT doc_id, label, round(cosine, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, label)::INT AS rank FROM s) WHERE rank <= 2""")
def nearest_sources(t):
    """The two sources whose texts, taken together, are nearest to each document by TF-IDF."""
    profiles = centroids.class_profiles(t.documents, "source", "text")
    near = centroids.nearest_classes(t.documents, "doc_id", "text", profiles, 2)
    return near.withColumn("cosine", F.floor(F.col("cosine") * 1e6 + 0.5) / 1e6)  # of the double as it is, like the SQL: 0.1293615 lies below the half


@query()
def salary_bands(t):
    """Lower and upper pay of every candidate: boosted 0.15 and 0.85 quantiles of the pay of candidates in other folds, on years, projects, nation and segment."""
    nation, years = F.col("nation"), F.col("years")
    pay = careers.salary_target(F.when(nation % 3 == 0, 2.8).when(nation % 3 == 1, 3.2), years, F.col("projects"), F.lit("MBA"))
    noise = (F.pmod(F.xxhash64("candidate_id"), F.lit(1000)) / 1000 - 0.5) * (1 + years)  # pay differs between like candidates
    rows = t.candidates.join(t.customer.select(F.col("c_custkey").alias("candidate_id"), "c_mktsegment"), "candidate_id").withColumn("pay", pay + noise)
    stages = models.mixed_features(None, ["c_mktsegment"], ["years", "projects", "nation"])
    ready = models.Pipeline(stages=stages).fit(rows).transform(rows).select("candidate_id", "pay", "x")
    train = ready.where(calibration.fold_of("candidate_id", 5) > 0)
    lower, upper = (boosting.quantile_boost(train, "x", "pay", a, rounds=20, rate=0.2) for a in (0.15, 0.85))
    band = boosting.band_of(ready, lower, upper)
    return band.select("candidate_id", (calibration.fold_of("candidate_id", 5) == 0).alias("held_out"), F.round("pay", 6).alias("pay"), "lo", "hi")


@query()
def language_chances(t):
    """Chance of each language for every document: linear margins one against the rest, calibrated on rows that each model has not seen."""
    rows = models.class_weights(t.documents.where("lang IS NOT NULL").select("doc_id", "text", "lang"), "lang")
    index = models.StringIndexer(inputCol="lang", outputCol="k", stringOrderType="alphabetAsc").fit(rows)
    weighed = checkpointed(models.word_vectors(index.transform(rows).select("doc_id", "k", "weight", "text"), "text", 5_000))
    made = calibration.calibrate(weighed, "doc_id", "k", lambda part: models.one_against_rest("k", 10).fit(part))
    names = F.array(*[F.lit(x) for x in index.labels])
    best = F.array_max(F.zip_with("chances", names, lambda p, c: F.struct(p.alias("chance"), c.alias("lang"))))
    return made.transform(weighed.select("doc_id", "features")).select("doc_id", best.alias("b")).select("doc_id", "b.lang", "b.chance")


# JSON texts of several shapes out of events: fenced, old and new layouts, lists and objects, cut off, and the events' own.
_JSONS = (
    """concat('```json', chr(10), '{"personal_info": {"name": "u', user_id, '"}, "skills": ["', event_type, '", " x "], "experience": [{"role": "', event_type, '", "company": "c', event_id % 9, '"}, {"title": "t", "type": "internship"}]}', chr(10), '```')""",
    """concat('{"candidate": {"full_name": "u', user_id, '", "email": "', event_id, '@x.org"}, "skills": "', event_type, ', k', event_id % 5, ',"}')""",
    """concat('{"skills": {"b": ["', event_type, '"], "a": "z"}, "experience": {"full_time": [{"title": "', event_type, '"}], "internships": []}, "employment_status": "Busy"}')""",
    """concat('{"personal_info": {"name": "u', user_id)""",
    """concat('{"internships": [{"role": "', event_type, '"}, {"role": "', event_id, '"}], "summary": "s', event_id % 3, '"}')""",
    "props",
)


@query(rf"""WITH r AS (SELECT event_id, CASE event_id % 6 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_JSONS))} END AS raw FROM events),
c AS (SELECT event_id, trim(CASE WHEN raw LIKE '```%' THEN regexp_replace(string_split(raw, '```')[2], '^json', '') ELSE raw END, ' ' || chr(10)) AS cut FROM r),
j AS (SELECT event_id, CASE WHEN json_valid(cut) AND json_type(cut) = 'OBJECT' THEN cut::JSON END AS j FROM c),
s AS (SELECT *, CASE json_type(j, '$.skills') WHEN 'ARRAY' THEN from_json(j->'$.skills', '["VARCHAR"]') WHEN 'VARCHAR' THEN string_split(j->>'$.skills', ',')
    WHEN 'OBJECT' THEN flatten(list_transform(list_sort(json_keys(j->'$.skills')), lambda k: CASE WHEN json_type(j, '$.skills.' || k) = 'ARRAY' THEN from_json(j->('$.skills.' || k), '["VARCHAR"]') ELSE [j->>('$.skills.' || k)] END)) ELSE [] END AS raw_skills,
  CASE json_type(j, '$.experience') WHEN 'ARRAY' THEN coalesce(json_array_length(j, '$.experience'), 0) - len(list_filter(from_json(j->'$.experience', '["JSON"]'), lambda x: x->>'$.type' = 'internship')) WHEN 'OBJECT' THEN coalesce(json_array_length(j, '$.experience.full_time'), 0) ELSE 0 END AS full_jobs,
  CASE json_type(j, '$.experience') WHEN 'ARRAY' THEN len(list_filter(from_json(j->'$.experience', '["JSON"]'), lambda x: x->>'$.type' = 'internship')) ELSE 0 END AS own_interns,
  CASE WHEN json_type(j, '$.experience') = 'OBJECT' THEN coalesce(json_array_length(j, '$.experience.internships'), 0) ELSE coalesce(json_array_length(j, '$.internships'), 0) END AS more FROM j)
SELECT event_id, j IS NULL AS bad, coalesce(j->>'$.personal_info.name', j->>'$.candidate.full_name') AS name, coalesce(j->>'$.personal_info.email', j->>'$.candidate.email') AS email, j->>'$.summary' AS summary,
  array_to_string(list_filter(list_transform(raw_skills, lambda x: trim(x, ' ')), lambda x: x <> ''), ', ') AS skills, full_jobs::INT AS n_jobs, (CASE WHEN own_interns > 0 THEN own_interns ELSE more END)::INT AS n_internships,
  CASE WHEN j IS NOT NULL THEN coalesce(j->>'$.employment_status', CASE WHEN full_jobs > 0 THEN '{profile_json.EXPERIENCED}' WHEN own_interns + more > 0 THEN '{profile_json.INTERN}' ELSE '{profile_json.UNSAID}' END) END AS status FROM s""")
def json_profiles(t):
    """Profiles read from JSON of six shapes, written in one layout and read again."""
    shapes = F.array(*[F.expr(x.replace("chr(10)", "char(10)")) for x in _JSONS])
    raw = t.events.select("event_id", F.get(shapes, (F.col("event_id") % 6).cast("int")).alias("text"))
    first = profile_json.read_profiles(raw, "event_id", "text")
    again = profile_json.read_profiles(profile_json.write_profiles(first.where("NOT bad"), "event_id"), "event_id", "text")
    flat = profile_json.flat_profiles(again.unionByName(first.where("bad")), "event_id").join(first.select("event_id", "bad"), "event_id")
    return flat.select("event_id", "bad", "name", "email", "summary", "skills", "n_jobs", "n_internships", "status")


# Chat records out of conversations, some of them broken, and the tasks that their words stand for.
_TASKS = (("[?]", "question"), ("the|und", preparation.CLASSIFICATION), ("la |de ", "romance"))
_CHAT = """CASE conv_id % 9 WHEN 1 THEN '  ' WHEN 2 THEN concat('{"messages": ', conv_id) WHEN 3 THEN '{"messages": [{"role": "user"}]}' ELSE NULL END"""


@query(rf"""WITH c AS (SELECT conv_id, arg_max(coalesce(text, ''), turn) FILTER (role = 'user') AS u, arg_max(coalesce(text, ''), turn) FILTER (role = 'assistant') AS a, count(*) AS n FROM conversations GROUP BY 1),
r AS (SELECT *, {_CHAT} AS broken FROM c),
b AS (SELECT *, coalesce(u, '') AS su, coalesce(a, '') AS sa, regexp_replace(coalesce(u, ''), '^\s+|\s+$', '', 'g') AS x FROM r),
h AS (SELECT *, string_split(x, chr(10))[1] AS head FROM b), l AS (SELECT *, regexp_replace(head, '^\s+|\s+$', '', 'g') AS line FROM h),
w AS (SELECT *, contains(x, chr(10)) AND length(line) < 120 AND (regexp_matches(line, '[?:]$') OR regexp_matches(lower(line), '{"|".join(rules.INSTRUCTS)}')) AS by_line FROM l),
s AS (SELECT *, CASE WHEN by_line THEN regexp_replace(substr(x, length(head) + 1), '^\s+|\s+$', '', 'g') ELSE x END AS body FROM w),
j AS (SELECT *, CASE WHEN conv_id % 9 = 1 THEN 'empty_line' WHEN conv_id % 9 = 2 THEN 'json_parse_error' WHEN conv_id % 9 = 3 OR n < 2 THEN 'invalid_messages_structure' WHEN su = '' OR sa = '' THEN 'missing_user_or_assistant_message'
  WHEN length(body) < {preparation.LEAST_BODY} THEN 'resume_content_too_short' WHEN length(sa) < {preparation.LEAST_ANSWER} THEN 'assistant_response_too_short' END AS reason FROM s),
t AS (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(su), '{p}') THEN '{n}' END" for p, n in _TASKS)}], lambda x: x IS NOT NULL) AS tasks FROM j)
SELECT conv_id, reason, CASE WHEN reason IS NULL THEN 'cand_' || substr(sha256(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g'), ' ')), 1, 12) END AS candidate_id,
  CASE WHEN reason IS NULL THEN CASE WHEN len(tasks) = 0 THEN 'other' ELSE array_to_string(tasks, ',') END END AS tasks FROM t""")
def judged_records(t):
    """Every conversation as a chat record of one JSON line: why it is rejected, or its candidate and tasks."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    made = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("messages"))).alias("whole"))
    lines = made.select("conv_id", F.coalesce(F.expr(_CHAT), F.col("whole")).alias("line"))
    out = preparation.judge_records(lines, "conv_id", "line", _TASKS, "other", [], "Read this")
    return out.select("conv_id", "reason", "candidate_id", F.array_join("tasks", ",").alias("tasks"))
