"""Queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import dates, labels, text
from tessella.operators import audit, match, metrics, models, pairs, profiles, records, sections, skills
from tessella.plans.bindings import CANDIDATE_SKILLS, CANDIDATES, JOB_SKILLS, JOBS, Tables
from tessella.sources.cuts import checkpointed
from tessella.streaming import funnel as live

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- scoring -----------------------------------------------------------------

_PAIRS = f"""cs AS ({CANDIDATE_SKILLS}), js AS ({JOB_SKILLS}), c AS ({CANDIDATES}), j AS ({JOBS}),
hits AS (SELECT candidate_id, job_id, count(*) FILTER (tier = 'required') AS r, count(*) FILTER (tier = 'preferred') AS p
  FROM cs JOIN js USING (skill) GROUP BY ALL),
wants AS (SELECT job_id, count(*) FILTER (tier = 'required') AS nr, count(*) FILTER (tier = 'preferred') AS np FROM js GROUP BY 1),
pairs AS (SELECT c.*, j.*, coalesce(r, 0) AS r, coalesce(p, 0) AS p, coalesce(nr, 0) AS nr, coalesce(np, 0) AS np
  FROM c CROSS JOIN j LEFT JOIN hits USING (candidate_id, job_id) LEFT JOIN wants USING (job_id)),
scored AS (SELECT candidate_id, job_id, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100::DOUBLE * (0.0::DOUBLE + 0.5::DOUBLE * (r::DOUBLE / greatest(1, nr))
  + 0.15::DOUBLE * (CASE WHEN np > 0 THEN p::DOUBLE / np WHEN r > 0 THEN 1.0 ELSE 0.5 END)::DOUBLE
  + 0.15::DOUBLE * (CASE WHEN years >= CASE WHEN wanted = 0 THEN 1.0 ELSE wanted END THEN 1.0 WHEN years > 0 THEN greatest(0.35::DOUBLE, years / CASE WHEN wanted = 0 THEN 1.0 ELSE wanted END) ELSE 0.30 END)::DOUBLE
  + 0.1::DOUBLE * (CASE WHEN nation = job_nation THEN 1.0 WHEN nation % 5 = job_nation % 5 THEN 0.85 ELSE 0.5 END)::DOUBLE
  + 0.1::DOUBLE * (CASE WHEN projects >= 2 THEN 1.0 WHEN projects = 1 THEN 0.75 ELSE 0.4 END)::DOUBLE))), 1) AS score
  FROM pairs)"""


def _pairs(t: Tables) -> pairs.Pairs:
    candidates = t.candidates.select("candidate_id", "years", "nation", F.least("projects", F.lit(2)).alias("projects"))
    return pairs.Pairs(candidates, t.bought, t.jobs, t.job_skills)


@query(f"WITH {_PAIRS} SELECT job_id, candidate_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS rank FROM scored) WHERE rank <= 10")
def candidate_job_rank(t):
    """The ten best candidates of every job."""
    return _pairs(t).best(pairs.match_tenths, "job", 10).select("job_id", "candidate_id", (F.col("score") / 10).alias("score"), "rank")


@query(f"WITH {_PAIRS} SELECT job_id, candidate_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, job_id) AS rank FROM scored) WHERE rank <= 5")
def jobs_for_candidate_topk(t):
    return _pairs(t).best(pairs.match_tenths, "candidate", 5).select("job_id", "candidate_id", (F.col("score") / 10).alias("score"), "rank")


_BANDS = "CASE WHEN score >= 80 THEN 'Strong Match' WHEN score >= 65 THEN 'Potential Candidate' WHEN score >= 50 THEN 'Moderate Match' WHEN score >= 35 THEN 'Needs Skill Development' ELSE 'Not Currently Suitable' END"


@query(f"WITH {_PAIRS} SELECT {_BANDS} AS label, count(*) AS n FROM scored GROUP BY 1")
def fit_labels(t):
    counted = _pairs(t).counts(pairs.match_tenths)
    return counted.groupBy(labels.banded(F.col("score") / 10, labels.FIT_BANDS, labels.FIT_BELOW).alias("label")).agg(F.sum("n").alias("n"))


_JD = f"""{_PAIRS},
parts AS (SELECT candidate_id, job_id, r + p AS matched, nr + np - r - p AS missing, CASE WHEN nr + np = 0 THEN 100.0 ELSE 100.0::DOUBLE * (r + 0.5::DOUBLE * p) / (nr + 0.5::DOUBLE * np) END::DOUBLE AS skill,
  CASE WHEN wanted > 0 THEN least(100.0::DOUBLE, 100.0::DOUBLE * years / wanted) END AS exp, CASE WHEN job_nation % 2 = 0 THEN CASE WHEN projects > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END AS edu FROM pairs),
jd AS (SELECT *, CASE WHEN matched = 0 THEN 0.0::DOUBLE ELSE round((skill * 0.7::DOUBLE + coalesce(exp * 0.2::DOUBLE, 0) + coalesce(edu * 0.1::DOUBLE, 0))
  / (0.7::DOUBLE + CASE WHEN exp IS NULL THEN 0.0 ELSE 0.2 END::DOUBLE + CASE WHEN edu IS NULL THEN 0.0 ELSE 0.1 END::DOUBLE), 1) END AS score, round(skill, 1) AS skill_pct FROM parts),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS rank,
  CASE WHEN matched = 0 OR score = 0 THEN 'No Match' WHEN score >= 80 THEN 'Strong Match' WHEN score >= 60 THEN 'Good Match' WHEN score >= 30 THEN 'Partial Match' ELSE 'Low Match' END AS label FROM jd)"""


@query(f"""WITH {_JD} SELECT job_id, candidate_id, rank, score, label, CASE WHEN matched = 0 THEN '#' || rank || ': no matched skill'
  WHEN rank = 1 THEN '#1: best fit, ' || score || ' % (' || label || '), skills ' || skill_pct || ' %' WHEN rank <= 3 THEN '#' || rank || ': ' || label || ', skills ' || skill_pct || ' %, ' || missing || ' open'
  ELSE '#' || rank || ': ' || label || ', ' || missing || ' open' END AS reason FROM k WHERE rank <= 5""")
def jd_leaderboard(t):
    """The five best candidates for every job description, with band and reason; parts that a description lacks do not count."""
    candidates = t.candidates.select("candidate_id", "years", (F.col("projects") > 0).alias("placed"))
    jobs = t.jobs.select("job_id", "wanted", (F.col("job_nation") % 2 == 0).alias("schooled"))
    top = pairs.Pairs(candidates, t.bought, jobs, t.job_skills).best(pairs.jd_tenths, "job", 5).withColumn("score", F.col("score") / 10)
    matched, wanted = F.col("r") + F.col("p"), F.col("nr") + F.col("np")
    skill = F.when(wanted == 0, 100.0).otherwise(100.0 * (F.col("r") + 0.5 * F.col("p")) / (F.col("nr") + 0.5 * F.col("np")))
    top = top.withColumns({"matched": matched, "missing": wanted - matched, "skill_pct": F.round(skill, 1)}).withColumn("label", labels.jd_label(F.col("score"), F.col("matched")))
    reason = match.rank_reason(F.col("rank"), F.col("matched"), F.col("missing"), F.col("score"), F.col("skill_pct"), F.col("label"))
    return top.select("job_id", "candidate_id", "rank", "score", "label", reason.alias("reason"))


_GAP = f"""WITH cs AS (SELECT candidate_id, list(skill) AS held FROM ({CANDIDATE_SKILLS}) GROUP BY 1),
js AS (SELECT job_id, list(skill) AS req FROM ({JOB_SKILLS}) WHERE tier = 'required' GROUP BY 1)
SELECT candidate_id, job_id, len(list_filter(req, lambda x: list_contains(held, x))) AS n_matched,
  array_to_string(list_sort(list_filter(req, lambda x: NOT list_contains(held, x))), ',') AS missing,
  len(list_filter(held, lambda x: NOT list_contains(req, x))) AS n_additional,
  round(100.0 * len(list_filter(req, lambda x: list_contains(held, x))) / greatest(1, len(req)), 1) AS match_pct
FROM cs JOIN js ON job_id = 1 + candidate_id % (SELECT count(*) FROM supplier)"""


@query(_GAP)
def skill_gap(t):
    """Every candidate against one job: matched, missing and additional skills."""
    held = t.candidate_skills.groupBy("candidate_id").agg(F.collect_set("skill").alias("held"))
    req = t.job_skills.where("tier = 'required'").groupBy("job_id").agg(F.collect_set("skill").alias("req"))
    total = t.supplier.agg(F.count("*").alias("total"))
    own = held.join(F.broadcast(total)).withColumn("job_id", 1 + F.col("candidate_id") % F.col("total"))
    g = own.join(req, "job_id").withColumn("g", skills.gap(F.col("held"), F.col("req")))
    return g.select("candidate_id", "job_id", F.size("g.matched").alias("n_matched"), F.array_join("g.missing", ",").alias("missing"), F.size("g.additional").alias("n_additional"), "g.match_pct")


# roles: part types with the names seen most; tiers by rank
_ROLES = """SELECT role, skill, CASE WHEN n <= 4 THEN 'core' WHEN n <= 8 THEN 'important' WHEN n <= 12 THEN 'recommended' END AS tier FROM (
  SELECT p_type AS role, p_name AS skill, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_name) AS n FROM part GROUP BY 1, 2) WHERE n <= 12"""


def _roles(t: Tables) -> DataFrame:
    counted = t.part.groupBy(F.col("p_type").alias("role"), F.col("p_name").alias("skill")).agg(F.count("*").alias("c"))
    top = audit.Window.partitionBy("role").orderBy(F.desc("c"), "skill")
    tier = labels.upper_band(F.col("n"), ((4, "core"), (8, "important"), (12, "recommended")), "none")
    return counted.withColumn("n", F.row_number().over(top)).where("n <= 12").select("role", "skill", tier.alias("tier"))


@query(f"""WITH cs AS ({CANDIDATE_SKILLS}), r AS ({_ROLES}),
hits AS (SELECT candidate_id, role, count(*) FILTER (tier = 'core') / 4.0 AS c, count(*) FILTER (tier = 'important') / 4.0 AS i,
  count(*) FILTER (tier = 'recommended') / 4.0 AS o FROM cs JOIN r USING (skill) GROUP BY ALL),
s AS (SELECT candidate_id, role, round(CASE WHEN c > 0 THEN least(96.0, 125 * (0.6 * c + 0.25 * i + 0.15 * o)) ELSE 30 * i + 15 * o END, 4) AS score FROM hits)
SELECT candidate_id, role, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, role) AS rank FROM s) WHERE rank <= 3""")
def role_reco_tiered(t):
    """The three best roles of every candidate by tiered shares."""
    tiers = {k: (F.count_if(F.col("tier") == k) / 4.0).alias(k) for k in ("core", "important", "recommended")}
    hits = t.candidate_skills.join(_roles(t), "skill").groupBy("candidate_id", "role").agg(*tiers.values())
    scored = hits.withColumn("score", match.role_score(F.col("core"), F.col("important"), F.col("recommended")))
    return match.ranked(scored, "candidate_id", "role", 3).select("candidate_id", "role", "score", "rank")


@query(f"""WITH cs AS ({CANDIDATE_SKILLS}), e AS (SELECT DISTINCT a.skill AS src, b.skill AS dst FROM ({_ROLES}) a JOIN ({_ROLES}) b
  ON a.role = b.role AND a.tier = 'core' AND b.tier = 'core' AND a.skill <> b.skill),
near AS (SELECT DISTINCT candidate_id, dst AS skill FROM cs JOIN e ON skill = src)
SELECT candidate_id, count(*) AS reachable FROM near n WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.candidate_id = n.candidate_id AND cs.skill = n.skill) GROUP BY 1""")
def one_hop_credit(t):
    core = _roles(t).where("tier = 'core'").select("role", "skill")
    edges = core.select("role", F.col("skill").alias("src")).join(core.select("role", F.col("skill").alias("dst")), "role").where("src <> dst").select("src", "dst").distinct()
    return skills.one_hop(t.candidate_skills, edges).groupBy("candidate_id").agg(F.count("*").alias("reachable"))


@query(f"""WITH cs AS ({CANDIDATE_SKILLS}), r AS (SELECT skill, min(role) AS category FROM ({_ROLES}) GROUP BY 1)
SELECT candidate_id, category, string_agg(skill, ',' ORDER BY skill) AS skills FROM cs JOIN r USING (skill) GROUP BY ALL""")
def category_matrix(t):
    category = _roles(t).groupBy("skill").agg(F.min("role").alias("category"))
    rows = skills.category_matrix(t.candidate_skills.join(category, "skill"))
    return rows.select("candidate_id", "category", F.array_join("skills", ",").alias("skills"))


@query("""SELECT candidate_id, skill, priority, seq FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, skill ORDER BY priority DESC, seq) AS n FROM (
  SELECT o_custkey AS candidate_id, p_name AS skill, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 ELSE 1 END AS priority,
  o_orderkey AS seq FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)) WHERE n = 1""")
def evidence_argmax(t):
    """The strongest evidence of every candidate's skill; the earliest order wins ties."""
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", 5).when(F.col("o_orderpriority") == "2-HIGH", 4).when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(1)
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    evidence = rows.select(F.col("o_custkey").alias("candidate_id"), F.col("p_name").alias("skill"), priority.alias("priority"), F.col("o_orderkey").alias("seq"))
    return skills.best_evidence(evidence)


@query(f"""WITH c AS ({CANDIDATES}), j AS ({JOBS}), p AS (SELECT candidate_id, CASE WHEN nation % 3 = 0 THEN NULL ELSE years * 10 END AS skill,
  CASE WHEN projects = 0 THEN NULL ELSE least(100.0, projects * 5.0) END AS exp, CASE WHEN years < 5 THEN 0.0 ELSE 100.0 END AS edu FROM c)
SELECT candidate_id, round((coalesce(skill * 0.7, 0) + coalesce(exp * 0.2, 0) + edu * 0.1) / (CASE WHEN skill IS NULL THEN 0.0 ELSE 0.7 END + CASE WHEN exp IS NULL THEN 0.0 ELSE 0.2 END + 0.1), 4) AS score FROM p""")
def weighted_present(t):
    """Weighted mean over the parts that a candidate has."""
    c = t.candidates
    parts = {
        "skills": F.when(F.col("nation") % 3 != 0, F.col("years") * 10),
        "experience": F.when(F.col("projects") > 0, F.least(F.lit(100.0), F.col("projects") * 5.0)),
        "education": F.when(F.col("years") < 5, 0.0).otherwise(100.0),
    }
    return c.select("candidate_id", F.round(match.present_mean(parts, match.JD_WEIGHTS), 4).alias("score"))


@query(f"""WITH cs AS ({CANDIDATE_SKILLS}), js AS ({JOB_SKILLS}), h AS (SELECT job_id, candidate_id, count(*) FILTER (tier = 'required') AS r, count(*) FILTER (tier = 'preferred') AS p FROM cs JOIN js USING (skill) GROUP BY ALL),
pairs AS (SELECT c_custkey AS candidate_id, 1 + c_custkey % (SELECT count(*) FROM supplier) AS job_id FROM customer)
SELECT candidate_id, job_id, CASE WHEN coalesce(r, 0) + coalesce(p, 0) = 0 THEN 0.0 ELSE round(100.0 * (r + 0.5 * p) / 10.0, 4) END AS score FROM pairs LEFT JOIN h USING (candidate_id, job_id)""")
def jd_zero_skill(t):
    """Every candidate against one job description; without a matched skill the score is 0."""
    total = t.supplier.agg(F.count("*").alias("total"))
    pairs = t.customer.join(F.broadcast(total)).select(F.col("c_custkey").alias("candidate_id"), (1 + F.col("c_custkey") % F.col("total")).alias("job_id"))
    wanted = pairs.join(t.job_skills.select("job_id", "skill", "tier"), "job_id")
    hits = wanted.join(t.candidate_skills, ["candidate_id", "skill"]).groupBy("candidate_id", "job_id").agg(
        F.round(100.0 * F.sum(F.when(F.col("tier") == "required", 1.0).otherwise(0.5)) / 10.0, 4).alias("s"))
    return pairs.join(hits, ["candidate_id", "job_id"], "left").select("candidate_id", "job_id", F.coalesce("s", F.lit(0.0)).alias("score"))


@query(f"SELECT CASE WHEN years <= 1 THEN 'entry' WHEN years <= 2 THEN 'junior' WHEN years <= 4 THEN 'mid' ELSE 'senior' END AS band, count(*) AS n FROM ({CANDIDATES}) GROUP BY 1")
def salary_band(t):
    return t.candidates.groupBy(labels.upper_band(F.col("years"), labels.SALARY_BANDS, "senior").alias("band")).agg(F.count("*").alias("n"))


# --- text and corpus audits --------------------------------------------------

_HTML = "trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"


@query(f"SELECT page_id, sha256({_HTML}) AS clean_sha256, length({_HTML}) AS n_chars FROM pages")
def html_clean(t):
    clean = text.strip_html(F.col("html"))
    return t.pages.select("page_id", F.sha2(clean, 256).alias("clean_sha256"), F.length(clean).alias("n_chars"))


def _form(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _print(c: str) -> str:
    return f"sha256({_form(c)})"


@query(f"SELECT doc_id, {_print('text')} AS fingerprint FROM documents")
def text_fingerprint(t):
    """SHA-256 of the hash form of every whole text."""
    return t.documents.select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


_UNION = f"""SELECT 'documents' AS ds, sha256({_form('text')}) AS h FROM documents UNION ALL SELECT 'benchmark', sha256({_form('text')}) FROM benchmark
  UNION ALL SELECT 'conversations', sha256({_form('text')}) FROM conversations"""


def _corpora(t: Tables) -> DataFrame:
    h = F.sha2(text.hash_form(F.col("text")), 256).alias("h")
    return t.documents.select(F.lit("documents").alias("ds"), h).unionByName(t.benchmark.select(F.lit("benchmark").alias("ds"), h)).unionByName(t.conversations.select(F.lit("conversations").alias("ds"), h))


@query(f"SELECT ds, count(*) AS total, count(DISTINCT h) AS distinct_keys, count(*) - count(DISTINCT h) AS duplicates, round(100.0 * (count(*) - count(DISTINCT h)) / count(*), 2) AS dup_rate FROM ({_UNION}) GROUP BY 1")
def intra_dups(t):
    return audit.duplicate_summary(_corpora(t), "ds", "h")


@query(f"WITH u AS (SELECT DISTINCT * FROM ({_UNION})), n AS (SELECT DISTINCT ds FROM u) SELECT a.ds AS a, b.ds AS b, (SELECT count(*) FROM u x JOIN u y USING (h) WHERE x.ds = a.ds AND y.ds = b.ds) AS shared FROM n a JOIN n b ON a.ds < b.ds")
def cross_overlap(t):
    return audit.pairwise_overlap(_corpora(t), "ds", "h")


@query(f"SELECT doc_id, h FROM (SELECT doc_id, sha256({_form('text')}) AS h, row_number() OVER (PARTITION BY sha256({_form('text')}) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def keep_first(t):
    rows = t.documents.select("doc_id", F.sha2(text.hash_form(F.col("text")), 256).alias("h"))
    return audit.keep_first(rows, ["h"], ["doc_id"])


_BUCKET = "('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 10"
_SPLIT = f"CASE WHEN {_BUCKET} < 8 THEN 'train' WHEN {_BUCKET} = 8 THEN 'validation' ELSE 'test' END"


@query(f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def split_801010(t):
    return t.documents.select("doc_id", audit.split_name(F.col("doc_id")).alias("split"))


@query(f"WITH s AS (SELECT DISTINCT {_SPLIT} AS g, {_print('text')} AS h FROM documents), n AS (SELECT DISTINCT g FROM s) SELECT a.g AS a, b.g AS b, (SELECT count(*) FROM s x JOIN s y USING (h) WHERE x.g = a.g AND y.g = b.g) AS shared FROM n a JOIN n b ON a.g < b.g")
def split_leak_audit(t):
    rows = t.documents.select(audit.split_name(F.col("doc_id")).alias("g"), text.fingerprint(F.col("text")).alias("h"))
    return audit.pairwise_overlap(rows, "g", "h")


@query("""SELECT lang, count(*) AS n, round(avg(v), 2) AS mean, round(median(v), 2) AS median, min(v) AS lo, max(v) AS hi, round(stddev_pop(v), 2) AS std,
  max(v) FILTER (r = floor(0.25 * c) + 1) AS p25, max(v) FILTER (r = floor(0.75 * c) + 1) AS p75
FROM (SELECT lang, length(text) AS v, row_number() OVER (PARTITION BY lang ORDER BY length(text)) AS r, count(*) OVER (PARTITION BY lang) AS c FROM documents) GROUP BY lang""")
def length_stats(t):
    return audit.length_summary(t.documents.withColumn("v", F.length("text")), "lang", "v")


# Fixed values of this binding: rules over a whole turn.
TASKS = (("[?]", "question"), ("(^|[^a-z])(the|and)([^a-z]|$)", "english"), ("(^|[^a-z])(der|die|und)([^a-z]|$)", "german"), ("[|]", "table"))
_HEAD = "lower(coalesce(text, ''))"
_TASKS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_HEAD}, '{p}') THEN '{n}' END" for p, n in TASKS) + "], lambda x: x IS NOT NULL)"


def _task_rows(t: Tables) -> DataFrame:
    head = F.lower(F.coalesce("text", F.lit("")))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", labels.all_matches(head, TASKS, "other").alias("tasks"))


@query(f"""WITH r AS (SELECT CASE WHEN len({_TASKS}) = 0 THEN ['other'] ELSE {_TASKS} END AS tasks FROM conversations WHERE role = 'user')
SELECT task, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 2) AS pct FROM (SELECT unnest(tasks) AS task FROM r) GROUP BY 1""")
def task_labels(t):
    """Labels of user turns; a turn may have several, so shares may add to more than 100."""
    rows = _task_rows(t)
    total = rows.agg(F.count("*").alias("total"))
    counted = rows.select(F.explode("tasks").alias("task")).groupBy("task").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(total)).select("task", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


@query(f"SELECT array_to_string(list_sort(CASE WHEN len({_TASKS}) = 0 THEN ['other'] ELSE {_TASKS} END), ' + ') AS combo, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def task_combos(t):
    return _task_rows(t).groupBy(F.array_join(F.array_sort("tasks"), " + ").alias("combo")).agg(F.count("*").alias("n"))


_QA = """SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS body, arg_min(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY 1"""
_REASON = """CASE WHEN trim(coalesce(body, '')) = '' THEN 'missing body' WHEN trim(coalesce(answer, '')) = '' THEN 'missing answer'
  WHEN length(body) < 200 THEN 'body too short' WHEN length(answer) < 20 THEN 'answer too short' END"""


def _first_turns(t: Tables) -> DataFrame:
    first = lambda role: F.min_by(F.col("text"), F.when(F.col("role") == role, F.col("turn")))
    return t.conversations.groupBy("conv_id").agg(first("user").alias("body"), first("assistant").alias("answer"))


@query(f"SELECT conv_id, length(body) AS n_body, length(answer) AS n_answer FROM ({_QA}) WHERE {_REASON} IS NULL")
def quality_gate(t):
    rows = _first_turns(t).withColumn("why", audit.reject_reason(F.col("body"), F.col("answer")))
    return rows.where("why IS NULL").select("conv_id", F.length("body").alias("n_body"), F.length("answer").alias("n_answer"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM ({_QA})) WHERE reason IS NOT NULL GROUP BY 1")
def reject_reasons(t):
    rows = _first_turns(t).select(audit.reject_reason(F.col("body"), F.col("answer")).alias("reason"))
    return rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9_])(blue|green|red|steel)([^a-z0-9_]|$)')")
def keyword_mask(t):
    return t.part.where(F.lower("p_name").rlike("(^|[^a-z0-9_])(blue|green|red|steel)([^a-z0-9_]|$)")).select("p_partkey", "p_name")


@query("SELECT source, n, round(100.0 * n / sum(n) OVER (), 2) AS pct FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, source LIMIT 5")
def value_counts_topn(t):
    return audit.value_counts(t.documents, "source", 5)


@query("SELECT 'conv_id' AS column_name, count(*) FILTER (conv_id IS NULL)::BIGINT AS nulls, 0::BIGINT AS blanks FROM conversations UNION ALL SELECT 'turn', count(*) FILTER (turn IS NULL), 0 FROM conversations UNION ALL SELECT 'role', count(*) FILTER (role IS NULL), count(*) FILTER (trim(role) = '') FROM conversations UNION ALL SELECT 'text', count(*) FILTER (text IS NULL), count(*) FILTER (trim(text) = '') FROM conversations")
def null_inventory(t):
    return audit.null_inventory(t.conversations)


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{text.EMAIL}')) AS n_emails, len(list_filter(regexp_extract_all(coalesce(text, ''), '{text.PHONE.replace(chr(92) + '+', '[+]')}'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS n_phones FROM documents")
def email_phone_extract(t):
    return t.documents.select("doc_id", F.size(text.emails(F.col("text"))).alias("n_emails"), F.size(text.phones(F.col("text"))).alias("n_phones"))


# --- records -----------------------------------------------------------------

@query("WITH s(stage_no, stage) AS (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, 'Selected')) SELECT stage_no, stage, (SELECT count(*) FROM orders WHERE o_orderstatus = stage) AS n FROM s")
def funnel_zero_fill(t):
    return records.funnel(t.orders, "o_orderstatus", ("F", "O", "P", "Selected"))


@query("SELECT (SELECT count(*) FROM supplier) AS jobs, (SELECT count(*) FROM customer) AS candidates, count(*) AS applications, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS shortlisted FROM orders")
def kpi_row(t):
    apps = t.orders.agg(F.count("*").alias("applications"), F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("shortlisted"))
    return t.supplier.agg(F.count("*").alias("jobs")).join(t.customer.agg(F.count("*").alias("candidates"))).join(apps)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77')")
def search_filter(t):
    return records.search(t.customer, "77", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("WITH e AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P') SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_key FROM (SELECT * FROM e UNION ALL SELECT o_custkey, min(o_orderkey) FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM e) GROUP BY 1) GROUP BY 1")
def insert_if_absent(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    out = records.insert_if_absent(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), rows.where("o_orderstatus <> 'P'").drop("o_orderstatus"), ["o_custkey"], ["o_orderkey"])
    return out.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


@query("""WITH s AS (SELECT o_orderkey AS stored_id, 'u' || o_custkey || '@x.org' AS s_email, 'Customer ' || (o_custkey % 50) AS s_name, o_orderdate AS created FROM orders),
n AS (SELECT s_suppkey AS new_id, 'U' || (s_suppkey * 3) || '@x.org' AS email, CASE WHEN s_suppkey % 2 = 0 THEN 'unnamed candidate' ELSE 'customer ' || s_suppkey END AS name FROM supplier),
h AS (SELECT new_id, stored_id, created FROM n JOIN s ON lower(email) = lower(s_email) OR (name <> 'unnamed candidate' AND lower(name) = lower(s_name)))
SELECT new_id, stored_id FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY created DESC, stored_id) AS k FROM h) WHERE k = 1""")
def entity_resolution(t):
    """The newest stored record with a new record's e-mail or name."""
    mail = lambda k: F.concat(F.lit("u"), k.cast("string"), F.lit("@x.org"))
    stored = t.orders.select(F.col("o_orderkey").alias("stored_id"), mail(F.col("o_custkey")).alias("s_email"), F.concat(F.lit("Customer "), (F.col("o_custkey") % 50).cast("string")).alias("s_name"), F.col("o_orderdate").alias("created"))
    name = F.when(F.col("s_suppkey") % 2 == 0, "unnamed candidate").otherwise(F.concat(F.lit("customer "), F.col("s_suppkey").cast("string")))
    new = t.supplier.select(F.col("s_suppkey").alias("new_id"), F.upper(mail(F.col("s_suppkey") * 3)).alias("email"), name.alias("name"))
    return records.resolve(new, stored)


@query("SELECT s_suppkey, count(l_orderkey) AS n_children FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def apps_per_job(t):
    return records.count_by_parent(t.supplier.select("s_suppkey"), t.lineitem, "s_suppkey", "l_suppkey")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_status(t):
    return records.latest(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT o_custkey, greatest(1, round_even(days / 30.44, 0)::INT) AS months, round_even(greatest(1, round_even(days / 30.44, 0)::INT) / 12.0::DOUBLE, 2) AS years FROM (SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days FROM orders GROUP BY 1)")
def date_durations(t):
    span = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    months = dates.months_between_days(F.col("a"), F.col("b"))
    return span.select("o_custkey", months.alias("months"), dates.years_of(months).alias("years"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w_start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(t):
    """Batch form of the live funnel."""
    return live.windowed_counts(t.events).select("event_type", F.col("w.start").alias("w_start"), "n", F.round("total", 2).alias("total"))


# --- metrics -----------------------------------------------------------------

_PRED = "SELECT l.doc_id, l.quality AS y, CASE WHEN length(d.text) >= 1000 THEN 1 ELSE 0 END AS p, length(d.text) AS s FROM labels l JOIN documents d USING (doc_id)"


def _predicted(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select("doc_id", F.col("quality").alias("y"), F.when(F.length("text") >= 1000, 1).otherwise(0).alias("p"), F.length("text").alias("s"))


@query(f"""WITH r AS ({_PRED}), c AS (SELECT DISTINCT y AS cls FROM r UNION SELECT DISTINCT p FROM r), m AS (SELECT cls, (SELECT count(*) FROM r WHERE y = cls) AS support,
  (SELECT count(*) FROM r WHERE p = cls) AS said, (SELECT count(*) FROM r WHERE y = cls AND p = cls) AS tp FROM c),
q AS (SELECT *, coalesce(tp / nullif(said, 0), 0.0) AS pr, coalesce(tp / nullif(support, 0), 0.0) AS re FROM m)
SELECT cls, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) AS f1 FROM q""")
def class_metrics(t):
    return metrics.class_report(_predicted(t), "y", "p")


@query("SELECT round(avg(abs(l_extendedprice - 900 * l_quantity)), 4) AS mae, round(sqrt(avg((l_extendedprice - 900 * l_quantity) ** 2)), 4) AS rmse, round(1 - sum((l_extendedprice - 900 * l_quantity) ** 2) / sum((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) ** 2), 4) AS r2 FROM lineitem")
def regression_metrics(t):
    return metrics.regression_report(t.lineitem.withColumn("guess", 900 * F.col("l_quantity")), "l_extendedprice", "guess")


@query(f"WITH r AS ({_PRED}), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS a FROM r) SELECT round((sum(a) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM k")
def roc_auc(t):
    return metrics.roc_auc(_predicted(t), "y", "s")


_CENTROID = "SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL"


def _cosine_rank(t: Tables) -> DataFrame:
    """Rank of the true label among all centroids by cosine; the labels are few, the vectors many."""
    mean = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centroids = mean.groupBy(F.col("label").alias("other")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    # all centroids as one row: a vector counts those nearer than its own, without a shuffle of vectors times classes
    listed = centroids.select(F.struct("other", "c", F.sqrt(dot("c", "c")).alias("norm")).alias("x")).agg(F.collect_list("x").alias("all"))
    near = F.transform("all", lambda x: F.struct(x["other"].alias("other"), F.round(dot(F.col("embedding"), x["c"]) / x["norm"], 9).alias("cos")))
    rows = t.embeddings.join(F.broadcast(listed)).select("vec_id", "label", near.alias("near"))
    own = rows.withColumn("own", F.get(F.filter("near", lambda x: x["other"] == F.col("label")), F.lit(0))["cos"])
    ahead = F.filter("near", lambda x: (x["cos"] > F.col("own")) | ((x["cos"] == F.col("own")) & (x["other"] < F.col("label"))))
    return own.select("vec_id", "label", (F.size(ahead) + 1).alias("rank"))


_RANKED = f"""WITH c AS ({_CENTROID}), z AS (SELECT label AS other, list(m ORDER BY i) AS c FROM c GROUP BY 1),
p AS (SELECT vec_id, label, other, round(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(c, c)), 9) AS cos FROM embeddings, z),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, other) AS rank FROM p)"""


@query(f"{_RANKED} SELECT round(avg((rank <= 1)::INT), 6) AS top1, round(avg((rank <= 3)::INT), 6) AS top3, round(avg((rank <= 5)::INT), 6) AS top5 FROM k WHERE label = other")
def topk_accuracy(t):
    return metrics.top_k_accuracy(_cosine_rank(t))


@query(f"{_RANKED} SELECT vec_id, label, rank FROM k WHERE label = other")
def centroid_cosine(t):
    return _cosine_rank(t).select("vec_id", "label", "rank")


# --- lines, sections and profiles --------------------------------------------

_LINES = r"""lines AS (SELECT doc_id, i - 1 AS line_no, trim(parts[i], ' ') AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS parts FROM documents)) WHERE trim(parts[i], ' ') <> '')"""


def _lines(t: Tables) -> DataFrame:
    return sections.lines_of(t.documents, "doc_id", "text")


@query(f"""WITH {_LINES}, p AS (SELECT *, CASE WHEN length(line) <= 20 THEN line END AS head FROM lines),
s AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'personal_info_header') AS section FROM p)
SELECT doc_id, section, min(line_no) AS first_line, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS body_sha256 FROM s WHERE head IS NULL GROUP BY ALL""")
def sections_by_header(t):
    """Sections of every document; a line of at most 20 characters is a header here."""
    head = F.when(F.length("line") <= 20, F.col("line"))
    out = sections.split_sections(_lines(t), "doc_id", head)
    return out.select("doc_id", "section", "first_line", "n_lines", F.sha2("body", 256).alias("body_sha256"))


@query(f"""WITH {_LINES}, m AS (SELECT *, regexp_matches(line, '[0-9]') AS is_head FROM lines),
o AS (SELECT *, is_head AND NOT coalesce(lag(is_head) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS opens FROM m),
r AS (SELECT *, (sum(opens::BIGINT) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS record FROM o)
SELECT doc_id, record, count(*) FILTER (is_head) AS n_heads, count(*) FILTER (NOT is_head) AS n_details FROM r WHERE record > 0 GROUP BY ALL""")
def line_records(t):
    """Records that open at lines with a digit."""
    rows = sections.records_by_head(_lines(t), "doc_id", F.col("line").rlike("[0-9]"))
    return rows.groupBy("doc_id", "record").agg(F.count_if("is_head").alias("n_heads"), F.count_if(~F.col("is_head")).alias("n_details"))


@query(f"""WITH {_LINES}, i AS (SELECT doc_id, lower(trim(unnest(regexp_split_to_array(regexp_replace(line, '{sections.BULLET}', ''), '[,;]')), ' ')) AS item FROM lines)
SELECT doc_id, count(DISTINCT item) AS n_items FROM i WHERE item <> '' GROUP BY 1""")
def line_items(t):
    return sections.list_items(_lines(t), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_items"))


# Heads of profiles: a number, some lines of a word, a name, more such lines, a place.
_HEADS = """concat(c_name, repeat(concat(chr(10), 'x'), CAST(c_custkey % 7 AS INT)), chr(10), c_mktsegment, ' ', r_name, repeat(concat(chr(10), 'y z'), CAST(c_custkey % 17 AS INT)), chr(10), r_name, ', ', c_mktsegment)"""


@query(f"""WITH d AS (SELECT c_custkey, string_split({_HEADS}, chr(10)) AS parts FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
l AS (SELECT c_custkey, i - 1 AS line_no, parts[i] AS line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM d))
SELECT c_custkey, arg_min(line, line_no) FILTER (line_no < 5 AND regexp_matches(line, '{sections.NAME.replace("'", "''")}')) AS name,
  arg_min(line, line_no) FILTER (line_no < 15 AND regexp_matches(line, '{sections.PLACE}')) AS location FROM l GROUP BY 1""")
def name_and_place(t):
    """Name and place out of the first lines of customers' profiles."""
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    heads = people.select("c_custkey", F.expr(_HEADS.replace("chr(10)", "char(10)")).alias("text"))
    return sections.name_and_place(sections.lines_of(heads, "c_custkey", "text"), "c_custkey")


_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9+#]+'), lambda w: w <> '')"


@query(f"""WITH b AS (SELECT {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark), t AS (SELECT DISTINCT array_to_string(w[i:i + 1], ' ') AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b)),
{_LINES}, d AS (SELECT doc_id, line_no, {_WORDS.format("line")} AS w FROM lines),
g AS (SELECT doc_id, line_no, array_to_string(w[i:i + 1], ' ') AS term FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d))
SELECT doc_id, count(DISTINCT term) AS n_terms, min(line_no) AS first_line, count(*) AS n FROM g JOIN t USING (term) GROUP BY 1""")
def taxonomy_scan(t):
    """Word pairs of the benchmark, as a taxonomy, found in the lines of documents."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9+#]+"), lambda w: w != "")
    rows = t.benchmark.select(words.alias("w")).select(F.explode(F.arrays_zip(F.col("w"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("v"))).alias("p"))
    terms = rows.where("p.v IS NOT NULL").select(F.concat_ws(" ", "p.w", "p.v").alias("term")).distinct()
    found = sections.find_terms(_lines(t), "doc_id", terms.withColumn("skill", F.col("term")), 2)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.min("first_line").alias("first_line"), F.sum("n").alias("n"))


@query(f"""WITH w AS (SELECT candidate_id, list_filter([CASE WHEN projects = 0 THEN 'no projects' END, CASE WHEN years = 0 THEN 'no experience' END,
  CASE WHEN projects > 12 THEN 'many projects' END], lambda x: x IS NOT NULL) AS warnings FROM ({CANDIDATES}))
SELECT candidate_id, array_to_string(warnings, ',') AS warnings, round(1 - least(0.6, 0.05 * len(warnings)), 4)::DOUBLE AS score, len(warnings) <= 6 AS valid FROM w""")
def structural_warnings(t):
    rules = {"no projects": F.col("projects") == 0, "no experience": F.col("years") == 0, "many projects": F.col("projects") > 12}
    out = profiles.structural_warnings(t.candidates, rules)
    return out.select("candidate_id", F.array_join("warnings", ",").alias("warnings"), F.col("score").cast("double").alias("score"), "valid")


@query("""WITH b AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1),
a AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey, array_to_string(list_filter([CASE WHEN b.urgent IS NOT NULL AND a.urgent IS NULL THEN 'urgent' END, CASE WHEN b.n > coalesce(a.n, 0) THEN 'n' END], lambda x: x IS NOT NULL), ',') AS lost FROM b LEFT JOIN a USING (o_custkey)""")
def information_loss(t):
    def summed(rows: DataFrame) -> DataFrame:
        urgent = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")))
        return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), urgent.alias("urgent"))

    out = profiles.information_loss(summed(t.orders), summed(t.orders.where("o_orderstatus = 'F'")), "o_custkey", ["urgent"], ["n"])
    return out.select("o_custkey", F.array_join("lost", ",").alias("lost"))


@query("""WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS nation FROM customer),
j AS (SELECT k, name, nation, s_name, s_nationkey AS s_nation FROM f LEFT JOIN supplier ON s_suppkey = k),
x AS (SELECT *, (name IS NULL AND s_name IS NOT NULL)::INT AS p1, (nation IS NULL AND s_nation IS NOT NULL)::INT AS p2, (nation IS NULL AND coalesce(s_nation >= 10, false))::INT AS a2 FROM j)
SELECT k, coalesce(name, s_name) AS name, CASE WHEN a2 = 1 THEN s_nation ELSE nation END AS nation, p1 + p2 AS proposed, p1 + a2 AS accepted, p2 - a2 AS rejected FROM x""")
def merge_sources(t):
    """Gaps of one source filled from another; nations only from 10 on."""
    k = F.col("c_custkey")
    first = t.customer.select(k.alias("k"), F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.when(k % 4 != 0, F.col("c_nationkey")).alias("nation"))
    second = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return profiles.merge_sources(first, second, "k", {"name": F.lit(True), "nation": F.col("s_nation") >= 10})


@query(f"SELECT role AS role_id, role, string_agg(skill, ';' ORDER BY skill) AS skills, count(*) AS n_skills FROM ({_ROLES}) GROUP BY 1, 2")
def taxonomy_export(t):
    rows = _roles(t).groupBy(F.col("role").alias("role_id"), "role").agg(F.array_sort(F.collect_list("skill")).alias("skills"))
    aliases = t.part.select(F.lower("p_name").alias("alias"), F.col("p_name").alias("skill")).distinct()
    return profiles.taxonomy_tables(rows, aliases)["roles"]


@query(f"""SELECT candidate_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.4::DOUBLE * (years * 8) + 0.35::DOUBLE * 100 * (CASE WHEN projects > 5 THEN 0.75 ELSE 0.25 END)::DOUBLE
  + 0.25::DOUBLE * (0.3::DOUBLE * (years * 10) + 0.2::DOUBLE * nation + 0.15::DOUBLE * 50 + 0.15::DOUBLE * 40 + 0.2::DOUBLE * least(projects, 100)))), 6) AS score FROM ({CANDIDATES})""")
def success_blend(t):
    """The blend of regressed score, chance and pillars, on columns of candidates in their place."""
    pillars = [F.col("years") * 10, F.col("nation"), F.lit(50), F.lit(40), F.least(F.col("projects"), F.lit(100))]
    chance = F.when(F.col("projects") > 5, 0.75).otherwise(0.25)
    return t.candidates.select("candidate_id", F.round(profiles.success_score(pillars, F.col("years") * 8, chance), 6).alias("score"))


@query()
def brand_classifier(t):
    """TF-IDF and weighted logistic regression from names to brands; the likeliest brand of every part."""
    rows = models.class_weights(t.part.select("p_partkey", "p_name", "p_brand"), "p_brand")
    model = models.text_classifier("p_name", "p_brand").fit(rows)
    best = models.top_classes(model, t.part.select("p_partkey", "p_name"), 1)
    return best.select("p_partkey", F.col("classes")[0]["name"].alias("brand"), F.col("classes")[0]["probability"].alias("confidence"))


@query()
def screening_model(t):
    """A hundred trees on the names of what was ordered, categories and numbers, with balanced classes; decision and chance for every order."""
    said = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), " ").alias("said"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(said, "o_orderkey", "left").withColumn("said", F.coalesce("said", F.lit("")))
    rows = rows.select("o_orderkey", "said", "o_orderpriority", "c_mktsegment", "o_totalprice", "c_acctbal", (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    rows = checkpointed(models.class_weights(rows, "label"))  # every stage reads the joined rows, the forest the vectors, again and again
    stages = models.mixed_features("said", ["o_orderpriority", "c_mktsegment"], ["o_totalprice", "c_acctbal"], 250)
    ready = checkpointed(models.Pipeline(stages=stages).fit(rows).transform(rows).select("o_orderkey", "label", "weight", "x"))
    scored = models.decision_model([], "label", 100, 6, weight="weight").fit(ready).transform(ready)
    return scored.select("o_orderkey", "prediction", models.vector_to_array("probability")[1].alias("chance"))
