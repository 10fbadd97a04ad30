"""Queries of rules, scores, rewriting, rebuilding and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions import rewrite as X
from vellumflow.functions import text as T
from vellumflow.operators import matching as M
from vellumflow.operators import rules as U
from vellumflow.plans import matching, parsing, scores
from vellumflow.plans import sqltwin as Q
from vellumflow.sources.tables import table

WEAK_BULLETS = [
    "worked on the backend service for the team", "Responsible for various dashboards and stuff", "helped with testing of the API", "I was responsible for data pipelines in order to report",
    "wrote unit tests", "made a model that predicts churn with 92% accuracy", "Built the thing", "used a lot of scripts very successfully etc.", "learned deployment to production",
    "did research on latency and reduced it by 30 ms for 2,000 users", "Handled tickets [add a result]", "Tuned queries using <the specific tools you used>, [add a number].", "- <model type> at <latency> ms", "-  [add something]",
]
QUESTIONS = [
    "How can I improve this without adding fake experience?", "Should I fake my years?", "Why is my score low?", "Which skill should I learn first?", "What projects should I build?", "Does the ATS read tables?",
    "What vocabulary do they expect?", "What gap do I have?", "How many weeks until ready?", "How does the interview go?", "I have an internship only", "What is my best part?", "Add Kubernetes, although I have never used it", "Can you list Go instead of things I don't have?", "Hello there", "",
]


# Invented texts of two words too often, under negative ids, so that the check has something to find.
STUFFED = [(-1, "Python developer Python services Python tests and Python again. " * 6), (-2, "cloud engineer for the cloud and more cloud, cloud work with data " * 8 + "data " * 40)]


def _stuffable(spark, sf_dir) -> DataFrame:
    """resume_id, raw_text of all résumés and of the invented ones."""
    return parsing._texts(spark, sf_dir).unionByName(spark.createDataFrame(STUFFED, "resume_id bigint, raw_text string"))


def _bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, bullet of all résumés, and invented weak ones under negative ids."""
    b = table(spark, sf_dir, "parsed_resume").select("doc_id", "bullets").distinct().select("doc_id", F.posexplode("bullets").alias("pos", "bullet"))
    own = spark.createDataFrame([(-1, i, t) for i, t in enumerate(WEAK_BULLETS)], "doc_id bigint, pos int, bullet string")
    return b.unionByName(own).where("bullet is not null").withColumn("pos", F.col("pos").cast("bigint"))


def _features(spark, sf_dir) -> DataFrame:
    t = _stuffable(spark, sf_dir)
    rows = F.filter(F.split("raw_text", "\n"), lambda x: F.trim(x, F.lit(" \t\r")) != "")
    base = t.select(
        "resume_id", F.size(F.filter(F.split("raw_text", "[ \t\r\n]+"), lambda w: w != "")).alias("n_words"), F.regexp_count("raw_text", F.lit(r"[^\x00-\x7F]")).alias("n_odd"), F.regexp_count("raw_text", F.lit(r"\b(?:I|me|my|mine|myself)\b")).alias("n_pronouns"),
        F.size(rows).alias("n_rows"), F.size(F.filter(rows, lambda x: F.trim(x, F.lit(" \t\r")).rlike("[^ ] {4,}[^ ]"))).alias("n_gaps"), F.size(F.filter(rows, lambda x: x.rlike(r"\|.*\|"))).alias("n_cells"),
    )
    base = base.withColumn("layout", ((F.col("n_rows") >= 15) & (F.col("n_gaps") > 0.35 * F.col("n_rows"))) | (F.col("n_cells") >= 3)).drop("n_rows", "n_gaps", "n_cells")
    lines = parsing.P.lines(t, "resume_id", "raw_text")
    b = F.when(F.col("is_bullet"), parsing.P.bullet_text(F.col("line")))
    per = lines.groupBy("resume_id").agg(
        F.count_distinct(F.when(F.col("section").isin(*U.STANDARD) & ~F.col("is_blank"), F.col("section"))).alias("n_sections"), F.count(b).alias("n_bullets"), F.count_if(X.word_count(b) > 34).alias("n_long"),
        F.count_if(T.first_word(b).isin(T.STRONG_VERBS)).alias("n_strong"), F.count_if(b.isNotNull() & T.has_metric(b)).alias("n_measured"),
    )
    stuffed = U.stuffing_terms(t, "resume_id", "raw_text").groupBy("resume_id").agg(F.count(F.lit(1)).alias("n_stuffed"))
    r = table(spark, sf_dir, "resumes").select("resume_id", "email", "phone", "linkedin", "file_type", "word_count")
    some = sum((F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in ("email", "phone", "linkedin")), F.lit(0))
    known = r.groupBy("resume_id").agg(F.max(some).alias("n_contact"), F.coalesce(F.max((F.col("file_type") == "pdf") & (F.col("word_count") < 60)), F.lit(False)).alias("image"))
    e = table(spark, sf_dir, "doc_entry").where("section = 'experience'").select("doc_id", "entry", "date_range").distinct()
    jobs = e.groupBy(F.col("doc_id").alias("resume_id")).agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.coalesce("date_range", F.lit("")) != "").alias("n_dated"))
    for other in (per, stuffed, known, jobs):
        base = base.join(other, "resume_id", "left")
    return base.na.fill(0).na.fill(False)


def stuffing_terms(spark, sf_dir):
    """ATS-16: words that a text repeats too often."""
    return U.stuffing_terms(_stuffable(spark, sf_dir), "resume_id", "raw_text")


def quality_checks(spark, sf_dir):
    """ATS-1..12, 16: one row a check that needs no target."""
    return U.checks(_features(spark, sf_dir), "resume_id").select("resume_id", "check_id", "family", "status", F.round(F.col("points") + 1e-9, 6).alias("points"))


def quality_scores(spark, sf_dir):
    """ATS-0 without a target: scores of families and of the whole over thirteen checks, with the band and what failed."""
    s = U.totals(U.checks(_features(spark, sf_dir), "resume_id"), ["resume_id"])
    return s.withColumn("band", U.band(F.round("score", 1)))


def _pair_counts(spark, sf_dir) -> DataFrame:
    m = matching._matches(spark, sf_dir)
    required = F.col("tier") == "required"
    return m.groupBy("doc_id", "target_id").agg(
        F.count_if((F.col("status") == "missing") & (F.col("priority") == "high")).alias("n_blocking"), F.count_if((F.col("status") == "partial") & (F.coalesce("via", F.lit("")) == "")).alias("n_declared"),
        F.count_if(required).alias("n_required"), F.count_if(required & (F.col("status") == "matched")).alias("n_required_matched"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("skill") != "", F.struct("ord", "skill")))), lambda x: x["skill"]), 1, 8).alias("first_keywords"),
    )


def pair_quality_scores(spark, sf_dir, wide=None):
    """ATS-0, 13..15: scores of families and of the whole over all sixteen checks of each pair."""
    w = (wide or scores.wide(spark, sf_dir)).select("doc_id", "target_id", "coverage")
    keys = ["doc_id", "target_id"]
    own = U.target_checks(w.join(_pair_counts(spark, sf_dir), keys), keys)
    base = U.checks(_features(spark, sf_dir), "resume_id").withColumnRenamed("resume_id", "doc_id")
    every = w.select(*keys).join(base, "doc_id").unionByName(own)
    return U.totals(every, keys).withColumn("band", U.band(F.round("score", 1)))


def _section_features(spark, sf_dir, wide=None) -> DataFrame:
    keys = ["doc_id", "target_id"]
    lines = parsing._lines(spark, sf_dir).where("section in ('summary', 'skills')")
    block = lambda s: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("pos", "line")))), lambda x: x["line"]), "\n"), F.lit(" \t\n"))
    blocks = lines.groupBy(F.col("resume_id").alias("doc_id")).agg(block("summary").alias("summary"), block("skills").alias("skills_block"))
    raw = F.coalesce("entry_raw", F.lit(""))
    b = F.coalesce("bullets", F.array().cast("array<string>"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    of = lambda s: F.col("section") == s
    e = scores._entries(spark, sf_dir).groupBy("doc_id").agg(
        F.count_if(of("experience") & filled("date_range")).alias("n_dated"), F.coalesce(F.sum(F.when(of("experience"), F.size(F.filter(b, lambda x: T.first_word(x).isin(T.STRONG_VERBS))))), F.lit(0)).alias("job_strong"),
        F.count_if(of("projects") & (filled("tech_hint") | raw.rlike(U.TOOLS))).alias("projects_tools"), F.count_if(of("projects") & raw.rlike(U.LINK)).alias("projects_linked"),
        F.count_if(of("education") & filled("degree")).alias("n_degree"), F.count_if(of("education") & filled("grad_year")).alias("n_year"),
    )
    terms = table(spark, sf_dir, "parsed_resume").groupBy("doc_id").agg(F.max(F.coalesce(F.size("skill_section_terms"), F.lit(0))).alias("n_terms"))
    x = (wide or scores.wide(spark, sf_dir)).select(*keys, "relevance", "n_jobs", "job_bullets", "job_measured", "n_projects", "project_bullets", "projects_measured", "n_education", "technical", "certs")
    x = x.join(_pair_counts(spark, sf_dir), keys)
    for other in (blocks, e, terms):
        x = x.join(other, "doc_id", "left")
    x = x.na.fill(0).na.fill("")
    low = F.lower("summary")
    x = x.withColumn("n_summary_words", X.word_count(F.regexp_replace("summary", "\n", " "))).withColumn("n_generic", sum((F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in U.GENERIC), F.lit(0)))
    x = x.withColumn("n_named", F.size(F.filter("first_keywords", lambda k: F.contains(low, F.lower(k))))).withColumn("role_named", F.contains(low, F.replace(F.get(F.split("target_id", ":"), F.lit(1)), F.lit("-"), F.lit(" "))))
    return x.withColumn("grouped", F.contains("skills_block", F.lit(":")) | (F.regexp_count("skills_block", F.lit("\n")) >= 3))


def section_checks(spark, sf_dir):
    """SEC-1..6: every check of the five sections of each pair."""
    c = U.section_checks(_section_features(spark, sf_dir), ["doc_id", "target_id"])
    r = F.round(F.col("ratio") + 1e-9, 6)
    return c.select("doc_id", "target_id", "section", "check_id", r.alias("ratio"), F.when(r >= 0.8, "pass").when(r >= 0.4, "warn").otherwise("fail").alias("status"))


def section_scores(spark, sf_dir, wide=None):
    """SEC-0: score, verdict and weakest check of the five sections of each pair, and their mean."""
    keys = ["doc_id", "target_id"]
    return U.section_totals(U.section_checks(_section_features(spark, sf_dir, wide), keys).withColumn("ratio", F.round("ratio", 9)), keys)


def bullet_weakness(spark, sf_dir):
    """RW-3, TXT-11: the six weakest bullets of each résumé."""
    b = _bullets(spark, sf_dir).withColumn("weakness", X.weakness(F.col("bullet")))
    r = b.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("weakness"), "pos")).cast("bigint"))
    return r.where("rank <= 6").select("doc_id", "rank", "pos", "weakness")


def bullet_rewrites(spark, sf_dir):
    """RW-1, 2, 9: rewritten bullets, which never hold a number that the original lacks."""
    b = _bullets(spark, sf_dir).withColumn("a", X.without_filler(F.col("bullet"))).withColumn("b", X.opened(F.col("a"))).withColumn("rewritten", X.completed(F.col("b"), F.col("bullet")))
    return b.select("doc_id", "pos", "rewritten", X.introduces_number(F.col("bullet"), F.col("rewritten")).alias("new_number"), F.md5("bullet").alias("digest"))


def number_screen(spark, sf_dir):
    """RW-9: whether the next bullet would bring a new number."""
    n = F.lead("bullet").over(W.partitionBy("doc_id").orderBy("pos"))
    b = _bullets(spark, sf_dir).withColumn("next", n).where("next is not null")
    return b.select("doc_id", "pos", X.introduces_number(F.col("bullet"), F.col("next")).alias("introduces"))


def blank_strip(spark, sf_dir):
    """BLD-11, 12: bullets without optional prompts, and their required blanks."""
    b = _bullets(spark, sf_dir).withColumn("clean", X.stripped_line(F.col("bullet")))
    return b.where("clean is not null").select("doc_id", "pos", "clean", X.required_blanks(F.col("bullet")).cast("bigint").alias("n_required"))


def line_kinds(spark, sf_dir):
    """BLD-13: kinds of the lines of each text."""
    t = parsing._texts(spark, sf_dir).select("resume_id", F.posexplode(F.split("raw_text", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw", F.lit(" \t\r"))).where("line <> ''")
    first = F.row_number().over(W.partitionBy("resume_id").orderBy("pos"))
    letters = F.regexp_replace("line", "[^A-Za-z]", "")
    kind = (
        F.when(F.col("n") == 1, "name").when((F.col("n") == 2) & F.col("line").rlike(r"(?i)@|\||https?://|\+[0-9]|linkedin|github"), "contact")
        .when((letters != "") & (X.word_count(F.col("line")) <= 6) & (F.upper(letters) == letters) & ~F.col("line").rlike(r"[^\x00-\x7F]"), "heading").when(F.col("line").rlike("^[-•*] "), "bullet").otherwise("text")
    )
    return t.withColumn("n", first).withColumn("kind", kind).groupBy("resume_id", "kind").agg(F.count(F.lit(1)).alias("n_lines"))


GROUPS = {"language": "Languages", "ml": "ML & AI", "web": "Frameworks & Libraries", "data": "Data", "cloud": "Cloud & DevOps", "devops": "Cloud & DevOps", "database": "Databases", "testing": "Tools", "security": "Tools", "cs": "CS Fundamentals"}


def skill_groups(spark, sf_dir):
    """BLD-2, 3: each pair's evidenced skills by group, required ones first."""
    table_ = F.create_map(*[F.lit(x) for p in GROUPS.items() for x in p])
    m = matching._matches(spark, sf_dir).where("status <> 'missing' and skill is not null and coalesce(category, '') <> 'soft'")
    m = m.withColumn("grp", F.coalesce(F.try_element_at(table_, F.col("category")), F.lit("Other")))
    key = F.struct((F.col("tier") != "required").alias("late"), "skill", "ord")
    return m.groupBy("doc_id", "target_id", "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["skill"]), ", ").alias("skills"))


def safe_names(spark, sf_dir):
    """SNK-7, TXT-17: download names and profile addresses."""
    r = table(spark, sf_dir, "resumes").select("resume_id", "candidate_name", "linkedin", "github").distinct()
    return r.select("resume_id", X.safe_file_name(F.coalesce("candidate_name", F.lit("")), "pdf").alias("file"), T.joined(F.filter(F.array(T.clean_url(F.col("linkedin")), T.clean_url(F.col("github"))), lambda x: F.coalesce(x, F.lit("")) != "")).alias("profiles"))


def intent_route(spark, sf_dir):
    """QA-1: what each question asks for."""
    own = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(QUESTIONS)], "item_id bigint, text string")
    q = table(spark, sf_dir, "test_items").select("item_id", "text").distinct().unionByName(own)
    return q.select("item_id", X.intent(F.col("text")).alias("intent"))


def score_answers(spark, sf_dir):
    """QA-2, REC-13: a sentence on each analysis's score."""
    a = table(spark, sf_dir, "resume_analyses").select("analysis_id", "overall_score", "ats_score", "matched_count", "missing_count").distinct()
    low = F.when(F.col("ats_score") < 70, " Formatting comes first.").otherwise("")
    text = F.concat(F.lit("Matched "), F.col("matched_count").cast("string"), F.lit(" of "), (F.col("matched_count") + F.col("missing_count")).cast("string"), F.lit(" skills."), low)
    return a.select("analysis_id", text.alias("answer"))


def missing_bars(spark, sf_dir):
    """REC-12, UI-2: the ten most important missing skills of each pair, with bars scaled to the longest."""
    m = matching._matches(spark, sf_dir).where("status = 'missing' and skill is not null")
    r = m.withColumn("rank", F.row_number().over(W.partitionBy("doc_id", "target_id").orderBy(F.desc("importance"), "ord")).cast("bigint")).where("rank <= 10")
    return r.select("doc_id", "target_id", "rank", "skill", F.round(F.col("importance") / F.max("importance").over(W.partitionBy("doc_id", "target_id")), 6).alias("bar"))


_B = f"b AS (SELECT doc_id, unnest(range(0, len(bullets))) AS pos, unnest(bullets) AS bullet FROM (SELECT DISTINCT doc_id, bullets FROM parsed_resume) UNION ALL SELECT * FROM {Q.values([(-1, i, t) for i, t in enumerate(WEAK_BULLETS)], 'doc_id, pos, bullet')})"
_WC = "len([w FOR w IN regexp_split_to_array({x}, '[ \\t]+') IF w <> ''])"
_FIRST = "lower(regexp_extract({x}, '[A-Za-z]+'))"
_METRIC = "regexp_matches({x}, " + Q.quoted(T.METRIC) + ")"
_RT = "(SELECT DISTINCT resume_id, raw_text FROM resumes WHERE raw_text IS NOT NULL)"
_RTS = f"(SELECT DISTINCT resume_id, raw_text FROM resumes WHERE raw_text IS NOT NULL UNION ALL SELECT * FROM {Q.values(STUFFED, 'resume_id, raw_text')})"
_STUFF = f"""sw AS (SELECT resume_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM (SELECT resume_id, regexp_extract_all(lower(raw_text), '[a-z][a-z+#.]{{2,}}') AS ws FROM {_RTS})),
  sc AS (SELECT resume_id, word, count(*) AS n, min(p) AS first FROM sw GROUP BY ALL), sr AS (SELECT *, n / sum(n) OVER (PARTITION BY resume_id) AS share, row_number() OVER (PARTITION BY resume_id ORDER BY n DESC, first) AS r FROM sc),
  st AS (SELECT resume_id, word, n, round(share, 6) AS share FROM sr WHERE r <= 40 AND n >= 9 AND share > 0.012 AND word NOT IN {Q.listed(U.COMMON)})"""
_TRIM = "trim(x, ' ' || chr(9) || chr(13))"


def _checks(lines: str) -> str:
    """CTEs from `l` (the lines of all texts and the invented ones) to ck, the thirteen checks of each text."""
    rows = [
        ("text_extractable", "parsability", "CASE WHEN n_words > 120 THEN 'pass' ELSE 'fail' END", "CASE WHEN n_words > 120 THEN 10.0 ELSE 0 END", 10),
        ("simple_layout", "parsability", "CASE WHEN layout THEN 'warn' ELSE 'pass' END", "CASE WHEN layout THEN 3.0 ELSE 8 END", 8),
        ("no_image_text", "parsability", "CASE WHEN image THEN 'warn' ELSE 'pass' END", "CASE WHEN image THEN 2.0 ELSE 5 END", 5),
        ("character_set", "parsability", "CASE WHEN n_odd < 25 THEN 'pass' ELSE 'warn' END", "CASE WHEN n_odd < 25 THEN 4.0 ELSE 1.5 END", 4),
        ("contact_block", "structure", "CASE WHEN n_contact >= 2 THEN 'pass' ELSE 'fail' END", "CASE WHEN n_contact >= 2 THEN 4.0 * n_contact ELSE 2 END", 12),
        ("standard_headings", "structure", "CASE WHEN n_sections >= 3 THEN 'pass' WHEN n_sections = 2 THEN 'warn' ELSE 'fail' END", "12.0 * n_sections / 4", 12),
        ("length", "structure", "CASE WHEN n_words BETWEEN 380 AND 950 THEN 'pass' ELSE 'warn' END", "CASE WHEN n_words BETWEEN 380 AND 950 THEN 8.0 WHEN n_words < 380 THEN 4 ELSE 4.5 END", 8),
        ("dates", "structure", "CASE WHEN n_jobs = n_dated THEN 'pass' ELSE 'warn' END", "CASE WHEN n_jobs = 0 THEN 6.0 ELSE 6.0 * n_dated / n_jobs END", 6),
        ("bullets", "content", "CASE WHEN n_bullets = 0 THEN 'fail' WHEN sh > 0.8 THEN 'pass' ELSE 'warn' END", "CASE WHEN n_bullets > 0 THEN 8.0 * sh ELSE 0 END", 8),
        ("action_verbs", "content", "CASE WHEN sv >= 0.6 THEN 'pass' WHEN sv >= 0.3 THEN 'warn' ELSE 'fail' END", "10.0 * least(1, sv / 0.7)", 10),
        ("quantified", "content", "CASE WHEN sm >= 0.4 THEN 'pass' WHEN sm >= 0.2 THEN 'warn' ELSE 'fail' END", "12.0 * least(1, sm / 0.5)", 12),
        ("pronouns", "content", "CASE WHEN n_pronouns <= 3 THEN 'pass' ELSE 'warn' END", "CASE WHEN n_pronouns <= 3 THEN 4.0 ELSE 1.5 END", 4),
        ("keyword_stuffing", "keywords", "CASE WHEN n_stuffed = 0 THEN 'pass' ELSE 'warn' END", "CASE WHEN n_stuffed = 0 THEN 6.0 ELSE 3 END", 6),
    ]
    each = " UNION ALL ".join(f"SELECT resume_id, '{i}' AS check_id, '{f}' AS family, {s} AS status, ({p})::DOUBLE AS points, {m}::DOUBLE AS most FROM fx" for i, f, s, p, m in rows)
    return f"""{_STUFF},
  f0 AS (SELECT resume_id, {_WC.format(x='raw_text').replace('[ ', '[ \\r\\n')} AS n_words, len(regexp_extract_all(raw_text, '[^\\x00-\\x7F]')) AS n_odd, len(regexp_extract_all(raw_text, '\\b(?:I|me|my|mine|myself)\\b')) AS n_pronouns,
    [x FOR x IN string_split(raw_text, chr(10)) IF {_TRIM} <> ''] AS rs FROM {_RTS}),
  f00 AS (SELECT *, (len(rs) >= 15 AND len([x FOR x IN rs IF regexp_matches({_TRIM}, '[^ ] {{4,}}[^ ]')]) > 0.35 * len(rs)) OR len([x FOR x IN rs IF regexp_matches(x, '\\|.*\\|')]) >= 3 AS layout FROM f0),
  lb AS (SELECT *, CASE WHEN is_bullet THEN {parsing._BTEXT} END AS bt FROM {lines}),
  f1 AS (SELECT resume_id, count(DISTINCT CASE WHEN section IN {Q.listed(U.STANDARD)} AND NOT is_blank THEN section END) AS n_sections, count(bt) AS n_bullets, count(*) FILTER ({_WC.format(x='bt')} > 34) AS n_long,
    count(*) FILTER ({_FIRST.format(x='bt')} IN {Q.listed(T.STRONG_VERBS)}) AS n_strong, count(*) FILTER (bt IS NOT NULL AND {_METRIC.format(x='bt')}) AS n_measured FROM lb GROUP BY ALL),
  fk AS (SELECT resume_id, max((coalesce(email, '') <> '')::INT + (coalesce(phone, '') <> '')::INT + (coalesce(linkedin, '') <> '')::INT) AS n_contact, coalesce(bool_or(file_type = 'pdf' AND word_count < 60), false) AS image FROM resumes GROUP BY resume_id),
  fj AS (SELECT doc_id AS resume_id, count(*) AS n_jobs, count(*) FILTER (coalesce(date_range, '') <> '') AS n_dated FROM (SELECT DISTINCT doc_id, entry, date_range FROM doc_entry WHERE section = 'experience') GROUP BY doc_id),
  fx AS (SELECT f00.resume_id, n_words, n_odd, n_pronouns, layout, coalesce(image, false) AS image, coalesce(n_contact, 0) AS n_contact, coalesce(n_jobs, 0) AS n_jobs, coalesce(n_dated, 0) AS n_dated, coalesce(n_sections, 0) AS n_sections, coalesce(n_bullets, 0) AS n_bullets, coalesce(ns, 0) AS n_stuffed,
    CASE WHEN n_bullets > 0 THEN n_strong / n_bullets ELSE 0 END AS sv, CASE WHEN n_bullets > 0 THEN n_measured / n_bullets ELSE 0 END AS sm, 1 - CASE WHEN n_bullets > 0 THEN n_long / n_bullets ELSE 0 END AS sh
    FROM f00 LEFT JOIN f1 USING (resume_id) LEFT JOIN (SELECT resume_id, count(*) AS ns FROM st GROUP BY ALL) USING (resume_id) LEFT JOIN fk USING (resume_id) LEFT JOIN fj USING (resume_id)),
  ck AS ({each})"""


_CHECKS = parsing._SQL_LINES.replace(parsing._TEXTS, _RTS) + ", " + _checks("l")
_GRADES = "CASE WHEN round(score, 1) >= 85 THEN 'ready' WHEN round(score, 1) >= 70 THEN 'mostly compatible' WHEN round(score, 1) >= 55 THEN 'needs work' ELSE 'high risk' END"


def _totals(keys: str, source: str) -> str:
    return f"""tt AS (SELECT {keys}, family, round(100 * sum(points) / sum(most) + 1e-9, 4) AS score, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'fail') AS n_fail,
    coalesce(array_to_string(list(check_id ORDER BY check_id) FILTER (status = 'fail'), '|'), '') AS failures FROM (SELECT * FROM {source} UNION ALL SELECT * REPLACE ('all' AS family) FROM {source}) GROUP BY ALL)
    SELECT *, {_GRADES} AS band FROM tt"""


_PC = """pc AS (SELECT doc_id, target_id, count(*) FILTER (status = 'missing' AND priority = 'high') AS n_blocking, count(*) FILTER (status = 'partial' AND coalesce(via, '') = '') AS n_declared, count(*) FILTER (tier = 'required') AS n_required,
    count(*) FILTER (tier = 'required' AND status = 'matched') AS n_required_matched, coalesce((list(skill ORDER BY ord) FILTER (skill <> ''))[1:8], []) AS fk8 FROM m GROUP BY ALL)"""
# the invented texts have lines too, and only here: their CTEs stand apart from those of the pair
_PAIR_CHECKS = f"cq AS (WITH {_CHECKS} SELECT * FROM ck)"
_SECTION_ROWS = [
    ("summary", "present", "(summary <> '')::INT", 25), ("summary", "length", "CASE WHEN summary = '' THEN 0 WHEN nw BETWEEN 20 AND 70 THEN 1 WHEN nw <= 110 THEN 0.5 ELSE 0.25 END", 20),
    ("summary", "specific", "CASE WHEN ng > 0 OR summary = '' THEN 0 ELSE 1 END", 25), ("summary", "aligned", "CASE WHEN summary = '' THEN 0 ELSE nk / 2 + CASE WHEN rn THEN 0.5 ELSE 0 END END", 30),
    ("skills", "present", "(skills_block <> '')::INT", 20), ("skills", "breadth", "n_terms / 12", 15), ("skills", "grouped", "(contains(skills_block, ':') OR len(string_split(skills_block, chr(10))) >= 4)::INT", 15),
    ("skills", "evidence", "1 - least(1, n_declared / greatest(1, n_required))", 25), ("skills", "covers", "CASE WHEN n_required > 0 THEN n_required_matched / n_required ELSE 0 END", 25),
    ("experience", "present", "(n_jobs > 0)::INT", 20), ("experience", "dated", "CASE WHEN n_jobs > 0 THEN n_dated / n_jobs ELSE 0 END", 15), ("experience", "depth", "CASE WHEN n_jobs > 0 THEN job_bullets / n_jobs / 3 ELSE 0 END", 15),
    ("experience", "verbs", "CASE WHEN job_bullets > 0 THEN job_strong / job_bullets ELSE 0 END", 20), ("experience", "measured", "CASE WHEN job_bullets > 0 THEN 2 * job_measured / job_bullets ELSE 0 END", 20), ("experience", "relevant", "relevance / 0.35", 10),
    ("projects", "present", "(n_projects > 0)::INT", 25), ("projects", "enough", "n_projects / 2", 10), ("projects", "depth", "CASE WHEN n_projects > 0 THEN project_bullets / n_projects / 3 ELSE 0 END", 15),
    ("projects", "tools", "CASE WHEN n_projects > 0 THEN projects_tools / n_projects ELSE 0 END", 20), ("projects", "measured", "CASE WHEN n_projects > 0 THEN projects_measured / n_projects ELSE 0 END", 20), ("projects", "linked", "CASE WHEN n_projects > 0 THEN projects_linked / n_projects ELSE 0 END", 10),
    ("education", "present", "(n_education > 0)::INT", 30), ("education", "degree", "CASE WHEN n_education > 0 THEN n_degree / n_education ELSE 0 END", 20), ("education", "dated", "CASE WHEN n_education > 0 THEN n_year / n_education ELSE 0 END", 15),
    ("education", "field", "technical::INT", 20), ("education", "certificates", "certs / 2", 15),
]


def _block(s: str) -> str:
    return f"coalesce(trim(string_agg(line, chr(10) ORDER BY pos) FILTER (section = '{s}'), ' ' || chr(9) || chr(10)), '')"


_SECTIONS = f"""{scores._WIDE}, {_PC},
  sb AS (SELECT resume_id AS doc_id, {_block('summary')} AS summary, {_block('skills')} AS skills_block FROM l WHERE section IN ('summary', 'skills') GROUP BY resume_id),
  se AS (SELECT doc_id, count(*) FILTER (section = 'experience' AND coalesce(date_range, '') <> '') AS n_dated, coalesce(sum(len([x FOR x IN coalesce(bullets, []) IF {_FIRST.format(x='x')} IN {Q.listed(T.STRONG_VERBS)}])) FILTER (section = 'experience'), 0) AS job_strong,
    count(*) FILTER (section = 'projects' AND (coalesce(tech_hint, '') <> '' OR regexp_matches(coalesce(entry_raw, ''), {Q.quoted(U.TOOLS)}))) AS projects_tools, count(*) FILTER (section = 'projects' AND regexp_matches(coalesce(entry_raw, ''), {Q.quoted(U.LINK)})) AS projects_linked,
    count(*) FILTER (section = 'education' AND coalesce(degree, '') <> '') AS n_degree, count(*) FILTER (section = 'education' AND coalesce(grad_year, '') <> '') AS n_year FROM en GROUP BY doc_id),
  sm AS (SELECT doc_id, max(coalesce(len(skill_section_terms), 0)) AS n_terms FROM parsed_resume GROUP BY doc_id),
  s0 AS (SELECT wd.*, n_declared, n_required, n_required_matched, fk8, coalesce(summary, '') AS summary, coalesce(skills_block, '') AS skills_block, coalesce(n_dated, 0) AS n_dated, coalesce(job_strong, 0) AS job_strong, coalesce(projects_tools, 0) AS projects_tools,
    coalesce(projects_linked, 0) AS projects_linked, coalesce(n_degree, 0) AS n_degree, coalesce(n_year, 0) AS n_year, coalesce(n_terms, 0) AS n_terms FROM wd JOIN pc USING (doc_id, target_id) LEFT JOIN sb USING (doc_id) LEFT JOIN se USING (doc_id) LEFT JOIN sm USING (doc_id)),
  s1 AS (SELECT *, {_WC.format(x="replace(summary, chr(10), ' ')")} AS nw, {' + '.join(f"contains(lower(summary), {Q.quoted(p)})::INT" for p in U.GENERIC)} AS ng, len([k FOR k IN fk8 IF contains(lower(summary), lower(k))]) AS nk,
    contains(lower(summary), replace(split_part(target_id, ':', 2), '-', ' ')) AS rn FROM s0),
  ss AS ({' UNION ALL '.join(f"SELECT doc_id, target_id, '{s}' AS section, {i} AS ord, '{c}' AS check_id, greatest(0, least(1, ({r})))::DOUBLE AS ratio, {m}::DOUBLE AS most FROM s1" for i, (s, c, r, m) in enumerate(_SECTION_ROWS))})"""


def _fill(x: str) -> str:
    e = f"trim({x}, ' ')"
    for p, n in X.FILLERS:
        e = f"regexp_replace({e}, {Q.quoted(p)}, {Q.quoted(n)}, 'g')"
    return f"trim(regexp_replace({e}, '[ \\t]{{2,}}', ' ', 'g'), ' ')"


_CTX = " ".join(f"WHEN regexp_matches(lower(a), {Q.quoted(p)}) AND NOT contains(head, '{s}') THEN '{v}'" for p, v, s in X.CONTEXT)
_UPG = " ".join(f"WHEN fw = '{a}' THEN '{b}'" for a, b in X.UPGRADES.items())
_NUMS = "regexp_extract_all({x}, " + Q.quoted(X.NUMBER) + ")"
_NEWNUM = "len([n FOR n IN " + _NUMS.format(x="{b}") + " IF NOT list_contains(" + _NUMS.format(x="{a}") + ", n)]) > 0"
_BARE = "regexp_replace({x}, '[. ]+$', '')"
_INT = " ".join(f"WHEN regexp_matches(low, {Q.quoted('|'.join(w))}) THEN '{n}'" for n, w in X.INTENTS)

QUERIES = {
    f.__name__: f
    for f in (stuffing_terms, quality_checks, quality_scores, pair_quality_scores, section_checks, section_scores, bullet_weakness, bullet_rewrites, number_screen, blank_strip, line_kinds, skill_groups, safe_names, intent_route, score_answers, missing_bars)
}
SQL = {
    "stuffing_terms": f"WITH {_STUFF} SELECT * FROM st",
    "quality_checks": f"WITH {_CHECKS} SELECT resume_id, check_id, family, status, round(points + 1e-9, 6) AS points FROM ck",
    "quality_scores": f"WITH {_CHECKS}, {_totals('resume_id', 'ck')}",
    "pair_quality_scores": f"""WITH {scores._WIDE}, {_PC}, {_PAIR_CHECKS},
      cp AS (SELECT doc_id, target_id, check_id, family, status, points, most FROM wd JOIN cq ON cq.resume_id = wd.doc_id
        UNION ALL SELECT doc_id, target_id, 'keyword_coverage', 'keywords', CASE WHEN coverage >= 0.5 THEN 'pass' WHEN coverage >= 0.25 THEN 'warn' ELSE 'fail' END, 12 * least(1, coverage / 0.6), 12 FROM wd
        UNION ALL SELECT doc_id, target_id, 'required_skill_terms', 'keywords', CASE WHEN n_blocking = 0 THEN 'pass' WHEN n_blocking <= 2 THEN 'warn' ELSE 'fail' END, greatest(0, 10 - 2.5 * n_blocking), 10 FROM pc
        UNION ALL SELECT doc_id, target_id, 'skill_placement', 'keywords', CASE WHEN n_declared <= 2 THEN 'pass' ELSE 'warn' END, greatest(2, 8 - 1.5 * n_declared), 8 FROM pc), {_totals('doc_id, target_id', 'cp')}""",
    "section_checks": f"WITH {_SECTIONS} SELECT doc_id, target_id, section, check_id, round(ratio + 1e-9, 6) AS ratio, CASE WHEN round(ratio + 1e-9, 6) >= 0.8 THEN 'pass' WHEN round(ratio + 1e-9, 6) >= 0.4 THEN 'warn' ELSE 'fail' END AS status FROM ss",
    "section_scores": f"""WITH {_SECTIONS}, sr2 AS (SELECT * REPLACE (round(ratio, 9) AS ratio) FROM ss), sg AS (SELECT doc_id, target_id, section, 100 * sum(ratio * most) / sum(most) AS s, max(ratio) FILTER (check_id = 'present') AS present FROM sr2 GROUP BY ALL),
      sw2 AS (SELECT doc_id, target_id, section, check_id AS weakest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id, section ORDER BY ratio, ord) AS r FROM sr2 WHERE ratio < 0.8) WHERE r = 1),
      sa2 AS (SELECT doc_id, target_id, 'all' AS section, avg(s) AS s, 1.0 AS present, (list(section ORDER BY round(s, 6), section))[1] AS weakest FROM sg GROUP BY ALL),
      sx AS (SELECT doc_id, target_id, section, s, present, weakest FROM sg LEFT JOIN sw2 USING (doc_id, target_id, section) UNION ALL SELECT * FROM sa2)
      SELECT doc_id, target_id, section, round(s + 1e-9, 4) AS score, CASE WHEN present = 0 THEN 'missing' WHEN round(s + 1e-9, 4) >= 80 THEN 'strong' WHEN round(s + 1e-9, 4) >= 55 THEN 'adequate' ELSE 'weak' END AS verdict, coalesce(weakest, '') AS weakest FROM sx""",
    "bullet_weakness": f"""WITH {_B}, s AS (SELECT doc_id, pos, (CASE WHEN {_FIRST.format(x='bullet')} IN {Q.listed(T.WEAK_OPENERS)} THEN 3 WHEN {_FIRST.format(x='bullet')} NOT IN {Q.listed(T.STRONG_VERBS)} THEN 1.5 ELSE 0 END + CASE WHEN {_METRIC.format(x='bullet')} THEN 0 ELSE 2.5 END
      + CASE WHEN {_WC.format(x='bullet')} > 34 THEN 1 ELSE 0 END + CASE WHEN {_WC.format(x='bullet')} < 8 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(bullet, {Q.quoted(X.ANY_FILLER)}) THEN 1 ELSE 0 END)::DOUBLE AS weakness FROM b WHERE bullet IS NOT NULL)
      SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY weakness DESC, pos) AS rank, pos, weakness FROM s) WHERE rank <= 6""",
    "bullet_rewrites": f"""WITH {_B}, s1 AS (SELECT *, {_fill('bullet')} AS a FROM b WHERE bullet IS NOT NULL), s2 AS (SELECT *, {_FIRST.format(x='a')} AS fw, lower(array_to_string(regexp_split_to_array(regexp_replace(a, '^[^ ]+ ?', ''), ' +')[1:3], ' ')) AS head FROM s1),
      s3 AS (SELECT *, (fw IN {Q.listed(T.WEAK_OPENERS)} OR fw IN {Q.listed(X.UPGRADES)}) AND fw NOT IN {Q.listed(X.SUPPORT)} AS weak, CASE {_CTX} {_UPG} ELSE 'Delivered' END AS verb FROM s2),
      s4 AS (SELECT *, CASE WHEN weak THEN regexp_replace(verb || regexp_replace(a, '^[ \\t]*[A-Za-z0-9_]+', ''), '^([A-Za-z0-9_]+) +(?:on|with|for|in) +', '\\1 ') WHEN fw <> '' AND fw NOT IN {Q.listed(T.STRONG_VERBS)} AND fw NOT IN {Q.listed(X.SUPPORT)} THEN upper(left(a, 1)) || substring(a, 2) ELSE a END AS t FROM s3),
      s5 AS (SELECT *, CASE WHEN NOT regexp_matches(t, '(?i)\\b(?:using|with|in)\\b') AND {_WC.format(x='t')} > 6 AND NOT contains(t, '{X.TOOL_BLANK}') AND NOT regexp_matches(t, '\\[add [^\\]]*\\]') THEN {_BARE.format(x='t')} || ' using {X.TOOL_BLANK}' ELSE t END AS u FROM s4),
      s6 AS (SELECT *, CASE WHEN NOT {_METRIC.format(x='bullet')} AND NOT regexp_matches(u, '\\[add [^\\]]*\\]') THEN {_BARE.format(x='u')} || ', {X.METRIC_PROMPT}' ELSE u END AS v FROM s5),
      s7 AS (SELECT *, CASE WHEN regexp_matches(v, '[.\\]>]$') THEN v ELSE v || '.' END AS rewritten FROM s6)
      SELECT doc_id, pos, rewritten, {_NEWNUM.format(a='bullet', b='rewritten')} AS new_number, md5(bullet) AS digest FROM s7""",
    "number_screen": f"WITH {_B}, n AS (SELECT *, lead(bullet) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM b WHERE bullet IS NOT NULL) SELECT doc_id, pos, {_NEWNUM.format(a='bullet', b='nx')} AS introduces FROM n WHERE nx IS NOT NULL",
    "blank_strip": f"""WITH {_B}, s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(bullet, '(?i)[ \\t]*(?:\\b(?:using|with|via|through)\\b[ \\t]*)?{X.TOOL_BLANK}', '', 'g'), '[ \\t]*\\[[^\\]]*\\]', '', 'g'), '[ ,;:]+(\\.?)$', '\\1'), '[ \\t]+$', '') AS clean FROM b WHERE bullet IS NOT NULL)
      SELECT doc_id, pos, clean, len([x FOR x IN regexp_extract_all(bullet, '<[^>]*>') IF lower(x) <> '{X.TOOL_BLANK}']) AS n_required FROM s WHERE NOT (trim(clean, ' ') IN ('-', '-.', '') AND trim(bullet, ' ') <> '')""",
    "line_kinds": f"""WITH t AS (SELECT resume_id, unnest(range(0, len(string_split(raw_text, chr(10))))) AS pos, trim(unnest(string_split(raw_text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM {_RT}),
      n AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY pos) AS n, regexp_replace(line, '[^A-Za-z]', '', 'g') AS ls FROM t WHERE line <> '')
      SELECT resume_id, CASE WHEN n = 1 THEN 'name' WHEN n = 2 AND regexp_matches(line, '(?i)@|\\||https?://|\\+[0-9]|linkedin|github') THEN 'contact' WHEN ls <> '' AND {_WC.format(x='line')} <= 6 AND upper(ls) = ls AND NOT regexp_matches(line, '[^\\x00-\\x7F]') THEN 'heading'
        WHEN regexp_matches(line, '^[-•*] ') THEN 'bullet' ELSE 'text' END AS kind, count(*) AS n_lines FROM n GROUP BY ALL""",
    "skill_groups": f"""WITH {matching._M}, g AS (SELECT *, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUPS.items())} ELSE 'Other' END AS grp FROM m WHERE status <> 'missing' AND skill IS NOT NULL AND coalesce(category, '') <> 'soft')
      SELECT doc_id, target_id, grp, array_to_string(list(skill ORDER BY tier <> 'required', skill, ord), ', ') AS skills FROM g GROUP BY ALL""",
    "safe_names": """WITH r AS (SELECT DISTINCT resume_id, candidate_name, linkedin, github FROM resumes), n AS (SELECT *, regexp_replace(trim(regexp_replace(coalesce(candidate_name, ''), '[^A-Za-z0-9 _.-]', '', 'g'), ' '), '[ \\t]+', '_', 'g') AS t FROM r), u AS (SELECT *, CASE WHEN t = '' THEN 'document' ELSE left(t, 80) END AS b,
        [x FOR x IN [regexp_replace(regexp_replace(trim(linkedin, ' '), '[).,;]+$', ''), '^https?://', ''), regexp_replace(regexp_replace(trim(github, ' '), '[).,;]+$', ''), '^https?://', '')] IF coalesce(x, '') <> ''] AS ps FROM n)
      SELECT resume_id, CASE WHEN ends_with(lower(b), '.pdf') THEN b ELSE b || '.pdf' END AS file, CASE len(ps) WHEN 0 THEN '' WHEN 1 THEN ps[1] ELSE ps[1] || ' and ' || ps[2] END AS profiles FROM u""",
    "intent_route": f"""WITH q AS (SELECT DISTINCT item_id, text FROM test_items UNION ALL SELECT * FROM {Q.values([(-1 - i, q) for i, q in enumerate(QUESTIONS)], 'item_id, text')}), l AS (SELECT item_id, lower(text) AS low FROM q)
      SELECT item_id, CASE WHEN regexp_matches(low, {Q.quoted(X.UNOWNED)}) AND NOT regexp_matches(low, 'without|instead of|rather than') THEN 'fabricate' {_INT} ELSE 'default' END AS intent FROM l""",
    "score_answers": "SELECT analysis_id, 'Matched ' || matched_count || ' of ' || (matched_count + missing_count) || ' skills.' || CASE WHEN ats_score < 70 THEN ' Formatting comes first.' ELSE '' END AS answer FROM (SELECT DISTINCT analysis_id, overall_score, ats_score, matched_count, missing_count FROM resume_analyses)",
    "missing_bars": f"""WITH {matching._M}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY importance DESC, ord) AS rank FROM m WHERE status = 'missing' AND skill IS NOT NULL)
      SELECT doc_id, target_id, rank, skill, round(importance / max(importance) OVER (PARTITION BY doc_id, target_id), 6) AS bar FROM r WHERE rank <= 10""",
}
