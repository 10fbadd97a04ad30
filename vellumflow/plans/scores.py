"""Queries of the six component scores, the weighted overall, the document checks of a pair and the fit verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.operators import extract as E
from vellumflow.operators import matching as M
from vellumflow.operators import scores as S
from vellumflow.operators import similarity
from vellumflow.plans import matching, parsing, targets
from vellumflow.plans import sqltwin as Q
from vellumflow.sources.tables import checkpointed, table

PAIR = S.PAIR
LABELS = {"skills": "Skills", "keywords": "Keywords", "experience": "Experience", "projects": "Projects", "education": "Education", "semantic": "Wording"}
METHODS = {
    "skills": "credited share of the importance", "keywords": "share of the target's words that the text holds", "experience": "years, relevance and measured bullets",
    "projects": "skills, depth and results of projects", "education": "degree, field and certificates", "semantic": "blended cosines of text and target",
}
# Own rows of what postings state: role, years, degree, whether an equivalent will do.
POSTINGS = [
    ("data-engineer", 3.0, "none", False), ("ml-engineer", 0.0, "master", True), ("security-engineer", 2.0, "bachelor", False), ("cloud-engineer", 5.0, "none", False),
    ("product-analyst", 0.0, "bachelor", False), ("platform-engineer", 1.0, "phd", False),
]
# Degrees that an education entry shows, the first that fits holds.
HELD_DEGREES = (
    ("phd", r"\bph\.? ?d\b|\bdoctor(?:ate|al)\b"),
    ("master", r"\bmaster\b|\bm\.? ?tech\b|\bm\.? ?sc\b|\bm\.?s\.?\b|\bmba\b|\bm\.?e\.?\b"),
    ("bachelor", r"\bbachelor\b|\bb\.? ?tech\b|\bb\.? ?sc\b|\bb\.?s\.?\b|\bb\.?e\.?\b|\bb\.?c\.?a\b"),
)


def _entries(spark, sf_dir) -> DataFrame:
    cols = ["doc_id", "section", "entry", "duration_months", "date_range", "tech_hint", "degree", "field_of_study", "grad_year", "score", "bullets", "entry_raw", "organisation", "title", "institution", "entry_name"]
    return table(spark, sf_dir, "doc_entry").select(*cols).distinct()


def _parsed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "parsed_resume").select("doc_id", "bullets", "certifications").distinct()


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pair with all inputs and the six scores; written once, for most queries read it twice."""
    texts = parsing._texts(spark, sf_dir).select(F.col("resume_id").alias("doc_id"), F.col("raw_text").alias("text"))
    found = matching._evidence(spark, sf_dir).select("doc_id", "skill")
    return checkpointed(S.components(matching._matches(spark, sf_dir), texts, _entries(spark, sf_dir), _parsed(spark, sf_dir), found, table(spark, sf_dir, "ontology")))


def component_scores(spark, sf_dir):
    """AGG-1..9, CPL-3, 4, CMP-12, JN-6: the six component scores of each pair."""
    return S.component_rows(wide(spark, sf_dir)).select(*PAIR, "component", F.round(F.col("score") + 1e-9, 4).alias("score"))


def weighted_overall(spark, sf_dir):
    """AGG-10, 11, 13, CPL-5: overall of the six components of each pair, its band, the strongest, the weakest by what it weighs, and both in a sentence."""
    rows = S.component_rows(wide(spark, sf_dir))
    order = F.array_position(F.array(*[F.lit(c) for c in S.WEIGHTS]), F.col("component"))
    g = rows.groupBy(*PAIR).agg(
        T.clamp(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("o"),
        F.max_by(F.struct("component", "score"), F.struct(F.round("score", 6), -order)).alias("hi"),
        F.min_by(F.struct("component", "score", "weight"), F.struct(F.round(F.col("score") + (1 - F.col("weight")) * 40, 6), order)).alias("lo"),
    )
    told = F.concat(F.lit("Strongest: "), F.col("hi.component"), F.lit("; most to gain: "), F.col("lo.component"), F.lit(", which weighs "), F.round(100 * F.col("lo.weight")).cast("int").cast("string"), F.lit(" %"))
    o = F.round(F.col("o") + 1e-9, 4)
    return g.select(*PAIR, o.alias("overall"), S.score_band(o).alias("band"), F.col("hi.component").alias("strongest"), F.col("lo.component").alias("weakest"), told.alias("narrative"))


def score_breakdown(spark, sf_dir):
    """AGG-12: what each component adds to the overall, with its weight in percent and its method."""
    rows = S.component_rows(wide(spark, sf_dir))
    label, method = (F.create_map(*[F.lit(x) for p in d.items() for x in p]) for d in (LABELS, METHODS))
    return rows.select(*PAIR, "component", label[F.col("component")].alias("label"), method[F.col("component")].alias("method"), F.round(100 * F.col("weight"), 1).alias("weight_percent"), F.round(F.col("score") * F.col("weight") + 1e-9, 4).alias("contribution"))


def keyword_lists(spark, sf_dir):
    """AGG-3: of each pair's keywords those held, held in part and missing, at most twenty each."""
    listed = table(spark, sf_dir, "ontology").select("skill").distinct()
    keywords = matching._matches(spark, sf_dir).join(E.bounded(listed), "skill", "left_semi").select(*PAIR, "skill").distinct()
    texts = parsing._texts(spark, sf_dir).select(F.col("resume_id").alias("doc_id"), F.col("raw_text").alias("text"))
    held = similarity.held_shares(texts, "doc_id", "text", listed, "skill").where("skill is not null and share >= 0.5")
    k = keywords.join(held, ["doc_id", "skill"], "left")
    some = lambda c: F.array_join(F.slice(F.array_sort(F.collect_list(F.when(c, F.col("skill")))), 1, 20), "|")
    s = F.coalesce("share", F.lit(0.0))
    return k.groupBy(*PAIR).agg(some(s >= 1).alias("present"), some((s >= 0.5) & (s < 1)).alias("partial"), some(s < 0.5).alias("missing"))


def shared_terms(spark, sf_dir):
    """AGG-9, TXT-16: the terms that each résumé shares with its target's text, the longest first."""
    texts = parsing._texts(spark, sf_dir).select(F.col("resume_id").alias("doc_id"), F.col("raw_text").alias("text"))
    m = matching._matches(spark, sf_dir).join(E.bounded(table(spark, sf_dir, "ontology").select("skill").distinct()), "skill", "left_semi")
    left = texts.select("doc_id", F.explode(F.array_distinct(T.content_lemmas(F.col("text")))).alias("term"))
    right = S.target_texts(m).select("target_id", F.explode(F.array_distinct(T.content_lemmas(F.col("text")))).alias("term"))
    both = m.select(*PAIR).distinct().join(E.bounded(right), "target_id").join(left, ["doc_id", "term"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("l"), "term"))), lambda x: x["term"])
    return both.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_shared"), T.joined(F.slice(ordered, 1, 5)).alias("longest"))


def projected_overall(spark, sf_dir):
    """REC-8, 11: the overall of each pair if its named skills were shown and its high gaps closed: only the skills component changes."""
    p = M.projection(matching._matches(spark, sf_dir))
    x = wide(spark, sf_dir).join(p, [*PAIR])
    rest = T.sum_columns([F.lit(w) * F.col(f"s_{c}") for c, w in S.WEIGHTS.items() if c != "skills"])
    of = lambda c: F.round(T.clamp(rest + S.WEIGHTS["skills"] * F.col(c)) + 1e-9, 4)
    return x.select(*PAIR, of("score_now").alias("now"), of("score_shown").alias("shown"), of("score_closed").alias("closed"))


def fit_verdicts(spark, sf_dir, wide_rows=None):
    """FIT-1..8: the five checks, the verdict, its confidence, headline, strengths and next step of each pair, against what postings of the role state."""
    m = matching._matches(spark, sf_dir)
    w = wide_rows or wide(spark, sf_dir)
    g = m.groupBy(*PAIR).agg(
        F.count_if((F.col("status") == "missing") & (F.col("priority") == "high")).alias("n_blocking"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when((F.col("tier") == "required") & (F.col("status") == "matched") & F.col("skill").isNotNull(), F.struct("ord", "skill")))), lambda x: x["skill"]), 1, 6).alias("shown"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("status") == "partial") & (F.coalesce("via", F.lit("")) == "") & F.col("skill").isNotNull(), F.struct("ord", "skill")))), lambda x: x["skill"]).alias("hidden"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("status") == "missing") & (F.col("priority") == "high") & F.col("skill").isNotNull(), F.struct("ord", "skill")))), lambda x: x["skill"]).alias("blocked"),
    )
    blob = F.lower(F.concat_ws(" ", "degree", "field_of_study", "entry_raw"))
    degrees = _entries(spark, sf_dir).where("section = 'education'").groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list(blob)).alias("b"))
    held = F.lit("unspecified")
    for name, pattern in reversed(HELD_DEGREES):
        held = F.when(F.col("b").rlike(pattern), name).otherwise(held)
    degrees = degrees.select("doc_id", held.alias("held"))
    postings = spark.createDataFrame(POSTINGS, "role string, stated double, wanted string, equivalent boolean")
    x = w.withColumn("role", S.part(F.col("target_id"), 1)).join(F.broadcast(postings), "role", "left").na.fill({"stated": 0.0, "wanted": "none", "equivalent": False})
    x = x.join(g, [*PAIR]).join(M.required_coverage(m).withColumnRenamed("coverage", "required"), [*PAIR]).join(degrees, "doc_id", "left").na.fill({"held": "none"})
    c, gap, score = F.col("required"), F.col("stated") - F.col("years"), S.overall(w)
    x = x.withColumn("o", F.round(score + 1e-9, 4))
    coverage = F.when(F.col("n_required") == 0, "pass").when(c < 0.4, "fail").when(c >= 0.65, "pass").otherwise("warn")
    blocking = F.when(F.col("n_blocking") == 0, "pass").when(F.col("n_blocking") >= 3, "fail").otherwise("warn")
    years = F.when(F.col("stated") > 0, F.when(gap >= 2, "fail").when(gap >= 1, "warn").otherwise("pass")).when((F.col("expected") > 0) & (F.col("years") < F.col("expected") - 1), "warn").otherwise("pass")
    degree = F.when(F.col("wanted").isin("master", "phd") & ~F.col("held").isin("master", "phd"), "fail").when((F.col("wanted") == "bachelor") & (F.col("n_education") == 0), "warn").otherwise("pass")
    overall = F.when(F.col("o") >= 70, "pass").when(F.col("o") >= 55, "warn").otherwise("fail")
    x = x.withColumn("c1", coverage).withColumn("c2", blocking).withColumn("c3", years).withColumn("c4", degree).withColumn("c5", overall)
    out = F.when(F.col("c1") == "fail", "required_coverage").when((F.col("c3") == "fail") & (F.col("stated") > 0), "experience").when(F.col("c4") == "fail", "degree")
    n_out = sum((F.when(F.col(k) == "fail", 1).otherwise(0) for k in ("c1", "c3", "c4")), F.lit(0))
    x = x.withColumn("out", out).withColumn("n_out", n_out)
    verdict = F.when(F.col("n_out") > 0, "none").when((c >= 0.8) & (F.col("o") >= 70), "strong").when((c >= 0.65) & (F.col("o") >= 55), "good").when(c >= 0.4, "partial").otherwise("none")
    nearest = F.array_min(F.array(F.abs(c - 0.4), F.abs(c - 0.65), F.abs(c - 0.8)))
    sure = F.when(F.col("n_out") > 0, F.least(F.lit(100.0), 82.0 + 6 * F.col("n_out"))).otherwise(F.least(F.lit(97.0), 50 + 37 * F.least(F.lit(1.0), nearest / 0.2) + 10 * F.least(F.lit(1.0), F.col("n_required") / 8)))
    x = x.withColumn("verdict", verdict)
    headline = (
        F.when(F.col("n_out") > 0, F.concat(F.lit("ruled out by "), F.col("out"))).when(F.col("verdict") == "strong", "apply").when(F.col("verdict") == "good", "worth applying, gaps first")
        .otherwise(F.concat(F.lit("covers "), F.round(100 * c).cast("int").cast("string"), F.lit(" % of what is required")))
    )
    strong = F.filter(F.array(*[F.when(F.col(f"s_{k}") >= 70, F.concat(F.lit(k + " "), F.round(F.col(f"s_{k}") + 1e-9).cast("int").cast("string"))) for k in S.WEIGHTS]), lambda y: y.isNotNull())
    step = (
        F.when(F.col("n_out") > 0, F.concat(F.lit("clear "), F.col("out"))).when(F.col("verdict") == "strong", "apply")
        .when(F.size("hidden") > 0, F.concat(F.lit("show "), F.array_join(F.slice("hidden", 1, 3), ", "))).when(F.size("blocked") > 0, F.concat(F.lit("close "), F.array_join(F.slice("blocked", 1, 3), ", "))).otherwise("strengthen evidence")
    )
    return x.select(
        *PAIR, F.col("c1").alias("coverage_check"), F.col("c2").alias("blocking_check"), F.col("c3").alias("experience_check"), F.col("c4").alias("degree_check"), F.col("c5").alias("score_check"),
        "verdict", F.round(sure + 1e-9, 4).alias("confidence"), headline.alias("headline"), F.array_join(F.slice(F.concat("shown", strong), 1, 8), "|").alias("strengths"), step.alias("next_step"),
    )


def _terms(n: str, source: str, key: str) -> str:
    return f"""{n}c AS ({Q.content_tokens(source, key, 'text')}),
  {n}t AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, lemma AS term FROM {n}c UNION ALL SELECT {key}, a || ' ' || b FROM (SELECT {key}, lemma AS a, lead(lemma) OVER (PARTITION BY {key} ORDER BY pos) AS b FROM {n}c) WHERE b IS NOT NULL) GROUP BY ALL),
  {n}n AS (SELECT {key}, sum(tf * tf) AS sq, count(*) FILTER (NOT contains(term, ' ')) AS n FROM {n}t GROUP BY ALL)"""


def _near(n: str) -> str:
    return f"""{n}f AS (SELECT doc_id, target_id, dot / sqrt((k * a.sq - (k - 1) * sa) * (k * b.sq - (k - 1) * sb)) AS cos, ns / (a.n + b.n - ns) AS jac FROM (
    SELECT kp.doc_id, kp.target_id, sum(d.tf * g.tf) AS dot, sum(d.tf * d.tf) AS sa, sum(g.tf * g.tf) AS sb, count(*) FILTER (NOT contains(term, ' ')) AS ns FROM kp JOIN gt g USING (target_id) JOIN {n}t d USING (doc_id, term) GROUP BY ALL) p
    JOIN {n}n a USING (doc_id) JOIN gn b USING (target_id), (SELECT power(1 + ln(1.5), 2) AS k) c)"""


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {Q.quoted(w)})" for w in words) + ")"


_MET = "regexp_matches({x}, " + Q.quoted(T.METRIC) + ")"
_LEVELS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.EXPECTED_YEARS.items())
_KW = f"""{matching._M}, kw AS (SELECT DISTINCT doc_id, target_id, skill FROM m WHERE skill IN (SELECT skill FROM ontology)), kp AS (SELECT DISTINCT doc_id, target_id FROM kw),
  tx AS (SELECT DISTINCT resume_id AS doc_id, raw_text AS text FROM resumes WHERE raw_text IS NOT NULL), {_terms('x', 'tx', 'doc_id')},
  tl AS (SELECT DISTINCT doc_id, lemma FROM xc), kc AS ({Q.content_tokens("(SELECT DISTINCT skill, skill AS t FROM ontology)", "skill", "t")}), kl AS (SELECT DISTINCT skill, lemma FROM kc),
  kn AS (SELECT o.skill, count(lemma) AS n FROM (SELECT DISTINCT skill FROM ontology) o LEFT JOIN kl USING (skill) GROUP BY ALL), hh AS (SELECT doc_id, skill, count(*) AS hits FROM tl JOIN kl USING (lemma) GROUP BY ALL),
  sh AS (SELECT kw.*, CASE WHEN contains(lower(text), lower(skill)) THEN 1.0 WHEN n > 0 AND coalesce(hits, 0) = n THEN 1.0 WHEN n > 0 AND coalesce(hits, 0) / n >= 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS s
    FROM kw LEFT JOIN tx USING (doc_id) JOIN kn USING (skill) LEFT JOIN hh USING (doc_id, skill)),
  tg AS (SELECT target_id, array_to_string([x FOR x IN [replace(split_part(target_id, ':', 2), '-', ' '), split_part(target_id, ':', 1), array_to_string(list_sort(list(DISTINCT skill)), ', ')] IF x <> ''], ' . ') AS text FROM kw GROUP BY target_id),
  {_terms('g', 'tg', 'target_id')}"""
_ENTRY = "en AS (SELECT DISTINCT doc_id, section, entry, duration_months, date_range, tech_hint, degree, field_of_study, grad_year, score, bullets, entry_raw, organisation, title, institution, entry_name FROM doc_entry)"
_WIDE = f"""{matching._EV}, {_KW}, {matching._EDGES}, {_ENTRY},
  kv AS (SELECT doc_id, target_id, sum(s) / count(*) AS coverage FROM sh GROUP BY ALL),
  jx AS (SELECT doc_id, string_agg(coalesce(entry_raw, ''), chr(10) ORDER BY entry) AS text FROM en WHERE section = 'experience' GROUP BY doc_id), {_terms('j', 'jx', 'doc_id')},
  rl AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS more FROM ev JOIN ed ON src = skill GROUP BY doc_id), wx AS (SELECT doc_id, concat_ws(' ', text, more) AS text FROM tx LEFT JOIN rl USING (doc_id)), {_terms('v', 'wx', 'doc_id')},
  {_near('j')}, {_near('x')}, {_near('v')},
  pm AS (WITH pq AS (SELECT doc_id, section, entry_raw AS line FROM en WHERE section = 'projects' AND entry_raw IS NOT NULL), {targets._mentions('pq')} SELECT DISTINCT doc_id, skill FROM mn),
  ov AS (SELECT doc_id, target_id, sum(CASE WHEN pm.skill IS NOT NULL THEN importance ELSE 0 END) / greatest(1e-6, sum(importance)) AS overlap FROM m LEFT JOIN pm USING (doc_id, skill) GROUP BY ALL),
  ef AS (SELECT doc_id, section, len(coalesce(bullets, [])) AS nb, len([b FOR b IN coalesce(bullets, []) IF {_MET.format(x='b')}]) AS nm, {_MET.format(x="coalesce(entry_raw, '')")} AS measured, duration_months,
    {_any("lower(coalesce(degree, ''))", S.POSTGRADUATE)} AS post, {_any("lower(concat_ws(' ', field_of_study, coalesce(entry_raw, '')))", S.TECHNICAL)} AS technical, coalesce(score, '') <> '' AS scored FROM en),
  eg2 AS (SELECT doc_id, count(*) FILTER (section = 'experience') AS n_jobs, coalesce(sum(duration_months) FILTER (section = 'experience'), 0) AS months, coalesce(sum(nb) FILTER (section = 'experience'), 0) AS job_bullets, coalesce(sum(nm) FILTER (section = 'experience'), 0) AS job_measured,
    count(*) FILTER (section = 'projects') AS n_projects, coalesce(sum(nb) FILTER (section = 'projects'), 0) AS project_bullets, count(*) FILTER (section = 'projects' AND measured) AS projects_measured, count(*) FILTER (section = 'education') AS n_education,
    bool_or(section = 'education' AND post) AS post, bool_or(section = 'education' AND technical) AS technical, bool_or(section = 'education' AND scored) AS scored FROM ef GROUP BY doc_id),
  pr AS (SELECT doc_id, max(len(coalesce(bullets, []))) AS all_bullets, max(len([b FOR b IN coalesce(bullets, []) IF {_MET.format(x='b')}])) AS all_measured, max(coalesce(len(certifications), 0)) AS certs FROM (SELECT DISTINCT doc_id, bullets, certifications FROM parsed_resume) GROUP BY doc_id),
  yc AS (SELECT doc_id, {targets._YEARS} AS claimed FROM tx), sk AS ({matching.SQL['skills_component']}),
  b0 AS (SELECT sk.doc_id, sk.target_id, score AS s_skills, coalesce(coverage, 0) AS coverage, coalesce(overlap, 0) AS overlap, coalesce(jf.cos, 0) AS relevance, coalesce(xf.cos, 0) AS plain, coalesce(xf.jac, 0) AS plain_overlap, coalesce(vf.cos, 0) AS expanded,
    coalesce(n_jobs, 0) AS n_jobs, coalesce(job_bullets, 0) AS job_bullets, coalesce(job_measured, 0) AS job_measured, coalesce(n_projects, 0) AS n_projects, coalesce(project_bullets, 0) AS project_bullets, coalesce(projects_measured, 0) AS projects_measured, coalesce(n_education, 0) AS n_education,
    coalesce(post, false) AS post, coalesce(technical, false) AS technical, coalesce(scored, false) AS scored, coalesce(all_bullets, 0) AS all_bullets, coalesce(all_measured, 0) AS all_measured, coalesce(certs, 0) AS certs,
    round(greatest(coalesce(months, 0) / 12, coalesce(claimed, 0)), 1) AS years, CASE split_part(target_id, ':', 3) {_LEVELS} ELSE 1.0 END::DOUBLE AS expected
    FROM sk LEFT JOIN kv USING (doc_id, target_id) LEFT JOIN ov USING (doc_id, target_id) LEFT JOIN jf USING (doc_id, target_id) LEFT JOIN xf USING (doc_id, target_id) LEFT JOIN vf USING (doc_id, target_id) LEFT JOIN eg2 USING (doc_id) LEFT JOIN pr USING (doc_id) LEFT JOIN yc USING (doc_id)),
  b1 AS (SELECT *, CASE WHEN job_bullets > 0 THEN job_measured / job_bullets WHEN all_bullets > 0 THEN all_measured / all_bullets ELSE 0 END AS measured_share, CASE WHEN expected <= 0 THEN CASE WHEN n_jobs > 0 THEN 100 ELSE 55 END ELSE least(100, 100 * years / expected) END AS duration FROM b0),
  wd AS (SELECT *, greatest(0, least(100, 100 * coverage)) AS s_keywords, greatest(0, least(100, 0.5 * duration + 0.3 * least(100, 100 * relevance / 0.4) + 20 * measured_share)) AS s_experience,
    CASE WHEN n_projects > 0 THEN greatest(0, least(100, 100 * (0.6 * least(1, 3 * overlap) + 0.25 * least(1, project_bullets / (3 * n_projects)) + 0.15 * projects_measured / n_projects))) ELSE 0 END AS s_projects,
    greatest(0, least(100, CASE WHEN n_education > 0 THEN 55 + CASE WHEN post THEN 12 ELSE 0 END + CASE WHEN technical THEN 18 ELSE 0 END + CASE WHEN scored THEN 5 ELSE 0 END ELSE 0 END + least(15, 5 * certs))) AS s_education,
    greatest(0, least(100, 100 * least(1, least(1, 0.6 * expanded + 0.25 * plain + 0.15 * plain_overlap) / {S.NEAR}))) AS s_semantic FROM b1),
  cr AS ({' UNION ALL '.join(f"SELECT doc_id, target_id, '{c}' AS component, {i} AS o, s_{c}::DOUBLE AS score, {w}::DOUBLE AS weight FROM wd" for i, (c, w) in enumerate(S.WEIGHTS.items()))})"""
_OVERALL = "greatest(0, least(100, " + " + ".join(f"{w} * s_{c}" for c, w in S.WEIGHTS.items()) + "))"
_BAND = "CASE WHEN {x} >= 85 THEN 'excellent' WHEN {x} >= 70 THEN 'strong' WHEN {x} >= 55 THEN 'moderate' WHEN {x} >= 40 THEN 'developing' ELSE 'early' END"


def _some(cond: str) -> str:
    return f"coalesce(array_to_string(list(skill ORDER BY skill) FILTER ({cond})[1:20], '|'), '')".replace("list(skill ORDER BY skill) FILTER", "(list(skill ORDER BY skill) FILTER").replace("[1:20]", ")[1:20]")


_REST = " + ".join(f"{w} * s_{c}" for c, w in S.WEIGHTS.items() if c != "skills")
_NAMES = "list(skill ORDER BY ord) FILTER ({c} AND skill IS NOT NULL)"

QUERIES = {f.__name__: f for f in (component_scores, weighted_overall, score_breakdown, keyword_lists, shared_terms, projected_overall, fit_verdicts)}
SQL = {
    "component_scores": f"WITH {_WIDE} SELECT doc_id, target_id, component, round(score + 1e-9, 4) AS score FROM cr",
    "weighted_overall": f"""WITH {_WIDE}, g AS (SELECT doc_id, target_id, round(greatest(0, least(100, sum(score * weight) / sum(weight))) + 1e-9, 4) AS overall FROM cr GROUP BY ALL),
      rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY round(score, 6) DESC, o) AS hi, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY round(score + (1 - weight) * 40, 6), o) AS lo FROM cr)
      SELECT g.doc_id, g.target_id, overall, {_BAND.format(x='overall')} AS band, h.component AS strongest, w.component AS weakest, 'Strongest: ' || h.component || '; most to gain: ' || w.component || ', which weighs ' || round(100 * w.weight)::INT || ' %' AS narrative
      FROM g JOIN rk h ON h.doc_id = g.doc_id AND h.target_id = g.target_id AND h.hi = 1 JOIN rk w ON w.doc_id = g.doc_id AND w.target_id = g.target_id AND w.lo = 1""",
    "score_breakdown": f"""WITH {_WIDE} SELECT doc_id, target_id, component, CASE component {' '.join(f"WHEN '{k}' THEN {Q.quoted(v)}" for k, v in LABELS.items())} END AS label, CASE component {' '.join(f"WHEN '{k}' THEN {Q.quoted(v)}" for k, v in METHODS.items())} END AS method,
      round(100 * weight, 1) AS weight_percent, round(score * weight + 1e-9, 4) AS contribution FROM cr""",
    "keyword_lists": f"WITH {_KW} SELECT doc_id, target_id, {_some('s = 1')} AS present, {_some('s = 0.5')} AS partial, {_some('s = 0')} AS missing FROM sh GROUP BY ALL",
    "shared_terms": f"""WITH {_KW}, st AS (SELECT DISTINCT kp.doc_id, kp.target_id, gc.lemma FROM kp JOIN gc USING (target_id) JOIN tl ON tl.doc_id = kp.doc_id AND tl.lemma = gc.lemma),
      ls AS (SELECT doc_id, target_id, count(*) AS n_shared, (list(lemma ORDER BY length(lemma) DESC, lemma))[1:5] AS t FROM st GROUP BY ALL)
      SELECT doc_id, target_id, n_shared, CASE WHEN len(t) = 1 THEN t[1] ELSE array_to_string(t[1:len(t) - 1], ', ') || ' and ' || t[len(t)] END AS longest FROM ls""",
    "projected_overall": f"""WITH {_WIDE}, sp AS ({matching.SQL['score_projection']}) SELECT doc_id, target_id, {', '.join(f"round(greatest(0, least(100, {_REST} + {S.WEIGHTS['skills']} * score_{c})) + 1e-9, 4) AS {c}" for c in ('now', 'shown', 'closed'))} FROM wd JOIN sp USING (doc_id, target_id)""",
    "fit_verdicts": f"""WITH {_WIDE}, rc AS ({matching.SQL['required_coverage']}),
      ls AS (SELECT doc_id, target_id, count(*) FILTER (status = 'missing' AND priority = 'high') AS n_blocking, coalesce(({_NAMES.format(c="tier = 'required' AND status = 'matched'")})[1:6], []) AS shown, coalesce({_NAMES.format(c="status = 'partial' AND coalesce(via, '') = ''")}, []) AS hidden, coalesce({_NAMES.format(c="status = 'missing' AND priority = 'high'")}, []) AS blocked FROM m GROUP BY ALL),
      dg AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(b, {Q.quoted(p)}) THEN '{n}'" for n, p in HELD_DEGREES)} ELSE 'unspecified' END AS held FROM (SELECT doc_id, string_agg(lower(concat_ws(' ', degree, field_of_study, entry_raw)), chr(10)) AS b FROM en WHERE section = 'education' GROUP BY doc_id)),
      po AS (SELECT * FROM {Q.values(POSTINGS, 'role, stated, wanted, equivalent')}),
      f0 AS (SELECT wd.*, round({_OVERALL} + 1e-9, 4) AS ovl, coalesce(stated, 0) AS stated, coalesce(wanted, 'none') AS wanted, coalesce(held, 'none') AS held, rc.coverage AS required, n_required, n_blocking, shown, hidden, blocked
        FROM wd JOIN rc USING (doc_id, target_id) JOIN ls USING (doc_id, target_id) LEFT JOIN dg USING (doc_id) LEFT JOIN po ON po.role = split_part(target_id, ':', 2)),
      f1 AS (SELECT *, CASE WHEN n_required = 0 THEN 'pass' WHEN required < 0.4 THEN 'fail' WHEN required >= 0.65 THEN 'pass' ELSE 'warn' END AS c1, CASE WHEN n_blocking = 0 THEN 'pass' WHEN n_blocking >= 3 THEN 'fail' ELSE 'warn' END AS c2,
        CASE WHEN stated > 0 THEN CASE WHEN stated - years >= 2 THEN 'fail' WHEN stated - years >= 1 THEN 'warn' ELSE 'pass' END WHEN expected > 0 AND years < expected - 1 THEN 'warn' ELSE 'pass' END AS c3,
        CASE WHEN wanted IN ('master', 'phd') AND held NOT IN ('master', 'phd') THEN 'fail' WHEN wanted = 'bachelor' AND n_education = 0 THEN 'warn' ELSE 'pass' END AS c4, CASE WHEN ovl >= 70 THEN 'pass' WHEN ovl >= 55 THEN 'warn' ELSE 'fail' END AS c5 FROM f0),
      f2 AS (SELECT *, (c1 = 'fail')::INT + (c3 = 'fail')::INT + (c4 = 'fail')::INT AS n_out, CASE WHEN c1 = 'fail' THEN 'required_coverage' WHEN c3 = 'fail' THEN 'experience' WHEN c4 = 'fail' THEN 'degree' END AS ko, least(abs(required - 0.4), abs(required - 0.65), abs(required - 0.8)) AS nearest FROM f1),
      f3 AS (SELECT *, CASE WHEN n_out > 0 THEN 'none' WHEN required >= 0.8 AND ovl >= 70 THEN 'strong' WHEN required >= 0.65 AND ovl >= 55 THEN 'good' WHEN required >= 0.4 THEN 'partial' ELSE 'none' END AS verdict FROM f2)
      SELECT doc_id, target_id, c1 AS coverage_check, c2 AS blocking_check, c3 AS experience_check, c4 AS degree_check, c5 AS score_check, verdict,
        round(CASE WHEN n_out > 0 THEN least(100, 82 + 6 * n_out) ELSE least(97, 50 + 37 * least(1, nearest / 0.2) + 10 * least(1, n_required / 8)) END + 1e-9, 4)::DOUBLE AS confidence,
        CASE WHEN n_out > 0 THEN 'ruled out by ' || ko WHEN verdict = 'strong' THEN 'apply' WHEN verdict = 'good' THEN 'worth applying, gaps first' ELSE 'covers ' || round(100 * required)::INT || ' % of what is required' END AS headline,
        array_to_string(list_concat(shown, [x FOR x IN [{', '.join(f"CASE WHEN s_{c} >= 70 THEN '{c} ' || round(s_{c} + 1e-9)::INT END" for c in S.WEIGHTS)}] IF x IS NOT NULL])[1:8], '|') AS strengths,
        CASE WHEN n_out > 0 THEN 'clear ' || ko WHEN verdict = 'strong' THEN 'apply' WHEN len(hidden) > 0 THEN 'show ' || array_to_string(hidden[1:3], ', ') WHEN len(blocked) > 0 THEN 'close ' || array_to_string(blocked[1:3], ', ') ELSE 'strengthen evidence' END AS next_step FROM f3""",
}
