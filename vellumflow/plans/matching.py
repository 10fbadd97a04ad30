"""Queries of extraction, matching, scoring, gaps and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.operators import extract as E
from vellumflow.operators import matching as M
from vellumflow.operators import parse as P
from vellumflow.plans import parsing
from vellumflow.plans import sqltwin as Q
from vellumflow.sources.tables import table

# An own small catalogue: (project_id, difficulty, roles, companies, weeks, teaches).
PROJECTS = [
    ("stream-gauge", "Intermediate", ["data-engineer", "platform-engineer"], ["cindervale"], 6, ["Stream Processing", "Riverbed Streams", "Data Quality"]),
    ("ledger-api", "Beginner", ["backend-developer", "qa-engineer"], ["northloom", "paleridge"], 3, ["REST APIs", "Unit Testing", "SQL"]),
    ("vision-bench", "Advanced", ["ml-engineer"], ["lattermoor"], 9, ["Computer Vision", "Deep Learning", "Model Evaluation"]),
    ("card-board", "Beginner", ["frontend-developer"], [], 3, ["Renderly", "Responsive Design", "Web Accessibility"]),
    ("guard-rail", "Intermediate", ["security-engineer"], ["paleridge"], 5, ["Threat Modelling", "Access Control", "Secure Coding"]),
    ("cost-lens", "Intermediate", ["cloud-engineer", "platform-engineer"], ["northloom"], 5, ["Cost Optimisation", "Monitoring", "Autoscaling"]),
    ("trial-desk", "Intermediate", ["data-analyst", "product-analyst"], ["lattermoor"], 4, ["A/B Testing", "Statistics", "Dashboard Design"]),
    ("pipe-forge", "Advanced", ["data-engineer", "cloud-engineer"], ["cindervale"], 8, ["Infrastructure as Code", "CI/CD", "Containers", "Granary"]),
]
_CATALOGUE = "project_id string, p_ord int, difficulty string, roles array<string>, companies array<string>, weeks int, teaches array<string>"


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, *rest) for n, (i, *rest) in enumerate(PROJECTS)], _CATALOGUE)


def _ontology(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "ontology")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "target_id", "ord", "skill", "category", "importance", "tier", "priority", "status", "credit", "via"]
    return table(spark, sf_dir, "skill_match").select(*cols).distinct()


def _evidence(spark, sf_dir) -> DataFrame:
    lines = P.lines(parsing._texts(spark, sf_dir), "resume_id", "raw_text")
    return E.evidence(E.mentions(lines, "resume_id", _ontology(spark, sf_dir)), "resume_id").withColumnRenamed("resume_id", "doc_id")


def skill_evidence(spark, sf_dir):
    """EXT-1, 2, 3, 5: every skill of every résumé with mentions, sections and confidence."""
    return _evidence(spark, sf_dir)


def skill_profile(spark, sf_dir):
    """EXT-6: each résumé's skills by category."""
    return _evidence(spark, sf_dir).groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n_skills"), F.count_if("applied").alias("n_applied"), F.count_if("declared_only").alias("n_declared"), F.sum("mentions").alias("mentions"))


def related_skills(spark, sf_dir):
    """EXT-7: the skills related to those found, per résumé."""
    e = E.edges(_ontology(spark, sf_dir))
    r = _evidence(spark, sf_dir).select("doc_id", F.col("skill").alias("src")).join(E.bounded(e), "src")
    return r.groupBy("doc_id").agg(F.count_distinct("dst").alias("n_related"), F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("related"))


def alias_canonical(spark, sf_dir):
    """CMP-1: entered skills by their listed name, exact forms only."""
    m = E.canonical(_matches(spark, sf_dir).where("skill <> ''"), "skill", _ontology(spark, sf_dir), "name")
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("skill").alias("n_forms"))


def resolve_credit(spark, sf_dir):
    """JN-1..4: requirements resolved by the résumé's own text, directly or through related skills."""
    req = E.canonical(_matches(spark, sf_dir).where("skill <> ''").select("doc_id", "target_id", "ord", "skill"), "skill", _ontology(spark, sf_dir), "name")
    req = req.select("doc_id", "target_id", F.col("ord").cast("bigint").alias("ord"), F.col("name").alias("skill"))
    return M.resolve(req, _evidence(spark, sf_dir), E.edges(_ontology(spark, sf_dir)))


def extra_skills(spark, sf_dir):
    """JN-5: found skills that no target of the résumé asks for, the surest twenty."""
    asked = _matches(spark, sf_dir).select("doc_id", F.lower("skill").alias("low")).distinct()
    x = _evidence(spark, sf_dir).where("category <> 'soft'").withColumn("low", F.lower("skill")).join(asked, ["doc_id", "low"], "left_anti")
    w = W.partitionBy("doc_id").orderBy(F.desc("confidence"), F.desc("mentions"), "skill")
    return x.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 20").select("doc_id", "rank", "skill")


def skills_component(spark, sf_dir):
    """AGG-1: the skills score of each pair."""
    return M.skills_component(_matches(spark, sf_dir))


def required_coverage(spark, sf_dir):
    """AGG-16: credited share of the required skills."""
    return M.required_coverage(_matches(spark, sf_dir))


def radar_by_category(spark, sf_dir):
    """AGG-14: score of each category of each pair."""
    return M.radar(_matches(spark, sf_dir))


def gap_buckets(spark, sf_dir):
    """AGG-15: gaps by priority."""
    return M.gap_buckets(_matches(spark, sf_dir))


def learn_plan(spark, sf_dir):
    """REC-9: what to learn first, with running weeks."""
    return M.learn_plan(_matches(spark, sf_dir), _ontology(spark, sf_dir))


def roadmap_phases(spark, sf_dir):
    """REC-6, 7, 10: phases with their weeks, in words too."""
    m, o = _matches(spark, sf_dir), _ontology(spark, sf_dir)
    return M.roadmap(m, o, M.rank_projects(m, catalogue(spark), o)).withColumn("duration", M.duration(F.col("weeks")))


def score_projection(spark, sf_dir):
    """REC-8: the skills score after closing gaps."""
    return M.projection(_matches(spark, sf_dir))


def project_rank(spark, sf_dir):
    """REC-1..4, JN-7, CPL-7, 8: the projects that close the most, and why."""
    return M.rank_projects(_matches(spark, sf_dir), catalogue(spark), _ontology(spark, sf_dir))


def projects_alone(spark, sf_dir):
    """REC-5: the recommender that stands alone."""
    return M.recommend_alone(_matches(spark, sf_dir), catalogue(spark), _ontology(spark, sf_dir))


def ref_integrity(spark, sf_dir):
    """Referenced skills that the reference list lacks: edges of the list, and entered skills by how often."""
    o = _ontology(spark, sf_dir)
    e = E.edges(o).select(F.lit("related").alias("origin"), F.col("dst").alias("skill"))
    both = e.unionByName(_matches(spark, sf_dir).where("skill <> ''").select(F.lit("match").alias("origin"), "skill"))
    lost = both.join(E.bounded(o.select("skill")), "skill", "left_anti")
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n_all")).join(lost.groupBy("origin").agg(F.count(F.lit(1)).alias("n_lost"), F.count_distinct("skill").alias("n_names")), "origin", "left").na.fill(0)


_M = "m AS (SELECT DISTINCT doc_id, target_id, ord, skill, category, importance, tier, priority, status, credit, via FROM skill_match)"
_TOKENS = f"[w FOR w IN [regexp_replace(t, '[./]+$', '') FOR t IN regexp_extract_all(replace(line, '-', ' '), {Q.quoted(E.TOKEN)})] IF w <> '']"
_SQ = "lower(regexp_replace(trim({x}, ' '), '[ -]', '', 'g'))"
_WEIGHTS = " ".join(f"WHEN '{s}' THEN {w}" for s, w in E.SECTION_WEIGHT.items())
_LENGTHS = "(SELECT unnest(range(1, 1 + (SELECT max(len(regexp_split_to_array(trim(replace(f, '-', ' '), ' '), ' +'))) FROM (SELECT skill AS f FROM ontology UNION ALL SELECT unnest(aliases) FROM ontology) fs))) AS n)"
_EV = f"""
  {parsing._SQL_LINES},
  w AS (SELECT resume_id, pos, section, {_TOKENS} AS ws FROM l WHERE NOT is_blank),
  r AS (SELECT resume_id, section, unnest(ws) AS form, true AS cased FROM w UNION ALL
        SELECT resume_id, section, lower(array_to_string(ws[i:i + n - 1], '')) AS form, false FROM (SELECT resume_id, section, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, {_LENGTHS} k)),
  sf AS (SELECT DISTINCT * FROM (
    SELECT skill, category, CASE WHEN length(skill) <= 2 OR regexp_matches(skill, '^[.]|[+#]$') THEN skill ELSE {_SQ.format(x='skill')} END AS form, length(skill) <= 2 OR regexp_matches(skill, '^[.]|[+#]$') AS cased FROM ontology
    UNION ALL SELECT skill, category, {_SQ.format(x='a')}, false FROM (SELECT skill, category, unnest(aliases) AS a FROM ontology))),
  mn AS (SELECT resume_id AS doc_id, section, skill, category, count(*) AS n FROM r JOIN sf USING (form, cased) GROUP BY ALL),
  eg AS (SELECT doc_id, skill, category, sum(n) AS total, count(*) AS n_sections, max(CASE section {_WEIGHTS} ELSE 0.5 END)::DOUBLE AS base, bool_or(section IN ('experience', 'projects')) AS applied, bool_and(section = 'skills') AS declared_only FROM mn GROUP BY ALL),
  ev AS (SELECT doc_id, skill, category, least(total, greatest({E.MENTION_CAP}, n_sections))::BIGINT AS mentions, n_sections, applied, declared_only,
    round(least(1, base + least(0.15, 0.04 * (least(total, greatest({E.MENTION_CAP}, n_sections)) - 1)) + CASE WHEN n_sections > 1 THEN 0.08 ELSE 0 END)::DOUBLE, 6) AS confidence FROM eg)
"""
_CANON = "ix AS (SELECT form, arg_min(skill, r * 1000000 + skill_id) AS name FROM (SELECT skill_id, skill, lower(skill) AS form, 0 AS r FROM ontology UNION ALL SELECT skill_id, skill, lower(unnest(aliases)), 1 FROM ontology) GROUP BY form)"
_EDGES = "ed AS (SELECT skill AS src, unnest(related) AS dst, unnest(range(0, len(related))) AS eo FROM ontology)"
_PRI = "CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_CLAMP = "round(greatest(0, least(100, {x})), 4)"

_CLOSING = f"""pj AS (SELECT * FROM {Q.values([(i, n, *rest) for n, (i, *rest) in enumerate(PROJECTS)], 'project_id, p_ord, difficulty, roles, companies, weeks, teaches')}),
  g AS (SELECT *, importance * CASE WHEN status = 'missing' THEN 1.0 ELSE 0.4 END AS weight FROM m WHERE status <> 'matched'), tt AS (SELECT doc_id, target_id, sum(weight) AS total FROM g GROUP BY ALL),
  tu AS (SELECT pt.*, emerging FROM (SELECT * EXCLUDE (teaches), unnest(teaches) AS skill FROM pj) pt LEFT JOIN (SELECT skill, emerging FROM ontology) USING (skill)),
  h AS (SELECT doc_id, target_id, project_id, p_ord, difficulty, roles, companies, weeks, sum(weight) AS closed, count(*) AS n_closed, bool_or(priority = 'high' AND status = 'missing') AS high, bool_or(coalesce(emerging, false)) AS em,
    coalesce(list(skill ORDER BY ord) FILTER (priority = 'high' AND status = 'missing'), []) AS hn, list(skill ORDER BY ord) AS nn FROM g JOIN tu USING (skill) GROUP BY ALL),
  hx AS (SELECT *, closed / total AS cov, list_contains(roles, split_part(target_id, ':', 2)) AS of_role, list_contains(companies, split_part(target_id, ':', 1)) AS of_company FROM h JOIN tt USING (doc_id, target_id))"""
_RANKED = f"""f AS (SELECT *, round(least(1, 0.55 * least(1, 2.5 * cov) + 0.15 * CASE WHEN of_role THEN 1 ELSE 0.35 END + 0.10 * CASE WHEN of_company THEN 1 ELSE 0.4 END + 0.12 * CASE split_part(target_id, ':', 3) || '/' || difficulty {' '.join(f"WHEN '{k}' THEN {v}" for k, v in M.DIFFICULTY.items())} ELSE 0.6 END
    + 0.08 * CASE WHEN em THEN 1 ELSE 0.3 END) + 1e-9, 6)::DOUBLE AS fit, CASE WHEN high THEN 'high' WHEN cov > 0.08 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN len(hn) > 0 THEN 'blocking: ' || array_to_string(hn, ', ') ELSE 'closes: ' || array_to_string(nn[1:4], ', ') END AS rationale FROM hx),
  rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY {_PRI} DESC, fit DESC, p_ord) AS rank FROM f)"""

QUERIES = {
    f.__name__: f
    for f in (skill_evidence, skill_profile, related_skills, alias_canonical, resolve_credit, extra_skills, skills_component, required_coverage, radar_by_category, gap_buckets, learn_plan, roadmap_phases, score_projection, project_rank, projects_alone, ref_integrity)
}
SQL = {
    "skill_evidence": f"WITH {_EV} SELECT * FROM ev",
    "skill_profile": f"WITH {_EV} SELECT doc_id, category, count(*) AS n_skills, count(*) FILTER (applied) AS n_applied, count(*) FILTER (declared_only) AS n_declared, sum(mentions)::BIGINT AS mentions FROM ev GROUP BY ALL",
    "related_skills": f"WITH {_EV}, {_EDGES} SELECT doc_id, count(DISTINCT dst) AS n_related, array_to_string(list_sort(list(DISTINCT dst)), '|') AS related FROM ev JOIN ed ON src = skill GROUP BY ALL",
    "alias_canonical": f"WITH {_M}, {_CANON} SELECT coalesce(name, skill) AS name, count(*) AS n, count(DISTINCT skill) AS n_forms FROM m LEFT JOIN ix ON lower(trim(skill, ' ')) = form WHERE skill <> '' GROUP BY coalesce(name, skill)",
    "resolve_credit": f"""WITH {_EV}, {_M}, {_CANON}, {_EDGES},
      q AS (SELECT doc_id, target_id, ord::BIGINT AS ord, coalesce(name, skill) AS skill FROM m LEFT JOIN ix ON lower(trim(skill, ' ')) = form WHERE skill <> ''),
      d AS (SELECT q.*, ev.applied, ev.declared_only FROM q LEFT JOIN ev ON ev.doc_id = q.doc_id AND lower(ev.skill) = lower(q.skill)),
      aw AS (SELECT doc_id, skill AS have, confidence, mentions FROM ev WHERE applied),
      v1 AS (SELECT d.doc_id, target_id, ord, arg_min(have, eo) AS via FROM d JOIN ed ON lower(src) = lower(d.skill) JOIN aw ON aw.doc_id = d.doc_id AND have = dst WHERE applied IS NULL GROUP BY ALL),
      v2 AS (SELECT doc_id, target_id, ord, have AS via FROM (SELECT d.doc_id, target_id, ord, have, row_number() OVER (PARTITION BY d.doc_id, target_id, ord ORDER BY confidence DESC, mentions DESC, have) AS r FROM d JOIN ed ON dst = d.skill JOIN aw ON aw.doc_id = d.doc_id AND have = src WHERE applied IS NULL) WHERE r = 1)
      SELECT d.doc_id, d.target_id, d.ord, d.skill, CASE WHEN applied OR NOT declared_only THEN 'matched' WHEN declared_only THEN 'partial' WHEN coalesce(v1.via, v2.via) IS NOT NULL THEN 'partial' ELSE 'missing' END AS status,
        CASE WHEN applied THEN 1.0 WHEN applied IS NOT NULL THEN 0.8 WHEN coalesce(v1.via, v2.via) IS NOT NULL THEN 0.35 ELSE 0.0 END::DOUBLE AS credit, CASE WHEN applied IS NULL THEN coalesce(v1.via, v2.via, '') ELSE '' END AS via
      FROM d LEFT JOIN v1 USING (doc_id, target_id, ord) LEFT JOIN v2 USING (doc_id, target_id, ord)""",
    "extra_skills": f"""WITH {_EV}, {_M} SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, mentions DESC, skill) AS rank, skill FROM ev
      WHERE category <> 'soft' AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = ev.doc_id AND lower(m.skill) = lower(ev.skill))) WHERE rank <= 20""",
    "skills_component": f"WITH {_M} SELECT doc_id, target_id, {_CLAMP.format(x='100 * sum(importance * coalesce(credit, 0)) / sum(importance)')} AS score, count(*) FILTER (status = 'matched') AS n_matched, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'missing') AS n_missing FROM m GROUP BY ALL",
    "required_coverage": f"WITH {_M} SELECT doc_id, target_id, round(coalesce(avg(CASE status WHEN 'matched' THEN 1 WHEN 'partial' THEN coalesce(credit, 0) ELSE 0 END) FILTER (tier = 'required'), 1), 6)::DOUBLE AS coverage, count(*) FILTER (tier = 'required') AS n_required FROM m GROUP BY ALL",
    "radar_by_category": f"WITH {_M} SELECT doc_id, target_id, category, round(100 * sum(importance * coalesce(credit, 0)) / sum(importance), 4) AS score, count(*) AS n_skills, count(*) FILTER (status = 'matched') AS n_matched FROM m WHERE category <> '' GROUP BY ALL",
    "gap_buckets": f"""WITH {_M} SELECT doc_id, target_id, {', '.join(f"count(*) FILTER (status = 'missing' AND priority = '{p}') AS missing_{p}" for p in M.PRIORITIES)}, count(*) FILTER (status = 'missing' AND tier = 'optional') AS optional,
      coalesce(array_to_string(list(skill ORDER BY ord) FILTER (status = 'missing' AND priority = 'high' AND skill IS NOT NULL), '|'), '') AS high_names FROM m GROUP BY ALL""",
    "learn_plan": f"""WITH {_M}, g AS (SELECT m.*, CASE WHEN status = 'partial' THEN 1 ELSE coalesce(learn_weeks, 4) END AS weeks FROM m LEFT JOIN ontology USING (skill) WHERE status IN ('missing', 'partial') AND skill IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY {_PRI} DESC, importance DESC, weeks, ord) AS rank FROM g)
      SELECT doc_id, target_id, rank, skill, weeks::BIGINT AS weeks, (sum(weeks) OVER (PARTITION BY doc_id, target_id ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS week_total FROM r WHERE rank <= 12""",
    "roadmap_phases": f"""WITH {_M}, {_CLOSING}, {_RANKED}, g0 AS (SELECT m.*, CASE WHEN status = 'partial' THEN 1 WHEN status = 'missing' AND priority = 'high' THEN 2 WHEN status = 'missing' AND coalesce(emerging, false) THEN 5 WHEN status = 'missing' THEN 4 END AS phase, coalesce(learn_weeks, 4) AS lw FROM m LEFT JOIN ontology USING (skill) WHERE skill IS NOT NULL),
      r AS (SELECT *, CASE WHEN phase = 1 THEN 1 ELSE lw END AS weeks, row_number() OVER (PARTITION BY doc_id, target_id, phase ORDER BY importance DESC, ord) AS rn FROM g0 WHERE phase IS NOT NULL),
      i AS (SELECT doc_id, target_id, phase, weeks FROM r WHERE rn <= CASE phase WHEN 1 THEN 6 WHEN 2 THEN 4 WHEN 4 THEN 5 ELSE 3 END UNION ALL SELECT doc_id, target_id, 3, weeks FROM rk WHERE rank <= 2),
      p AS (SELECT doc_id, target_id, phase, floor(max(weeks) + 0.5 * (sum(weeks) - max(weeks)))::BIGINT AS weeks, count(*) AS n_items FROM i GROUP BY ALL)
      SELECT doc_id, target_id, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY phase) AS number, phase::BIGINT AS phase, weeks, n_items, CASE WHEN weeks < 8 THEN weeks || ' weeks' ELSE 'about ' || round(weeks / 4.345)::INT || ' months' END AS duration FROM p""",
    "score_projection": f"""WITH {_M}, x AS (SELECT *, coalesce(credit, 0) AS c0, CASE WHEN status = 'partial' THEN 1 ELSE coalesce(credit, 0) END AS c1 FROM m)
      SELECT doc_id, target_id, {_CLAMP.format(x='100 * sum(importance * c0) / sum(importance)')} AS score_now, {_CLAMP.format(x='100 * sum(importance * c1) / sum(importance)')} AS score_shown,
      {_CLAMP.format(x="100 * sum(importance * CASE WHEN status = 'missing' AND priority = 'high' THEN 1 ELSE c1 END) / sum(importance)")} AS score_closed FROM x GROUP BY ALL""",
    "project_rank": f"WITH {_M}, {_CLOSING}, {_RANKED} SELECT doc_id, target_id, rank, project_id, fit, priority, n_closed, weeks::BIGINT AS weeks, rationale FROM rk WHERE rank <= 6",
    "projects_alone": f"""WITH {_M}, {_CLOSING}, a AS (SELECT *, round(0.6 * cov + 0.25 * CASE WHEN of_role THEN 1 ELSE 0.4 END + 0.15 * CASE WHEN of_company THEN 1 ELSE 0.4 END + 1e-9, 3)::DOUBLE AS fit FROM hx)
      SELECT doc_id, target_id, rank, project_id, fit, CASE WHEN fit >= 0.5 THEN 'high' ELSE 'medium' END AS priority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY fit DESC, p_ord) AS rank FROM a) WHERE rank <= 6""",
    "ref_integrity": f"""WITH {_M}, b AS (SELECT 'related' AS origin, unnest(related) AS skill FROM ontology UNION ALL SELECT 'match', skill FROM m WHERE skill <> '')
      SELECT origin, count(*) AS n_all, count(*) FILTER (skill NOT IN (SELECT skill FROM ontology)) AS n_lost, count(DISTINCT CASE WHEN skill NOT IN (SELECT skill FROM ontology) THEN skill END) AS n_names FROM b GROUP BY ALL""",
}
