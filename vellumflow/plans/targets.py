"""Queries of requirement composition and of job postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.operators import extract as E
from vellumflow.operators import posting as J
from vellumflow.operators import requirements as R
from vellumflow.plans import sqltwin as Q
from vellumflow.sources.tables import distinct_rows, table

# Own reference rows: small enough to read, with every case of the layers.
ROLES = [
    ("data-engineer", [("SQL", 0.95), ("Python", 0.9), ("ETL", 0.8)], [("Stream Processing", 0.7), ("Monitoring", 0.6)], [("Scala", 0.5)], ["Problem Solving"]),
    ("ml-engineer", [("Python", 0.95), ("Machine Learning", 0.95), ("SQL", 0.6)], [("Model Deployment", 0.75), ("Python", 0.5)], [("Rust", 0.3)], ["Technical Writing", "Problem Solving"]),
    ("qa-engineer", [("Unit Testing", 0.9), ("Test Automation", 0.85)], [("CI/CD", 0.65)], [("Load Testing", 0.55), ("Go", 0.2)], ["Mentoring"]),
]
COMPANIES = [
    ("cindervale", [("SQL", 0.1, "required"), ("Monitoring", 0.15, "required"), ("Go", 0.2, None)]),
    ("lattermoor", [("Python", 0.05, None), ("Privacy Engineering", 0.25, "required"), ("Scala", 0.3, "preferred")]),
    ("northloom", [("CI/CD", 0.35, "required"), ("Model Deployment", 0.3, "preferred")]),
]
OVERRIDES = [
    ("cindervale", "data-engineer", [("Containers", 0.85), ("SQL", 0.7)], [("Data Quality", 0.6), ("Scala", 0.9)]),
    ("northloom", "ml-engineer", [("Model Deployment", 0.99)], [("Rust", 0.2)]),
]
LEVELS = [("intern", 0.8), ("entry", 0.9), ("mid", 1.0), ("senior", 1.1)]
_PAIR = "array<struct<skill string, importance double>>"


def reference(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(ROLES, f"role string, required_skills {_PAIR}, preferred_skills {_PAIR}, optional_skills {_PAIR}, soft_skills array<string>"),
        spark.createDataFrame(COMPANIES, "company string, focus array<struct<skill string, boost double, promote_to string>>"),
        spark.createDataFrame(OVERRIDES, f"company string, role string, extra_required {_PAIR}, extra_preferred {_PAIR}"),
        spark.createDataFrame(LEVELS, "level string, scale double"),
    )


def compose_targets(spark, sf_dir):
    """CMP-2..7, 9, 11, JN-11: requirement rows of every company, role and level."""
    return R.compose(*reference(spark))


def posted_targets(spark, sf_dir):
    """JD-14: each analysis's target with the skills its résumé matches, fused with the composed ones of the same role."""
    m = table(spark, sf_dir, "skill_match").select("target_id", "skill", "importance", "tier").where("skill <> '' and target_id is not null")
    posted = m.groupBy("target_id", F.lower("skill").alias("low")).agg(F.max(F.struct("importance", "skill", "tier")).alias("x")).select("target_id", "x.skill", F.round("x.importance", 3).alias("importance"), "x.tier")
    fused = R.fuse(R.compose(*reference(spark)), posted)
    return fused.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_skills"), F.count_if(F.col("source") == "posting").alias("n_posting"), F.count_if(F.col("tier") == "required").alias("n_required"), F.round(F.sum("importance"), 6).alias("importance"))


def _postings(spark, sf_dir) -> DataFrame:
    return distinct_rows(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), "doc_id")


def domain_gate(spark, sf_dir):
    """JD-2, 3: whether each text is a technical posting."""
    p = _postings(spark, sf_dir)
    return J.domain(p, "doc_id", "text", J.skills_named(p, "doc_id", "text", table(spark, sf_dir, "ontology")))


def posting_blocks(spark, sf_dir):
    """JD-4: lines and bullets of each block of each text."""
    return J.blocks(_postings(spark, sf_dir), "doc_id", "text").groupBy("doc_id", F.col("section").alias("block")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("is_bullet").alias("n_bullets"))


def posting_requirements(spark, sf_dir):
    """JD-5, 6: requirement rows that each text states."""
    b = J.blocks(_postings(spark, sf_dir), "doc_id", "text")
    return J.requirements(E.mentions(b, "doc_id", table(spark, sf_dir, "ontology")), "doc_id")


def posting_facts(spark, sf_dir):
    """JD-1, 9: length gate, level, guessed organisation and role, and degree of each text."""
    t = F.col("text")
    n = F.size(F.filter(F.split(t, "[ \t\r\n]+"), lambda w: w != ""))
    return _postings(spark, sf_dir).select("doc_id", n.cast("bigint").alias("n_words"), (n >= 30).alias("long_enough"), J.level(t).alias("level"), J.organisation(t).alias("organisation"), J.role(t).alias("role"), J.degree(t).alias("degree"), T.years_claimed(t).alias("years"))


def _pairs(rows: list[tuple], at: int, key: str, tier: int) -> str:
    return Q.values([(r[0], s, float(i), tier) for r in rows for s, i in r[at]], f"{key}, skill, importance, t")


_RANK = "CASE {x} WHEN 'required' THEN 3 WHEN 'preferred' THEN 2 WHEN 'optional' THEN 1 ELSE 0 END"
_COMPOSED = f"""
  rl AS (SELECT role, skill, least(1, max(importance)) AS importance, max(t) AS t FROM (
    SELECT * FROM {_pairs(ROLES, 1, 'role', 3)} UNION ALL SELECT * FROM {_pairs(ROLES, 2, 'role', 2)} UNION ALL SELECT * FROM {_pairs(ROLES, 3, 'role', 1)}
    UNION ALL SELECT * FROM {Q.values([(r[0], s, 0.55, 2) for r in ROLES for s in r[4]], 'role, skill, importance, t')}) GROUP BY ALL),
  rs AS (SELECT * FROM {Q.values([(r[0],) for r in ROLES], 'role')}), cs AS (SELECT * FROM {Q.values([(c[0],) for c in COMPANIES], 'company')}),
  fo AS (SELECT company, role, skill, boost, {_RANK.format(x='promote_to')} AS pt FROM {Q.values([(c, s, float(b), p) for c, f in COMPANIES for s, b, p in f], 'company, skill, boost, promote_to')} CROSS JOIN rs),
  ba AS (SELECT company, rl.* FROM cs CROSS JOIN rl),
  l2 AS (SELECT company, role, skill, CASE WHEN boost IS NULL THEN importance WHEN importance IS NOT NULL THEN least(1, importance + boost) ELSE least(1, 0.5 + boost) END AS importance,
    CASE WHEN boost IS NULL THEN t WHEN importance IS NOT NULL THEN greatest(t, pt) WHEN pt > 0 THEN pt ELSE 2 END AS t, CASE WHEN boost IS NULL THEN 'role' ELSE 'company' END AS source FROM ba FULL JOIN fo USING (company, role, skill)),
  ex AS (SELECT company, role, skill, max(i) AS i, max(et) AS et FROM {Q.values([(o[0], o[1], s, float(i), e) for o in OVERRIDES for at, e in ((2, 3), (3, 2)) for s, i in o[at]], 'company, role, skill, i, et')} GROUP BY ALL),
  l3 AS (SELECT company, role, skill, least(1, greatest(importance, i)) AS importance, greatest(t, et) AS t, CASE WHEN i IS NOT NULL AND (et > coalesce(t, 0) OR i > coalesce(importance, 0)) THEN 'override' ELSE source END AS source FROM l2 FULL JOIN ex USING (company, role, skill)),
  l4 AS (SELECT company || ':' || role || ':' || level AS target_id, skill, round(least(1, importance * scale), 3)::DOUBLE AS importance, t, source FROM l3 CROSS JOIN {Q.values(LEVELS, 'level, scale')}),
  co AS (SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY t DESC, importance DESC, lower(skill)) AS ord, skill, importance, CASE t WHEN 3 THEN 'required' WHEN 2 THEN 'preferred' ELSE 'optional' END AS tier, source,
    CASE WHEN importance >= 0.85 THEN 'high' WHEN importance >= 0.65 THEN 'medium' ELSE 'low' END AS priority FROM l4)
"""
from vellumflow.plans.matching import _LENGTHS, _SQ, _TOKENS  # noqa: E402

_P = "p AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"
_SF = f"""sf AS (SELECT DISTINCT * FROM (
    SELECT skill, category, CASE WHEN length(skill) <= 2 OR regexp_matches(skill, '^[.]|[+#]$') THEN skill ELSE {_SQ.format(x='skill')} END AS form, length(skill) <= 2 OR regexp_matches(skill, '^[.]|[+#]$') AS cased FROM ontology
    UNION ALL SELECT skill, category, {_SQ.format(x='a')}, false FROM (SELECT skill, category, unnest(aliases) AS a FROM ontology)))"""


def _mentions(source: str) -> str:
    """CTEs from rows (doc_id, section, line) of a CTE to mn(doc_id, section, skill, category, n)."""
    return f"""
  w AS (SELECT doc_id, section, {_TOKENS} AS ws FROM {source}),
  r AS (SELECT doc_id, section, unnest(ws) AS form, true AS cased FROM w UNION ALL
        SELECT doc_id, section, lower(array_to_string(ws[i:i + n - 1], '')) AS form, false FROM (SELECT doc_id, section, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, {_LENGTHS} k)),
  {_SF}, mn AS (SELECT doc_id, section, skill, category, count(*) AS n FROM r JOIN sf USING (form, cased) GROUP BY ALL)"""


def _signals(terms: list[str]) -> str:
    return "(" + " + ".join(f"least(len(regexp_extract_all(low, '\\b{t}\\b')), {J.CAP})" for t in terms) + ")"


_BLOCKS = f"""{_P}, t AS (SELECT doc_id, {Q.normalised('text')} AS n FROM p),
  l0 AS (SELECT doc_id, unnest(range(0, len(string_split(n, chr(10))))) AS pos, unnest(string_split(n, chr(10))) AS line FROM t),
  l1 AS (SELECT *, lower(trim(trim(line, ' ' || chr(9)), ':')) AS low FROM l0),
  l2 AS (SELECT *, CASE WHEN length(low) BETWEEN 1 AND 60 AND NOT regexp_matches(line, {Q.quoted(J.BULLET)}) AND (regexp_matches(line, {Q.quoted(J.HEADING)}) OR ends_with(trim(line, ' ' || chr(9)), ':')) THEN
    CASE {' '.join(f"WHEN regexp_matches(low, {Q.quoted('|'.join(v))}) THEN '{k}'" for k, v in J.BLOCKS.items())} END END AS h FROM l1),
  b AS (SELECT doc_id, pos, line, section, regexp_matches(line, {Q.quoted(J.BULLET)}) AS is_bullet, trim(line, ' ' || chr(9)) = '' AS is_blank FROM (
    SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'other') AS section FROM l2) WHERE h IS NULL)"""
_YEARS = f"coalesce(list_max([y::DOUBLE FOR y IN regexp_extract_all(text, {Q.quoted(T.YEARS)}, 1)]), 0.0)"

QUERIES = {f.__name__: f for f in (compose_targets, posted_targets, domain_gate, posting_blocks, posting_requirements, posting_facts)}
SQL = {
    "compose_targets": f"WITH {_COMPOSED} SELECT * FROM co",
    "posted_targets": f"""WITH {_COMPOSED}, pm AS (SELECT target_id, lower(skill) AS low, skill, round(importance, 3) AS importance, tier FROM (SELECT *, row_number() OVER (PARTITION BY target_id, lower(skill) ORDER BY importance DESC, skill DESC, tier DESC) AS r FROM skill_match WHERE skill <> '' AND target_id IS NOT NULL) WHERE r = 1),
      f AS (SELECT target_id, CASE WHEN c.skill IS NULL OR pm.importance > c.importance THEN 'posting' ELSE 'curated' END AS source, CASE WHEN c.skill IS NULL OR pm.importance > c.importance THEN pm.tier ELSE c.tier END AS tier, CASE WHEN c.skill IS NULL OR pm.importance > c.importance THEN pm.importance ELSE c.importance END AS importance
        FROM (SELECT *, lower(skill) AS low FROM co) c FULL JOIN pm USING (target_id, low))
      SELECT target_id, count(*) AS n_skills, count(*) FILTER (source = 'posting') AS n_posting, count(*) FILTER (tier = 'required') AS n_required, round(sum(importance), 6) AS importance FROM f GROUP BY ALL""",
    "domain_gate": f"""WITH {_P}, q AS (SELECT doc_id, 'other' AS section, text AS line FROM p), {_mentions('q')}, k AS (SELECT doc_id, count(DISTINCT skill) AS ns FROM mn WHERE category <> 'soft' GROUP BY ALL),
      s AS (SELECT doc_id, {_signals(J.TECH_TERMS)} AS a, {_signals(J.OTHER_TERMS)} AS o, {_signals(J.ANALYST_TERMS)} AS b, {_signals(J.ANALYST_TOOLS)} AS c FROM (SELECT doc_id, lower(text) AS low FROM p)),
      x AS (SELECT s.doc_id, a + CASE WHEN b > 0 AND c > 0 THEN b ELSE 0 END AS n_tech, o AS n_other, coalesce(ns, 0) AS n_skills FROM s LEFT JOIN k USING (doc_id)),
      y AS (SELECT *, NOT (n_skills < 3 AND n_other > n_tech) AS is_tech, least(1, n_skills / 6) AS share, (n_tech - n_other) / 4 AS margin FROM x)
      SELECT doc_id, n_tech::BIGINT AS n_tech, n_other::BIGINT AS n_other, n_skills, is_tech, round(greatest(0, least(100, CASE WHEN is_tech THEN 50 + 35 * share + 15 * least(1, greatest(0, margin)) ELSE 50 + 35 * least(1, -margin) + 15 * (1 - share) END)), 4)::DOUBLE AS confidence FROM y""",
    "posting_blocks": f"WITH {_BLOCKS} SELECT doc_id, section AS block, count(*) AS n_lines, count(*) FILTER (is_bullet) AS n_bullets FROM b GROUP BY ALL",
    "posting_requirements": f"""WITH {_BLOCKS}, bl AS (SELECT * FROM b WHERE NOT is_blank), {_mentions('bl')},
      f AS (SELECT doc_id, skill, CASE section WHEN 'required' THEN 0 WHEN 'preferred' THEN 1 ELSE 2 END AS r, sum(n) AS n FROM mn GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, skill ORDER BY r) AS k FROM f)
      SELECT doc_id, skill, round(least(1, CASE r WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.6 END + least(0.09, 0.03 * (n - 1))), 3)::DOUBLE AS importance, CASE r WHEN 0 THEN 'required' ELSE 'preferred' END AS tier FROM x WHERE k = 1""",
    "posting_facts": f"""WITH {_P}, y AS (SELECT *, lower(text) AS low, {_YEARS} AS years, len([w FOR w IN regexp_split_to_array(text, '[ \\t\\r\\n]+') IF w <> '']) AS n_words FROM p)
      SELECT doc_id, n_words, n_words >= 30 AS long_enough, CASE WHEN regexp_matches(low, 'intern|internship|co-op') THEN 'intern' WHEN regexp_matches(low, 'senior|staff|principal|lead engineer') OR years >= 5 THEN 'senior' WHEN regexp_matches(low, 'entry level|new grad|graduate|junior') OR years <= 1 THEN 'entry' ELSE 'mid' END AS level,
        trim(regexp_extract(text, '\\bat[ \\t]+([A-Z][A-Za-z0-9&.-]+(?:[ \\t]+[A-Z][A-Za-z0-9&.-]+){{0,2}})', 1), ' ') AS organisation,
        trim(regexp_extract(array_to_string(string_split(text, chr(10))[1:6], chr(10)), '\\b((?:Senior|Staff|Lead|Junior)? *[A-Z][A-Za-z]+ +(?:Engineer|Developer|Scientist|Analyst|Architect))\\b', 1), ' ') AS role,
        CASE {' '.join(f"WHEN regexp_matches(text, {Q.quoted(p)}) THEN '{n}'" for n, p in J.DEGREES)} ELSE 'none' END AS degree, years FROM y""",
}
