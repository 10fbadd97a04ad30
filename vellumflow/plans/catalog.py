"""Queries of the catalogue, of claimed skills and of what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.operators import extract as E
from vellumflow.operators import nested
from vellumflow.operators import requirements as R
from vellumflow.operators import scores as S
from vellumflow.plans import matching, parsing, targets
from vellumflow.plans import sqltwin as Q
from vellumflow.sources import sinks
from vellumflow.sources.tables import spread, table

PAIR = ["doc_id", "target_id"]
# Own rows: keywords of roles and of curated pairs, and reference skills to be merged in.
ROLE_KEYWORDS = [("data-engineer", ["Data pipelines", "batch jobs", "Data Quality"]), ("ml-engineer", ["model serving", "feature store", "Model Serving"]), ("qa-engineer", ["regression suite"])]
PAIR_KEYWORDS = [("cindervale", "data-engineer", ["DATA PIPELINES", "late data"]), ("northloom", "ml-engineer", ["drift", "Feature Store"])]
FRESH_SKILLS = [(1, "Python", "language", 5), (2, "Renamed Skill", "tools", 3), (900001, "Brand New Skill", "tools", 2), (900002, "Another New Skill", "data", 6)]
GROUPS = {"language": "Languages", "ml": "ML & AI", "web": "Frameworks & Libraries", "data": "Data", "cloud": "Cloud & DevOps", "devops": "Cloud & DevOps", "database": "Databases", "testing": "Tools", "security": "Tools", "cs": "CS Fundamentals"}
LEAST_WORDS = 40


def requirement_texts(spark, sf_dir):
    """CMP-12: every target's requirement as one text."""
    o = table(spark, sf_dir, "ontology").select("skill").distinct()
    k = matching._matches(spark, sf_dir).join(E.bounded(o), "skill", "left_semi").select("target_id", "skill").distinct()
    return S.target_texts(k)


def requirement_round_trip(spark, sf_dir):
    """CMP-13: composed requirements as JSON and back: the same rows, tiers in order, importance to three places."""
    rows = R.compose(*targets.reference(spark))
    kind = "array<struct<ord:bigint,skill:string,importance:double,tier:string,source:string,priority:string>>"
    as_json = rows.groupBy("target_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ord", "skill", F.round("importance", 3).alias("importance"), "tier", "source", "priority")))).alias("j"))
    return as_json.select("target_id", F.inline(F.from_json("j", kind))).select("target_id", "ord", "skill", "importance", "tier", "source", "priority")


def merged_keywords(spark, sf_dir):
    """CMP-5, 8: keywords of every role and curated pair in one list: the first spelling of those equal without case, in order."""
    roles = spark.createDataFrame(ROLE_KEYWORDS, "role string, words array<string>")
    pairs = spark.createDataFrame(PAIR_KEYWORDS, "company string, role string, more array<string>")
    companies = spark.createDataFrame([(c[0],) for c in targets.COMPANIES], "company string")
    every = companies.crossJoin(F.broadcast(roles)).join(pairs, ["company", "role"], "left").select("company", "role", F.posexplode(F.concat("words", F.coalesce("more", F.array().cast("array<string>")))).alias("i", "word"))
    first = every.withColumn("n", F.row_number().over(W.partitionBy("company", "role", F.lower("word")).orderBy("i"))).where("n = 1")
    return first.groupBy("company", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), "|").alias("keywords"))


def target_errors(spark, sf_dir):
    """CMP-10: targets of analyses that name an unknown organisation or role; an unknown level is entry in silence."""
    a = table(spark, sf_dir, "resume_analyses").select("company_slug", "role_slug", "seniority").distinct()
    known = lambda rows: [r[0] for r in rows]
    problem = F.when(F.col("role_slug").isNull() | ~F.col("role_slug").isin(known(targets.ROLES)), "role").when(F.col("company_slug").isNull() | ~F.col("company_slug").isin(known(targets.COMPANIES)), "company").otherwise("")
    level = F.when(F.col("seniority").isin(known(targets.LEVELS)), F.col("seniority")).otherwise("entry")
    return a.select("company_slug", "role_slug", "seniority", problem.alias("problem"), level.alias("level")).distinct()


def catalog_lists(spark, sf_dir):
    """CMP-14, QRY-3: what can be chosen: organisations with their curated roles, roles with their first six skills, levels, categories, projects and the method of scoring."""
    roles, companies, overrides, levels = targets.reference(spark)
    row = lambda df, kind, name, detail: df.select(F.lit(kind).alias("kind"), name.alias("name"), detail.cast("string").alias("detail"))
    curated = companies.select("company").join(overrides.select("company", "role"), "company", "left").groupBy("company").agg(F.array_join(F.sort_array(F.collect_list("role")), "|").alias("d"))
    core = roles.select("role", F.array_join(F.slice(F.transform(F.concat("required_skills", "preferred_skills"), lambda x: x["skill"]), 1, 6), "|").alias("d"))
    skills = table(spark, sf_dir, "ontology").groupBy("category").agg(F.count(F.lit(1)).alias("d"))
    weights = spark.createDataFrame(list(S.WEIGHTS.items()), "component string, weight double")
    parts = [
        row(curated, "organisation", F.col("company"), F.col("d")), row(core, "role", F.col("role"), F.col("d")), row(levels, "level", F.col("level"), F.round(100 * F.col("scale")).cast("int")), row(skills, "category", F.col("category"), F.col("d")),
        row(matching.catalogue(spark), "project", F.col("project_id"), F.col("difficulty")), row(weights, "weight", F.col("component"), F.round(100 * F.col("weight")).cast("int")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ticked(spark, sf_dir) -> DataFrame:
    """doc_id, low: what a résumé's owner ticks: here the elements of its skill section."""
    return table(spark, sf_dir, "parsed_resume").select("doc_id", F.explode("skill_section_terms").alias("t")).select("doc_id", F.lower(F.trim("t")).alias("low")).distinct()


def consent_skills(spark, sf_dir):
    """BLD-2, JN-8: the missing required and preferred skills that are added to each pair: those ticked, or all of them; unknown modes are the first."""
    m = matching._matches(spark, sf_dir).where("status = 'missing' and tier in ('required', 'preferred') and skill <> ''").withColumn("low", F.lower("skill"))
    names = F.array_join(F.array_sort(F.collect_set("skill")), "|")
    every = m.groupBy(*PAIR).agg(names.alias("skills")).withColumn("mode", F.lit("auto_add"))
    ticked = m.join(_ticked(spark, sf_dir), ["doc_id", "low"], "left_semi").groupBy(*PAIR).agg(names.alias("skills")).withColumn("mode", F.lit("confirmed"))
    return every.unionByName(ticked)


def claim_errors(spark, sf_dir):
    """JN-9: ticked skills that no target of the résumé lists: claims to be refused."""
    asked = matching._matches(spark, sf_dir).where("skill <> ''").select("doc_id", F.lower("skill").alias("low")).distinct()
    known = asked.select("doc_id").distinct()
    return _ticked(spark, sf_dir).where("low <> ''").join(known, "doc_id", "left_semi").join(asked, ["doc_id", "low"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refused"), F.min("low").alias("first"))


def rebuilt_groups(spark, sf_dir):
    """BLD-3, CPL-9: each résumé's skills for its rebuilt form: those its text shows (without soft ones) in eight groups, required ones first, and up to twelve entered terms that no entry lists."""
    o = table(spark, sf_dir, "ontology")
    found = matching._evidence(spark, sf_dir).where("category <> 'soft'").select("doc_id", "skill", "category")
    need = matching._matches(spark, sf_dir).where("tier = 'required'").select("doc_id", "skill").distinct().withColumn("need", F.lit(1))
    group = F.create_map(*[F.lit(x) for p in GROUPS.items() for x in p])
    rows = found.join(need, ["doc_id", "skill"], "left").select("doc_id", F.coalesce(F.try_element_at(group, F.col("category")), F.lit("Tools")).alias("grp"), F.when(F.col("need") == 1, 0).otherwise(1).alias("late"), "skill")
    forms = o.select(F.lower("skill").alias("low")).unionByName(o.select(F.explode("aliases").alias("a")).select(F.lower("a").alias("low"))).distinct()
    terms = table(spark, sf_dir, "parsed_resume").select("doc_id", F.posexplode("skill_section_terms").alias("i", "skill")).withColumn("low", F.lower(F.trim("skill"))).where("low <> ''").groupBy("doc_id", "low").agg(F.min(F.struct("i", F.trim("skill").alias("skill"))).alias("x"))
    other = terms.join(E.bounded(forms), "low", "left_anti").withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("x.i"))).where("r <= 12").select("doc_id", F.lit("Other").alias("grp"), F.lit(1).alias("late"), F.col("x.skill").alias("skill"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("late", "skill"))), lambda x: x["skill"]), ", ")
    return rows.unionByName(other).groupBy("doc_id", "grp").agg(names.alias("skills"))


def seed_upsert(spark, sf_dir):
    """SNK-3: fresh reference skills merged over the stored ones by key."""
    stored = table(spark, sf_dir, "ontology").select("skill_id", "skill", "category", F.col("learn_weeks").cast("int").alias("learn_weeks"))
    return sinks.merged(stored, spark.createDataFrame(FRESH_SKILLS, "skill_id bigint, skill string, category string, learn_weeks int"), ["skill_id"])


def stored_children(spark, sf_dir):
    """SNK-1, 2: the rows that storing every analysis of a résumé would write for its suggestions: high priority by tag, texts cut."""
    a = spread(table(spark, sf_dir, "resume_analyses").where("resume_id is not null").select("analysis_id", "payload"))
    flat = nested.flatten(a, "analysis_id", "payload", nested.array_paths(a, "payload"), with_values=True)
    f = flat.where(F.col("path").rlike("^ai_suggestions/sections/[^/]+$"))
    field = lambda name: F.try_element_at(F.filter("fields", lambda x: x["key"] == name), F.lit(1))["value"]
    rows = f.select(F.col("record_id").alias("analysis_id"), "node", F.element_at(F.split("path", "/"), -1).alias("section"), field("tags").alias("tags"), field("suggested").alias("suggested")).distinct()
    return sinks.suggestion_rows(rows).groupBy("analysis_id", "section").agg(F.count(F.lit(1)).alias("n_suggestions"), F.count_if(F.col("priority") == "high").alias("n_high"), F.max(F.length("text")).cast("bigint").alias("longest"))


def pasted_texts(spark, sf_dir):
    """SRC-7: whether each text is long enough to be taken as pasted."""
    n = F.size(F.filter(F.split("raw_text", "[ \t\r\n]+"), lambda w: w != ""))
    return parsing._texts(spark, sf_dir).select("resume_id", n.cast("bigint").alias("n_words"), (n >= LEAST_WORDS).alias("accepted"))


def resume_lookup(spark, sf_dir, resume_id: int = 7):
    """SRC-8: one résumé by its key; the filter reaches the scan."""
    return table(spark, sf_dir, "resumes").where(F.col("resume_id") == resume_id).select("resume_id", "file_name", "file_type", "word_count").distinct()


_TICK = "tk AS (SELECT DISTINCT doc_id, lower(trim(t, ' ')) AS low FROM (SELECT doc_id, unnest(skill_section_terms) AS t FROM parsed_resume) WHERE t IS NOT NULL)"
_KEYWORDS = [(c[0], r, i, w) for c in targets.COMPANIES for r, ws in ROLE_KEYWORDS for i, w in enumerate([*ws, *next((m for x, y, m in PAIR_KEYWORDS if (x, y) == (c[0], r)), [])])]
_CATALOG = (
    [("organisation", c[0], "|".join(sorted(o[1] for o in targets.OVERRIDES if o[0] == c[0]))) for c in targets.COMPANIES]
    + [("role", r[0], "|".join([s for s, _ in [*r[1], *r[2]]][:6])) for r in targets.ROLES]
    + [("level", n, str(round(100 * s))) for n, s in targets.LEVELS]
    + [("project", p[0], p[1]) for p in matching.PROJECTS]
    + [("weight", c, str(round(100 * w))) for c, w in S.WEIGHTS.items()]
)

QUERIES = {
    f.__name__: f
    for f in (requirement_texts, requirement_round_trip, merged_keywords, target_errors, catalog_lists, consent_skills, claim_errors, rebuilt_groups, seed_upsert, stored_children, pasted_texts, resume_lookup)
}
SQL = {
    "requirement_texts": f"""WITH {matching._M}, kw AS (SELECT DISTINCT target_id, skill FROM m WHERE skill IN (SELECT skill FROM ontology))
      SELECT target_id, array_to_string([x FOR x IN [replace(split_part(target_id, ':', 2), '-', ' '), split_part(target_id, ':', 1), array_to_string(list_sort(list(DISTINCT skill)), ', ')] IF x <> ''], ' . ') AS text FROM kw GROUP BY target_id""",
    "requirement_round_trip": targets.SQL["compose_targets"],
    "merged_keywords": f"""WITH k AS (SELECT * FROM {Q.values(_KEYWORDS, 'company, role, i, word')}), f AS (SELECT *, row_number() OVER (PARTITION BY company, role, lower(word) ORDER BY i) AS n FROM k)
      SELECT company, role, array_to_string(list(word ORDER BY i), '|') AS keywords FROM f WHERE n = 1 GROUP BY ALL""",
    "target_errors": f"""SELECT DISTINCT company_slug, role_slug, seniority, CASE WHEN role_slug IS NULL OR role_slug NOT IN {Q.listed([r[0] for r in targets.ROLES])} THEN 'role' WHEN company_slug IS NULL OR company_slug NOT IN {Q.listed([c[0] for c in targets.COMPANIES])} THEN 'company' ELSE '' END AS problem,
      CASE WHEN seniority IN {Q.listed([x[0] for x in targets.LEVELS])} THEN seniority ELSE 'entry' END AS level FROM resume_analyses""",
    "catalog_lists": f"SELECT * FROM {Q.values(_CATALOG, 'kind, name, detail')} UNION ALL SELECT 'category', category, count(*)::VARCHAR FROM ontology GROUP BY category",
    "consent_skills": f"""WITH {matching._M}, {_TICK}, x AS (SELECT *, lower(skill) AS low FROM m WHERE status = 'missing' AND tier IN ('required', 'preferred') AND skill <> '')
      SELECT doc_id, target_id, array_to_string(list_sort(list(DISTINCT skill)), '|') AS skills, 'auto_add' AS mode FROM x GROUP BY ALL UNION ALL SELECT doc_id, target_id, array_to_string(list_sort(list(DISTINCT skill)), '|'), 'confirmed' FROM x SEMI JOIN tk USING (doc_id, low) GROUP BY ALL""",
    "claim_errors": f"""WITH {matching._M}, {_TICK}, a AS (SELECT DISTINCT doc_id, lower(skill) AS low FROM m WHERE skill <> '')
      SELECT doc_id, count(*) AS n_refused, min(low) AS first FROM tk ANTI JOIN a USING (doc_id, low) WHERE low <> '' AND doc_id IN (SELECT doc_id FROM a) GROUP BY doc_id""",
    "rebuilt_groups": f"""WITH {matching._EV}, {matching._M}, nd AS (SELECT DISTINCT doc_id, skill FROM m WHERE tier = 'required'), fo AS (SELECT lower(skill) AS low FROM ontology UNION SELECT lower(unnest(aliases)) FROM ontology),
      te AS (SELECT doc_id, lower(trim(t, ' ')) AS low, min(i) AS i, arg_min(trim(t, ' '), i) AS skill FROM (SELECT doc_id, unnest(range(0, len(skill_section_terms))) AS i, unnest(skill_section_terms) AS t FROM parsed_resume) WHERE trim(t, ' ') <> '' GROUP BY ALL),
      xo AS (SELECT doc_id, 'Other' AS grp, 1 AS late, skill FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM te ANTI JOIN fo USING (low)) WHERE r <= 12),
      xa AS (SELECT ev.doc_id, CASE category {' '.join(f"WHEN '{k}' THEN {Q.quoted(v)}" for k, v in GROUPS.items())} ELSE 'Tools' END AS grp, CASE WHEN nd.skill IS NOT NULL THEN 0 ELSE 1 END AS late, ev.skill FROM ev LEFT JOIN nd ON nd.doc_id = ev.doc_id AND nd.skill = ev.skill WHERE category <> 'soft')
      SELECT doc_id, grp, array_to_string(list(skill ORDER BY late, skill), ', ') AS skills FROM (SELECT * FROM xa UNION ALL SELECT * FROM xo) GROUP BY ALL""",
    "seed_upsert": f"""WITH f AS (SELECT * FROM {Q.values(FRESH_SKILLS, 'skill_id, f_skill, f_category, f_weeks')}) SELECT coalesce(f.skill_id, o.skill_id)::BIGINT AS skill_id, coalesce(f_skill, skill) AS skill, coalesce(f_category, category) AS category, coalesce(f_weeks, learn_weeks)::INT AS learn_weeks,
      CASE WHEN f.skill_id IS NULL THEN 'kept' WHEN o.skill_id IS NULL THEN 'inserted' WHEN f_skill = skill AND f_category = category AND f_weeks = learn_weeks THEN 'same' ELSE 'updated' END AS origin FROM ontology o FULL JOIN f ON f.skill_id = o.skill_id""",
    "pasted_texts": f"SELECT resume_id, len([w FOR w IN regexp_split_to_array(raw_text, '[ \\t\\r\\n]+') IF w <> '']) AS n_words, len([w FOR w IN regexp_split_to_array(raw_text, '[ \\t\\r\\n]+') IF w <> '']) >= {LEAST_WORDS} AS accepted FROM {parsing._TEXTS}",
    "resume_lookup": "SELECT DISTINCT resume_id, file_name, file_type, word_count FROM resumes WHERE resume_id = 7",
}
