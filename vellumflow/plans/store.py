"""Queries of stored tables: merging deliveries, deleting with children, listings, searches and checks of uploads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.operators import rebuild as B
from vellumflow.operators import requirements as R
from vellumflow.plans import matching, parsing, targets
from vellumflow.plans import sqltwin as Q
from vellumflow.sources.files import upload_problem
from vellumflow.sources.tables import table

FORMATS = ("pdf", "docx", "txt")


def upsert_latest(spark, sf_dir):
    """SNK-3 over a table itself: every résumé's last delivery merged over its first."""
    r = table(spark, sf_dir, "resumes").select("resume_id", "loaded_at", "word_count", "file_type")
    first = r.groupBy("resume_id").agg(F.min_by(F.struct("word_count", "file_type"), "loaded_at").alias("a"), F.min("loaded_at").alias("t0"))
    last = r.groupBy("resume_id").agg(F.max_by(F.struct("word_count", "file_type"), "loaded_at").alias("b"), F.max("loaded_at").alias("t1"), F.count(F.lit(1)).alias("n"))
    m = first.join(last.where("n > 1"), "resume_id", "full")
    return m.select("resume_id", F.coalesce("b.word_count", "a.word_count").cast("bigint").alias("words"), F.coalesce("b.file_type", "a.file_type").alias("file_type"), F.date_format(F.coalesce("t1", "t0"), "yyyy-MM-dd").alias("loaded"), F.coalesce("n", F.lit(1)).alias("n_deliveries"))


def unseen_targets(spark, sf_dir):
    """SNK-4: targets of analyses and of the composed requirements for which no requirement rows are stored, with how often they are asked for."""
    a = table(spark, sf_dir, "resume_analyses").select(F.concat_ws(":", "company_slug", "role_slug", "seniority").alias("target_id"), "analysis_id").distinct()
    composed = R.compose(*targets.reference(spark)).select("target_id", F.lit(None).cast("bigint").alias("analysis_id")).distinct()
    known = table(spark, sf_dir, "skill_match").select("target_id").distinct()
    return a.unionByName(composed).join(known, "target_id", "left_anti").groupBy("target_id").agg(F.count_distinct("analysis_id").alias("n_analyses"))


def cascade_delete(spark, sf_dir):
    """SNK-5: the résumés and analyses that are left once short résumés are deleted with their analyses."""
    r = table(spark, sf_dir, "resumes")
    gone = r.where("word_count < 150").select("resume_id").distinct()
    parents = r.select(F.lit("resume").alias("kind"), "resume_id", F.col("resume_id").alias("id")).distinct()
    children = table(spark, sf_dir, "resume_analyses").select(F.lit("analysis").alias("kind"), "resume_id", F.col("analysis_id").alias("id")).distinct()
    return parents.unionByName(children).join(gone, "resume_id", "left_anti").select("kind", "id", "resume_id")


def recent_reports(spark, sf_dir):
    """QRY-1: the twenty latest analyses."""
    a = table(spark, sf_dir, "resume_analyses").select("analysis_id", "resume_id", "company_slug", "role_slug", "overall_score", "band", "created_at").distinct()
    return a.orderBy(F.desc("created_at"), "analysis_id").limit(20).drop("created_at")


def catalog_search(spark, sf_dir):
    """QRY-2: skills of any category whose name or an alias holds the words, with their aliases."""
    o = table(spark, sf_dir, "ontology")
    hit = F.contains(F.lower("skill"), F.lit("data")) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit("data")))
    return o.where(hit).select("skill_id", "skill", "category", F.array_join("aliases", ", ").alias("aliases"), F.size("related").cast("bigint").alias("n_related"))


def health_counts(spark, sf_dir):
    """QRY-5: rows and keys of each table."""
    keys = {"ontology": "skill_id", "resumes": "resume_id", "parsed_resume": "doc_id", "doc_entry": "doc_id", "resume_analyses": "analysis_id", "skill_match": "doc_id", "documents": "doc_id", "test_items": "item_id"}
    parts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(k).alias("n_keys")).select(F.lit(t).alias("name"), "n_rows", "n_keys") for t, k in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upload_checks(spark, sf_dir):
    """SRC-6: why uploads would be refused."""
    r = table(spark, sf_dir, "resumes").select("resume_id", "file_name", "raw_text").distinct()
    return r.select("resume_id", F.coalesce(upload_problem(F.col("file_name"), F.length(F.coalesce("raw_text", F.lit(""))), FORMATS, 2500), F.lit("")).alias("problem"))


def multi_column(spark, sf_dir):
    """SRC-5: texts that look like several columns."""
    t = parsing._texts(spark, sf_dir).select("resume_id", F.filter(F.split("raw_text", "\n"), lambda x: F.trim(x, F.lit(" \t\r")) != "").alias("ls"))
    gaps = F.size(F.filter("ls", lambda x: F.trim(x, F.lit(" \t\r")).rlike("[^ ] {4,}[^ ]")))
    return t.select("resume_id", F.size("ls").cast("bigint").alias("n_lines"), gaps.cast("bigint").alias("n_gaps"), ((F.size("ls") >= 15) & (gaps > 0.35 * F.size("ls"))).alias("columns"))


def lateness(spark, sf_dir):
    """How many days after their creation résumés are loaded, by file type."""
    r = table(spark, sf_dir, "resumes").select("resume_id", "file_type", F.date_diff(F.col("loaded_at").cast("date"), F.col("created_at").cast("date")).alias("d")).distinct()
    b = F.when(F.col("d") < 1, "same day").when(F.col("d") < 7, "week").when(F.col("d") < 30, "month").otherwise("later")
    return r.groupBy("file_type", b.alias("late")).agg(F.count(F.lit(1)).alias("n"), F.max("d").cast("bigint").alias("most_days"))


def merged_gaps(spark, sf_dir):
    """UI-1: the gap buckets of each pair merged, the first of those equal without case."""
    m = matching._matches(spark, sf_dir).where("skill <> '' and status <> 'matched'")
    bucket = F.when((F.col("status") == "missing") & (F.col("priority") == "high"), 0).when((F.col("status") == "missing") & (F.col("priority") == "medium"), 1).when(F.col("status") == "missing", 2).otherwise(3)
    r = m.withColumn("bucket", bucket).withColumn("r", F.row_number().over(W.partitionBy("doc_id", "target_id", F.lower("skill")).orderBy("bucket", "ord"))).where("r = 1")
    return r.groupBy("doc_id", "target_id", F.col("bucket").cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n_skills"), F.min("ord").cast("bigint").alias("first_ord"))


def target_totals(spark, sf_dir):
    """Documents and credited share of every target; partial sums first, so a hot target is no hot task."""
    m = matching._matches(spark, sf_dir).where("target_id is not null")
    return m.groupBy("target_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.round(F.sum(F.col("importance") * F.coalesce("credit", F.lit(0.0))) / F.sum("importance"), 6).alias("share"))


def rebuild_loop(spark, sf_dir):
    """BLD-1, 6, 10: texts rebuilt from their parts with rewritten bullets, and the skills found before and after."""
    return B.closed_loop(parsing._texts(spark, sf_dir), "resume_id", "raw_text", table(spark, sf_dir, "ontology"))


_TABLES = {"ontology": "skill_id", "resumes": "resume_id", "parsed_resume": "doc_id", "doc_entry": "doc_id", "resume_analyses": "analysis_id", "skill_match": "doc_id", "documents": "doc_id", "test_items": "item_id"}
QUERIES = {f.__name__: f for f in (upsert_latest, unseen_targets, cascade_delete, recent_reports, catalog_search, health_counts, upload_checks, multi_column, lateness, merged_gaps, target_totals, rebuild_loop)}
SQL = {
    "upsert_latest": """SELECT resume_id, arg_max(word_count, loaded_at)::BIGINT AS words, arg_max(file_type, loaded_at) AS file_type, strftime(max(loaded_at), '%Y-%m-%d') AS loaded, count(*) AS n_deliveries FROM resumes GROUP BY ALL""",
    "unseen_targets": f"""WITH {targets._COMPOSED}, a AS (SELECT company_slug || ':' || role_slug || ':' || seniority AS target_id, analysis_id FROM resume_analyses UNION ALL SELECT DISTINCT target_id, NULL FROM co)
      SELECT target_id, count(DISTINCT analysis_id) AS n_analyses FROM a WHERE target_id NOT IN (SELECT target_id FROM skill_match WHERE target_id IS NOT NULL) GROUP BY ALL""",
    "cascade_delete": """SELECT * FROM (SELECT DISTINCT 'resume' AS kind, resume_id AS id, resume_id FROM resumes UNION ALL SELECT DISTINCT 'analysis', analysis_id, resume_id FROM resume_analyses) x WHERE NOT EXISTS (SELECT 1 FROM resumes r WHERE r.resume_id = x.resume_id AND word_count < 150)""",
    "recent_reports": "SELECT analysis_id, resume_id, company_slug, role_slug, overall_score, band FROM (SELECT DISTINCT analysis_id, resume_id, company_slug, role_slug, overall_score, band, created_at FROM resume_analyses) ORDER BY created_at DESC, analysis_id LIMIT 20",
    "catalog_search": "SELECT skill_id, skill, category, array_to_string(aliases, ', ') AS aliases, len(related) AS n_related FROM ontology WHERE contains(lower(skill), 'data') OR len([a FOR a IN aliases IF contains(lower(a), 'data')]) > 0",
    "health_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t}" for t, k in _TABLES.items()),
    "upload_checks": f"""SELECT resume_id, CASE WHEN n = 0 THEN 'empty' WHEN NOT contains(coalesce(file_name, ''), '.') OR lower(regexp_extract(file_name, '[.]([^.]+)$', 1)) NOT IN {Q.listed(FORMATS)} THEN 'format' WHEN n > 2500 THEN 'too large' ELSE '' END AS problem
      FROM (SELECT DISTINCT resume_id, file_name, raw_text, length(coalesce(raw_text, '')) AS n FROM resumes)""",
    "multi_column": """WITH t AS (SELECT resume_id, [x FOR x IN [trim(y, ' ' || chr(9) || chr(13)) FOR y IN string_split(raw_text, chr(10))] IF x <> ''] AS ls FROM (SELECT DISTINCT resume_id, raw_text FROM resumes WHERE raw_text IS NOT NULL)),
      g AS (SELECT resume_id, len(ls) AS n_lines, len([x FOR x IN ls IF regexp_matches(x, '[^ ] {4,}[^ ]')]) AS n_gaps FROM t) SELECT *, n_lines >= 15 AND n_gaps > 0.35 * n_lines AS columns FROM g""",
    "lateness": "SELECT file_type, CASE WHEN d < 1 THEN 'same day' WHEN d < 7 THEN 'week' WHEN d < 30 THEN 'month' ELSE 'later' END AS late, count(*) AS n, max(d) AS most_days FROM (SELECT DISTINCT resume_id, file_type, date_diff('day', created_at::DATE, loaded_at::DATE) AS d FROM resumes) GROUP BY ALL",
    "merged_gaps": f"""WITH {matching._M}, b AS (SELECT *, CASE WHEN status = 'missing' AND priority = 'high' THEN 0 WHEN status = 'missing' AND priority = 'medium' THEN 1 WHEN status = 'missing' THEN 2 ELSE 3 END AS bucket FROM m WHERE skill <> '' AND status <> 'matched'),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id, lower(skill) ORDER BY bucket, ord) AS r FROM b) SELECT doc_id, target_id, bucket::BIGINT AS bucket, count(*) AS n_skills, min(ord)::BIGINT AS first_ord FROM r WHERE r = 1 GROUP BY ALL""",
    "target_totals": f"""WITH {matching._M}, t AS (SELECT target_id, count(DISTINCT doc_id) AS n_docs, round(sum(importance * coalesce(credit, 0)) / sum(importance), 6) AS share FROM m WHERE target_id IS NOT NULL GROUP BY ALL)
      SELECT * FROM t""",
}
