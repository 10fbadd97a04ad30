"""Rule rows and their totals: every check is one row of a long table, every score an aggregate over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions import text as T

STANDARD = ("skills", "experience", "education", "projects")
COMMON = ("and", "the", "with", "for", "data")
BANDS = ((85, "ready"), (70, "mostly compatible"), (55, "needs work"))


def band(score: Column, steps=BANDS, lowest: str = "high risk") -> Column:
    out = F.lit(lowest)
    for least, name in reversed(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def status(ok: Column, warn: Column | None = None) -> Column:
    return F.when(ok, "pass").when(warn, "warn").otherwise("fail") if warn is not None else F.when(ok, "pass").otherwise("warn")


def stuffing_terms(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, word, n, share: of a text's forty commonest words those that stand nine times and in 1.2 % of its words."""
    w = df.select(key, F.posexplode(F.regexp_extract_all(F.lower(column), F.lit("[a-z][a-z+#.]{2,}"), F.lit(0))).alias("p", "word"))
    c = w.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))
    total = F.sum("n").over(W.partitionBy(key))
    r = c.withColumn("share", F.col("n") / total).withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first")))
    return r.where((F.col("r") <= 40) & (F.col("n") >= 9) & (F.col("share") > 0.012) & ~F.col("word").isin(*COMMON)).select(key, "word", "n", F.round("share", 6).alias("share"))


def checks(features: DataFrame, key: str) -> DataFrame:
    """key, check_id, family, status, points, most of the thirteen checks that need no target.

    features: n_words, n_odd, n_sections, n_bullets, n_long, n_strong, n_measured, n_pronouns, n_stuffed, n_contact, n_jobs, n_dated, layout, image.
    """
    share = lambda c: F.when(F.col("n_bullets") > 0, F.col(c) / F.col("n_bullets")).otherwise(0.0)
    strong, measured, short = share("n_strong"), share("n_measured"), 1 - share("n_long")
    words, some = F.col("n_words"), F.col("n_bullets") > 0
    rows = [
        ("text_extractable", "parsability", F.when(words > 120, "pass").otherwise("fail"), F.when(words > 120, 10.0).otherwise(0.0), 10.0),
        ("simple_layout", "parsability", status(~F.col("layout")), F.when(F.col("layout"), 3.0).otherwise(8.0), 8.0),
        ("no_image_text", "parsability", status(~F.col("image")), F.when(F.col("image"), 2.0).otherwise(5.0), 5.0),
        ("contact_block", "structure", F.when(F.col("n_contact") >= 2, "pass").otherwise("fail"), F.when(F.col("n_contact") >= 2, 4.0 * F.col("n_contact")).otherwise(2.0), 12.0),
        ("dates", "structure", status(F.col("n_jobs") == F.col("n_dated")), F.when(F.col("n_jobs") == 0, 6.0).otherwise(6.0 * F.col("n_dated") / F.greatest(F.lit(1), F.col("n_jobs"))), 6.0),
        ("character_set", "parsability", status(F.col("n_odd") < 25), F.when(F.col("n_odd") < 25, 4.0).otherwise(1.5), 4.0),
        ("standard_headings", "structure", status(F.col("n_sections") >= 3, F.col("n_sections") == 2), 12.0 * F.col("n_sections") / len(STANDARD), 12.0),
        ("length", "structure", status(words.between(380, 950)), F.when(words.between(380, 950), 8.0).when(words < 380, 4.0).otherwise(4.5), 8.0),
        ("bullets", "content", F.when(~some, "fail").otherwise(status(short > 0.8)), F.when(some, 8.0 * short).otherwise(0.0), 8.0),
        ("action_verbs", "content", status(strong >= 0.6, strong >= 0.3), 10.0 * F.least(F.lit(1.0), strong / 0.7), 10.0),
        ("quantified", "content", status(measured >= 0.4, measured >= 0.2), 12.0 * F.least(F.lit(1.0), measured / 0.5), 12.0),
        ("pronouns", "content", status(F.col("n_pronouns") <= 3), F.when(F.col("n_pronouns") <= 3, 4.0).otherwise(1.5), 4.0),
        ("keyword_stuffing", "keywords", status(F.col("n_stuffed") == 0), F.when(F.col("n_stuffed") == 0, 6.0).otherwise(3.0), 6.0),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(f).alias("family"), s.alias("status"), p.alias("points"), F.lit(m).alias("most")) for i, f, s, p, m in rows])
    return features.select(key, F.inline(each))


def target_checks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, check_id, family, status, points, most of the three checks against a target. pairs: coverage, n_blocking (missing of high priority), n_declared (named only)."""
    c, gaps, named = F.col("coverage"), F.col("n_blocking"), F.col("n_declared")
    rows = [
        ("keyword_coverage", status(c >= 0.5, c >= 0.25), 12.0 * F.least(F.lit(1.0), c / 0.6), 12.0),
        ("required_skill_terms", status(gaps == 0, gaps <= 2), F.greatest(F.lit(0.0), 10.0 - 2.5 * gaps), 10.0),
        ("skill_placement", status(named <= 2), F.greatest(F.lit(2.0), 8.0 - 1.5 * named), 8.0),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit("keywords").alias("family"), s.alias("status"), p.alias("points"), F.lit(m).alias("most")) for i, s, p, m in rows])
    return pairs.select(*keys, F.inline(each))


def totals(check_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, family ('all' for the whole), score, n_pass, n_warn, n_fail, failures: both levels by one grouping."""
    both = check_rows.select(*keys, F.explode(F.array("family", F.lit("all"))).alias("family"), "check_id", "status", "points", "most")
    of = lambda s: F.count_if(F.col("status") == s)
    failed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "fail", F.col("check_id")))), "|")
    return both.groupBy(*keys, "family").agg(F.round(100 * F.sum("points") / F.sum("most") + 1e-9, 4).alias("score"), of("pass").alias("n_pass"), of("warn").alias("n_warn"), of("fail").alias("n_fail"), failed.alias("failures"))


def ratio_points(ratio: Column, most: float) -> Column:
    return most * F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))


# Phrases that say nothing, and signs of tools and links in a project's text.
GENERIC = [
    "hard working", "hardworking", "team player", "passionate", "quick learner", "detail oriented", "detail-oriented", "highly motivated",
    "self motivated", "go-getter", "think outside the box", "results driven", "dynamic professional",
]
LINK = r"(?i)https?://|github\.com|gitlab\.com|\bdemo\b|\blive\b"
TOOLS = r"(?i)\b(?:using|built with|tech(?:nologies)?|stack|tools)\b"


def section_checks(x: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, ord, check_id, ratio (0..1), most of every check of the five sections of a pair.

    x: summary, n_summary_words, n_generic, n_named (of the first eight keywords), role_named; skills_block, n_terms, grouped,
    n_declared, n_required, n_required_matched; n_jobs, n_dated, job_bullets, job_strong, job_measured, relevance; n_projects,
    project_bullets, projects_tools, projects_measured, projects_linked; n_education, n_degree, n_year, technical, certs.
    """
    there = F.col("summary") != ""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    words = F.col("n_summary_words")
    rows = [
        ("summary", "present", yes(there), 25.0), ("summary", "length", F.when(~there, 0.0).when(words.between(20, 70), 1.0).when(words <= 110, 0.5).otherwise(0.25), 20.0),
        ("summary", "specific", F.when(F.col("n_generic") > 0, 0.0).otherwise(yes(there)), 25.0), ("summary", "aligned", F.when(there, F.col("n_named") / 2 + F.when(F.col("role_named"), 0.5).otherwise(0.0)).otherwise(0.0), 30.0),
        ("skills", "present", yes(F.col("skills_block") != ""), 20.0), ("skills", "breadth", F.col("n_terms") / 12, 15.0), ("skills", "grouped", yes(F.col("grouped")), 15.0),
        ("skills", "evidence", 1 - F.least(F.lit(1.0), F.col("n_declared") / F.greatest(F.lit(1), F.col("n_required"))), 25.0), ("skills", "covers", per("n_required_matched", "n_required"), 25.0),
        ("experience", "present", yes(F.col("n_jobs") > 0), 20.0), ("experience", "dated", per("n_dated", "n_jobs"), 15.0), ("experience", "depth", per("job_bullets", "n_jobs") / 3, 15.0),
        ("experience", "verbs", per("job_strong", "job_bullets"), 20.0), ("experience", "measured", 2 * per("job_measured", "job_bullets"), 20.0), ("experience", "relevant", F.col("relevance") / 0.35, 10.0),
        ("projects", "present", yes(F.col("n_projects") > 0), 25.0), ("projects", "enough", F.col("n_projects") / 2, 10.0), ("projects", "depth", per("project_bullets", "n_projects") / 3, 15.0),
        ("projects", "tools", per("projects_tools", "n_projects"), 20.0), ("projects", "measured", per("projects_measured", "n_projects"), 20.0), ("projects", "linked", per("projects_linked", "n_projects"), 10.0),
        ("education", "present", yes(F.col("n_education") > 0), 30.0), ("education", "degree", per("n_degree", "n_education"), 20.0), ("education", "dated", per("n_year", "n_education"), 15.0),
        ("education", "field", yes(F.col("technical")), 20.0), ("education", "certificates", F.col("certs") / 2, 15.0),
    ]
    clamped = lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("ord"), F.lit(c).alias("check_id"), clamped(r).alias("ratio"), F.lit(m).alias("most")) for i, (s, c, r, m) in enumerate(rows)])
    return x.select(*keys, F.inline(each))


def section_totals(check_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section ('all': the mean of the five), score, verdict, weakest: the check that isn't passed with the least share of its points."""
    g = check_rows.groupBy(*keys, "section").agg(
        (100 * F.sum(F.col("ratio") * F.col("most")) / F.sum("most")).alias("s"), F.max(F.when(F.col("check_id") == "present", F.col("ratio"))).alias("present"),
        F.min_by(F.when(F.col("ratio") < 0.8, F.col("check_id")), F.when(F.col("ratio") < 0.8, F.struct("ratio", "ord"))).alias("weakest"),
    )
    total = g.groupBy(*keys).agg(F.avg("s").alias("s"), F.min_by("section", F.struct(F.round("s", 6), "section")).alias("weakest")).select(*keys, F.lit("all").alias("section"), "s", F.lit(1.0).alias("present"), "weakest")
    score = F.round(F.col("s") + 1e-9, 4)
    verdict = F.when(F.col("present") == 0, "missing").when(score >= 80, "strong").when(score >= 55, "adequate").otherwise("weak")
    return g.unionByName(total).select(*keys, "section", score.alias("score"), verdict.alias("verdict"), F.coalesce("weakest", F.lit("")).alias("weakest"))
