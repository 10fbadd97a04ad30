"""The six component scores of every (document, target) pair, their weighted overall, and what is read out of them.

Everything is an aggregate keyed by document or by pair; a target's text is made once a target and meets a document's terms
only for the given pairs, so that no pair of a document and a foreign target is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.operators import extract as E
from vellumflow.operators import matching as M
from vellumflow.operators import similarity as S
from vellumflow.operators.rules import band

PAIR = M.PAIR
# Weights of the components.
WEIGHTS = {"skills": 0.35, "keywords": 0.20, "experience": 0.15, "projects": 0.15, "education": 0.05, "semantic": 0.10}
BANDS = ((85, "excellent"), (70, "strong"), (55, "moderate"), (40, "developing"))
# Words of a postgraduate degree and of a technical field.
POSTGRADUATE = ["master", "m.tech", "msc", "phd", "mba", "m.sc"]
TECHNICAL = [
    "computer", "software", "data", "information", "electronic", "electrical", "statistic", "mathemat", "artificial", "machine", "technolog",
    "engineer", "comput", "science", "ai", "ml", "cyber", "network",
]
# Own reference rows: the years that a level usually asks for.
EXPECTED_YEARS = {"intern": 0.0, "entry": 1.0, "mid": 3.0, "senior": 6.0}
NEAR = 0.35  # a cosine of this and more counts as full


def holds_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def part(target: Column, n: int) -> Column:
    return F.get(F.split(target, ":"), F.lit(n))


def target_texts(keywords: DataFrame) -> DataFrame:
    """target_id, text: a target's requirement as one text, its parts joined by ' . '. keywords: (target_id, skill), bounded by the reference list."""
    k = keywords.select("target_id", "skill").distinct().groupBy("target_id").agg(F.array_join(F.array_sort(F.collect_set("skill")), ", ").alias("skills"))
    parts = F.filter(F.array(F.replace(part(F.col("target_id"), 1), F.lit("-"), F.lit(" ")), part(F.col("target_id"), 0), F.col("skills")), lambda x: F.coalesce(x, F.lit("")) != "")
    return k.select("target_id", F.array_join(parts, " . ").alias("text"))


def entry_features(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """doc_id and the counts of its entries that the components read. entries: doc_entry rows, parsed: (doc_id, bullets, certifications); both without repeats."""
    b = F.coalesce("bullets", F.array().cast("array<string>"))
    raw = F.coalesce("entry_raw", F.lit(""))
    e = entries.select(
        "doc_id", "section", F.size(b).alias("nb"), F.size(F.filter(b, lambda x: T.has_metric(x))).alias("nm"), T.has_metric(raw).alias("measured"), "duration_months",
        holds_any(F.lower(F.coalesce("degree", F.lit(""))), POSTGRADUATE).alias("post"), holds_any(F.lower(F.concat_ws(" ", "field_of_study", raw)), TECHNICAL).alias("technical"), (F.coalesce("score", F.lit("")) != "").alias("scored"),
    )
    of = lambda s: F.col("section") == s
    g = e.groupBy("doc_id").agg(
        F.count_if(of("experience")).alias("n_jobs"), F.coalesce(F.sum(F.when(of("experience"), F.col("duration_months"))), F.lit(0)).alias("months"),
        F.coalesce(F.sum(F.when(of("experience"), F.col("nb"))), F.lit(0)).alias("job_bullets"), F.coalesce(F.sum(F.when(of("experience"), F.col("nm"))), F.lit(0)).alias("job_measured"),
        F.count_if(of("projects")).alias("n_projects"), F.coalesce(F.sum(F.when(of("projects"), F.col("nb"))), F.lit(0)).alias("project_bullets"), F.count_if(of("projects") & F.col("measured")).alias("projects_measured"),
        F.count_if(of("education")).alias("n_education"), F.coalesce(F.max(of("education") & F.col("post")), F.lit(False)).alias("post"),
        F.coalesce(F.max(of("education") & F.col("technical")), F.lit(False)).alias("technical"), F.coalesce(F.max(of("education") & F.col("scored")), F.lit(False)).alias("scored"),
    )
    p = parsed.groupBy("doc_id").agg(F.max(F.size(b)).alias("all_bullets"), F.max(F.size(F.filter(b, lambda x: T.has_metric(x)))).alias("all_measured"), F.max(F.coalesce(F.size("certifications"), F.lit(0))).alias("certs"))
    return g.join(p, "doc_id", "full").na.fill(0).na.fill(False)


def components(matches: DataFrame, texts: DataFrame, entries: DataFrame, parsed: DataFrame, found: DataFrame, ontology: DataFrame) -> DataFrame:
    """One row a pair: coverage, relevance, years and the other inputs, and the six scores s_<component>.

    texts: (doc_id, text); found: skills found in them (doc_id, skill). Scores are those of the survey: skills by credited
    importance; keywords by coverage; experience by years, relevance and measured bullets; projects by the importance of
    the skills they show, depth and results; education by degree, field and certificates; semantic by blended cosines.
    """
    listed = E.bounded(ontology.select("skill").distinct())
    keywords = matches.join(listed, "skill", "left_semi").select(*PAIR, "skill").distinct()
    names = ontology.select("skill").distinct()
    held = S.held_shares(texts, "doc_id", "text", names, "skill").where("skill is not null and share >= 0.5")
    k = keywords.join(held, ["doc_id", "skill"], "left").groupBy(*PAIR).agg(((F.count_if(F.col("share") >= 1) + 0.5 * F.count_if(F.col("share") < 1)) / F.count(F.lit(1))).alias("coverage"))
    wanted = S.term_weights(target_texts(keywords), "target_id", "text", True)
    pairs = keywords.select(*PAIR).distinct()

    def near(df: DataFrame, column: str, name: str) -> DataFrame:
        f = S.given_features(pairs, S.term_weights(df, "doc_id", column, True), wanted, *PAIR)
        return f.select(*PAIR, F.col("cosine").alias(name), F.col("jaccard").alias(f"{name}_overlap"))

    jobs = entries.where("section = 'experience'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", F.coalesce("entry_raw", F.lit("")).alias("raw")))), lambda x: x["raw"]), "\n").alias("text"))
    related = found.select("doc_id", F.col("skill").alias("src")).join(E.bounded(E.edges(ontology)), "src").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("dst")), " ").alias("more"))
    wide = texts.join(related, "doc_id", "left").select("doc_id", F.concat_ws(" ", "text", "more").alias("text"))
    # skills that a document's projects show
    lines = entries.where("section = 'projects' and entry_raw is not null").select("doc_id", "section", F.col("entry_raw").alias("line"), F.lit(False).alias("is_blank"))
    shown = E.mentions(lines, "doc_id", ontology).select("doc_id", "skill").distinct().withColumn("shown", F.lit(1))
    o = matches.join(shown, ["doc_id", "skill"], "left").groupBy(*PAIR).agg((F.sum(F.when(F.col("shown") == 1, F.col("importance")).otherwise(0.0)) / F.greatest(F.lit(1e-6), F.sum("importance"))).alias("overlap"))
    claimed = texts.select("doc_id", T.years_claimed(F.col("text")).alias("claimed"))
    x = M.skills_component(matches).select(*PAIR, F.col("score").alias("s_skills")).join(k, [*PAIR], "left").join(o, [*PAIR], "left")
    for f in (near(jobs, "text", "relevance"), near(texts, "text", "plain"), near(wide, "text", "expanded")):
        x = x.join(f, [*PAIR], "left")
    x = x.join(entry_features(entries, parsed), "doc_id", "left").join(claimed, "doc_id", "left").na.fill(0).na.fill(False)
    level = F.create_map(*[F.lit(y) for p in EXPECTED_YEARS.items() for y in p])
    x = x.withColumn("years", F.round(F.greatest(F.col("months") / 12, F.col("claimed")), 1)).withColumn("expected", F.coalesce(F.try_element_at(level, part(F.col("target_id"), 2)), F.lit(1.0)))
    measured = F.when(F.col("job_bullets") > 0, F.col("job_measured") / F.col("job_bullets")).when(F.col("all_bullets") > 0, F.col("all_measured") / F.col("all_bullets")).otherwise(0.0)
    duration = F.when(F.col("expected") <= 0, F.when(F.col("n_jobs") > 0, 100.0).otherwise(55.0)).otherwise(F.least(F.lit(100.0), 100 * F.col("years") / F.col("expected")))
    n = F.col("n_projects")
    project = 100 * (0.6 * F.least(F.lit(1.0), 3 * F.col("overlap")) + 0.25 * F.least(F.lit(1.0), F.col("project_bullets") / (3 * n)) + 0.15 * F.col("projects_measured") / n)
    flag = lambda c, points: F.when(F.col(c), points).otherwise(0.0)
    education = F.when(F.col("n_education") > 0, 55.0 + flag("post", 12.0) + flag("technical", 18.0) + flag("scored", 5.0)).otherwise(0.0) + F.least(F.lit(15.0), 5.0 * F.col("certs"))
    semantic = F.least(F.lit(1.0), 0.6 * F.col("expanded") + 0.25 * F.col("plain") + 0.15 * F.col("plain_overlap"))
    scores = {
        "keywords": 100 * F.col("coverage"), "experience": 0.5 * duration + 0.3 * F.least(F.lit(100.0), 100 * F.col("relevance") / 0.4) + 20 * measured,
        "projects": F.when(n > 0, project).otherwise(0.0), "education": education, "semantic": 100 * F.least(F.lit(1.0), semantic / NEAR),
    }
    for name, s in scores.items():
        x = x.withColumn(f"s_{name}", T.clamp(s))
    return x.withColumn("measured_share", measured)


def component_rows(wide: DataFrame) -> DataFrame:
    """doc_id, target_id, component, score, weight: one row a component."""
    each = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"s_{c}").alias("score"), F.lit(w).alias("weight")) for c, w in WEIGHTS.items()])
    return wide.select(*PAIR, F.inline(each))


def overall(wide: DataFrame) -> Column:
    return T.clamp(T.sum_columns([F.lit(w) * F.col(f"s_{c}") for c, w in WEIGHTS.items()]) / sum(WEIGHTS.values()))


def score_band(score: Column) -> Column:
    return band(score, BANDS, "early")
