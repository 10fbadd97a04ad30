"""Requirements against evidence, component scores, gaps, plans and rankings: joins and aggregates over (document, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.operators.extract import bounded

# Credit of a skill that is shown at work, only named, or only related to one shown at work.
APPLIED_CREDIT, NAMED_CREDIT, RELATED_CREDIT = 1.0, 0.8, 0.35
# Ranks of tiers and priorities.
TIERS = {"required": 3, "preferred": 2, "optional": 1}
PRIORITIES = {"high": 3, "medium": 2, "low": 1}
PAIR = ("doc_id", "target_id")


def rank_of(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, r in ranks.items():
        out = F.when(F.col(column) == name, r).otherwise(out)
    return out


def resolve(requirements: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    """requirements (doc_id, target_id, ord, skill) with status, credit and via.

    Direct evidence first; for what it leaves, the first applied skill that the requirement's entry lists as related, then
    the surest applied skill whose entry lists the requirement. A document's evidence is one map (as large as the reference
    list at most), so that one join by document answers all three and nothing is exploded or grouped again.
    """
    payload = F.struct("skill", "applied", "declared_only", "confidence", "mentions")
    listed = F.array_sort(F.collect_list(F.struct(F.lower("skill").alias("low"), payload.alias("x"))))
    have = found.groupBy("doc_id").agg(listed.alias("e"))
    have = have.select("doc_id", F.map_from_entries(F.filter("e", lambda y, i: (i == 0) | (F.get("e", i - 1)["low"] != y["low"]))).alias("e"))
    names = edges.groupBy(F.lower("src").alias("low")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda y: y["dst"]).alias("ahead"))
    back = edges.groupBy(F.col("dst").alias("__dst")).agg(F.collect_set("src").alias("back"))
    r = requirements.withColumn("low", F.lower("skill")).join(bounded(names), "low", "left").join(bounded(back), F.col("skill") == F.col("__dst"), "left").join(have, "doc_id", "left")
    at = lambda name: F.try_element_at("e", F.lower(name))
    at_work = lambda names_: F.filter(F.transform(names_, at), lambda y: y["applied"])
    surest = F.array_sort(F.transform(at_work("back"), lambda y: F.struct((-y["confidence"]).alias("c"), (-y["mentions"]).alias("m"), y["skill"].alias("skill"))))
    r = r.withColumn("own", F.try_element_at("e", F.col("low")))
    r = r.withColumn("via", F.when(F.col("own").isNull(), F.coalesce(F.get(at_work("ahead"), F.lit(0))["skill"], F.get(surest, F.lit(0))["skill"])))
    own, via = F.col("own").isNotNull(), F.col("via").isNotNull()
    return r.select(
        *PAIR, "ord", "skill",
        F.when(own, F.when(F.col("own.applied") | ~F.col("own.declared_only"), "matched").otherwise("partial")).when(via, "partial").otherwise("missing").alias("status"),
        F.when(own, F.when(F.col("own.applied"), APPLIED_CREDIT).otherwise(NAMED_CREDIT)).when(via, RELATED_CREDIT).otherwise(0.0).alias("credit"),
        F.coalesce("via", F.lit("")).alias("via"),
    )


def skills_component(matches: DataFrame) -> DataFrame:
    """Share of the importance that is credited, and the counts behind it."""
    c = F.coalesce("credit", F.lit(0.0))
    return matches.groupBy(*PAIR).agg(
        F.round(T.clamp(100 * F.sum(F.col("importance") * c) / F.sum("importance")), 4).alias("score"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("matched", "partial", "missing")],
    )


def required_coverage(matches: DataFrame) -> DataFrame:
    """Mean credit of the required skills; 1 where none is required."""
    got = F.when(F.col("status") == "matched", 1.0).when(F.col("status") == "partial", F.coalesce("credit", F.lit(0.0))).otherwise(0.0)
    return matches.groupBy(*PAIR).agg(F.round(F.coalesce(F.avg(F.when(F.col("tier") == "required", got)), F.lit(1.0)), 6).alias("coverage"), F.count_if(F.col("tier") == "required").alias("n_required"))


def gap_buckets(matches: DataFrame) -> DataFrame:
    """Missing skills by priority over all tiers, and the optional ones; a skill may count in two."""
    missing = F.col("status") == "missing"
    return matches.groupBy(*PAIR).agg(
        *[F.count_if(missing & (F.col("priority") == p)).alias(f"missing_{p}") for p in PRIORITIES],
        F.count_if(missing & (F.col("tier") == "optional")).alias("optional"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(missing & (F.col("priority") == "high"), F.struct("ord", "skill")))), lambda x: x["skill"]), "|").alias("high_names"),
    )


def learn_plan(matches: DataFrame, ontology: DataFrame, rows: int = 12) -> DataFrame:
    """What to learn first: gaps by priority, importance and weeks, with the running sum of weeks."""
    gaps = matches.where("status in ('missing', 'partial') and skill is not null").join(bounded(ontology.select("skill", "learn_weeks")), "skill", "left")
    weeks = F.when(F.col("status") == "partial", 1).otherwise(F.coalesce("learn_weeks", F.lit(4)))
    w = W.partitionBy(*PAIR).orderBy(F.desc("p"), F.desc("importance"), "weeks", "ord")
    g = gaps.withColumn("weeks", weeks).withColumn("p", rank_of("priority", PRIORITIES)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rows)
    return g.select(*PAIR, F.col("rank").cast("bigint").alias("rank"), "skill", F.col("weeks").cast("bigint").alias("weeks"), F.sum("weeks").over(W.partitionBy(*PAIR).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)).cast("bigint").alias("week_total"))


def phase_weeks(weeks: str = "weeks") -> Column:
    """The longest task and half of the others, in whole weeks."""
    return F.floor(F.max(weeks) + 0.5 * (F.sum(weeks) - F.max(weeks)))


def roadmap(matches: DataFrame, ontology: DataFrame, ranked: DataFrame) -> DataFrame:
    """Up to five phases of each pair, numbered in order: surface named skills, close high gaps, build projects, close the rest, emerging ones.

    ranked: the pair's projects (rank, weeks), of which the first two are built.
    """
    g = matches.where("skill is not null").join(bounded(ontology.select("skill", "learn_weeks", "emerging")), "skill", "left")
    g = g.withColumn("phase", F.when(F.col("status") == "partial", 1).when((F.col("status") == "missing") & (F.col("priority") == "high"), 2).when((F.col("status") == "missing") & F.coalesce("emerging", F.lit(False)), 5).when(F.col("status") == "missing", 4)).where("phase is not null")
    most = F.when(F.col("phase") == 1, 6).when(F.col("phase") == 2, 4).when(F.col("phase") == 4, 5).otherwise(3)
    g = g.withColumn("r", F.row_number().over(W.partitionBy(*PAIR, "phase").orderBy(F.desc("importance"), "ord"))).where(F.col("r") <= most)
    g = g.select(*PAIR, "phase", F.when(F.col("phase") == 1, 1).otherwise(F.coalesce("learn_weeks", F.lit(4))).alias("weeks"))
    g = g.unionByName(ranked.where("rank <= 2").select(*PAIR, F.lit(3).alias("phase"), "weeks"))
    p = g.groupBy(*PAIR, "phase").agg(phase_weeks().cast("bigint").alias("weeks"), F.count(F.lit(1)).alias("n_items"))
    return p.select(*PAIR, F.row_number().over(W.partitionBy(*PAIR).orderBy("phase")).cast("bigint").alias("number"), F.col("phase").cast("bigint").alias("phase"), "weeks", "n_items")


def duration(weeks: Column) -> Column:
    """Weeks below eight, whole months from there on."""
    months = F.round(weeks / 4.345).cast("int").cast("string")
    return F.when(weeks < 8, F.concat(weeks.cast("string"), F.lit(" weeks"))).otherwise(F.concat(F.lit("about "), months, F.lit(" months")))


def projection(matches: DataFrame) -> DataFrame:
    """The skills score now, with named skills shown at work, and with the high gaps closed too."""
    c, i = F.coalesce("credit", F.lit(0.0)), F.col("importance")
    partial = F.when(F.col("status") == "partial", 1.0).otherwise(c)
    closed = F.when((F.col("status") == "missing") & (F.col("priority") == "high"), 1.0).otherwise(partial)
    return matches.groupBy(*PAIR).agg(*[F.round(T.clamp(100 * F.sum(i * x) / F.sum(i)), 4).alias(n) for n, x in (("score_now", c), ("score_shown", partial), ("score_closed", closed))])


def radar(matches: DataFrame) -> DataFrame:
    c = F.coalesce("credit", F.lit(0.0))
    return matches.where("category <> ''").groupBy(*PAIR, "category").agg(F.round(100 * F.sum(F.col("importance") * c) / F.sum("importance"), 4).alias("score"), F.count(F.lit(1)).alias("n_skills"), F.count_if(F.col("status") == "matched").alias("n_matched"))


def _closing(matches: DataFrame, projects: DataFrame, ontology: DataFrame) -> DataFrame:
    """Every pair and project that closes some of its gaps: coverage of the weighted gap, what it closes, whether it fits the role and company."""
    gap = matches.where("status <> 'matched'").withColumn("weight", F.col("importance") * F.when(F.col("status") == "missing", 1.0).otherwise(0.4))
    total = gap.groupBy(*PAIR).agg(F.sum("weight").alias("total"))
    own = ["project_id", "p_ord", "difficulty", "roles", "companies", "weeks"]
    taught = projects.select(*own, F.explode("teaches").alias("skill")).join(bounded(ontology.select("skill", "emerging")), "skill", "left")
    high = (F.col("priority") == "high") & (F.col("status") == "missing")
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "skill")))), lambda x: x["skill"])
    hit = gap.join(bounded(taught), "skill").groupBy(*PAIR, *own).agg(
        F.sum("weight").alias("closed"), F.count(F.lit(1)).alias("n_closed"), F.max(high).alias("high"), F.max(F.coalesce("emerging", F.lit(False))).alias("emerging"), names(high).alias("high_names"), names(F.lit(True)).alias("names")
    )
    part = lambda n: F.get(F.split("target_id", ":"), F.lit(n))
    h = hit.join(total, [*PAIR]).withColumn("coverage", F.col("closed") / F.col("total"))
    return h.withColumn("of_role", F.array_contains("roles", part(1))).withColumn("of_company", F.array_contains("companies", part(0))).withColumn("level", part(2))


def rank_projects(matches: DataFrame, projects: DataFrame, ontology: DataFrame, top: int = 6) -> DataFrame:
    """The projects that close the most of a pair's gaps: coverage, role, company, difficulty and emerging skills; ties by catalogue order."""
    h = _closing(matches, projects, ontology)
    yes = lambda c, otherwise: F.when(F.col(c), 1.0).otherwise(otherwise)
    table = F.create_map(*[F.lit(x) for p in DIFFICULTY.items() for x in p])
    hard = F.coalesce(F.try_element_at(table, F.concat_ws("/", "level", "difficulty")), F.lit(0.6))
    fit = 0.55 * F.least(F.lit(1.0), 2.5 * F.col("coverage")) + 0.15 * yes("of_role", 0.35) + 0.10 * yes("of_company", 0.4) + 0.12 * hard + 0.08 * yes("emerging", 0.3)
    h = h.withColumn("fit", F.round(F.least(F.lit(1.0), fit) + 1e-9, 6)).withColumn("priority", F.when(F.col("high"), "high").when(F.col("coverage") > 0.08, "medium").otherwise("low"))
    w = W.partitionBy(*PAIR).orderBy(F.desc(rank_of("priority", PRIORITIES)), F.desc("fit"), "p_ord")
    why = F.when(F.size("high_names") > 0, F.concat(F.lit("blocking: "), F.array_join("high_names", ", "))).otherwise(F.concat(F.lit("closes: "), F.array_join(F.slice("names", 1, 4), ", ")))
    return h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(*PAIR, F.col("rank").cast("bigint").alias("rank"), "project_id", "fit", "priority", "n_closed", F.col("weeks").cast("bigint").alias("weeks"), why.alias("rationale"))


def recommend_alone(matches: DataFrame, projects: DataFrame, ontology: DataFrame, top: int = 6) -> DataFrame:
    """The recommender that stands alone: coverage, role and company only, sorted by the rounded fit."""
    h = _closing(matches, projects, ontology)
    yes = lambda c, otherwise: F.when(F.col(c), 1.0).otherwise(otherwise)
    h = h.withColumn("fit", F.round(0.6 * F.col("coverage") + 0.25 * yes("of_role", 0.4) + 0.15 * yes("of_company", 0.4) + 1e-9, 3))
    h = h.withColumn("rank", F.row_number().over(W.partitionBy(*PAIR).orderBy(F.desc("fit"), "p_ord"))).where(F.col("rank") <= top)
    return h.select(*PAIR, F.col("rank").cast("bigint").alias("rank"), "project_id", "fit", F.when(F.col("fit") >= 0.5, "high").otherwise("medium").alias("priority"))


# How well a difficulty suits a level.
DIFFICULTY = {
    "intern/Beginner": 1.0, "intern/Intermediate": 0.75, "intern/Advanced": 0.35, "entry/Beginner": 0.85, "entry/Intermediate": 1.0,
    "entry/Advanced": 0.55, "mid/Beginner": 0.45, "mid/Intermediate": 1.0, "mid/Advanced": 0.9, "senior/Beginner": 0.2,
    "senior/Intermediate": 0.7, "senior/Advanced": 1.0,
}
