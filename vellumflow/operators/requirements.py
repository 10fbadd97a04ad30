"""Requirement rows of every organisation, role and level at once: layers joined one after the other, since a boost and a
maximum don't commute. All inputs are reference tables; the product of their keys is the result's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.operators.matching import TIERS, rank_of

SOFT_IMPORTANCE, ABSENT_BASE = 0.55, 0.5


def tier_name(rank):
    return F.when(rank == 3, "required").when(rank == 2, "preferred").when(rank == 1, "optional")


def priority(importance):
    return F.when(importance >= 0.85, "high").when(importance >= 0.65, "medium").otherwise("low")


def role_layer(roles: DataFrame) -> DataFrame:
    """role, skill, importance, t (tier's rank): the role's three tiers and its soft skills; the strongest tier and the greatest importance hold."""
    parts = [roles.select("role", F.explode(f"{tier}_skills").alias("s"), F.lit(rank).alias("t")).select("role", "s.skill", "s.importance", "t") for tier, rank in TIERS.items()]
    soft = roles.select("role", F.explode("soft_skills").alias("skill"), F.lit(SOFT_IMPORTANCE).alias("importance"), F.lit(TIERS["preferred"]).alias("t"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(soft)
    return rows.groupBy("role", "skill").agg(F.least(F.lit(1.0), F.max("importance")).alias("importance"), F.max("t").alias("t"))


def compose(roles: DataFrame, companies: DataFrame, overrides: DataFrame, levels: DataFrame) -> DataFrame:
    """target_id, ord, skill, importance, tier, source, priority of every company x role x level.

    Role baseline; the company's focus raises what is there (never above 1) and may promote its tier, or adds what isn't;
    curated additions of the pair by maximum; the level scales; then the order by tier, importance and name.
    """
    pairs = companies.select("company").crossJoin(roles.select("role"))
    base = pairs.join(role_layer(roles), "role")
    focus = companies.select("company", F.explode("focus").alias("f")).select("company", "f.skill", "f.boost", "f.promote_to")
    focus = focus.join(roles.select("role"), how="cross").withColumn("pt", rank_of("promote_to", TIERS))
    two = base.join(focus, ["company", "role", "skill"], "full")
    there = F.col("importance").isNotNull()
    two = two.select(
        "company", "role", "skill",
        F.when(F.col("boost").isNull(), F.col("importance")).when(there, F.least(F.lit(1.0), F.col("importance") + F.col("boost"))).otherwise(F.least(F.lit(1.0), ABSENT_BASE + F.col("boost"))).alias("importance"),
        F.when(F.col("boost").isNull(), F.col("t")).when(there, F.greatest("t", "pt")).otherwise(F.when(F.col("pt") > 0, F.col("pt")).otherwise(F.lit(TIERS["preferred"]))).alias("t"),
        F.when(F.col("boost").isNull(), "role").otherwise("company").alias("source"),
    )
    extra = overrides.select("company", "role", F.explode(F.concat(F.transform("extra_required", lambda x: F.struct(x["skill"].alias("skill"), x["importance"].alias("i"), F.lit(3).alias("et"))), F.transform("extra_preferred", lambda x: F.struct(x["skill"].alias("skill"), x["importance"].alias("i"), F.lit(2).alias("et"))))).alias("e"))
    extra = extra.select("company", "role", "e.skill", "e.i", "e.et").groupBy("company", "role", "skill").agg(F.max("i").alias("i"), F.max("et").alias("et"))
    three = two.join(extra, ["company", "role", "skill"], "full")
    raised = (F.col("et") > F.coalesce("t", F.lit(0))) | (F.col("i") > F.coalesce("importance", F.lit(0.0)))
    three = three.select(
        "company", "role", "skill", F.least(F.lit(1.0), F.greatest("importance", "i")).alias("importance"), F.greatest("t", "et").alias("t"),
        F.when(F.col("i").isNotNull() & raised, "override").otherwise(F.col("source")).alias("source"),
    )
    four = three.crossJoin(F.broadcast(levels.select("level", "scale"))).withColumn("importance", F.round(F.least(F.lit(1.0), F.col("importance") * F.col("scale")), 3))
    four = four.withColumn("target_id", F.concat_ws(":", "company", "role", "level"))
    w = W.partitionBy("target_id").orderBy(F.desc("t"), F.desc("importance"), F.lower("skill"))
    return four.select("target_id", F.row_number().over(w).cast("bigint").alias("ord"), "skill", "importance", tier_name(F.col("t")).alias("tier"), "source", priority(F.col("importance")).alias("priority"))


def fuse(curated: DataFrame, posted: DataFrame) -> DataFrame:
    """Rows of both requirements of a target; of a skill in both, the posting's only if its importance is strictly greater."""
    c = curated.select("target_id", F.lower("skill").alias("low"), F.struct("skill", "importance", "tier", F.lit("curated").alias("source")).alias("c"))
    p = posted.select("target_id", F.lower("skill").alias("low"), F.struct("skill", "importance", "tier", F.lit("posting").alias("source")).alias("p"))
    best = F.when(F.col("c").isNull() | (F.col("p")["importance"] > F.col("c")["importance"]), F.col("p")).otherwise(F.col("c"))
    return c.join(p, ["target_id", "low"], "full").select("target_id", best.alias("x")).select("target_id", "x.*")
