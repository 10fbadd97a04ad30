"""A document rebuilt from its parsed parts, and the loop that parses and scores the result again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import rewrite as X
from vellumflow.operators import extract as E
from vellumflow.operators import parse as P
from vellumflow.sources.tables import checkpointed

ORDER = ("header", "summary", "skills", "experience", "projects", "education", "certifications", "achievements", "publications", "leadership")


def render(doc_lines: DataFrame, key: str) -> DataFrame:
    """key, text: sections in fixed order under plain headings, bullets rewritten, blank lines dropped."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in ORDER]), F.col("section")), F.lit(0))
    # one step a column: nested in one expression each step would be evaluated once for every use of it
    steps = doc_lines.where(~F.col("is_blank")).select(key, "section", rank.alias("r"), "pos", "line", "is_bullet", P.bullet_text(F.col("line")).alias("b0"))
    steps = steps.withColumn("b1", X.without_filler(F.col("b0"))).withColumn("b2", X.opened(F.col("b1"))).withColumn("b3", X.completed(F.col("b2"), F.col("b0")))
    body = steps.select(key, "section", "r", "pos", F.when(F.col("is_bullet"), F.concat(F.lit("- "), F.col("b3"))).otherwise(F.trim("line", F.lit(" \t"))).alias("line"))
    heads = body.where("section <> 'header'").groupBy(key, "section", "r").agg(F.lit(-1).alias("pos")).select(key, "section", "r", "pos", F.upper("section").alias("line"))
    rows = body.unionByName(heads)
    ordered = F.array_sort(F.collect_list(F.struct("r", "pos", "line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def closed_loop(texts: DataFrame, key: str, column: str, ontology: DataFrame) -> DataFrame:
    """key, n_before, n_after, n_lost: distinct skills found in each text and in its rebuilt form; rebuilding loses none."""
    lines = P.lines(texts, key, column)
    rebuilt = checkpointed(render(lines, key))  # the second pass plans and runs from the written texts
    before = E.mentions(lines, key, ontology).select(key, "skill").distinct()
    after = E.mentions(P.lines(rebuilt, key, "text"), key, ontology).select(key, "skill").distinct()
    both = before.withColumn("b", F.lit(1)).join(after.withColumn("a", F.lit(1)), [key, "skill"], "full").na.fill(0, ["a", "b"])
    return both.groupBy(key).agg(F.sum("b").cast("bigint").alias("n_before"), F.sum("a").cast("bigint").alias("n_after"), F.count_if(F.col("b") > F.col("a")).alias("n_lost"))
