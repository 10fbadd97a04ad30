"""Snippets and coverage over the whole ontology."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellumflow.operators import extract as E
from vellumflow.sources.tables import table


def test_snippets_of_every_mentioned_skill(spark, sf_dir):
    ontology, docs = table(spark, sf_dir, "ontology"), table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null").distinct()
    lines = docs.select("doc_id", F.lit("other").alias("section"), F.explode(F.split("text", "\n")).alias("line"), F.lit(False).alias("is_blank"))
    want = {(r.doc_id, r.skill) for r in E.mentions(lines, "doc_id", ontology).collect()}
    got = [(r.doc_id, r.skill) for r in entry.queries()["skill_snippets"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {"SQL", "Machine Learning"} <= {s for _, s in got}


def test_place_of_the_first_mention(spark):
    ontology = spark.createDataFrame([("C++", "language", []), ("R", "language", []), ("Machine Learning", "ml", ["ml"])], "skill string, category string, aliases array<string>")
    df = spark.createDataFrame([(1, "é😀 r, R and C++.\nMachine-learning"), (2, "Some ML, then R")], "id int, t string")
    got = {(r.id, r.skill): (r["at"], r["length"]) for r in E.first_mentions(df, "id", "t", ontology).collect()}
    assert got == {(1, "R"): (7, 1), (1, "C++"): (13, 3), (1, "Machine Learning"): (18, 16), (2, "Machine Learning"): (6, 2), (2, "R"): (15, 1)}


def test_coverage_counts_every_name(spark, sf_dir):
    n = table(spark, sf_dir, "ontology").select("skill").distinct().count()
    for r in entry.queries()["keyword_coverage"](spark, sf_dir).collect():
        assert abs(r.coverage * n - (r.n_present + 0.5 * r.n_partial)) < 1e-3
