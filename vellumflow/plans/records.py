"""Queries of the record operators: packed fields (p2) and nested records (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.operators import nested, packed
from vellumflow.sources.tables import spread, table


def section_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, entry, value: the elements of skill_section_terms."""
    t = table(spark, sf_dir, "parsed_resume")
    return t.select("doc_id", F.posexplode("skill_section_terms").alias("i", "value")).select("doc_id", F.col("i").cast("bigint").alias("entry"), "value")


def packed_values(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    protected = packed.vocabulary(table(spark, sf_dir, "ontology"))
    hints = table(spark, sf_dir, "doc_entry").where("section = 'projects'").select("doc_id", F.col("entry").cast("bigint").alias("entry"), F.col("tech_hint").alias("value"))
    both = hints.withColumn("field", F.lit("tech_hint")).unionByName(section_elements(spark, sf_dir).withColumn("field", F.lit("skill_section_terms")))
    return packed.split_packed(both.where("value is not null"), ["field", "doc_id", "entry"], "value", protected, least)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the fields that hold two or more."""
    return packed_values(spark, sf_dir, 2).distinct()


def p2_field_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields hold how many values."""
    v = packed_values(spark, sf_dir, 1).distinct()
    n = v.groupBy("field", "doc_id", "entry").agg(F.count(F.lit(1)).alias("n_values"))
    return n.groupBy("field", "n_values").agg(F.count(F.lit(1)).alias("n_fields"))


def nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for kind, name, key, column in (("resume", "resumes", "resume_id", "parsed"), ("analysis", "resume_analyses", "analysis_id", "payload")):
        t = spread(table(spark, sf_dir, name).select(key, column))
        flat = nested.flatten(t, key, column, nested.array_paths(t, column))
        parts.append(flat.select(F.lit(kind).alias("record_type"), F.col("record_id").cast("bigint").alias("record_id"), "path", "node", "parent"))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an element of an array, with its place and its parent's."""
    return nested_rows(spark, sf_dir).select("record_type", "record_id", "node", "parent").distinct()


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child tables: how many rows and records each has."""
    rows = nested_rows(spark, sf_dir).distinct()
    per = rows.groupBy("record_type", "path", "record_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("record_type", "path").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_records"))


def p3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child table of an analysis's components with its fields, linked to the record."""
    t = spread(table(spark, sf_dir, "resume_analyses").select("analysis_id", "payload"))
    flat = nested.flatten(t, "analysis_id", "payload", nested.array_paths(t, "payload"), with_values=True)
    c = nested.child_table(flat, "scoring/components", ["key", "score", "weight"])
    return c.select(F.col("record_id").alias("analysis_id"), "node", F.col("f_key").alias("component"), F.col("f_score").try_cast("double").alias("score"), F.col("f_weight").try_cast("double").alias("weight")).distinct()


def payload_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-4: the stored plan of every analysis: its phases with title and weeks, out of the nested payload."""
    t = spread(table(spark, sf_dir, "resume_analyses").select("analysis_id", "payload"))
    flat = nested.flatten(t, "analysis_id", "payload", nested.array_paths(t, "payload"), with_values=True)
    c = nested.child_table(flat, "learning_roadmap/phases", ["phase", "title", "duration_weeks"])
    return c.select(F.col("record_id").alias("analysis_id"), "node", F.col("f_phase").try_cast("int").alias("phase"), F.col("f_title").alias("title"), F.col("f_duration_weeks").try_cast("int").alias("weeks")).distinct()


QUERIES = {"p2_found": p2_found, "p2_field_sizes": p2_field_sizes, "p3_found": p3_found, "p3_tables": p3_tables, "p3_components": p3_components, "payload_phases": payload_phases}
SQL: dict[str, str] = {}
