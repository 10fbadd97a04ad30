"""Writes of parsed documents, analyses with their children, and reference data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 4000  # characters of a stored suggestion


def append_parsed(parsed: DataFrame, path: str) -> None:
    """Parsed documents behind what is stored. Retried tasks leave nothing twice, since files are committed once."""
    parsed.write.mode("append").parquet(path)


def suggestion_rows(suggestions: DataFrame) -> DataFrame:
    """analysis_id, section, priority, text to store. suggestions: analysis_id, section, tags (text or array), suggested.

    A suggestion is of high priority if it is tagged 'high-impact'; its text is cut at LONGEST characters.
    """
    tags = F.col("tags") if dict(suggestions.dtypes)["tags"] == "string" else F.array_join("tags", "|")
    high = F.contains(F.coalesce(tags, F.lit("")), F.lit("high-impact"))
    return suggestions.select("analysis_id", "section", F.when(high, "high").otherwise("medium").alias("priority"), F.substring(F.coalesce("suggested", F.lit("")), 1, LONGEST).alias("text"))


def store_analyses(analyses: DataFrame, suggestions: DataFrame, projects: DataFrame, path: str) -> None:
    """Three appends below `path`: analyses of stored résumés, and their suggestions and projects; nothing of analyses without a résumé."""
    kept = analyses.where("resume_id is not null")
    ids = kept.select("analysis_id").distinct()
    kept.write.mode("append").parquet(f"{path}/analyses")
    suggestion_rows(suggestions.join(ids, "analysis_id", "left_semi")).write.mode("append").parquet(f"{path}/suggestions")
    projects.join(ids, "analysis_id", "left_semi").write.mode("append").parquet(f"{path}/projects")


def merged(stored: DataFrame, fresh: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Reference rows with fresh ones over stored ones of the same key, and `origin`: kept, updated, same or inserted. The same input again changes nothing."""
    keys = list(keys)
    rest = [c for c in stored.columns if c not in keys]
    s = stored.select(*keys, F.struct(*rest).alias("s"))
    f = fresh.select(*keys, F.struct(*rest).alias("f"))
    both = s.join(f, keys, "full")
    origin = F.when(F.col("f").isNull(), "kept").when(F.col("s").isNull(), "inserted").when(F.col("s").eqNullSafe(F.col("f")), "same").otherwise("updated")
    return both.select(*keys, F.coalesce("f", "s").alias("x"), origin.alias("origin")).select(*keys, "x.*", "origin")


def write_reference(rows: DataFrame, path: str) -> None:
    """The merged table in place of the stored one: written beside it first, since a table can't be read and overwritten at once."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}.new")
    spark.read.parquet(f"{path}.new").write.mode("overwrite").parquet(path)
