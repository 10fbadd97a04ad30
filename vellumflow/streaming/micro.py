"""Structured Streaming forms: the stateless part of the analysis as micro-batches, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumflow.operators import extract as E


def skill_stream(spark: SparkSession, path: str, schema: str, key: str, column: str, ontology: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Texts that arrive as Parquet files below `path`, with the skills each names, appended below `out`; one run over what is there.

    Every row gives its own rows, so there's no state and any number of executors can share a batch.
    """
    forms = E.surface_forms(ontology)
    texts = spark.readStream.schema(schema).parquet(path).where(F.col(column).isNotNull())
    words = texts.select(key, E.words_of(F.col(column)).alias("ws"))
    found = words.select(key, F.inline(E.runs("ws", E.longest_form(ontology)))).join(E.bounded(forms), ["form", "cased"]).select(key, "skill", "category")
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and kind; on a stream, windows close once the watermark of `late` has passed them."""
    e = events.withColumn("__t", F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("__t", late)
    return e.groupBy(F.window("__t", width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
