"""Scanning many files or rows: totals over detections without confidence or overlap steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.detectors import detect


def scan(texts: DataFrame, key: str, text: str, detectors=("regex",)) -> DataFrame:
    """(key, entities, summary): per text the number of spans and their counts by type; null texts count as errors (null)."""
    from veilspark.functions.report import summary

    found = texts.withColumn("_s", detect(F.col(text), detectors))
    return found.select(key, F.when(F.col("_s").isNotNull(), F.size("_s")).alias("entities"), summary(F.col("_s")).alias("summary"))


def scan_totals(scanned: DataFrame) -> DataFrame:
    """(files, files_with_pii, entities); a text that couldn't be read counts as one with PII."""
    return scanned.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("entities").isNull() | (F.col("entities") > 0)).alias("files_with_pii"),
        F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"),
    )


def listing(texts: DataFrame, key: str, text: str, detectors=("regex",)) -> DataFrame:
    """(key, entity_type, found): per text and type the spans in text order, grouped inside the row, so nothing is shuffled."""
    spans = detect(F.col(text), detectors)
    types = F.array_sort(F.array_distinct(F.transform("_s", lambda s: s["entity_type"])))
    grouped = texts.withColumn("_s", spans).select(key, "_s", F.explode(types).alias("entity_type"))
    own = F.filter("_s", lambda s: s["entity_type"] == F.col("entity_type"))
    return grouped.select(key, "entity_type", F.transform(own, lambda s: s["text"]).alias("found"))
