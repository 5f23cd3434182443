"""Sinks: results, mappings and evaluation output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.report import without_sensitive_fields


#: Formats results are written in.
FORMATS = ("json", "text", "parquet", "noop")


def result_json(anonymized: Column) -> Column:
    """JSON with the anonymized text, the mapping and the number of entities."""
    entries = F.transform(anonymized["entries"], lambda e: F.struct(e["placeholder"].alias("key"), e["original"].alias("value")))
    return F.to_json(F.struct(anonymized["text"].alias("anonymized_text"), F.map_from_entries(entries).alias("mapping"), F.size(anonymized["entries"]).alias("entity_count")))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append(df: DataFrame, path: str) -> None:
    """Appends rows (sessions, mappings, events, detections) to a parquet table."""
    df.write.mode("append").parquet(path)


def keep_newest(df: DataFrame, stamp: str, tie: str, n: int = 10_000) -> DataFrame:
    """A capped list: the newest n rows."""
    return df.orderBy(F.desc(stamp), F.desc(tie)).limit(n)


def write_stream(df: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all input there is, writes its rows below a shared folder, and gives them back as a table."""
    job = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def log_lines(rows: DataFrame, level: Column, message: Column, context: Column, stamp: str) -> DataFrame:
    """(line): structured log records as JSON, without context fields whose names suggest personal data."""
    return rows.select(
        F.to_json(F.struct(F.col(stamp).cast("string").alias("timestamp"), level.alias("level"), message.alias("message"), without_sensitive_fields(context).alias("context"))).alias("line")
    )
