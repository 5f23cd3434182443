"""Detection quality against labels, and how much of a text anonymization preserves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import let


def confusion(expected: Column, detected: Column) -> Column:
    """Struct (tp, fp, fn) of two arrays taken as sets; null arrays count as empty."""
    e = F.array_distinct(F.coalesce(expected, F.array().cast("array<string>")))
    d = F.array_distinct(F.coalesce(detected, F.array().cast("array<string>")))
    return let(
        F.struct(e.alias("e"), d.alias("d")),
        lambda x: F.struct(
            F.size(F.array_intersect(x["e"], x["d"])).alias("tp"), F.size(F.array_except(x["d"], x["e"])).alias("fp"), F.size(F.array_except(x["e"], x["d"])).alias("fn")
        ),
    )


def scores(rows: DataFrame, confusion_col: str, group: list[str]) -> DataFrame:
    """Micro-averaged precision, recall and F1 per group (or over all rows), 0 where undefined."""
    agg = rows.groupBy(*group).agg(*[F.coalesce(F.sum(F.col(confusion_col)[k]), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = agg.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio(2 * p * r, p + r))


def word_count(text: Column) -> Column:
    """Words between runs of white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def utility(rows: DataFrame, original: str, anonymized: str, entries: str) -> DataFrame:
    """(samples, avg_char_ratio, avg_word_ratio, total_pii): means over all rows with a text.

    An entry's placeholder counts once per row, as keys of a mapping do.
    """
    chars = F.when(F.length(original) > 0, F.length(anonymized) / F.length(original)).otherwise(F.lit(0.0))
    words = word_count(F.col(original))
    ratio = F.when(words > 0, word_count(F.col(anonymized)) / words).otherwise(F.lit(0.0))
    keys = F.size(F.array_distinct(F.transform(entries, lambda e: e["placeholder"])))
    return rows.where(F.col(original).isNotNull()).agg(
        F.count("*").alias("samples"), F.avg(chars).alias("avg_char_ratio"), F.avg(ratio).alias("avg_word_ratio"), F.coalesce(F.sum(keys), F.lit(0)).alias("total_pii")
    )
