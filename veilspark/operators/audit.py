"""Audit queries over detections and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matching(rows: DataFrame, stamp: str, start: Column | None = None, end: Column | None = None, **equal) -> DataFrame:
    """Rows that meet every given condition; times inclusive at both ends; empty arguments are ignored."""
    for name, value in equal.items():
        if value:
            rows = rows.where(F.col(name) == value)
    if start is not None:
        rows = rows.where(F.col(stamp) >= start)
    if end is not None:
        rows = rows.where(F.col(stamp) <= end)
    return rows


def totals(rows: DataFrame) -> DataFrame:
    """(total_detections, unique_sessions, unique_users), exact."""
    return rows.agg(F.count("*").alias("total_detections"), F.countDistinct("session_id").alias("unique_sessions"), F.countDistinct("user_id").alias("unique_users"))


def by_type(rows: DataFrame) -> DataFrame:
    """(entity_type, detections, avg_count), most frequent first, ties by name."""
    return rows.groupBy("entity_type").agg(F.count("*").alias("detections"), F.avg("count").alias("avg_count")).orderBy(F.desc("detections"), "entity_type")


def alerts(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return rows.where(F.col("entity_type").isin(*types))


def counters(rows: DataFrame, group: list[str]) -> DataFrame:
    """Counts and value totals per group, as a metrics hook keeps them."""
    return rows.groupBy(*group).agg(F.count("*").alias("events"), F.sum("count").alias("values"))


def latency_percentiles(rows: DataFrame, value: str, group: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles (linear interpolation) per group: p50, p95, p99; nulls don't count.

    Equal values are counted before the shuffle. The counts fall into buckets of near values, the buckets' totals
    say in which of them a percentile lies, and only those are ranked: no task sorts or holds all values of a group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    # A monotone function of the value with a few thousand results.
    counted = counted.withColumn("_b", F.floor(F.signum("_v") * F.log2(F.abs("_v") + 1) * 64).cast("int"))
    buckets = counted.groupBy(*group, "_b").agg(F.sum("_n").alias("_in"))
    of_group = Window.partitionBy(*group)
    buckets = buckets.select(*group, "_b", F.sum("_in").over(of_group).alias("_all"), F.sum("_in").over(of_group.orderBy("_b")).alias("_upto"), "_in")
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("_all") - 1) * F.lit(p) + 0.0) for i, p in enumerate(points)])
    below = F.col("_upto") - F.col("_in")
    wanted = buckets.select(*group, "_b", below.alias("_below"), F.explode(F.transform(ranks, lambda r: F.struct(r["i"].alias("i"), r["col2"].alias("at")))).alias("_r"))
    wanted = wanted.join(buckets.select(*group, "_b", "_upto"), [*group, "_b"]).where((F.floor("_r.at") < F.col("_upto")) & (F.ceil("_r.at") >= F.col("_below")))
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*group, "_b", "_r.i").orderBy("_v"))
    ranked = counted.join(wanted, [*group, "_b"]).select(*group, "_v", F.col("_r.i").alias("_i"), F.col("_r.at").alias("_at"), upto.alias("_to"))
    low, high = (F.min(F.when(F.col("_to") > edge, F.col("_v"))) for edge in (F.floor("_at"), F.ceil("_at")))
    each = ranked.groupBy(*group, "_i", "_at").agg(low.alias("_low"), high.alias("_high"))
    exact = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return each.groupBy(*group).agg(*[F.max(F.when(F.col("_i") == i, exact)).alias(f"p{round(p * 100)}") for i, p in enumerate(points)])
