"""Request-rate limits over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fixed_window(requests: DataFrame, who: str, stamp: str, order: str, limit: int, burst: int = 0, window: str = "minute", trusted: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``allowed`` and ``remaining``: the first limit + burst requests of an identity in each window pass.

    ``remaining`` leaves the burst out. Trusted identities and rows without an identity are
    not limited (allowed, remaining null). Partitions are (identity, window), so no task
    holds an identity's whole history.
    """
    bucket = F.date_trunc(window, F.col(stamp))
    w = Window.partitionBy(who, bucket).orderBy(stamp, order)
    free = F.col(who).isNull() | (F.col(who).isin(*trusted) if trusted else F.lit(False))
    ranked = requests.withColumn("_n", F.row_number().over(w))
    used = F.least("_n", F.lit(limit + burst))
    return ranked.withColumns(
        {"allowed": free | (F.col("_n") <= limit + burst), "remaining": F.when(~free, F.greatest(F.lit(0), F.lit(limit) - used))}
    ).drop("_n")


def idle_gap_sessions(requests: DataFrame, who: str, stamp: str, gap: str = "60 seconds") -> DataFrame:
    """(identity, started, ended, hits): counters that only end after an idle gap, as a re-armed expiry makes them.

    Counters are built per identity and day, so an identity with very many requests is many tasks' work; only the
    first and last counter of each day can go on over midnight, and only those are joined.
    """
    at = F.col(stamp).cast("timestamp")
    known = requests.where(F.col(who).isNotNull() & F.col(stamp).isNotNull())
    # A session window takes what comes exactly at its end; a counter has expired by then.
    until = f"{gap} -1 microseconds"
    counted = [F.count("*").alias("hits"), F.min(stamp).alias("started"), F.max(stamp).alias("ended")]
    if known.isStreaming:
        return known.groupBy(who, F.session_window(at, until).alias("s")).agg(*counted).select(who, "started", "ended", "hits")
    daily = known.groupBy(who, F.to_date(stamp).alias("_day"), F.session_window(at, until).alias("s")).agg(*counted).select(who, "_day", "started", "ended", "hits")
    of_day = Window.partitionBy(who, "_day").orderBy("started")
    placed = daily.withColumns({"_first": F.lag("started").over(of_day).isNull(), "_last": F.lead("started").over(of_day).isNull()})
    inner = placed.where("not _first and not _last").select(who, "started", "ended", "hits")
    of_identity = Window.partitionBy(who).orderBy("started")
    edges = placed.where("_first or _last")
    apart = F.coalesce(F.col("started").cast("timestamp") >= F.lag("ended").over(of_identity).cast("timestamp") + F.expr(f"interval {gap}"), F.lit(True)) | ~F.col("_first")
    joined = edges.withColumn("_new", apart).withColumn("_run", F.sum(F.col("_new").cast("int")).over(of_identity))
    whole = joined.groupBy(who, "_run").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("hits").alias("hits"))
    return inner.unionByName(whole.select(who, "started", "ended", "hits"))


def per_second(requests: DataFrame, stamp: str, limit: int) -> DataFrame:
    """(second, requests, rejected): tumbling seconds; rejected requests count too."""
    counted = requests.where(F.col(stamp).isNotNull()).groupBy(F.date_trunc("second", F.col(stamp)).alias("second")).agg(F.count("*").alias("requests"))
    return counted.withColumn("rejected", F.greatest(F.lit(0), F.col("requests") - limit))


def quota(requests: DataFrame, who: str, stamp: str, now, limit: int, window: str = "minute") -> DataFrame:
    """(identity, used, remaining) in the window that holds ``now``."""
    current = F.date_trunc(window, F.col(stamp)) == F.date_trunc(window, now)
    return requests.where(current & F.col(who).isNotNull()).groupBy(who).agg(F.count("*").alias("used")).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))
