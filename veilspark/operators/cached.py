"""Result reuse: each distinct text is worked on once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once_per_text(rows: DataFrame, text: str, work: Callable[[Column], Column], out: str) -> DataFrame:
    """Adds ``work(text)``, computed per distinct text and joined back. Worth its two shuffles where texts repeat much and the work is dear.

    A text that holds a large share of the rows meets them in a join with one row on the
    other side, which adaptive execution splits. Null texts keep their rows with null.
    """
    done = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct().withColumn(out, work(F.col("_text")))
    return rows.join(done, rows[text] == done["_text"], "left").select(*rows.columns, out)
