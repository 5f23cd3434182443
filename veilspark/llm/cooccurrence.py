"""Items that appear together (problem 5): stripes and log-likelihood ratios.

Each block of baskets gives, per item, an associative array of the items it met and how
often (its stripe; the item's own count is its entry for itself). A block's arrays are
handed on before they outgrow ``FLUSH`` entries, and a huge basket is dealt out to many
tasks. Arrays of one item are merged by key, entry by entry and already before the shuffle,
so what is shuffled is bounded by blocks times distinct pairs, and no merged array has to
fit in one task; ``stripes`` puts them together again as one map per item. Significance is Dunning's log-likelihood ratio over the 2 x 2 table of a pair.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Items a worker holds, in baskets or in stripes, before it hands on its stripes.
FLUSH = 1_000_000
#: Items of a basket whose stripes are built in one piece.
PART = 256
_SPACE = " \t\r\n\f\v "


def clean_item(c: Column) -> Column:
    """Trimmed and lower-cased; blank gives null."""
    return F.nullif(F.lower(F.btrim(c.cast("string"), F.lit(_SPACE))), F.lit(""))


def baskets_of_rows(rows: DataFrame, basket_col: str, item_col: str) -> DataFrame:
    """(items): the distinct items of each non-null basket. Rows of one basket are combined before the shuffle."""
    item = clean_item(F.col(item_col))
    return (
        rows.select(F.col(basket_col).alias("b"), item.alias("i"))
        .where("b is not null and i is not null")
        .groupBy("b")
        .agg(F.collect_set("i").alias("items"))
        .select("items")
    )


def baskets_of_arrays(rows: DataFrame, items_col: str) -> DataFrame:
    """(items): the distinct items of each array; nulls and blanks are dropped, empty baskets don't exist."""
    items = F.array_distinct(F.filter(F.transform(F.col(items_col), clean_item), lambda x: x.isNotNull()))
    return rows.select(items.alias("items")).where("size(items) > 0")


def _stripes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(own, items, first) -> stripes of the items in ``own``; a basket is counted where ``first`` is set."""
    columns = ["item", "neighbours", "counts"]

    def stripes(baskets: Counter) -> Iterator[pd.DataFrame]:
        stripe: dict[str | None, Counter] = defaultdict(Counter)
        size = 0
        for (own, items, first), n in baskets.items():
            if first:
                stripe[None][None] += n  # the number of baskets
            for a in own:
                met = stripe[a]
                before = len(met)
                for b in items:
                    met[b] += n
                size += len(met) - before
                if size > FLUSH:
                    yield pd.DataFrame([(a, list(s), list(s.values())) for a, s in stripe.items()], columns=columns)
                    stripe, size = defaultdict(Counter), 0
        if stripe:
            yield pd.DataFrame([(a, list(s), list(s.values())) for a, s in stripe.items()], columns=columns)

    held: Counter = Counter()
    size = 0
    for pdf in batches:
        for own, items, first in zip(pdf["own"], pdf["items"], pdf["first"]):
            basket = (tuple(sorted(own)), tuple(sorted(items)), bool(first))
            if basket not in held:
                size += len(items)
            held[basket] += 1
        if size >= FLUSH:
            yield from stripes(held)
            held, size = Counter(), 0
    if held:
        yield from stripes(held)


def _dealt(baskets: DataFrame, part: int) -> DataFrame:
    """(own, items, first): a basket of up to ``part`` items as it is; a larger one as several rows, each with a part of its
    items as ``own``, dealt out to all tasks, so that no task works through all pairs of a huge basket."""
    spark = baskets.sparkSession
    small = baskets.where(F.size("items") <= part).select(F.col("items").alias("own"), "items", F.lit(True).alias("first"))
    begins = F.sequence(F.lit(1), F.size("items"), F.lit(part))
    large = baskets.where(F.size("items") > part).select("items", F.explode(begins).alias("at"))
    large = large.select(F.slice("items", F.col("at"), part).alias("own"), "items", (F.col("at") == 1).alias("first"))
    return small.unionByName(large.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _x_log_x(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(0.0)


def merged_entries(baskets: DataFrame, part: int = PART) -> DataFrame:
    """(item, other, n): the entries of all stripes, merged by key; (null, null, n) counts the baskets."""
    partial = _dealt(baskets, part).mapInPandas(_stripes, "item string, neighbours array<string>, counts array<long>")
    return (
        partial.select("item", F.explode(F.arrays_zip("neighbours", "counts")).alias("e"))
        .groupBy("item", F.col("e.neighbours").alias("other"))
        .agg(F.sum("e.counts").alias("n"))
    )


def stripes(baskets: DataFrame, part: int = PART) -> DataFrame:
    """(item, n, neighbours): each item's count and its stripe as a map, for items whose stripe fits a row."""
    entries = merged_entries(baskets, part).where("item is not null")
    own = F.max(F.when(F.col("item") == F.col("other"), F.col("n")))
    met = F.collect_list(F.when(F.col("item") != F.col("other"), F.struct("other", "n")))
    return entries.groupBy("item").agg(own.alias("n"), F.map_from_entries(F.array_sort(met)).alias("neighbours"))


def pairs(baskets: DataFrame, part: int = PART) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, llr) for every pair that met, item_a < item_b.

    ``llr`` is signed: negative where the pair met less often than chance. An empty input
    gives an empty result.
    """
    merged = written(merged_entries(baskets, part), "stripes")
    total = merged.where("item is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    single = merged.where("item = other").select(F.col("item").alias("i"), F.col("n").alias("c"))
    found = merged.where("item < other").select(F.col("item").alias("item_a"), F.col("other").alias("item_b"), F.col("n").alias("n_ab"))
    n = F.lit(float(total))
    a, b, ab = F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.col("n_ab").cast("double")
    table = [ab, a - ab, b - ab, n - a - b + ab]
    cells = sum((_x_log_x(x) for x in table), F.lit(0.0))
    sides = sum((_x_log_x(x) for x in (a, n - a, b, n - b)), F.lit(0.0))
    llr = 2 * (cells - sides + _x_log_x(n))
    return (
        found.join(single.withColumnsRenamed({"i": "item_a", "c": "n_a"}), "item_a")
        .join(single.withColumnsRenamed({"i": "item_b", "c": "n_b"}), "item_b")
        .select(
            "item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(total).cast("bigint").alias("n"),
            (ab * n / (a * b)).alias("lift"),
            F.when(ab * n >= a * b, F.greatest(llr, F.lit(0.0))).otherwise(-F.greatest(llr, F.lit(0.0))).alias("llr"),
        )
    )


def frequent_pairs(found: DataFrame, least_share: int = 100, least_lift: int = 2) -> DataFrame:
    """Pairs in at least 1 / ``least_share`` of the baskets that meet at least ``least_lift`` times as often as chance (whole-number arithmetic)."""
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("n_ab", "n_a", "n_b", "n")}
    return found.where((wide["n_ab"] * least_share >= wide["n"]) & (wide["n_ab"] * wide["n"] >= wide["n_a"] * wide["n_b"] * least_lift))
