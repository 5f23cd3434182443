"""Frequency of every distinct value or term (problem 6): integer dictionary and blockwise count arrays.

The distinct (field, term) pairs of the collection get integers, dense inside ranges of
``RANGE`` identifiers. Terms are encoded; copies of a record are brought together; each
block of (record, term) rows then adds up arrays of occurrences and of records per
identifier range, and the arrays are summed by range. A block hands its arrays on before
they outgrow ``BLOCK_BYTES``, and only the places that were hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cooccurrence import _SPACE
from .storage import written

RANGE_BITS = 10
RANGE = 1 << RANGE_BITS
#: A dictionary up to this size is broadcast (measured before it is); above, encoding is a shuffled join.
BROADCAST_TERMS, BROADCAST_BYTES = 500_000, 16 << 20
#: What the count arrays of a block may take before they are handed on.
BLOCK_BYTES = 64 << 20


def _clean(field: str):
    return F.lower(F.btrim(F.col(field).cast("string"), F.lit(_SPACE)))


def field_values(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, term): the trimmed, lower-cased values of the fields, nulls left out."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), _clean(f).alias("term")) for f in fields])
    kept = F.filter(entries, lambda e: e["term"].isNotNull())
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.explode(kept).alias("e")).select("id", "e.field", "e.term")


def field_totals(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field, field_records): the records with a non-null value, a row per field that has any.

    One flag per record and field, so no field's rows meet under one key.
    """
    flags = rows.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(*[F.max(F.col(f).isNotNull()).alias(f"f{i}") for i, f in enumerate(fields)])
    counted = flags.agg(*[F.count_if(F.col(f"f{i}")).alias(f"f{i}") for i in range(len(fields))])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("field_records")) for i, f in enumerate(fields)])
    return counted.select(F.explode(each).alias("e")).select("e.*").where("field_records > 0")


def dictionary(values: DataFrame) -> DataFrame:
    """(field, term, n, code): one integer per distinct pair and how many rows hold it, written once so that codes are fixed.

    Codes count up from 0 inside each part of the written dictionary; the part is in the high bits.
    """
    counted = values.groupBy("field", "term").agg(F.count("*").alias("n"))
    return written(counted.withColumn("code", F.monotonically_increasing_id()), "dictionary")


def _encoded(values: DataFrame, codes: DataFrame, broadcast_terms: int = BROADCAST_TERMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, code). A dictionary beyond the bounds is joined in a shuffle, but for the terms that hold over a thousandth of all rows.

    Those are fewer than a thousand, so they are broadcast, and no task gets all rows of a frequent term.
    """
    terms, size, rows = codes.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    table = codes.select("field", "term", "code")
    if terms <= broadcast_terms and 4 * size <= broadcast_bytes:
        return values.join(F.broadcast(table), ["field", "term"]).select("id", "code")
    hot = F.broadcast(codes.where(F.col("n") * 1000 > rows).select("field", "term", "code"))
    marked = values.join(hot, ["field", "term"], "left")
    rest = marked.where("code is null").select("id", "field", "term").join(codes.where(F.col("n") * 1000 <= rows).select("field", "term", "code"), ["field", "term"])
    return marked.where("code is not null").select("id", "code").unionByName(rest.select("id", "code"))


def _count_arrays(block_bytes: int):
    """Adds up blocks of rows (code, copies) into arrays per identifier range."""

    def handed(occurrences: dict[int, np.ndarray], records: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys = list(records)
        places = [np.flatnonzero(records[k]) for k in keys]
        return pa.record_batch(
            [
                pa.array(keys, pa.int64()),
                pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32())),
                pa.array([occurrences[k][p] for k, p in zip(keys, places)], pa.list_(pa.int64())),
                pa.array([records[k][p] for k, p in zip(keys, places)], pa.list_(pa.int64())),
            ],
            names=["part", "places", "occurrences", "records"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[int, np.ndarray] = {}
        records: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            copies = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            codes, copies = codes[order], copies[order]
            ranges, first = np.unique(codes >> RANGE_BITS, return_index=True)
            for r, a, b in zip(ranges.tolist(), first, np.append(first[1:], len(codes))):
                place = codes[a:b] & (RANGE - 1)
                if r not in records:
                    occurrences[r], records[r] = np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)
                occurrences[r] += np.bincount(place, copies[a:b], RANGE).astype(np.int64)
                records[r] += np.bincount(place, minlength=RANGE)
            if len(records) * 16 * RANGE > block_bytes:
                yield handed(occurrences, records)
                occurrences, records = {}, {}
        if records:
            yield handed(occurrences, records)

    return count


def frequencies(tables: list[tuple[DataFrame, str, list[str]]], broadcast_terms: int = BROADCAST_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(field_name, term, occurrences, records, field_records) for every distinct value.

    ``tables`` lists (rows, id column, fields). A record is a distinct id (a null id is one
    record); rows delivered twice add occurrences, not records. Null values don't count;
    an empty string is a value. Empty tables give an empty result.
    """
    values = reduce(DataFrame.unionByName, [field_values(*t) for t in tables])
    totals = reduce(DataFrame.unionByName, [field_totals(*t) for t in tables])
    codes = dictionary(values)
    per_record = _encoded(values, codes, broadcast_terms).groupBy("id", "code").agg(F.count("*").alias("copies"))
    arrays = per_record.select("code", "copies").mapInArrow(_count_arrays(block_bytes), "part long, places array<int>, occurrences array<long>, records array<long>")
    summed = (
        arrays.select("part", F.explode(F.arrays_zip("places", "occurrences", "records")).alias("x"))
        .groupBy((F.shiftleft("part", RANGE_BITS) + F.col("x.places")).alias("code"))
        .agg(F.sum("x.occurrences").alias("occurrences"), F.sum("x.records").alias("records"))
    )
    # A row per field: its size is that of the query.
    return (
        codes.join(summed, "code")
        .join(F.broadcast(totals), "field")
        .select(F.col("field").alias("field_name"), "term", "occurrences", "records", "field_records")
    )


def marked(counts: DataFrame, rare: int = 3, common_share: int = 10) -> DataFrame:
    """Adds ``mark``: 'rare' for at most ``rare`` records, else 'common' for more than 1 / ``common_share`` of the field's records, else null."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * common_share > F.col("field_records"), "common")
    return counts.withColumn("mark", mark)
