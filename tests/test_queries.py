"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import datetime
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (datetime.datetime, datetime.date)) or v is None:
        return str(v)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", ["anonymize_documents", "resolve_longest_match", "audit_by_type", "upsert_sessions", "limit_per_minute", "evaluate_by_category", "session_mappings", "resolve_merge", "anonymize_hipaa_prompts", "stream_buffered", "stream_restored", "restored_nodes", "function_arguments", "report_pages", "latency_percentiles"])
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    want = duck.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in columns]
    assert got == sorted([plain(r[i]) for i in order] for r in want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
