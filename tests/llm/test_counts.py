"""Sketches, co-occurrence and term frequencies against exact counts and edge cases."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import cooccurrence, sketches, terms


def test_estimates_keep_the_stated_error(spark):
    df = spark.range(0, 40_000).select((F.col("id") % 4).cast("string").alias("g"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("u"), F.lit(None).cast("string").alias("n"))
    parts = sketches.registers(df, ["g"], ["u", "n"])
    for r in sketches.counts(parts, ["g"], ["u", "n"]).collect():
        assert r["what"] == "u" and abs(r["estimate"] / 10_000 - 1) < 4 * r["rel_error"]


def test_merging_is_idempotent_and_equals_one_pass(spark):
    df = spark.range(0, 3000).select(F.lit("x").alias("g"), F.col("id").cast("string").alias("u"))
    whole = sketches.registers(df, ["g"], ["u"])
    halves = sketches.registers(df.where("u < 1500"), ["g"], ["u"]).unionByName(sketches.registers(df.where("u >= 1400"), ["g"], ["u"])).unionByName(whole)
    a = sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, sketches.merge(halves, ["g"]).collect())) == a


def test_grouped_counts_of_small_and_dirty_rows(spark):
    rows = [("d1", "A", "u1"), ("d1", "A", "u1"), ("d1", "B", "u2"), ("d2", None, "u3"), (None, "A", "u4"), ("d2", "A", None)]
    df = spark.createDataFrame(rows, "d string, t string, u string")
    out = {(r["grouping"], r["d"], r["t"]): round(r["estimate"]) for r in sketches.grouped_counts(df, ["d", "t"], ["u"]).collect()}
    assert out == {("d,t", "d1", "A"): 1, ("d,t", "d1", "B"): 1, ("d", "d1", None): 2, ("d", "d2", None): 1, ("t", None, "A"): 2, ("t", None, "B"): 1, ("all", None, None): 4}
    assert sketches.grouped_counts(df.limit(0), ["d", "t"], ["u"]).count() == 0


def test_joint_estimates():
    m, base, rng = 1024, 1.2, np.random.default_rng(4)

    def sketch(n):
        k = np.zeros(m, int)
        v = np.maximum(np.floor(1 - np.log(rng.random(n)) / math.log(base)), 1).astype(int)
        np.maximum.at(k, rng.integers(0, m, n), v)
        return k

    a, b, c = sketch(6000), sketch(3000), sketch(4000)
    union, both, jaccard, error = sketches.joint_estimate(np.maximum(a, c), np.maximum(b, c), m, base)
    assert abs(union / 13_000 - 1) < 0.12 and abs(jaccard - 4 / 13) < 4 * error and abs(both / 4000 - 1) < 0.2
    assert sketches.joint_estimate(np.zeros(m, int), a, m, base)[1:] == (0.0, 0.0, 0.0)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["s%d" % i for i in range(60)] + [None]), rng.choice([" Email", "EMAIL ", "phone", "SSN", "iban", None, " "])) for _ in range(400)]
    got = {(r["item_a"], r["item_b"]): r for r in cooccurrence.pairs(cooccurrence.baskets_of_rows(spark.createDataFrame(rows, "b string, i string"), "b", "i")).collect()}
    baskets = {}
    for b, i in rows:
        if b and i and i.strip():
            baskets.setdefault(b, set()).add(i.strip().lower())
    single = Counter(x for s in baskets.values() for x in s)
    met = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    assert {p: r["n_ab"] for p, r in got.items()} == dict(met)
    n = len(baskets)
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"], r["n"]) == (single[a], single[b], n)
        t = [met[a, b], single[a] - met[a, b], single[b] - met[a, b], n - single[a] - single[b] + met[a, b]]
        e = [single[a] * single[b] / n, single[a] * (n - single[b]) / n, (n - single[a]) * single[b] / n, (n - single[a]) * (n - single[b]) / n]
        assert abs(abs(r["llr"]) - 2 * sum(x * math.log(x / y) for x, y in zip(t, e) if x)) < 1e-6


def test_baskets_of_arrays(spark):
    df = spark.createDataFrame([([" A", "b", "a", None],), ([],), (None,), (["", " "],)], "x array<string>")
    assert [sorted(r["items"]) for r in cooccurrence.baskets_of_arrays(df, "x").collect()] == [["a", "b"]]
    assert cooccurrence.pairs(cooccurrence.baskets_of_arrays(df.limit(0), "x")).count() == 0


def test_term_counts_equal_plain_counts(spark):
    rng = random.Random(9)
    rows = [(rng.randint(1, 300), rng.choice([" A", "a", "B", None, "", "t%d" % rng.randint(0, 2000)])) for _ in range(3000)]
    rows += rows[:200]
    out = terms.marked(terms.frequencies([(spark.createDataFrame(rows, "id bigint, v string"), "id", ["v"])])).collect()
    clean = [(i, v.strip().lower()) for i, v in rows if v is not None]
    occurrences, records = Counter(v for _, v in clean), Counter(v for _, v in set(clean))
    total = len({i for i, _ in clean})
    assert {r["term"]: (r["occurrences"], r["records"]) for r in out} == {v: (occurrences[v], records[v]) for v in records}
    assert {r["field_records"] for r in out} == {total}
    for r in out:
        want = "rare" if r["records"] <= 3 else "common" if r["records"] * 10 > total else None
        assert r["mark"] == want


def test_terms_of_empty_tables(spark):
    df = spark.createDataFrame([], "id bigint, v string")
    assert terms.frequencies([(df, "id", ["v"])]).count() == 0


def test_joint_of_keys(spark):
    rows = spark.range(0, 12_000).select(F.explode(F.array(F.when(F.col("id") < 8000, "a"), F.when(F.col("id") >= 4000, "b"), F.lit(None))).alias("key"), F.col("id").cast("string").alias("u"))
    out = sketches.joint(sketches.registers(rows, ["key"], ["u"]), [], "key", ["u"]).collect()
    assert [(r["key_a"], r["key_b"]) for r in out] == [("a", "b")]
    assert abs(out[0]["jaccard_est"] - 1 / 3) < 4 * out[0]["jaccard_error"] and abs(out[0]["union_est"] / 12_000 - 1) < 0.13


def test_union_and_intersection_keep_their_stated_errors():
    m, base, rng = 1024, 1.2, np.random.default_rng(8)

    def sketch(n):
        k = np.zeros(m, int)
        v = np.maximum(np.floor(1 - np.log(rng.random(n)) / math.log(base)), 1).astype(int)
        np.maximum.at(k, rng.integers(0, m, n), v)
        return k

    for na, nb, nc in [(6000, 3000, 4000), (8000, 8000, 20), (5000, 200, 0), (50_000, 20_000, 10_000)] * 3:
        a, b, c = sketch(na), sketch(nb), sketch(nc)
        union, both, _, _, union_error, both_error = sketches.joint_estimates(np.maximum(a, c), np.maximum(b, c), m, base)
        assert 0 < union_error < union / 3 and abs(union - (na + nb + nc)) < 3.5 * union_error
        assert 0 < both_error and abs(both - nc) < 3.5 * both_error


def test_joint_of_policies_and_days(spark, tmp_path):
    from veilspark.llm import queries

    rows = [(f"2026-01-0{1 + i % 3} 10:00:00", "EMAIL", f"p{i % 2}", f"u{i % 40}", f"s{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "detected_at string, entity_type string, policy string, user_id string, session_id string")
    df.withColumn("detected_at", F.to_timestamp("detected_at")).write.parquet(str(tmp_path / "pii_detections.parquet"))
    for name, key, pairs in (("p3_overlap_policies", "policy", 1), ("p3_overlap_days", "day", 3)):
        out = queries.queries()[name](spark, str(tmp_path)).collect()
        assert len(out) == 2 * pairs and all(r[f"{key}_a"] < r[f"{key}_b"] and r["union_error"] > 0 for r in out)


def test_hot_terms_and_small_blocks_change_nothing(spark):
    rows = [(i % 300, "hot" if i % 3 == 0 else f"t{i % 170}", None if i % 11 == 0 else f"p{i % 2}") for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    plain = {tuple(r) for r in terms.frequencies([(df, "id", ["a", "b"])]).collect()}
    assert plain == {tuple(r) for r in terms.frequencies([(df, "id", ["a", "b"])], broadcast_terms=3, block_bytes=1).collect()}
    want = {}
    for f, k in (("a", 1), ("b", 2)):
        total = len({r[0] for r in rows if r[k] is not None})
        for t in {r[k] for r in rows} - {None}:
            want[f, t] = (sum(r[k] == t for r in rows), len({r[0] for r in rows if r[k] == t}), total)
    assert {(r[0], r[1]): tuple(r[2:]) for r in plain} == want


def test_huge_baskets_are_dealt_out(spark):
    rng = random.Random(8)
    baskets = [[f"i{k}" for k in rng.sample(range(40), rng.choice([1, 2, 3, 35]))] for _ in range(60)]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in cooccurrence.pairs(df, part=7).collect()}
    single = {x: sum(x in b for b in baskets) for b in baskets for x in b}
    want = {}
    for x in single:
        for y in single:
            n = sum(x in b and y in b for b in baskets)
            if x < y and n:
                want[x, y] = (n, single[x], single[y], 60)
    assert got == want
    rows = {r["item"]: (r["n"], dict(r["neighbours"])) for r in cooccurrence.stripes(df, part=7).collect()}
    assert {k: v[0] for k, v in rows.items()} == single and all(rows[x][1][y] == want[x, y][0] for x, y in want)


def test_joint_errors_hold_over_a_grid():
    """Full likelihood: over bases, sizes and overlaps the deviations are those of one standard error."""
    rng = np.random.default_rng(12)
    for base in (1.05, 1.2, 2.0):
        m = 1024

        def sketch(n, m=m, base=base):
            k = np.zeros(m, int)
            v = np.minimum(np.maximum(np.floor(1 - np.log(rng.random(n)) / math.log(base)), 1), sketches.limit_for(base)).astype(int)
            np.maximum.at(k, rng.integers(0, m, n), v)
            return k

        off = []
        for x, y, z in [(5000, 5000, 500), (3000, 8000, 6000), (100, 100, 30_000), (50, 2000, 30), (20_000, 10_000, 3000)] * 12:
            c = sketch(z)
            union, both, jaccard, jaccard_error, union_error, both_error = sketches.joint_estimates(np.maximum(sketch(x), c), np.maximum(sketch(y), c), m, base)
            off.append(((union - x - y - z) / union_error, (both - z) / both_error, (jaccard - z / (x + y + z)) / jaccard_error))
        off = np.array(off)
        assert (np.abs(off) < 2).mean() > 0.92 and np.abs(off).max() < 4.5


def test_joint_takes_any_base_and_refuses_too_many_keys(spark):
    import pytest

    rows = spark.range(0, 6000).select(F.explode(F.array(F.when(F.col("id") < 4000, "a"), F.when(F.col("id") >= 2000, "b"))).alias("key"), F.col("id").cast("string").alias("u"))
    parts = sketches.registers(rows, ["key"], ["u"], base=1.02)
    assert sketches.limit_for(1.02) > 255
    out = sketches.joint(parts, [], "key", ["u"], base=1.02).first()
    assert abs(out["jaccard_est"] - 1 / 3) < 4 * out["jaccard_error"]
    with pytest.raises(ValueError, match="at most 1"):
        sketches.joint(parts, [], "key", ["u"], base=1.02, max_keys=1)
