"""Registered queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.readers import spread

from . import cooccurrence, copies, leaks, lookalike, pii, reading, sketches, terms, tokens


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_types(lookalike.session_texts(spark, sf_dir), ["src", "rec_id"], "text")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(lookalike.session_texts(spark, sf_dir), ["src", "rec_id"], "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = lookalike.session_texts(spark, sf_dir)
    return lookalike.same_look_pairs(records, "src", "rec_id", "text", lookalike.corpus_table(records, "text"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result as classes: one row per record whose look is also written differently."""
    records = lookalike.session_texts(spark, sf_dir)
    return lookalike.look_classes(records, "src", "rec_id", "text", lookalike.corpus_table(records, "text")).withColumnRenamed("id", "rec_id")


def p2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = lookalike.session_texts(spark, sf_dir)
    return lookalike.normalized(records, "text", "normal", lookalike.corpus_table(records, "text")).select("src", "rec_id", "normal")


_P3_DIMENSIONS = ["day", "entity_type", "policy"]


def _p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lambda c: F.upper(F.trim(c))
    return _table(spark, sf_dir, "pii_detections").select(
        F.to_date("detected_at").alias("day"), clean("entity_type").alias("entity_type"), clean("policy").alias("policy"), "user_id", "session_id"
    )


def p3_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated distinct users and sessions per day, entity type, policy and every combination."""
    return sketches.grouped_counts(_p3_rows(spark, sf_dir), _P3_DIMENSIONS, ["user_id", "session_id"])


def _p3_joint(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    parts = sketches.registers(_p3_rows(spark, sf_dir), [key], ["user_id", "session_id"])
    return sketches.joint(parts, [], key, ["user_id", "session_id"])


def p3_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and Jaccard, with errors, of the users (and sessions) of each two entity types."""
    return _p3_joint(spark, sf_dir, "entity_type")


def p3_overlap_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of each two policies."""
    return _p3_joint(spark, sf_dir, "policy")


def p3_overlap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of each two days."""
    return _p3_joint(spark, sf_dir, "day")


def p3_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of users beside the verdict whether the estimate is within five stated errors (plus one), per type and policy."""
    rows = _p3_rows(spark, sf_dir).where("entity_type is not null and policy is not null")
    estimate = sketches.counts(sketches.registers(rows, ["entity_type", "policy"], ["user_id"]), ["entity_type", "policy"], ["user_id"])
    exact = rows.groupBy("entity_type", "policy").agg(F.countDistinct("user_id").alias("users")).where("users > 0")
    error = F.abs(F.col("estimate") - F.col("users")) <= 1 + 5 * F.col("rel_error") * F.col("users")
    return exact.join(estimate, ["entity_type", "policy"]).select("entity_type", "policy", "users", error.alias("within_bound"))


#: What the test tables say of prompts made of named fields.
_P4_FIELDS = ("task", "tone", "audience", "ref")


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, copies.CopyLedger]:
    records = lookalike.session_texts(spark, sf_dir)
    keyed = copies.written(copies.keyed_records(records, "src", "rec_id", "text", _P4_FIELDS), "copy-keys")
    ledger = copies.CopyLedger(spark)
    for src in ("sample_prompts", "chat_requests"):
        ledger.add(keyed.where(F.col("grp") == src))
    return keyed, ledger


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, ledger = _ledger(spark, sf_dir)
    return copies.copies_of(keyed, ledger.table()).select(F.col("grp").alias("src"), "first_id", "copy_id")


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per set of copies with the number of its copies."""
    _, ledger = _ledger(spark, sf_dir)
    return ledger.table().select(F.col("grp").alias("src"), "first_id", F.col("n").alias("n_copies"))


def _p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = cooccurrence.pairs(cooccurrence.baskets_of_rows(_table(spark, sf_dir, "pii_detections"), "session_id", "entity_type"))
    labels = cooccurrence.pairs(cooccurrence.baskets_of_arrays(_table(spark, sf_dir, "sample_prompts"), "expected_pii"))
    return sessions.select(F.lit("pii_detections").alias("src"), "*").unionByName(labels.select(F.lit("sample_prompts").alias("src"), "*"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.frequent_pairs(_p5_pairs(spark, sf_dir)).select("src", "item_a", "item_b")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with counts, lift and log-likelihood ratio (rounded for comparison)."""
    return _p5_pairs(spark, sf_dir).withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 3) + F.lit(0.0)})


def p5_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity type of the sessions with its count, how many types it meets, and how often in all."""
    rows = cooccurrence.stripes(cooccurrence.baskets_of_rows(_table(spark, sf_dir, "pii_detections"), "session_id", "entity_type"))
    met = F.aggregate(F.map_values("neighbours"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return rows.select("item", "n", F.size("neighbours").alias("neighbours"), met.alias("met"))


def _p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked(
        terms.frequencies([(_table(spark, sf_dir, "pii_detections"), "id", ["entity_type", "policy"]), (_table(spark, sf_dir, "sample_prompts"), "id", ["category"])])
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6_counts(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p6_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6_counts(spark, sf_dir).select("field_name", "term", "occurrences", "records", "mark")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_texts(spark, sf_dir))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts restored from the ids."""
    return tokens.decode(p7_ids(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_redacted, p2_found, p2_classes, p2_normalized, p3_distinct, p3_overlap, p3_overlap_policies, p3_overlap_days, p3_bound, p4_found, p4_collapsed,
            p5_found, p5_pairs, p5_stripes, p6_found, p6_frequencies, p7_ids, p7_decoded, p8_found, p9_found,
        )
    }


_BASKETS = """
with rows as (
  select distinct 'pii_detections' as src, session_id as basket, lower(trim(entity_type)) as item from pii_detections where session_id is not null
  union all
  select distinct 'sample_prompts', id::varchar, lower(trim(u.item)) from (select id, unnest(expected_pii) as item from sample_prompts) u
), items as (select * from rows where item <> ''),
total as (select src, count(distinct basket) as n from items group by src),
single as (select src, item, count(*) as c from items group by src, item),
met as (
  select a.src, a.item as item_a, b.item as item_b, count(*) as n_ab
  from items a join items b on a.src = b.src and a.basket = b.basket and a.item < b.item group by all
), pairs as (
  select m.src, m.item_a, m.item_b, m.n_ab, a.c as n_a, b.c as n_b, t.n
  from met m join total t using (src) join single a on a.src = m.src and a.item = m.item_a join single b on b.src = m.src and b.item = m.item_b
)"""
_TERMS = """
with v as (
  select 'entity_type' as field_name, id, lower(trim(entity_type)) as term from pii_detections
  union all select 'policy', id, lower(trim(policy)) from pii_detections
  union all select 'category', id, lower(trim(category)) from sample_prompts
), kept as (select * from v where term is not null),
total as (select field_name, count(distinct id) as n from kept group by field_name),
c as (select field_name, term, count(*) as occurrences, count(distinct id) as records from kept group by all),
f as (
  select c.*, case when records <= 3 then 'rare' when records * 10 > n then 'common' end as mark from c join total using (field_name)
)"""
_XLX = "case when {0} > 0 then {0} * ln({0}) else 0 end"


def _llr_sql() -> str:
    cells = " + ".join(_XLX.format(f"({x})::double") for x in ("n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab"))
    sides = " + ".join(_XLX.format(f"({x})::double") for x in ("n_a", "n - n_a", "n_b", "n - n_b"))
    llr = f"greatest(0, 2 * ({cells} - ({sides}) + {_XLX.format('n::double')}))"
    return f"round(case when n_ab * n >= n_a * n_b then {llr} else -{llr} end, 3) + 0.0"


_GRAMS = r"""
with grams as (
  select src, id, array_to_string(w[k:k + 11], ' ') as g from (
    select src, id, w, unnest(generate_series(1, len(w) - 11)) as k from (
      select 'd' as src, doc_id as id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') as w from documents where text is not null
      union all select 'i', item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') from benchmark where text is not null
    )
  )
) select distinct d.id as doc_id, i.id as item_id from grams d join grams i on d.g = i.g where d.src = 'd' and i.src = 'i'"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_bound": """
            select upper(trim(entity_type)) as entity_type, upper(trim(policy)) as policy, count(distinct user_id) as users, true as within_bound
            from pii_detections where policy is not null group by 1, 2 having count(distinct user_id) > 0""",
        "p5_found": _BASKETS + " select src, item_a, item_b from pairs where n_ab * 100 >= n and n_ab * n >= 2 * n_a * n_b",
        "p5_pairs": _BASKETS + f" select src, item_a, item_b, n_ab, n_a, n_b, n, round(n_ab::double * n / (n_a::double * n_b), 6) as lift, {_llr_sql()} as llr from pairs",
        "p5_stripes": _BASKETS
        + """, s as (select item_a as item, n_ab, n_a as n from pairs where src = 'pii_detections' union all select item_b, n_ab, n_b from pairs where src = 'pii_detections')
            select single.item, c as n, count(n_ab)::int as neighbours, coalesce(sum(n_ab), 0)::bigint as met from single left join s using (item) where src = 'pii_detections' group by all""",
        "p6_found": _TERMS + " select field_name, term, mark from f where mark is not null",
        "p6_frequencies": _TERMS + " select field_name, term, occurrences, records, mark from f",
        "p8_found": _GRAMS,
        "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    }
