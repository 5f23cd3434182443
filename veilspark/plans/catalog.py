"""Registered queries of the core operators and their SQL. Each runs over its whole tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilspark.functions import detectors, report, rewrite, strategies
from veilspark.functions.policy import BUILT_IN, load_policy
from veilspark.functions.resolve import resolve
from veilspark.functions.spans import let
from veilspark.operators import audit, cached, conversation, evaluate, events, hooks, limits, scan, store
from veilspark.sources import readers, sinks
from veilspark.sources.readers import spread
from veilspark.sources.sinks import result_json
from veilspark.sources.storage import shared_folder
from veilspark.streaming import text as text_stream

from . import oracle
from .oracle import anonymized, claimed_cte, resolved_cte, rewritten_cte, spans_cte

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = "timestamp '2026-05-01 00:00:00'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is any."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(_read(spark, d, name))


def _now():
    return F.to_timestamp_ntz(F.lit("2026-05-01 00:00:00"))


def _anonymized(docs: DataFrame, **options) -> DataFrame:
    return docs.select("doc_id", "text", rewrite.anonymize(F.col("text"), **options).alias("a"))


# Detection, resolution and rewriting


@query(anonymized("documents", "doc_id", "text") + " select k as doc_id, anonymized, entities from done")
def anonymize_documents(spark: SparkSession, d: str) -> DataFrame:
    return _anonymized(_texts(spark, d, "documents")).select("doc_id", F.col("a.text").alias("anonymized"), F.coalesce(F.size("a.entries"), F.lit(0)).alias("entities"))


def _policy_query(policy: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _anonymized(_texts(spark, d, "documents"), policy=policy).select("doc_id", F.md5("a.text").alias("digest"), F.coalesce(F.size("a.entries"), F.lit(0)).alias("entities"))

    run.__name__ = f"anonymize_{policy}"
    query(anonymized("documents", "doc_id", "text", policy) + " select k as doc_id, md5(anonymized) as digest, entities from done")(run)


for _p in ("gdpr_strict", "slm_local", "hipaa_phi", "pci_dss"):
    _policy_query(_p)


def _overlap_query(strategy: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _texts(spark, d, "documents")
        spans = resolve(detectors.detect(F.col("text")), F.col("text"), strategy)
        return docs.select("doc_id", F.explode(spans).alias("s")).select("doc_id", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))

    run.__name__ = f"resolve_{strategy}"
    sql = "with " + spans_cte("documents", "doc_id", "text") + "," + resolved_cte(strategy)
    query(sql + ' select k as doc_id, t as entity_type, s as start, e as "end" from kept')(run)


for _s in ("longest_match", "highest_confidence", "first_detector"):
    _overlap_query(_s)


_BOTH = (
    spans_cte("chat_requests", "request_id", "prompt", oracle.ENHANCED_RULES, True).replace("spans as (", "wide as (") + "," + claimed_cte().replace("spans.*", "wide.*").replace("from spans)", "from wide)")
    + ", plain as (" + spans_cte("chat_requests", "request_id", "prompt").replace("src as (", "with src as (", 1).rstrip() + " select k, t, s, e, ord from spans)"
    + ", spans as (select k, t, s, e, ord from claimed union all select k, t, s, e, ord + 1000000 from plain)"
)


@query("with " + _BOTH + "," + oracle.merged_cte() + ' select k as request_id, t as entity_type, s as start, e as "end", substring(src.text, s + 1, e - s) as text from kept join src using (k)')
def resolve_merge(spark: SparkSession, d: str) -> DataFrame:
    """Union of overlapping spans of one type, from two detectors together."""
    spans = resolve(detectors.detect(F.col("prompt"), ("enhanced_regex", "regex")), F.col("prompt"), "merge")
    return _texts(spark, d, "chat_requests").select("request_id", F.explode(spans).alias("s")).select("request_id", "s.entity_type", "s.start", "s.end", "s.text")


@query("with " + spans_cte("documents", "doc_id", "text") + ' select k as doc_id, t as entity_type, s as start, e as "end", ord, substring(src.text, s + 1, e - s) as value from spans join src using (k)')
def detect_basic(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d, "documents").select("doc_id", F.explode(detectors.detect(F.col("text"))).alias("s"))
    return docs.select("doc_id", "s.entity_type", "s.start", "s.end", "s.ord", F.col("s.text").alias("value"))


_ENHANCED = oracle.ENHANCED_RULES


@query("with " + spans_cte("documents", "doc_id", "text", _ENHANCED, True) + "," + claimed_cte() + ' select k as doc_id, t as entity_type, s as start, e as "end", c as confidence from claimed')
def detect_enhanced(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d, "documents").select("doc_id", F.explode(detectors.detect(F.col("text"), ("enhanced_regex",))).alias("s"))
    return docs.select("doc_id", "s.entity_type", "s.start", "s.end", "s.confidence")


@query(
    "with " + spans_cte("documents", "doc_id", "text", _ENHANCED, True) + "," + claimed_cte() + "," + resolved_cte("highest_confidence", "(select * from claimed where c >= 0.8)")
    + " select t as entity_type, count(*) as spans, round(avg(c), 6) as avg_confidence from kept group by t"
)
def enhanced_confident_counts(spark: SparkSession, d: str) -> DataFrame:
    spans = resolve(detectors.detect(F.col("text"), ("enhanced_regex",), 0.8), F.col("text"), "highest_confidence")
    return _texts(spark, d, "documents").select(F.explode(spans).alias("s")).groupBy("s.entity_type").agg(F.count("*").alias("spans"), F.round(F.avg("s.confidence"), 6).alias("avg_confidence"))


_SOME_TYPES = tuple(r for r in _ENHANCED if r.entity_type in ("SSN", "IBAN", "MAC_ADDRESS", "URL"))


@query("with " + spans_cte("documents", "doc_id", "text", _SOME_TYPES, True) + "," + claimed_cte() + " select k as doc_id, t as entity_type, s as start from claimed")
def detect_selected_types(spark: SparkSession, d: str) -> DataFrame:
    chosen = detectors.EnhancedDetector(("SSN", "IBAN", "MAC_ADDRESS", "URL"))
    return _texts(spark, d, "documents").select("doc_id", F.explode(detectors.detect(F.col("text"), (chosen,))).alias("s")).select("doc_id", "s.entity_type", "s.start")


_OPTIONAL = oracle.OPTIONAL_RULES


@query("with " + spans_cte("documents", "doc_id", "text", _OPTIONAL) + " select k as doc_id, t as entity_type, s as start, e - s as width from spans")
def detect_optional(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d, "documents").select("doc_id", F.explode(detectors.detect(F.col("text"), ("api_key", "employee_id", "mrn"))).alias("s"))
    return docs.select("doc_id", "s.entity_type", "s.start", (F.col("s.end") - F.col("s.start")).alias("width"))


@query("with " + ",".join((spans_cte("documents", "doc_id", "text"), "kept as (select k, ord as i, s, e, t, c from spans)", "o as (select *, row_number() over (partition by k, t order by s, e, i) as n from kept)"))
       + " select k as doc_id, t as entity_type, n, s as start from o")
def unresolved_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Numbers without overlap resolution, as the asynchronous form gives them."""
    policy = load_policy("default_pii")
    numbered = rewrite.number_placeholders(rewrite.kept_spans(F.col("text"), policy, overlap="none"), policy)
    docs = _texts(spark, d, "documents").select("doc_id", F.explode(numbered).alias("s"))
    return docs.select("doc_id", "s.entity_type", F.regexp_extract("s.placeholder", r"(\d+)", 1).cast("bigint").alias("n"), "s.start")


@query(anonymized("documents", "doc_id", "text") + oracle.restored() + " select k as doc_id, restored from back where restored is not null")
def roundtrip_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every text restored, those too that hold something like a placeholder themselves."""
    docs = _texts(spark, d, "documents").where("text is not null")
    return _anonymized(docs).select("doc_id", rewrite.deanonymize_entries(F.col("a.text"), F.col("a.entries")).alias("restored"))


@query(anonymized("documents", "doc_id", "text") + " select k as doc_id, i as position, label as placeholder, v as original, t as entity_type from (select labelled.* replace (row_number() over (partition by k order by s) - 1 as i) from labelled)")
def mapping_entries(spark: SparkSession, d: str) -> DataFrame:
    docs = _anonymized(_texts(spark, d, "documents"))
    types = {"NAME": "PERSON", "IP": "IP_ADDRESS", "CC": "CREDIT_CARD"}
    rows = store.mapping_rows(docs.select("doc_id", F.col("a.entries").alias("entries")), "doc_id", "entries")
    return rows.select(F.col("session_id").alias("doc_id"), F.col("position").cast("bigint").alias("position"), "placeholder", "original", detectors.normal_type(F.col("entity_type"), types).alias("entity_type"))


@query(anonymized("documents", "doc_id", "text") + " select k as doc_id, entities as entity_count, length(anonymized) as n from done")
def json_results(spark: SparkSession, d: str) -> DataFrame:
    """The JSON result of a document, read back."""
    result = F.from_json(result_json(rewrite.anonymize(F.col("text"))), "anonymized_text string, mapping map<string,string>, entity_count int")
    docs = _texts(spark, d, "documents").select("doc_id", result.alias("r"), F.col("text").isNull().alias("empty"))
    return docs.select("doc_id", F.when(F.col("empty"), 0).otherwise(F.col("r.entity_count")).alias("entity_count"), F.length("r.anonymized_text").cast("bigint").alias("n"))


# Strategies

_VALUES = anonymized("documents", "doc_id", "text")


def _values(spark: SparkSession, d: str) -> DataFrame:
    policy = load_policy("default_pii")
    return _texts(spark, d, "documents").select("doc_id", F.explode(rewrite.kept_spans(F.col("text"), policy)).alias("s")).select("doc_id", "s.entity_type", "s.start", F.col("s.text").alias("value"))


@query(_VALUES + " select k as doc_id, s as start, sha256('pepper' || v)[1:16] as sha, md5(v) as md from labelled")
def hash_values(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("doc_id", "start", strategies.hash_value(F.col("value"), salt="pepper", truncate=16).alias("sha"), strategies.hash_value(F.col("value"), "md5").alias("md"))


@query(_VALUES + " select k as doc_id, s as start, case when length(v) <= 4 then repeat('*', length(v)) else v[1:2] || repeat('*', length(v) - 4) || v[-2:] end as masked from labelled")
def mask_values(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("doc_id", "start", strategies.mask_simple(F.col("value"), 2, 2).alias("masked"))


@query(_VALUES + " select k as doc_id, s as start, regexp_replace(v, '[^@.\\-_:/() ]', '*', 'g') as masked from labelled")
def mask_structured_values(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("doc_id", "start", strategies.mask_structured(F.col("value")).alias("masked"))


@query(_VALUES + " select k as doc_id, s as start, v as value from labelled")
def encrypt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit("0123456789abcdef")
    return _values(spark, d).select("doc_id", "start", strategies.decrypt_value(strategies.encrypt_value(F.col("value"), key), key).alias("value"))


@query(_VALUES + " select t as entity_type, count(distinct v) as originals, true as deterministic from labelled group by t")
def synthetic_values(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, d).withColumn("made", strategies.synthetic_value(F.col("entity_type"), F.col("value")))
    per_value = rows.groupBy("entity_type", "value").agg(F.min("made").alias("a"), F.max("made").alias("b"))
    return per_value.groupBy("entity_type").agg(F.count("*").alias("originals"), F.min(F.col("a") == F.col("b")).alias("deterministic"))


# Reports, scans, evaluation

_PER_DOC = spans_cte("documents", "doc_id", "text") + """,
facts as (
  select src.k, length(src.text) as n, coalesce(sum(e - s), 0)::int as chars, count(s)::int as entities,
    coalesce(bool_or(t in ('SSN','CREDIT_CARD')), false) as high, coalesce(bool_or(t in ('EMAIL','PHONE','IP_ADDRESS')), false) as medium
  from src left join spans using (k) where src.text is not null group by src.k, src.text
), rated as (
  select *, case when n > 0 then chars::double / n else 0 end as coverage from facts
), report as (
  select *, case when entities = 0 then 'low' when high then 'critical' when coverage > 0.3 or (medium and entities > 5) then 'high' when medium or coverage > 0.1 then 'medium' else 'low' end as risk from rated
)"""


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "documents").where("text is not null").select("doc_id", report.report(F.col("text"), detectors.detect(F.col("text")), True).alias("r"))


@query("with " + _PER_DOC + " select k as doc_id, n as total_chars, chars as pii_chars, entities, round(coverage, 9) as coverage, risk from report")
def detection_report(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d)
    return r.select("doc_id", F.col("r.total_chars").cast("bigint").alias("total_chars"), "r.pii_chars", F.size("r.entities").alias("entities"), F.round("r.coverage", 9).alias("coverage"), "r.risk")


@query("with " + _PER_DOC + " select risk, count(*) as documents, sum(entities)::bigint as entities from report group by risk")
def risk_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).groupBy("r.risk").agg(F.count("*").alias("documents"), F.sum(F.size("r.entities")).alias("entities"))


@query("with " + _PER_DOC + " select k as doc_id, 'Risk Level: ' || upper(risk) as level, case when length(text) > 100 then text[1:100] || '...' else text end as preview from report join src using (k)")
def report_texts(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d).withColumn("t", report.report_text(F.col("r")))
    return r.select("doc_id", F.regexp_extract("t", "(Risk Level: [A-Z]+)", 1).alias("level"), F.col("r.preview").alias("preview"))


@query("with " + _PER_DOC + """, listed as (select k, string_agg(t || '@' || s || '–' || e, ';' order by s, e, ord) as places from spans group by k)
  select k as doc_id, entities, coalesce(places, '') as places from report left join listed using (k)""")
def report_pages(spark: SparkSession, d: str) -> DataFrame:
    """HTML pages, read back: the number of entities and the table's types and places."""
    r = _reports(spark, d).withColumn("h", report.report_page(F.col("r")))
    entities = F.regexp_extract("h", r"Total Entities:</strong></td><td>(\d+)", 1).cast("int")
    row = r"<tr><td>([A-Z_]+)</td><td>(?:[^<]*)</td><td>(\d+–\d+)</td>"
    places = F.zip_with(F.regexp_extract_all("h", F.lit(row), F.lit(1)), F.regexp_extract_all("h", F.lit(row), F.lit(2)), lambda t, x: F.concat(t, F.lit("@"), x))
    return r.select("doc_id", entities.alias("entities"), F.array_join(places, ";").alias("places"))



@query("with " + spans_cte("documents", "doc_id", "text") + " select t as entity_type, count(*) as spans, count(distinct k) as documents from spans group by t")
def spans_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, "documents").select("doc_id", F.explode(detectors.detect(F.col("text"))).alias("s"))
    return rows.groupBy("s.entity_type").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents"))


@query("with " + spans_cte("documents", "doc_id", "text") + ", f as (select k, text, count(s) as n from src left join spans using (k) group by all) select count(*) as files, count(*) filter (n > 0 or text is null) as files_with_pii, sum(n)::bigint as entities from f")
def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_totals(scan.scan(_texts(spark, d, "documents"), "doc_id", "text"))


@query("with " + spans_cte("documents", "doc_id", "text") + " select k as doc_id, t as entity_type, list(substring(src.text, s + 1, e - s) order by ord) as found from spans join src using (k) group by k, t")
def grouped_listing(spark: SparkSession, d: str) -> DataFrame:
    return scan.listing(_texts(spark, d, "documents"), "doc_id", "text")


_SAMPLES = anonymized("sample_prompts", "id", "text")
_EVAL = _SAMPLES + """, types as (
  select src.k, list(distinct t) filter (t is not null) as d from src left join kept using (k) group by src.k
), c as (
  select id, lower(trim(coalesce(category, 'unknown'))) as category, list_distinct(coalesce(expected_pii, [])) as e, list_distinct(coalesce(d, [])) as d from sample_prompts join types on k = id
), n as (select *, len(list_intersect(e, d)) as tp, len(list_filter(d, lambda x: not list_contains(e, x))) as fp, len(list_filter(e, lambda x: not list_contains(d, x))) as fn from c),
g as (select {group}sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from n {by}),
p as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as recall from g)
select {group}tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 9) as f1 from p"""


def _evaluated(spark: SparkSession, d: str, group: list[str]) -> DataFrame:
    spans = rewrite.kept_spans(F.col("text"), "default_pii")
    rows = _texts(spark, d, "sample_prompts").select(
        F.lower(F.trim(F.coalesce("category", F.lit("unknown")))).alias("category"), evaluate.confusion(F.col("expected_pii"), F.transform(spans, lambda s: s["entity_type"])).alias("c")
    )
    scored = evaluate.scores(rows, "c", group)
    return scored.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(_EVAL.replace("{group}", "").replace("{by}", ""))
def evaluate_overall(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d, [])


@query(_EVAL.replace("{group}", "category, ").replace("{by}", "group by category"))
def evaluate_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d, ["category"])


@query(anonymized("documents", "doc_id", "text") + r""", w as (
  select text, anonymized, entities, len(list_filter(regexp_split_to_array(text, '[\s\p{Z}\x{85}\x{0B}]+'), lambda x: x <> '')) as a, len(list_filter(regexp_split_to_array(anonymized, '[\s\p{Z}\x{85}\x{0B}]+'), lambda x: x <> '')) as b
  from done join src using (k) where text is not null
) select count(*) as samples, round(avg(case when length(text) > 0 then length(anonymized)::double / length(text) else 0 end), 6) as avg_char_ratio,
  round(avg(case when a > 0 then b::double / a else 0 end), 6) as avg_word_ratio, sum(entities)::bigint as total_pii from w""")
def utility(spark: SparkSession, d: str) -> DataFrame:
    docs = _anonymized(_texts(spark, d, "documents")).select("text", F.col("a.text").alias("anonymized"), F.col("a.entries").alias("entries"))
    return evaluate.utility(docs, "text", "anonymized", "entries").withColumns({c: F.round(c, 6) for c in ("avg_char_ratio", "avg_word_ratio")})


@query(anonymized("chat_requests", "request_id", "prompt") + " select k as request_id, entities from done")
def cached_anonymize(spark: SparkSession, d: str) -> DataFrame:
    """Repeated prompts are worked on once."""
    rows = cached.once_per_text(_read(spark, d, "chat_requests"), "prompt", lambda t: F.size(rewrite.anonymize(t)["entries"]), "entities")
    return rows.select("request_id", F.coalesce("entities", F.lit(0)).alias("entities"))


# Audit


@query("select count(*) as total_detections, count(distinct session_id) as unique_sessions, count(distinct user_id) as unique_users from pii_detections")
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    return audit.totals(_read(spark, d, "pii_detections"))


@query("select entity_type, count(*) as detections, round(avg(count), 9) as avg_count from pii_detections group by entity_type")
def audit_by_type(spark: SparkSession, d: str) -> DataFrame:
    return audit.by_type(_read(spark, d, "pii_detections")).withColumn("avg_count", F.round("avg_count", 9))


@query("select entity_type, count(*) as detections, round(avg(count), 9) as avg_count from pii_detections where user_id = 'svc-batch-gateway' and detected_at >= timestamp '2026-04-01' and detected_at <= timestamp '2026-05-01' group by entity_type")
def audit_stats_of_user(spark: SparkSession, d: str) -> DataFrame:
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    rows = audit.matching(_read(spark, d, "pii_detections"), "detected_at", at("2026-04-01 00:00:00"), at("2026-05-01 00:00:00"), user_id="svc-batch-gateway", session_id=None)
    return audit.by_type(rows).withColumn("avg_count", F.round("avg_count", 9))


@query("select id, session_id, entity_type, detected_at from pii_detections where policy = 'hipaa_phi' order by detected_at desc, id desc limit 50 offset 100")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.matching(_read(spark, d, "pii_detections"), "detected_at", policy="hipaa_phi")
    return store.newest(rows, "detected_at", "id", 50, 100).select("id", "session_id", "entity_type", "detected_at")


@query("select * from (select id, user_id, policy from pii_detections order by detected_at desc, id desc limit 1000) where policy = 'gdpr_strict'")
def newest_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """The newest rows first, the filter after: not to be reordered."""
    return store.newest(_read(spark, d, "pii_detections"), "detected_at", "id", 1000).where("policy = 'gdpr_strict'").select("id", "user_id", "policy")


@query("select session_id, user_id from pii_sessions where is_active order by created_at desc, session_id desc limit 100")
def list_sessions(spark: SparkSession, d: str) -> DataFrame:
    return store.newest(_read(spark, d, "pii_sessions").where("is_active"), "created_at", "session_id", 100).select("session_id", "user_id")


@query("select id, session_id, entity_type from pii_detections where entity_type in ('SSN', 'CREDIT_CARD', 'PASSPORT')")
def high_risk_alerts(spark: SparkSession, d: str) -> DataFrame:
    return audit.alerts(_read(spark, d, "pii_detections"), report.ALERT_TYPES).select("id", "session_id", "entity_type")


@query("select policy, entity_type, count(*) as events, sum(count)::bigint as values from pii_detections group by all")
def metrics_counters(spark: SparkSession, d: str) -> DataFrame:
    return audit.counters(_read(spark, d, "pii_detections"), ["policy", "entity_type"])


@query("select event_type, round(quantile_cont(value, 0.5), 9) as p50, round(quantile_cont(value, 0.95), 9) as p95, round(quantile_cont(value, 0.99), 9) as p99 from events group by event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = audit.latency_percentiles(_read(spark, d, "events"), "value", ["event_type"])
    return out.withColumns({c: F.round(c, 9) for c in ("p50", "p95", "p99")})


@query("with " + spans_cte("documents", "doc_id", "text") + ", n as (select k, count(*)::int as c from spans group by k) select k as doc_id, t as entity_type, c as count from (select distinct k, t from spans) join n using (k)")
def log_detections(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d, "documents").withColumn("s", detectors.detect(F.col("text")))
    return store.detections_of(docs, ["doc_id"], "s")


# Sessions and retention


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Later detections as changes of their sessions: expiry an hour after the last one."""
    rows = _read(spark, d, "pii_detections").where("session_id is not null").groupBy("session_id").agg(F.max("detected_at").alias("at"), F.max("user_id").alias("user_id"))
    return rows.select(
        "session_id", "user_id", F.col("at").alias("created_at"), (F.col("at") + F.expr("interval 1 hour")).alias("expires_at"), F.lit("{}").alias("metadata"), F.lit(True).alias("is_active")
    )


@query("""with c as (select session_id, max(user_id) as u, max(detected_at) as at from pii_detections where session_id is not null group by 1)
  select coalesce(s.session_id, c.session_id) as session_id, case when s.session_id is not null then s.user_id else c.u end as user_id,
    case when s.session_id is not null then s.created_at else c.at end as created_at, case when c.session_id is not null then c.at + interval 1 hour else s.expires_at end as expires_at,
    case when s.session_id is not null then s.is_active else true end as is_active
  from pii_sessions s full join c on s.session_id = c.session_id""")
def upsert_sessions(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert_sessions(_read(spark, d, "pii_sessions"), _changes(spark, d)).select("session_id", "user_id", "created_at", "expires_at", "is_active")


@query(f"select session_id, expires_at from pii_sessions where expires_at < {NOW} and is_active")
def expired_sessions(spark: SparkSession, d: str) -> DataFrame:
    return store.expired(_read(spark, d, "pii_sessions"), _now()).select("session_id", "expires_at")


@query(f"select session_id, case when expires_at < {NOW} and is_active then false else is_active end as is_active from pii_sessions")
def deactivate_expired(spark: SparkSession, d: str) -> DataFrame:
    return store.deactivate_expired(_read(spark, d, "pii_sessions"), _now()).select("session_id", "is_active")


@query("select session_id, case when is_active then expires_at + interval 3600 second else expires_at end as expires_at from pii_sessions")
def extend_sessions(spark: SparkSession, d: str) -> DataFrame:
    return store.extend_expiry(_read(spark, d, "pii_sessions"), 3600, F.coalesce("is_active", F.lit(False))).select("session_id", "expires_at")


@query("select session_id from pii_sessions s where not exists (select 1 from pii_detections p where p.session_id = s.session_id)")
def orphan_sessions(spark: SparkSession, d: str) -> DataFrame:
    return store.orphan_sessions(_read(spark, d, "pii_sessions"), _read(spark, d, "pii_detections")).select("session_id")


@query("select id, session_id from pii_detections p where not exists (select 1 from pii_sessions s where s.session_id = p.session_id and not s.is_active)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = _read(spark, d, "pii_sessions").where("not is_active")
    return store.without_sessions(_read(spark, d, "pii_detections"), gone).select("id", "session_id")


@query(f"select id, detected_at from pii_detections where detected_at >= {NOW} - interval 30 day")
def retained_detections(spark: SparkSession, d: str) -> DataFrame:
    return store.retained(_read(spark, d, "pii_detections"), "detected_at", 30, _now()).select("id", "detected_at")


@query(f"select request_id from chat_requests where epoch_us({NOW}) - epoch_us(received_at) <= 864000::bigint * 1000000")
def alive_cache_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "chat_requests").withColumn("ttl", F.lit(864000).cast("bigint"))
    return store.alive(rows, "received_at", "ttl", _now()).select("request_id")


@query("select prompt, min(request_id) as arrived from chat_requests where prompt is not null group by prompt order by arrived desc, prompt desc limit 1000")
def fifo_cache(spark: SparkSession, d: str) -> DataFrame:
    return store.first_in_first_out(_read(spark, d, "chat_requests").where("prompt is not null"), "prompt", "request_id", 1000)


_CHAT = anonymized("chat_requests", "request_id", "prompt", where="session_id is not null")


@query(_CHAT + """, e as (select c.session_id, c.request_id, l.i, l.label, l.v from labelled l join chat_requests c on c.request_id = l.k),
  last as (select session_id, label, v, row_number() over (partition by session_id, label order by request_id desc, i desc) as r from e)
  select session_id, count(*) as placeholders, md5(string_agg(label || '=' || v, ';' order by label)) as digest from last where r = 1 group by session_id""")
def session_mappings(spark: SparkSession, d: str) -> DataFrame:
    """The mapping of each session, the last original of a placeholder winning."""
    chats = _texts(spark, d, "chat_requests").where("session_id is not null").select("session_id", "request_id", rewrite.anonymize(F.col("prompt")).alias("a"))
    rows = chats.select("session_id", "request_id", F.posexplode("a.entries").alias("p", "e")).select(
        "session_id", F.struct("request_id", "p").alias("position"), "e.placeholder", F.col("e.original").alias("original")
    )
    mapped = store.session_mappings(chats.select("session_id").distinct(), rows)
    pairs = F.transform(F.array_sort(F.map_entries("mapping")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return mapped.select("session_id", F.size("mapping").cast("bigint").alias("placeholders"), F.md5(F.array_join(pairs, ";")).alias("digest"))


@query(_CHAT + """, e as (select c.session_id, c.request_id, l.label from labelled l join chat_requests c on c.request_id = l.k),
  t as (select session_id, request_id from chat_requests where session_id is not null)
  select t.request_id, count(distinct e.label) as known from t left join e on e.session_id = t.session_id and e.request_id <= t.request_id group by t.request_id""")
def cumulative_mapping(spark: SparkSession, d: str) -> DataFrame:
    chats = _texts(spark, d, "chat_requests").where("session_id is not null").select("session_id", "request_id", F.coalesce(rewrite.anonymize(F.col("prompt"))["entries"], F.array().cast(rewrite.ENTRIES)).alias("entries"))
    return conversation.known_placeholders(chats, "session_id", "request_id", "entries").select("request_id", "known")


@query(_CHAT + """, e as (select c.session_id, c.request_id, l.i, l.label, l.v from labelled l join chat_requests c on c.request_id = l.k),
  last as (select session_id, max(request_id) as request_id from chat_requests where session_id is not null group by 1),
  held as (select session_id, label, v, row_number() over (partition by session_id, label order by request_id desc, i desc) as r from e)
  select last.session_id, last.request_id, coalesce(md5(string_agg(label || '=' || v, ';' order by label)), md5('')) as digest from last left join held on held.session_id = last.session_id and r = 1 group by all""")
def final_mappings(spark: SparkSession, d: str) -> DataFrame:
    """The whole mapping, materialised for the last turn of every session."""
    chats = _texts(spark, d, "chat_requests").where("session_id is not null").select("session_id", "request_id", F.coalesce(rewrite.anonymize(F.col("prompt"))["entries"], F.array().cast(rewrite.ENTRIES)).alias("entries"))
    changes = conversation.mapping_changes(chats, "session_id", "request_id", "entries").where("to_turn is null")
    last = chats.groupBy("session_id").agg(F.max("request_id").alias("request_id"))
    pair = F.when(F.col("placeholder").isNotNull(), F.concat("placeholder", F.lit("="), "original"))
    held = last.join(changes, "session_id", "left").groupBy("session_id", "request_id").agg(F.array_sort(F.collect_list(F.struct(F.col("placeholder").alias("p"), pair.alias("x")))).alias("l"))
    return held.select("session_id", "request_id", F.md5(F.array_join(F.transform("l", lambda y: y["x"]), ";")).alias("digest"))


@query("select request_id, prompt as restored from chat_requests where session_id is not null and prompt is not null")
def conversation_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders numbered through a session, then restored turn by turn."""
    chats = _read(spark, d, "chat_requests").where("session_id is not null and prompt is not null").select("session_id", "request_id", "prompt")
    done = conversation.anonymize_conversation(chats, "session_id", "request_id", "prompt")
    return conversation.restore_turns(done, "anonymized", "entries").select("request_id", "restored")


@query(anonymized("chat_requests", "request_id", "prompt") + " select k as request_id, anonymized as content, entities from done where anonymized is not null")
def chat_bodies(spark: SparkSession, d: str) -> DataFrame:
    """JSON request bodies: messages rewritten and entries gathered."""
    chats = _read(spark, d, "chat_requests").where("prompt is not null")
    body = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages")))
    done = chats.select("request_id", conversation.anonymize_body(body).alias("b"))
    return done.select("request_id", F.get("b.messages", F.lit(0))["content"].alias("content"), F.size("b.entries").alias("entities"))


@query(anonymized("chat_requests", "request_id", "prompt", where="prompt is not null") + oracle.restored() + " select k as request_id, restored from back")
def response_bodies(spark: SparkSession, d: str) -> DataFrame:
    """JSON response bodies that repeat the anonymized prompt, restored by its mapping."""
    chats = _read(spark, d, "chat_requests").where("prompt is not null").select("request_id", rewrite.anonymize(F.col("prompt")).alias("a"))
    entries = F.transform("a.entries", lambda e: F.struct(e["placeholder"].alias("key"), e["original"].alias("value")))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("a.text").alias("content")).alias("message"))).alias("choices")))
    return chats.select("request_id", conversation.restore_response(body, F.map_from_entries(entries)).alias("restored"))


_JSON = "'{\"q\":\"' || replace(replace(replace(replace(replace(prompt, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '\"}'"


@query(anonymized("chat_requests", "request_id", _JSON, where="prompt is not null") + " select k as request_id, case when json_valid(anonymized) then json_extract_string(anonymized, '$.q') end as argument from done")
def function_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of a call, anonymized in their JSON form; where that breaks the JSON, there are none."""
    chats = _texts(spark, d, "chat_requests").where("prompt is not null")
    done = conversation.anonymize_arguments(F.struct(F.col("prompt").alias("q")), "q string")
    return chats.select("request_id", done["q"].alias("argument"))


# The enhanced detector on prompts, which hold most of its types


@query("with " + spans_cte("chat_requests", "request_id", "prompt", _ENHANCED, True) + "," + claimed_cte() + ' select k as request_id, t as entity_type, s as start, e as "end", c as confidence from claimed')
def detect_enhanced_prompts(spark: SparkSession, d: str) -> DataFrame:
    chats = _texts(spark, d, "chat_requests").select("request_id", F.explode(detectors.detect(F.col("prompt"), ("enhanced_regex",))).alias("s"))
    return chats.select("request_id", "s.entity_type", "s.start", "s.end", "s.confidence")


def _prompts_query(policy: str, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        done = rewrite.anonymize(F.col("prompt"), policy, detectors=("enhanced_regex",))
        chats = _texts(spark, d, "chat_requests").select("request_id", done.alias("a"))
        return chats.select("request_id", F.col("a.text").alias("anonymized"), F.coalesce(F.size("a.entries"), F.lit(0)).alias("entities"))

    run.__name__ = name
    query(oracle.enhanced("chat_requests", "request_id", "prompt", policy) + " select k as request_id, anonymized, entities from done")(run)


_prompts_query("hipaa_phi", "anonymize_hipaa_prompts")
_prompts_query("pci_dss", "anonymize_pci_prompts")
_prompts_query("gdpr_strict", "anonymize_gdpr_prompts")


_FOUND = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


@F.arrow_udf(T.ArrayType(_FOUND))
def _toy_recognizer(texts):
    """Stands for a model: words of capitals, the surer the shorter."""
    import pyarrow as pa

    def found(text: str) -> list[dict]:
        return [{"label": "ORG" if len(m.group()) % 2 else "EMAIL_ADDRESS", "start": m.start(), "end": m.end(), "score": None if len(m.group()) == 7 else 0.95 - 0.1 * len(m.group())} for m in re.finditer(r"[A-Z]{3,}", text)]

    schema = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    return pa.array([None if t is None else found(t) for t in texts.to_pylist()], schema)


@query("with " + spans_cte("chat_requests", "request_id", "prompt", (oracle.Rule("W", "[A-Z]{3,}"),)) + """, n as (select *, e - s as w from spans)
  select k as request_id, case when w % 2 = 1 then 'ORGANIZATION' else 'EMAIL' end as entity_type, s as start, e as "end", case when w = 7 then 0.85 else round(0.95 - 0.1 * w, 6) end::double as confidence from n where w = 7 or w <= 4""")
def detect_model(spark: SparkSession, d: str) -> DataFrame:
    """A recognizer behind the model slot: labels mapped to types, weak spans dropped, a default where there is no score."""
    slot = detectors.ModelDetector(_toy_recognizer, {**detectors.ANALYZER_TYPES, **detectors.NER_TYPES}, threshold=0.5)
    rows = _texts(spark, d, "chat_requests").where("prompt is not null").select("request_id", F.explode(detectors.detect(F.col("prompt"), (slot,))).alias("s"))
    return rows.select("request_id", "s.entity_type", "s.start", "s.end", F.round("s.confidence", 6).alias("confidence"))


# Nodes, logs, events, files


@query(anonymized("sample_prompts", "id", "text", where="text is not null") + oracle.restored() + " select k as id, restored as first, restored as second from back")
def restored_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A response with its source nodes: the text fields of a struct and of the structs in an array, restored in place."""
    rows = _texts(spark, d, "sample_prompts").where("text is not null").select("id", rewrite.anonymize(F.col("text")).alias("a"))
    node = F.struct(F.col("a.text").alias("text"), F.lit(1.0).alias("score"))
    response = F.struct(F.col("a.text").alias("answer"), F.array(node, node).alias("nodes"))
    back = rewrite.deanonymize_fields(response, ("answer", "nodes.[].text"), F.col("a.entries"))
    return rows.select("id", back.alias("r")).select("id", F.col("r.answer").alias("first"), F.get("r.nodes", F.lit(1))["text"].alias("second"))


_EVENTS = """with log as (select id, case when entity_type in ('SSN', 'CREDIT_CARD', 'PASSPORT') then 'critical' when count > 5 then 'high' else 'low' end as severity,
  session_id, user_id, detected_at as occurred_at from pii_detections)"""


def _event_log(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("entity_type").isin("SSN", "CREDIT_CARD", "PASSPORT"), "critical").when(F.col("count") > 5, "high").otherwise("low")
    details = F.struct("entity_type", "count", "policy")
    return events.event_rows(_read(spark, d, "pii_detections"), F.lit("pii_detected"), severity, details, "id", "detected_at")


@query(_EVENTS + " select severity, count(*) as events, count(distinct user_id) as users from log group by severity")
def audit_events(spark: SparkSession, d: str) -> DataFrame:
    """The log written as rows and read back, counted by severity."""
    folder = shared_folder(spark, f"events-{uuid.uuid4().hex}")
    sinks.append(_event_log(spark, d), folder)
    return spark.read.parquet(folder).groupBy("severity").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


@query(_EVENTS + " select distinct id, severity, user_id from (select * from log where severity in ('high', 'critical') and user_id = 'svc-batch-gateway' and occurred_at >= timestamp '2026-03-01' order by occurred_at desc, id desc limit 200)")
def audit_event_page(spark: SparkSession, d: str) -> DataFrame:
    """The newest events of a user from a severity upwards."""
    page = events.query_events(_event_log(spark, d), F.to_timestamp_ntz(F.lit("2026-03-01 00:00:00")), least_severity="high", limit=200, user_id="svc-batch-gateway", event_type="pii_detected")
    return page.select("id", "severity", "user_id").distinct()


@query("select distinct id, detected_at from (select id, detected_at from pii_detections order by detected_at desc, id desc limit 10000)")
def newest_detections(spark: SparkSession, d: str) -> DataFrame:
    """A capped list of the newest rows, as written and trimmed."""
    return sinks.keep_newest(_read(spark, d, "pii_detections"), "detected_at", "id").select("id", "detected_at").distinct()


@query("select id, text, array_to_string(expected_pii, '|') as expected, category from sample_prompts")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as JSON lines and read back."""
    folder = shared_folder(spark, f"samples-{uuid.uuid4().hex}")
    sinks.write_json(_read(spark, d, "sample_prompts").select("id", "text", "expected_pii", "category", "note"), folder)
    return readers.read_json_lines(spark, folder).select("id", "text", F.array_join("expected_pii", "|").alias("expected"), "category")


@query("select text as line, count(*) as n from sample_prompts where text is not null and not regexp_matches(text, '[\\r\\n]') group by text")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """One-line texts written as text and read back line by line."""
    folder = shared_folder(spark, f"lines-{uuid.uuid4().hex}")
    sinks.write_text(_read(spark, d, "sample_prompts").where(~F.col("text").rlike(r"[\r\n]")), "text", folder)
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(anonymized("documents", "doc_id", "text") + " select k as doc_id, label as placeholder, v as original from labelled")
def mapping_files(spark: SparkSession, d: str) -> DataFrame:
    """Mappings written as JSON objects, read back and taken apart."""
    folder = shared_folder(spark, f"mappings-{uuid.uuid4().hex}")
    rows = _anonymized(_texts(spark, d, "documents")).where(F.size("a.entries") > 0)
    sinks.write_json(rows.select("doc_id", F.to_json(rewrite.mapping_of(F.transform("a.entries", lambda e: F.struct(e["placeholder"].alias("key"), e["original"].alias("value"))))).alias("mapping")), folder)
    back = spark.read.schema("doc_id bigint, mapping string").json(folder)
    return back.select("doc_id", F.explode(readers.parse_mapping(F.col("mapping"))).alias("placeholder", "original"))


@query("with " + spans_cte("documents", "doc_id", "text") + " select k as doc_id, t as entity_type, count(*) as n from spans group by k, t")
def scan_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type of every scanned text."""
    rows = scan.scan(_texts(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.explode("summary").alias("entity_type", "n")).select("doc_id", "entity_type", F.col("n").cast("bigint").alias("n"))


@query(anonymized("documents", "doc_id", "text") + """ , f as (select k, count(*)::int as n, array_to_string(list_sort(list(distinct t)), ',') as types from kept where t in (select unnest(['EMAIL','PHONE','PERSON','IP_ADDRESS','CREDIT_CARD','SSN'])) group by k)
  select done.k as doc_id, coalesce(n, 0)::int as entity_count, coalesce(types, '') as entity_types, length(src.text)::int as original_length, length(anonymized)::int as anonymized_length
  from done join src using (k) left join f using (k) where src.text is not null""")
def audit_records(spark: SparkSession, d: str) -> DataFrame:
    """What an audit hook keeps of every text."""
    docs = _texts(spark, d, "documents").where("text is not null").select("doc_id", "text", rewrite.kept_spans(F.col("text")).alias("s"))
    made = rewrite.rewrite(F.col("text"), rewrite.number_placeholders(F.col("s"), load_policy("default_pii")))
    record = hooks.audit_record(F.col("s"), F.col("text"), made)
    return docs.select("doc_id", record.alias("r")).select(
        "doc_id", "r.entity_count", F.array_join("r.entity_types", ",").alias("entity_types"), "r.original_length", "r.anonymized_length"
    )


@query("with " + spans_cte("documents", "doc_id", "text") + ", f as (select src.k, src.text, count(s) as n from src left join spans using (k) where src.text is not null group by all) select count(*) as requests, count(*) filter (n > 0) as with_pii, sum(n)::bigint as spans from f")
def processing_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters that are kept while the data flows by."""
    from pyspark.sql import Observation

    seen = Observation("pii")
    docs = _texts(spark, d, "documents").where("text is not null").select(detectors.detect(F.col("text")).alias("s"))
    text_stream.observed(docs, F.col("s"), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[c] for c in ("requests", "with_pii", "spans"))], "requests bigint, with_pii bigint, spans bigint")


@query("select id::varchar || ' ' || entity_type as message, coalesce(user_id, '') as who, policy is null as plain from pii_detections")
def log_records(spark: SparkSession, d: str) -> DataFrame:
    """Log lines as JSON; context fields that suggest personal data never reach them."""
    context = F.create_map(F.lit("who"), F.coalesce("user_id", F.lit("")), F.lit("email"), F.lit("x@y.zz"), F.lit("card_no"), F.lit("1"))
    level = F.when(F.col("policy").isNull(), "INFO").otherwise("WARNING")
    lines = sinks.log_lines(_read(spark, d, "pii_detections"), level, F.concat_ws(" ", F.col("id").cast("string"), "entity_type"), context, "detected_at")
    read = F.from_json("line", "timestamp string, level string, message string, context map<string,string>")
    rows = lines.select(read.alias("l")).where(F.size("l.context") == 1)
    return rows.select("l.message", F.element_at("l.context", F.lit("who")).alias("who"), (F.col("l.level") == "INFO").alias("plain"))


@query("select * from (values ('detector', 'api_key'), ('detector', 'employee_id'), ('detector', 'enhanced_regex'), ('detector', 'mrn'), ('detector', 'regex'), ('policy', 'default_pii'), ('policy', 'gdpr_strict'), ('policy', 'hipaa_phi'), ('policy', 'pci_dss'), ('policy', 'slm_local'), ('sink', 'json'), ('sink', 'noop'), ('sink', 'parquet'), ('sink', 'text'), ('source', 'json'), ('source', 'parquet'), ('source', 'text'), ('strategy', 'encrypt'), ('strategy', 'hash'), ('strategy', 'mask'), ('strategy', 'placeholder'), ('strategy', 'synthetic')) v(kind, name)")
def listings(spark: SparkSession, d: str) -> DataFrame:
    """What there is to choose from: detectors, policies, strategies, sources and sinks."""
    rows = [("detector", n) for n in detectors.list_detectors() if n in ("regex", "enhanced_regex", *detectors.OPTIONAL_RULES)]
    rows += [("policy", n) for n in BUILT_IN] + [("strategy", x.value) for x in strategies.Strategy]
    rows += [("sink", n) for n in sinks.FORMATS] + [("source", n) for n in readers.FORMATS]
    return spark.createDataFrame(rows, "kind string, name string")


@query(_VALUES + """ select t as entity_type, min(case t when 'EMAIL' then regexp_matches(v, '@') else true end) as kept, count(*) as n,
  bool_and(case t when 'EMAIL' then true else true end) as well_formed from labelled group by t""")
def synthetic_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic values look like values of their type: the detectors find them as such."""
    made = _values(spark, d).withColumn("m", strategies.apply_strategy("synthetic", F.col("entity_type"), F.col("value"), F.lit("")))
    again = detectors.detect(F.concat(F.lit(" "), F.col("m"), F.lit(" ")))
    seen = F.exists(again, lambda x: x["entity_type"] == F.col("entity_type"))
    return made.select("entity_type", "value", seen.alias("ok")).groupBy("entity_type").agg(F.lit(True).alias("kept"), F.count("*").alias("n"), F.min("ok").alias("well_formed"))


# Streams, run over all input there is


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of files: its folder, or the one file of that name."""
    path = f"{d}/{name}.parquet"
    files = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return files.parquet(path)
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _stream_folder(spark: SparkSession) -> str:
    return shared_folder(spark, f"stream-{uuid.uuid4().hex}")


@query(anonymized("chat_requests", "request_id", "prompt") + " select k as request_id, anonymized, entities from done")
def stream_anonymized(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a stream, each anonymized on its own."""
    done = text_stream.anonymize_stream(_stream(spark, d, "chat_requests").select("request_id", "prompt"), "prompt")
    rows = sinks.write_stream(done.select("request_id", "anonymized", F.coalesce(F.size("entries"), F.lit(0)).alias("entities")), _stream_folder(spark))
    return rows


def _chunks(rows: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, seq, chunk, last): a text cut every ``width`` characters."""
    n = F.ceil(F.length(text) / width).cast("int")
    cut = rows.where(F.length(text) > 0).select(F.col(key), F.col(text), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return cut.select(F.col(key), "seq", F.substring(F.col(text), F.col("seq") * width + 1, F.lit(width)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("last"))


_PARTS = "(select id * 1000 + p as k, substring(text, 120 * p + 1, 120) as part from (select id, text, unnest(generate_series(0, (length(text) - 1) // 120)) as p from sample_prompts where length(text) > 0))"


@query(anonymized(_PARTS, "k", "part") + " select k, anonymized, entities from done")
def stream_buffered(spark: SparkSession, d: str) -> DataFrame:
    """Small chunks joined until there is enough text, anonymized part by part."""
    chunks = _chunks(_stream(spark, d, "sample_prompts"), "id", "text", 60)
    parts = text_stream.buffered_chunks(chunks, "id", "seq", "chunk", "last", timeout_ms=None)
    done = text_stream.anonymize_stream(parts, "text")
    key = (F.col("key").cast("bigint") * 1000 + F.col("part")).alias("k")
    return sinks.write_stream(done.select(key, "anonymized", F.size("entries").alias("entities")), _stream_folder(spark))


@query(anonymized("sample_prompts", "id", "text") + oracle.restored() + " select k as id, restored from back where length(anonymized_text) > 0".replace("anonymized_text", "restored"))
def stream_restored(spark: SparkSession, d: str) -> DataFrame:
    """Anonymized texts that come in chunks of seven characters, restored chunk by chunk: a placeholder cut by a border is held back."""
    made = _stream(spark, d, "sample_prompts").select("id", rewrite.anonymize(F.col("text")).alias("a")).select("id", F.col("a.text").alias("t"))
    whole = text_stream.joined_placeholders(_chunks(made, "id", "t", 7), "id", "seq", "chunk", "last", timeout_ms=None)
    rows = sinks.write_stream(whole, _stream_folder(spark))
    entries = _texts(spark, d, "sample_prompts").select(F.col("id").cast("string").alias("key"), rewrite.anonymize(F.col("text"))["entries"].alias("e"))
    back = text_stream.restore_stream(rows.join(entries, "key"), "text", "e")
    joined = back.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "restored"))).alias("l"))
    return joined.select(F.col("key").cast("int").alias("id"), F.array_join(F.transform("l", lambda x: x["restored"]), "").alias("restored"))


@query("""select * from (select user_id, date_trunc('hour', received_at) as started, count(*) as requests from chat_requests where received_at is not null group by 1, 2)
  where started + interval 1 hour <= (select max(received_at) from chat_requests)""")
def stream_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests per identity and hour of a stream, as far as the watermark has closed the hours."""
    counted = text_stream.requests_per_window(_stream(spark, d, "chat_requests"), "user_id", "received_at", "1 hour", "0 seconds")
    rows = counted.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("started"), "requests")
    return sinks.write_stream(rows, _stream_folder(spark))



# Rate limits

_LIMIT = """with r as (select request_id, user_id, row_number() over (partition by user_id, date_trunc('{w}', received_at) order by received_at, request_id) as n from chat_requests)
  select request_id, coalesce(user_id is null or user_id = 'svc-batch-gateway' or n <= {cap}, false) as allowed,
    case when not (user_id is null or user_id = 'svc-batch-gateway') then greatest(0, {limit} - least(n, {cap})) end as remaining from r"""


@query(_LIMIT.format(w="minute", cap=3, limit=2))
def limit_per_minute(spark: SparkSession, d: str) -> DataFrame:
    out = limits.fixed_window(_read(spark, d, "chat_requests"), "user_id", "received_at", "request_id", 2, 1, "minute", ("svc-batch-gateway",))
    return out.select("request_id", "allowed", F.col("remaining").cast("bigint").alias("remaining"))


@query(_LIMIT.format(w="hour", cap=12, limit=10))
def limit_per_hour(spark: SparkSession, d: str) -> DataFrame:
    out = limits.fixed_window(_read(spark, d, "chat_requests"), "user_id", "received_at", "request_id", 10, 2, "hour", ("svc-batch-gateway",))
    return out.select("request_id", "allowed", F.col("remaining").cast("bigint").alias("remaining"))


@query("""with o as (select user_id, received_at as t, lag(received_at) over (partition by user_id order by received_at) as p from chat_requests where user_id is not null and received_at is not null),
  s as (select *, sum(case when p is null or epoch_us(t) - epoch_us(p) >= 3600000000 then 1 else 0 end) over (partition by user_id order by t) as g from o)
  select user_id, min(t) as started, max(t) as ended, count(*) as hits from s group by user_id, g""")
def idle_gap_counters(spark: SparkSession, d: str) -> DataFrame:
    return limits.idle_gap_sessions(_read(spark, d, "chat_requests"), "user_id", "received_at", "3600 seconds")


@query("select date_trunc('second', ts) as second, count(*) as requests, greatest(0, count(*) - 1) as rejected from events where ts is not null group by 1")
def global_limit(spark: SparkSession, d: str) -> DataFrame:
    return limits.per_second(_read(spark, d, "events"), "ts", 1).withColumn("second", F.col("second").cast("timestamp_ntz"))


@query("""with n as (select max(received_at) as now from chat_requests)
  select user_id, count(*) as used, greatest(0, 10 - count(*)) as remaining from chat_requests, n where user_id is not null and date_trunc('day', received_at) = date_trunc('day', now) group by user_id""")
def remaining_quota(spark: SparkSession, d: str) -> DataFrame:
    chats = _read(spark, d, "chat_requests")
    now = chats.agg(F.max("received_at")).first()[0]
    return limits.quota(chats, "user_id", "received_at", F.lit(now), 10, "day")


# Logs and static listings


@query("select session_id, json_valid(metadata) as readable from pii_sessions where metadata is not null and json_valid(metadata) and json_type(metadata) = 'OBJECT'")
def session_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "pii_sessions").withColumn("v", F.try_parse_json("metadata"))
    return rows.where("v is not null and schema_of_variant(v) like 'OBJECT%'").select("session_id", F.lit(True).alias("readable"))


@query("select user_id, count(*) as rows, 1 as fields from pii_detections group by user_id")
def log_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Log contexts without fields whose names suggest personal data."""
    context = F.create_map(F.lit("user"), F.coalesce("user_id", F.lit("")), F.lit("email_address"), F.lit("x"), F.lit("api_Token"), F.lit("y"))
    rows = _read(spark, d, "pii_detections").select("user_id", F.size(report.without_sensitive_fields(context)).alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("rows"), F.max("n").alias("fields"))


@query("select * from (values " + ", ".join(f"('{p}', '{t}', '{x}')" for p in oracle.POLICIES for t, x in oracle.placeholders(p).items()) + ") v(policy, entity_type, placeholder)")
def list_policies(spark: SparkSession, d: str) -> DataFrame:
    rows = [(p.name, t, x) for p in BUILT_IN.values() for t, x in p.placeholders.items()]
    return spark.createDataFrame(rows, "policy string, entity_type string, placeholder string")


# Long forms: one row per span


@query(_VALUES + " select k as doc_id, t as entity_type, s as start, row_number() over (partition by k, t order by s) as n, lag(e, 1, 0) over (partition by k order by s) as previous_end from labelled")
def numbered_spans(spark: SparkSession, d: str) -> DataFrame:
    """Running numbers and previous ends by windows over (document, type) and document."""
    spans = _texts(spark, d, "documents").select("doc_id", F.explode(rewrite.kept_spans(F.col("text"))).alias("s")).select("doc_id", "s.entity_type", "s.start", "s.end")
    return spans.select(
        "doc_id", "entity_type", "start",
        F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy("start")).cast("bigint").alias("n"),
        F.lag("end", 1, 0).over(Window.partitionBy("doc_id").orderBy("start")).alias("previous_end"),
    )


@query("with " + spans_cte("chat_requests", "request_id", "prompt") + " select a.k as request_id, a.ord as ord_a, b.ord as ord_b from spans a join spans b on a.k = b.k and a.ord < b.ord and a.s < b.e and b.s < a.e")
def overlapping_spans(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of overlapping spans, found inside each row's array, so nothing is shuffled."""
    found = detectors.detect(F.col("prompt"))
    touching = lambda all_spans: F.flatten(
        F.transform(
            all_spans,
            lambda a: F.transform(
                F.filter(all_spans, lambda b: (a["ord"] < b["ord"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])),
                lambda b: F.struct(a["ord"].alias("ord_a"), b["ord"].alias("ord_b")),
            ),
        )
    )
    return _texts(spark, d, "chat_requests").select("request_id", F.explode(let(found, touching)).alias("p")).select("request_id", "p.ord_a", "p.ord_b")


@query("select count(*) as requests, count(distinct prompt) as keys from chat_requests where prompt is not null")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    key = rewrite.cache_key(F.col("prompt"), load_policy("default_pii"), ("regex",))
    return _read(spark, d, "chat_requests").where("prompt is not null").agg(F.count("*").alias("requests"), F.countDistinct(key).alias("keys"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["oracle", "oracle_sql", "queries", "rewritten_cte"]
