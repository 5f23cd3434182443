"""SQL that computes spans, overlap resolution and rewriting without the library, for DuckDB.

Letters outside ASCII are folded to underscores first (same length), because the SQL
engine's word boundary knows ASCII only, and full-width digits become nines, which no pattern names
(or underscores, where a pattern lists plain digits); other Unicode digits and spaces are spelled out.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    """A pattern as the SQL engine's dialect has it; the library's own lists are not read here."""

    entity_type: str
    pattern: str
    priority: int = 100
    ignore_case: bool = False


# Patterns of the basic detector in emission order.
BASIC_RULES = (
    Rule("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Rule("PHONE", r"\+?\d[\d\-\s]{7,}\d"),
    Rule("PERSON", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"),
    Rule("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    Rule("CREDIT_CARD", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    Rule("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
)
# Patterns of the enhanced detector by falling priority.
ENHANCED_RULES = (
    Rule("EMAIL", r"\b[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\b", 100),
    Rule("IP_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b", 100),
    Rule("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 100),
    Rule("SSN", r"\b\d{3}[\s\-]?\d{2}[\s\-]?\d{4}\b", 100),
    Rule("NIN_UK", r"\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 100),
    Rule("PASSPORT", r"\b[0-9]{9}GBR[0-9]{7}[A-Z][0-9]{6}[A-Z]{3}[0-9]\b", 100),
    Rule("URL", r"\b(?:https?://|www\.)[^\s/$.?#].[^\s]*\b", 100),
    Rule("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", 100),
    Rule("PERSON", r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?|Sir|Madam)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", 95),
    Rule("CREDIT_CARD", r"\b4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 95),
    Rule("CREDIT_CARD", r"\b5[1-5]\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 95),
    Rule("CREDIT_CARD", r"\b3[47]\d{2}[\s\-]?\d{6}[\s\-]?\d{5}\b", 95),
    Rule("CREDIT_CARD", r"\b6(?:011|5\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 95),
    Rule("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 95),
    Rule("MRN", r"\bMRN[\s\-:]?\d{6,10}\b", 95, True),
    Rule("CRYPTO_ADDRESS", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", 95),
    Rule("CRYPTO_ADDRESS", r"\b0x[a-fA-F0-9]{40}\b", 95),
    Rule("PHONE", r"\+[1-9]\d{1,14}\b", 90),
    Rule("EIN", r"\b\d{2}[\s\-]?\d{7}\b", 90),
    Rule("PASSPORT", r"\b[A-Z]\d{8}\b|\b\d{9}\b", 90),
    Rule("PHONE", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 85),
    Rule("PHONE", r"(?:(?:\+44\s?|0)(?:\d{2}\s?\d{4}\s?\d{4}|\d{3}\s?\d{3}\s?\d{4}|\d{4}\s?\d{3}\s?\d{3}))", 85),
    Rule("PERSON", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 80),
    Rule("DRIVERS_LICENSE", r"\b[A-Z]{1,2}\d{5,8}\b", 80),
    Rule("PHONE", r"(?:\+?\d{1,4}[-.\s]?)?(?:\(?\d{1,4}\)?[-.\s]?)?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}", 70),
    Rule("CREDIT_CARD", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 70),
    Rule("PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b", 70),
    Rule("DOB", r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{2,4}[-/]\d{1,2}[-/]\d{1,2})\b", 70),
)
# The optional detectors.
OPTIONAL_RULES = (
    Rule("API_KEY", r"sk-[a-zA-Z0-9]{32,}"), Rule("API_KEY", r"ghp_[a-zA-Z0-9]{36}"), Rule("API_KEY", r"AKIA[A-Z0-9]{16}"),
    Rule("EMPLOYEE_ID", r"\bEMP-\d{5}\b"), Rule("MRN", r"\bMRN-\d{6}\b"),
)
# Type and placeholder stem of the policies; a stem in brackets has no number.
POLICIES = {
    "default_pii": "EMAIL EMAIL PHONE PHONE PERSON NAME IP_ADDRESS IP CREDIT_CARD CC SSN SSN",
    "gdpr_strict": "EMAIL EMAIL PHONE PHONE PERSON PERSON IP_ADDRESS IP CREDIT_CARD PAYMENT SSN ID",
    "slm_local": "EMAIL EMAIL PHONE PHONE PERSON USER IP_ADDRESS ADDR CREDIT_CARD CARD SSN ID",
    "hipaa_phi": """PERSON PATIENT EMAIL CONTACT PHONE PHONE LOCATION LOC DOB DATE DATE_TIME DATE SSN ID MRN MRN HEALTH_PLAN_ID PLAN BANK_ACCOUNT ACCT
        DRIVERS_LICENSE LIC PASSPORT PASS VEHICLE_ID VEH DEVICE_ID DEV URL URL IP_ADDRESS IP BIOMETRIC BIO PHOTO_REF PHOTO""",
    "pci_dss": """CREDIT_CARD PAN PERSON CARDHOLDER SERVICE_CODE SC CARD_EXPIRY EXP CVV [REDACTED] PIN [REDACTED] MAGNETIC_STRIPE [REDACTED]
        EMAIL EMAIL PHONE PHONE LOCATION ADDR SSN SSN TRANSACTION_ID TXN IP_ADDRESS IP""",
}


def placeholders(policy: str) -> dict[str, str]:
    words = POLICIES[policy].split()
    return {t: stem if stem[0] == "[" else f"[{stem}_{{i}}]" for t, stem in zip(words[::2], words[1::2])}


def _re2(pattern: str, ignore_case: bool = False) -> str:
    out = re.sub(r"(?<!\\)\\d", r"\\p{Nd}", pattern)
    out = re.sub(r"\[([^\]]*)\\s([^\]]*)\]", r"[\1\\s\\p{Z}\\x{85}\\x{0B}\2]", out)
    out = re.sub(r"\\s(?!\\p\{Z\})", r"[\\s\\p{Z}\\x{85}\\x{0B}]", out)
    return ("(?i)" if ignore_case else "") + out


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spans_cte(table: str, key: str, text: str, rules: tuple[Rule, ...] = BASIC_RULES, confidence: bool = False, where: str = "true") -> str:
    """CTEs ``src`` (key, text) and ``spans`` (key, s, e, ord, rule, t, v, c); emission order is (rule, s)."""
    parts = []
    for i, r in enumerate(rules):
        p = _literal(_re2(r.pattern, r.ignore_case))
        # Digits in a character class are plain ones only.
        fold = "strict" if re.search(r"\[[^\]]*[0-9][^\]]*\]", r.pattern) else "folded"
        parts.append(
            f"select k, {i} as rule, '{r.entity_type}' as t, {f'{r.priority / 100}::double' if confidence else 'null::double'} as c, "
            f"regexp_extract_all({fold}, {p}) as m, regexp_split_to_array({fold}, {p}) as g from src where text is not null"
        )
    return f"""
src as (select {key} as k, {text} as text, regexp_replace(translate({text}, '０１２３４５６７８９', '9999999999'), '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC\\pM\\p{{Nd}}]', '_', 'g') as folded,
  regexp_replace(translate({text}, '０１２３４５６７８９', '__________'), '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC\\pM\\p{{Nd}}]', '_', 'g') as strict from {table} where {where}),
found as ({' union all '.join(parts)}),
placed as (
  select k, rule, t, c, unnest(generate_series(1, len(m))) as i, m, g from found where len(m) > 0
), spans as (
  select p.k, p.rule, p.t, p.c,
    (list_sum(list_transform(p.g[1:p.i], lambda x: length(x))) + coalesce(list_sum(list_transform(p.m[1:p.i - 1], lambda x: length(x))), 0))::int as s,
    (list_sum(list_transform(p.g[1:p.i], lambda x: length(x))) + list_sum(list_transform(p.m[1:p.i], lambda x: length(x))))::int as e,
    (row_number() over (partition by p.k order by p.rule, p.i) - 1)::int as ord
  from placed p
)"""


def claimed_cte() -> str:
    """CTE ``claimed``: spans of rules by priority, later ones that begin or end inside an earlier one dropped."""
    return """
ranked as (select k, list([{'s': s, 'e': e, 't': t, 'c': c}] order by rank, s) as l from (select spans.*, rule as rank from spans) group by k),
reduced as (
  select k, list_reduce(l, lambda acc, x: case when len(list_filter(acc, lambda a: (a.s <= x[1].s and x[1].s < a.e) or (a.s < x[1].e and x[1].e <= a.e))) > 0 then acc else list_concat(acc, x) end) as l
  from ranked
), claimed as (select k, u.i as ord, l[u.i].s as s, l[u.i].e as e, l[u.i].t as t, l[u.i].c as c from (select k, l, unnest(generate_series(1, len(l))) as i from reduced) u)"""


_BETTER = {
    "longest_match": "x[1].e - x[1].s > acc[-1].e - acc[-1].s",
    "highest_confidence": "coalesce(x[1].c, 1) > coalesce(acc[-1].c, 1)",
    "first_detector": "false",
}


def resolved_cte(strategy: str = "longest_match", source: str = "spans") -> str:
    """CTE ``kept`` (k, i, s, e, t, c): spans after overlap resolution, numbered in text order."""
    return f"""
ordered as (select k, list([{{'s': s, 'e': e, 't': t, 'c': c}}] order by s, e, ord) as l from {source} group by k),
folded_spans as (
  select k, list_reduce(l, lambda acc, x: case
    when acc[-1].e <= x[1].s or x[1].e <= acc[-1].s then list_concat(acc, x)
    when {_BETTER[strategy]} then list_concat(acc[1:len(acc) - 1], x) else acc end) as l
  from ordered
), kept as (select k, i, l[i].s as s, l[i].e as e, l[i].t as t, l[i].c as c from (select k, l, unnest(generate_series(1, len(l))) as i from folded_spans))"""


def rewritten_cte(policy: str = "default_pii") -> str:
    """CTEs ``labelled`` (k, i, s, e, t, label, v) and ``done`` (k, anonymized, entities)."""
    table = placeholders(policy)
    cases = " ".join(f"when '{t}' then {_literal(p)}" for t, p in table.items())
    return f"""
covered as (
  select kept.*, row_number() over (partition by k, t order by s) as n, lag(e, 1, 0) over (partition by k order by s) as last
  from kept where t in ({', '.join(_literal(t) for t in table)})
), labelled as (
  select c.*, replace(case t {cases} end, '{{i}}', n::varchar) as label, substring(src.text, c.s + 1, c.e - c.s) as v, src.text from covered c join src using (k)
), pieces as (
  select k, string_agg(substring(text, last + 1, s - last) || label, '' order by s) as head, max(e) as tail, count(*) as entities from labelled group by k
), done as (
  select src.k, case when p.k is null then src.text else p.head || substring(src.text, p.tail + 1) end as anonymized, coalesce(p.entities, 0)::int as entities
  from src left join pieces p using (k)
)"""


def anonymized(table: str, key: str, text: str, policy: str = "default_pii", strategy: str = "longest_match", where: str = "true") -> str:
    """All CTEs up to ``done``, for the basic detector."""
    return "with " + ",".join((spans_cte(table, key, text, where=where), resolved_cte(strategy), rewritten_cte(policy)))


def enhanced(table: str, key: str, text: str, policy: str, where: str = "true") -> str:
    """All CTEs up to ``done``, for the enhanced detector."""
    claimed = (spans_cte(table, key, text, ENHANCED_RULES, True, where), claimed_cte(), resolved_cte("longest_match", "claimed"), rewritten_cte(policy))
    return "with " + ",".join(claimed)


def merged_cte(source: str = "spans") -> str:
    """CTE ``kept`` (k, s, e, t): overlapping spans of one type united, each with the first accepted one that it meets."""
    hit = "list_position(list_transform(acc, lambda a: a.t = x[1].t and not (a.e <= x[1].s or x[1].e <= a.s)), true)"
    return f"""
ordered as (select k, list([{{'s': s, 'e': e, 't': t}}] order by s, e, ord) as l from {source} group by k),
united as (
  select k, list_reduce(l, lambda acc, x: case when coalesce({hit}, 0) = 0 then list_concat(acc, x) else
    list_concat(list_concat(acc[1:{hit} - 1], [{{'s': least(acc[{hit}].s, x[1].s), 'e': greatest(acc[{hit}].e, x[1].e), 't': x[1].t}}]), acc[{hit} + 1:]) end) as l
  from ordered
), kept as (select k, l[i].s as s, l[i].e as e, l[i].t as t from (select k, l, unnest(generate_series(1, len(l))) as i from united))"""


def restored(text: str = "anonymized") -> str:
    """CTE ``back`` (k, restored): every placeholder of ``labelled`` replaced in turn in ``done``'s text."""
    return f"""
, back as (
  select d.k, coalesce(list_reduce(list_concat([{{'l': '', 'v': d.{text}}}], e.l), lambda a, x: {{'l': '', 'v': replace(a.v, x.l, x.v)}}).v, d.{text}) as restored
  from done d left join (select k, list({{'l': label, 'v': v}} order by s) as l from labelled group by k) e using (k)
)"""
