"""Detectors: text column -> array of spans. Built in, registered by name, or any object with ``spans``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import SPANS, emitted, gathered, java_pattern, let, matches, no_spans


class Detector(Protocol):
    """What anything must offer to be used as a detector: built-in expressions or an Arrow UDF."""

    def spans(self, text: Column) -> Column: ...


class Rule(NamedTuple):
    entity_type: str
    pattern: str
    priority: int = 100
    ignore_case: bool = False
    needs: str | None = None  # a literal or, with a leading backslash or bracket, a pattern every match contains


# Patterns of the basic detector, in emission order.
BASIC_RULES = (
    Rule("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", needs="@"),
    Rule("PHONE", r"\+?\d[\d\-\s]{7,}\d", needs=r"\d"),
    Rule("PERSON", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"),
    Rule("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", needs=r"\d"),
    Rule("CREDIT_CARD", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", needs=r"\d"),
    Rule("SSN", r"\b\d{3}-\d{2}-\d{4}\b", needs=r"\d"),
)
# The e-mail pattern tries every start in a run without '@'; begun only where a run begins
# (or where the last match ended) and taken possessively it is linear, with the same matches.
_LINEAR_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# Patterns of the enhanced detector in declaration order, with type and priority.
ENHANCED_RULES = (
    Rule("EMAIL", r"\b[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\b", 100, needs="@"),
    Rule("PHONE", r"\+[1-9]\d{1,14}\b", 90, needs="+"),
    Rule("PHONE", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 85, needs=r"\d"),
    Rule("PHONE", r"(?:(?:\+44\s?|0)(?:\d{2}\s?\d{4}\s?\d{4}|\d{3}\s?\d{3}\s?\d{4}|\d{4}\s?\d{3}\s?\d{3}))", 85, needs=r"\d"),
    Rule("PHONE", r"(?:\+?\d{1,4}[-.\s]?)?(?:\(?\d{1,4}\)?[-.\s]?)?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}", 70, needs=r"\d"),
    Rule("PERSON", r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?|Sir|Madam)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", 95),
    Rule("PERSON", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 80),
    Rule("IP_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b", 100, needs=":"),
    Rule("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 100, needs="."),
    Rule("CREDIT_CARD", r"\b4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 95, needs=r"\d"),
    Rule("CREDIT_CARD", r"\b5[1-5]\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 95, needs=r"\d"),
    Rule("CREDIT_CARD", r"\b3[47]\d{2}[\s\-]?\d{6}[\s\-]?\d{5}\b", 95, needs=r"\d"),
    Rule("CREDIT_CARD", r"\b6(?:011|5\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 95, needs=r"\d"),
    Rule("CREDIT_CARD", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 70, needs=r"\d"),
    Rule("SSN", r"\b\d{3}[\s\-]?\d{2}[\s\-]?\d{4}\b", 100, needs=r"\d"),
    Rule("NIN_UK", r"\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 100, needs=r"\d"),
    Rule("EIN", r"\b\d{2}[\s\-]?\d{7}\b", 90, needs=r"\d"),
    Rule("PASSPORT", r"\b[0-9]{9}GBR[0-9]{7}[A-Z][0-9]{6}[A-Z]{3}[0-9]\b", 100, needs="GBR"),
    Rule("PASSPORT", r"\b[A-Z]\d{8}\b|\b\d{9}\b", 90, needs=r"\d"),
    Rule("PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b", 70, needs=r"\d"),
    Rule("DRIVERS_LICENSE", r"\b[A-Z]{1,2}\d{5,8}\b", 80, needs=r"\d"),
    Rule("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 95, needs=r"\d"),
    Rule("DOB", r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{2,4}[-/]\d{1,2}[-/]\d{1,2})\b", 70, needs=r"\d"),
    Rule("MRN", r"\bMRN[\s\-:]?\d{6,10}\b", 95, ignore_case=True, needs=r"\d"),
    Rule("URL", r"\b(?:https?://|www\.)[^\s/$.?#].[^\s]*\b", 100),
    Rule("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", 100),
    Rule("CRYPTO_ADDRESS", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", 95, needs=r"\d"),
    Rule("CRYPTO_ADDRESS", r"\b0x[a-fA-F0-9]{40}\b", 95, needs="0x"),
)

# Optional detectors shown in the documentation of such libraries.
OPTIONAL_RULES = {
    "api_key": (Rule("API_KEY", r"sk-[a-zA-Z0-9]{32,}"), Rule("API_KEY", r"ghp_[a-zA-Z0-9]{36}"), Rule("API_KEY", r"AKIA[A-Z0-9]{16}")),
    "employee_id": (Rule("EMPLOYEE_ID", r"\bEMP-\d{5}\b"),),
    "mrn": (Rule("MRN", r"\bMRN-\d{6}\b"),),
}
# Labels of model-based recognizers and the types they stand for.
ANALYZER_TYPES = {
    "PERSON": "PERSON", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "CREDIT_CARD": "CREDIT_CARD", "US_SSN": "SSN", "IP_ADDRESS": "IP_ADDRESS",
    "LOCATION": "LOCATION", "DATE_TIME": "DATE_TIME", "NRP": "NATIONALITY", "IBAN_CODE": "IBAN", "US_BANK_NUMBER": "BANK_ACCOUNT",
    "US_DRIVER_LICENSE": "DRIVERS_LICENSE", "US_PASSPORT": "PASSPORT", "CRYPTO": "CRYPTO_ADDRESS", "UK_NHS": "NHS_NUMBER", "MEDICAL_LICENSE": "MEDICAL_LICENSE",
}
NER_TYPES = {
    "PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "FACILITY", "DATE": "DATE_TIME", "TIME": "DATE_TIME",
    "MONEY": "MONEY", "PERCENT": "PERCENT", "CARDINAL": "NUMBER", "ORDINAL": "NUMBER", "QUANTITY": "QUANTITY", "NORP": "NATIONALITY", "EVENT": "EVENT",
    "WORK_OF_ART": "WORK_OF_ART", "LAW": "LAW", "LANGUAGE": "LANGUAGE", "PRODUCT": "PRODUCT",
}


def _guard(text: Column, needs: str | None) -> Column | None:
    if needs is None:
        return None
    return text.rlike("(?U)" + needs) if needs[0] in "\\[" else text.contains(needs)


class PatternDetector:
    """Spans of each rule, rule after rule, each left to right; confidence null."""

    name = "regex"

    def __init__(self, rules: Sequence[Rule] = BASIC_RULES) -> None:
        self.rules = tuple(rules)

    def spans(self, text: Column) -> Column:
        parts = []
        for r in self.rules:
            pattern = _LINEAR_EMAIL if r is BASIC_RULES[0] else java_pattern(r.pattern, r.ignore_case)
            parts.append(matches(text, pattern, r.entity_type, guard=_guard(text, r.needs)))
        return emitted(parts)


class EnhancedDetector:
    """Rules by priority (stable); a match is dropped if it begins or ends inside a span claimed before.

    A match that strictly contains a claimed span is not seen as a clash; overlap resolution removes what is left.
    """

    name = "enhanced_regex"

    def __init__(self, entity_types: Sequence[str] | None = None, enable_all: bool = True) -> None:
        chosen = [r for r in ENHANCED_RULES if (r.entity_type in entity_types if entity_types else enable_all)]
        self.rules = sorted(chosen, key=lambda r: -r.priority)

    def spans(self, text: Column) -> Column:
        if not self.rules:
            return F.when(text.isNotNull(), F.array().cast(SPANS))
        parts = [matches(text, java_pattern(r.pattern, r.ignore_case), r.entity_type, r.priority / 100, _guard(text, r.needs)) for r in self.rules]
        every = F.concat(*parts) if len(parts) > 1 else parts[0]
        return emitted([let(every, _unclaimed)])


#: Spans of a row up to which each is compared with all accepted ones; beyond, only within clusters of overlapping spans.
_FEW = 48


def _claim(spans: Column) -> Column:
    """Spans in order, without those that begin or end inside one accepted before."""

    def claim(acc: Column, s: Column) -> Column:
        clash = F.exists(acc, lambda c: ((c["start"] <= s["start"]) & (s["start"] < c["end"])) | ((c["start"] < s["end"]) & (s["end"] <= c["end"])))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, no_spans(), claim)


def _unclaimed(every: Column) -> Column:
    """The claim test over all spans of a row. Spans that overlap, directly or in a chain, form a cluster; no other span can clash with them."""
    # Numbered by rank, so that a plain sort gives either order back: by place for the clusters, by rank for the test.
    ranked = F.transform(every, lambda s, i: _with(s, ord=i))
    by_place = F.array_sort(ranked)

    def step(acc: Column, s: Column) -> tuple[Column, Column]:
        apart = s["start"] >= acc["reach"]
        reach = F.greatest(acc["reach"], s["end"])
        open_now = F.when(apart, F.array(s)).otherwise(F.concat(acc["open"], F.array(s)))
        done = F.when(apart & (F.size(acc["open"]) > 0), F.array(acc["open"])).otherwise(F.array().cast(f"array<{SPANS}>"))
        return F.struct(reach.alias("reach"), open_now.alias("open")), done

    far = F.lit(2**31 - 1)
    # A span beyond every text closes the last cluster.
    closing = F.array(F.struct(far.alias("start"), far.alias("end"), far.alias("ord"), F.lit("").alias("entity_type"), F.lit("").alias("text"), F.lit(None).cast("double").alias("confidence")))
    clusters = lambda spans: gathered(F.concat(spans, closing), F.struct(F.lit(0).alias("reach"), no_spans().alias("open")), step, SPANS)
    by_rank = lambda spans: F.array_sort(spans, lambda a, b: a["ord"] - b["ord"])
    apart = let(by_place, lambda spans: by_rank(F.flatten(F.transform(clusters(spans), lambda c: _claim(by_rank(c))))))
    return F.when(F.size(every) > _FEW, apart).otherwise(_claim(every))


def _with(s: Column, ord: Column) -> Column:  # noqa: A002
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), ord.cast("int").alias("ord"), s["entity_type"].alias("entity_type"), s["text"].alias("text"), s["confidence"].alias("confidence"))


class ModelDetector:
    """A recognizer run as an Arrow UDF. ``udf`` gives arrays of (label, start, end, score) and loads its model once per worker.

    Labels are mapped to types, unknown ones pass; spans below ``threshold`` are dropped;
    a missing score becomes ``default_confidence``.
    """

    def __init__(self, udf: Callable[[Column], Column], types: dict[str, str], threshold: float = 0.5, default_confidence: float = 0.85, name: str = "model") -> None:
        self.udf, self.types, self.threshold, self.default_confidence, self.name = udf, types, threshold, default_confidence, name

    def spans(self, text: Column) -> Column:
        score = lambda s: F.coalesce(s["score"].cast("double"), F.lit(self.default_confidence))
        kept = F.filter(self.udf(text), lambda s: score(s) >= self.threshold)
        return F.transform(
            kept,
            lambda s, i: F.struct(
                s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), i.alias("ord"), normal_type(s["label"], self.types).alias("entity_type"),
                F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), score(s).alias("confidence"),
            ),
        )


def normal_type(label: Column, types: dict[str, str]) -> Column:
    """The type a label stands for; labels not listed stand for themselves."""
    literal = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return F.coalesce(F.try_element_at(literal, label), label)


_REGISTRY: dict[str, Callable[[], Detector]] = {
    "regex": PatternDetector,
    "enhanced_regex": EnhancedDetector,
    **{name: (lambda rules=rules: PatternDetector(rules)) for name, rules in OPTIONAL_RULES.items()},
}


def register_detector(name: str, factory: Callable[[], Detector]) -> None:
    _REGISTRY[name] = factory


def detector(spec: str | Detector) -> Detector:
    """A detector by name or as an instance; unknown names raise ``ValueError``."""
    if not isinstance(spec, str):
        return spec
    if spec not in _REGISTRY:
        raise ValueError(f"unknown detector {spec!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[spec]()


def list_detectors() -> list[str]:
    return sorted(_REGISTRY)


def detect(text: Column, detectors: Sequence[str | Detector] = ("regex",), min_confidence: float | None = None) -> Column:
    """All spans in detector order, before overlap resolution; null text gives null.

    ``min_confidence`` keeps spans without a confidence and those at or above it; 0 or None keeps all.
    """
    found = emitted([detector(d).spans(text) for d in detectors])
    return confident(found, min_confidence)


def confident(spans: Column, min_confidence: float | None) -> Column:
    if not min_confidence:
        return spans
    return F.filter(spans, lambda s: s["confidence"].isNull() | (s["confidence"] >= min_confidence))
