"""Detection reports: counts, coverage, risk and their text and HTML forms, per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

# Types by risk.
HIGH_RISK = ("SSN", "CREDIT_CARD", "BANK_ACCOUNT", "CVV", "PASSPORT", "DRIVER_LICENSE", "MEDICAL_RECORD", "TAX_ID", "CRYPTO_ADDRESS")
MEDIUM_RISK = ("EMAIL", "PHONE", "IBAN", "IP_ADDRESS", "API_KEY", "PASSWORD")
RISK_LEVELS = ("low", "medium", "high", "critical")
# detectors' names for types that the risk sets call otherwise.
RISK_ALIASES = {"DRIVERS_LICENSE": "DRIVER_LICENSE", "MRN": "MEDICAL_RECORD"}
#: Default types of a high-risk alert.
ALERT_TYPES = ("SSN", "CREDIT_CARD", "PASSPORT")
RISK_COLORS = {"low": "#28a745", "medium": "#ffc107", "high": "#fd7e14", "critical": "#dc3545"}


def summary(spans: Column) -> Column:
    """Map type -> count, types in order of first appearance."""
    types = F.transform(spans, lambda s: s["entity_type"])
    counted = lambda all_types: F.transform(F.array_distinct(all_types), lambda t: F.struct(t.alias("key"), F.size(F.filter(all_types, lambda x: x == t)).alias("value")))
    return F.map_from_entries(let(types, counted))


def pii_chars(spans: Column) -> Column:
    """Characters inside spans; overlapping ones count twice."""
    return F.aggregate(spans, F.lit(0), lambda acc, s: (acc + s["end"] - s["start"]).cast("int"))


def coverage(text: Column, spans: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, pii_chars(spans) / n).when(text.isNotNull(), F.lit(0.0))


def risk(spans: Column, covered: Column, aliases: bool = False) -> Column:
    """low, medium, high or critical. ``aliases`` maps detectors' type names to those of the risk sets first."""
    types = F.transform(spans, lambda s: s["entity_type"])
    if aliases:
        literal = F.create_map(*[F.lit(x) for kv in RISK_ALIASES.items() for x in kv])
        types = F.transform(types, lambda t: F.coalesce(F.try_element_at(literal, t), t))
    n = F.size(spans)
    high = F.exists(types, lambda t: t.isin(list(HIGH_RISK)))
    medium = F.exists(types, lambda t: t.isin(list(MEDIUM_RISK)))
    return (
        F.when(spans.isNull(), F.lit(None).cast("string"))
        .when(n == 0, "low")
        .when(high, "critical")
        .when((covered > 0.3) | (medium & (n > 5)), "high")
        .when(medium | (covered > 0.1), "medium")
        .otherwise("low")
    )


def risk_rank(level: Column) -> Column:
    """0 to 3, for maxima over rows."""
    return F.array_position(F.array(*[F.lit(x) for x in RISK_LEVELS]), level) - 1


def preview(text: Column, width: int = 100) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def report(text: Column, spans: Column, include_preview: bool = False) -> Column:
    """Struct of entities, summary, coverage, risk, total_chars, pii_chars and preview (null unless asked for)."""
    shown = preview(text) if include_preview else F.lit(None).cast("string")
    return let(
        spans,
        lambda s: F.struct(
            s.alias("entities"), summary(s).alias("summary"), coverage(text, s).alias("coverage"), risk(s, coverage(text, s)).alias("risk"),
            F.length(text).alias("total_chars"), pii_chars(s).alias("pii_chars"), shown.alias("preview"),
        ),
    )


def _types_by_count(r: Column) -> Column:
    """Summary entries by count descending, ties in order of appearance."""
    entries = F.transform(F.map_entries(r["summary"]), lambda e, i: F.struct((-e["value"]).alias("n"), i.alias("i"), e["key"].alias("type")))
    return F.array_sort(entries)


def report_text(r: Column) -> Column:
    """A report as plain text."""
    rule = F.lit("=" * 60)
    warn = r["risk"].isin("high", "critical")
    high = F.array_sort(F.array_distinct(F.transform(F.filter(r["entities"], lambda s: s["entity_type"].isin(list(HIGH_RISK))), lambda s: s["entity_type"])))
    nothing = F.array().cast("array<string>")
    lines = F.concat(
        F.array(
            rule, F.lit("PII Detection Report"), rule, F.lit(""),
            F.concat(F.lit("Total Entities: "), F.size(r["entities"]).cast("string")),
            F.concat(F.lit("PII Coverage: "), F.format_string("%.1f", r["coverage"] * 100), F.lit("%")),
            F.concat(F.lit("Risk Level: "), F.upper(r["risk"])),
            F.concat(F.lit("Text Length: "), r["total_chars"].cast("string"), F.lit(" characters")),
            F.concat(F.lit("PII Characters: "), r["pii_chars"].cast("string")), F.lit(""),
        ),
        F.when(
            F.size(r["summary"]) > 0,
            F.concat(F.array(F.lit("Entity Types Detected:")), F.transform(_types_by_count(r), lambda e: F.concat(F.lit("  - "), e["type"], F.lit(": "), (-e["n"]).cast("string"))), F.array(F.lit(""))),
        ).otherwise(nothing),
        F.when(
            warn,
            F.concat(
                F.array(F.lit("⚠️  WARNING: High-risk PII detected!")),
                F.when(F.size(high) > 0, F.array(F.concat(F.lit("   High-risk types: "), F.array_join(high, ", ")))).otherwise(nothing),
                F.array(F.lit("")),
            ),
        ).otherwise(nothing),
        F.when(F.length(F.coalesce(r["preview"], F.lit(""))) > 0, F.array(F.lit("Text Preview:"), F.concat(F.lit("  "), r["preview"]), F.lit(""))).otherwise(nothing),
        F.array(rule),
    )
    return F.array_join(lines, "\n")


def report_html(r: Column) -> Column:
    """A report as an HTML fragment; values are escaped."""
    literal = F.create_map(*[F.lit(x) for kv in RISK_COLORS.items() for x in kv])
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda name, value: F.concat(F.lit(f"<tr><td><strong>{name}</strong></td><td>"), value, F.lit("</td></tr>"))
    items = F.array_join(F.transform(_types_by_count(r), lambda e: F.concat(F.lit("<li>"), escape(e["type"]), F.lit(": "), (-e["n"]).cast("string"), F.lit("</li>"))), "")
    return F.concat(
        F.lit('<section class="pii-report" style="border-top: 3px solid '), F.try_element_at(literal, r["risk"]), F.lit('"><h1>PII Detection Report</h1><table>'),
        row("Total Entities:", F.size(r["entities"]).cast("string")), row("PII Coverage:", F.concat(F.format_string("%.1f", r["coverage"] * 100), F.lit("%"))),
        row("Risk Level:", F.upper(r["risk"])), row("Text Length:", r["total_chars"].cast("string")), row("PII Characters:", r["pii_chars"].cast("string")),
        F.lit("</table><ul>"), items, F.lit("</ul>"), F.coalesce(F.concat(F.lit("<pre>"), escape(r["preview"]), F.lit("</pre>")), F.lit("")), F.lit("</section>"),
    )


def report_page(r: Column, title: str = "PII Detection Report") -> Column:
    """A whole HTML page: the report's section and a table of its entities in text order; values are escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    sure = lambda s: F.when(s["confidence"].isNull(), F.lit("–")).otherwise(F.format_string("%.2f", s["confidence"]))
    rows = F.transform(
        F.array_sort(r["entities"]),
        lambda s: F.concat(F.lit("<tr>"), cell(escape(s["entity_type"])), cell(escape(s["text"])), cell(F.concat(s["start"].cast("string"), F.lit("–"), s["end"].cast("string"))), cell(sure(s)), F.lit("</tr>")),
    )
    head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body>'
    table = F.when(
        F.size(r["entities"]) > 0,
        F.concat(F.lit('<table class="entities"><tr><th>Type</th><th>Text</th><th>Place</th><th>Confidence</th></tr>'), F.array_join(rows, ""), F.lit("</table>")),
    ).otherwise(F.lit("<p>No PII found.</p>"))
    return F.concat(F.lit(head), report_html(r), table, F.lit("</body></html>"))


# Parts of field names that suggest personal or secret data.
SENSITIVE_KEYWORDS = ("password", "secret", "token", "key", "ssn", "credit", "card", "email", "phone", "address", "pii", "personal")


def without_sensitive_fields(context: Column) -> Column:
    """A string map without the entries whose key contains a sensitive word."""
    return F.map_filter(context, lambda k, _: ~F.lower(k).rlike("|".join(SENSITIVE_KEYWORDS)))
