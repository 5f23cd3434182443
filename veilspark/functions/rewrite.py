"""Anonymize and restore: column expressions over a text and its spans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detectors import Detector, detect
from .policy import Policy, load_policy
from .resolve import Overlap, resolve
from .spans import gathered, let

ENTRIES = "array<struct<placeholder:string,original:string>>"


_LABELLED = "struct<start:int,end:int,entity_type:string,text:string,placeholder:string>"


def number_placeholders(spans: Column, policy: Policy, dedupe_values: bool = False) -> Column:
    """Per span (start, end, entity_type, text, placeholder): the type's template with a running number.

    Each occurrence counts; with ``dedupe_values`` equal values of a type share a number.
    """

    def labelled(s: Column, n: Column) -> Column:
        label = F.replace(policy.template(s["entity_type"]), F.lit("{i}"), n.cast("string"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["text"].alias("text"), label.alias("placeholder"))

    def with_counters(kept: Column, types: Column) -> Column:
        """One counter per type of the row, carried along."""

        def step(acc: Column, s: Column) -> tuple[Column, Column]:
            at = F.array_position(types, s["entity_type"])
            n = (F.get(acc["counts"], (at - 1).cast("int")) + 1).cast("int")
            counts = F.transform(acc["counts"], lambda c, i: F.when(i + 1 == at, c + 1).otherwise(c))
            return F.struct(counts.alias("counts")), F.array(labelled(s, n))

        return gathered(kept, F.struct(F.transform(types, lambda _: F.lit(0)).alias("counts")), step, _LABELLED)

    def by_value(kept: Column, s: Column, i: Column) -> Column:
        before = F.filter(F.slice(kept, 1, i + 1), lambda y: y["entity_type"] == s["entity_type"])
        return labelled(s, F.array_position(F.array_distinct(F.transform(before, lambda y: y["text"])), s["text"]))

    if dedupe_values:
        return let(spans, lambda kept: F.transform(kept, lambda s, i: by_value(kept, s, i)))
    return let(spans, lambda kept: let(F.array_distinct(F.transform(kept, lambda s: s["entity_type"])), lambda types: with_counters(kept, types)))


#: Spans of a row beyond which the text is cut by fixed-width code points: a cut in a string walks there from its beginning.
_MANY = 64


def rewrite(text: Column, labelled: Column) -> Column:
    """The text with each span's place taken by its placeholder; between spans the text stays.

    A piece runs from the *previous* span's end, so spans left overlapping repeat nothing.
    """

    def whole(numbered: Column, cut: Callable[[Column, Column], Column]) -> Column:
        def piece(s: Column, i: Column) -> Column:
            last = F.when(i == 0, F.lit(0)).otherwise(F.get(numbered, i - 1)["end"])
            return F.concat(cut(last, F.greatest(s["start"] - last, F.lit(0))), s["placeholder"])

        end = F.coalesce(F.get(numbered, F.size(numbered) - 1)["end"], F.lit(0))
        pieces = F.transform(numbered, piece)
        return F.concat(F.array_join(pieces, ""), cut(end, F.greatest(F.length(text) - end, F.lit(0))))

    def either(numbered: Column) -> Column:
        short = whole(numbered, lambda at, n: F.substring(text, at + 1, n))
        wide = let(F.encode(text, "UTF-32"), lambda b: whole(numbered, lambda at, n: F.decode(F.substring(b, 4 * at + 1, 4 * n), "UTF-32")))
        return F.when(F.size(numbered) > _MANY, wide).otherwise(short)

    return let(labelled, either)


def entries_of(numbered: Column) -> Column:
    """(placeholder, original) in text order, duplicates kept."""
    return F.transform(numbered, lambda s: F.struct(s["placeholder"].alias("placeholder"), s["text"].alias("original")))


def mapping_of(entries: Column) -> Column:
    """Map placeholder -> original; of equal placeholders the last value wins, in the first one's place."""
    return F.map_from_entries(entries)


def kept_spans(
    text: Column,
    policy: str | Policy = "default_pii",
    detectors: Sequence[str | Detector] = ("regex",),
    overlap: str | Overlap = Overlap.LONGEST,
    min_confidence: float | None = 0.5,
    policy_first: bool = False,
) -> Column:
    """Spans to replace: detect, confidence filter, overlap resolution, then the policy's types.

    The policy filter stays behind overlap resolution: a span without an entry still shadows
    what it covers. ``policy_first`` turns this round.
    """
    policy = load_policy(policy) if isinstance(policy, str) else policy
    covered = lambda spans: F.filter(spans, lambda s: policy.covers(s["entity_type"]))
    found = detect(text, detectors, min_confidence)
    if policy_first:
        return resolve(covered(found), text, overlap)
    return covered(resolve(found, text, overlap))


def anonymize(text: Column, policy: str | Policy = "default_pii", dedupe_values: bool = False, **options) -> Column:
    """Struct (text, entries): the rewritten text and its mapping as an ordered array.

    Null gives nulls; empty text gives empty text and no entries.
    """
    policy = load_policy(policy) if isinstance(policy, str) else policy
    numbered = number_placeholders(kept_spans(text, policy, **options), policy, dedupe_values)
    return let(numbered, lambda n: F.struct(rewrite(text, n).alias("text"), entries_of(n).alias("entries")))


def deanonymize(text: Column, mapping: Column) -> Column:
    """Replaces every placeholder by its original, one after another in the mapping's order (values may cascade)."""
    return deanonymize_entries(text, F.transform(F.map_entries(mapping), lambda e: F.struct(e["key"].alias("placeholder"), e["value"].alias("original"))))


def deanonymize_entries(text: Column, entries: Column) -> Column:
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["placeholder"], e["original"]))


def deanonymize_fields(value: Column, paths: Sequence[str], entries: Column) -> Column:
    """A struct, or an array of structs, with the named text fields restored; a path goes through structs and arrays (``nodes.text``)."""

    def inside(field: Column, path: str) -> Column:
        head, _, rest = path.partition(".")
        return field.withField(head, at(field[head], rest))

    def at(field: Column, path: str) -> Column:
        if not path:
            return deanonymize_entries(field, entries)
        if path.startswith("[]"):
            rest = path[2:].lstrip(".")
            return F.transform(field, lambda x: at(x, rest))
        return inside(field, path)

    for path in paths:
        value = at(value, path)
    return value


def type_of_placeholder(placeholder: Column) -> Column:
    """``[EMAIL_1]`` -> ``EMAIL``: what precedes the first underscore, without brackets."""
    return F.regexp_extract(placeholder, r"^\[?([^_\]]*)", 1)


def cache_key(text: Column, policy: Policy, detectors: Sequence[str]) -> Column:
    """Key under which equal (text, policy name, detectors) share a result."""
    return F.sha2(F.to_json(F.struct(F.array(*[F.lit(d) for d in sorted(detectors)]).alias("detectors"), F.lit(policy.name).alias("policy"), text.alias("text"))), 256)
