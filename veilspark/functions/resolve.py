"""Overlap resolution inside a row: a fold over spans in text order."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import SPAN, SPANS, gathered, in_text_order, let, no_spans


class Overlap(str, Enum):
    LONGEST = "longest_match"
    CONFIDENT = "highest_confidence"
    FIRST = "first_detector"
    MERGE = "merge"
    NONE = "none"


def _touch(a: Column, b: Column) -> Column:
    return (a["end"] > b["start"]) & (b["end"] > a["start"])


def _keep_or_replace(spans: Column, better) -> Column:
    """Accepted spans stay disjoint and in order, so a new one can only overlap the last of them: that one is held back until it is safe."""

    def step(acc: Column, s: Column) -> tuple[Column, Column]:
        last = acc["last"]
        clash = last.isNotNull() & _touch(last, s)
        taken = F.when(better(s, last), s).otherwise(last) if better else last
        done = F.when(last.isNotNull() & ~_touch(last, s), F.array(last)).otherwise(no_spans())
        return F.struct(F.when(clash, taken).otherwise(s).alias("last")), done

    far = F.lit(2**31 - 1)
    closing = F.array(F.struct(far.alias("start"), far.alias("end"), F.lit(0).alias("ord"), F.lit("").alias("entity_type"), F.lit("").alias("text"), F.lit(None).cast("double").alias("confidence")))
    return gathered(F.concat(in_text_order(spans), closing.cast(SPANS)), F.struct(F.lit(None).cast(SPAN).alias("last")), step, SPAN)


def _merge(spans: Column, text: Column) -> Column:
    """Each span joins the first accepted span of its type that it overlaps; the union takes its place."""

    def step(acc: Column, s: Column) -> Column:
        hit = F.transform(acc, lambda a: (a["entity_type"] == s["entity_type"]) & _touch(a, s))
        at = F.array_position(hit, F.lit(True))

        def joined(a: Column) -> Column:
            both = (a["confidence"] != 0) & (s["confidence"] != 0)
            mean = (a["confidence"] + s["confidence"]) / 2
            first = F.when(a["confidence"] != 0, a["confidence"]).otherwise(s["confidence"])
            start, end = F.least(a["start"], s["start"]), F.greatest(a["end"], s["end"])
            return F.struct(
                start.alias("start"), end.alias("end"), a["ord"].alias("ord"), a["entity_type"].alias("entity_type"),
                F.substring(text, start + 1, end - start).alias("text"), F.when(both, mean).otherwise(first).alias("confidence"),
            )

        replaced = lambda n: F.transform(acc, lambda a, i: F.when(i + 1 == n, joined(a)).otherwise(a))
        return let(at, lambda n: F.when(n == 0, F.concat(acc, F.array(s))).otherwise(replaced(n)))

    return F.aggregate(in_text_order(spans), F.array().cast(SPANS), step)


def resolve(spans: Column, text: Column, strategy: str | Overlap = Overlap.LONGEST) -> Column:
    """Spans left after resolving overlaps, in text order.

    longest_match replaces the accepted span only by a strictly longer one; highest_confidence
    by a strictly higher confidence (none counts as 1); first_detector never replaces, and goes
    by place, detector order breaking exact ties; merge unites spans of one type (text is that of
    the union); none only sorts. Unknown names fall back to longest_match.
    """
    try:
        chosen = Overlap(strategy)
    except ValueError:
        chosen = Overlap.LONGEST
    if chosen is Overlap.NONE:
        return in_text_order(spans)
    if chosen is Overlap.MERGE:
        return in_text_order(_merge(spans, text))
    if chosen is Overlap.FIRST:
        return _keep_or_replace(spans, None)
    if chosen is Overlap.CONFIDENT:
        sure = lambda s: F.coalesce(s["confidence"], F.lit(1.0))
        return _keep_or_replace(spans, lambda new, old: sure(new) > sure(old))
    return _keep_or_replace(spans, lambda new, old: new["end"] - new["start"] > old["end"] - old["start"])
