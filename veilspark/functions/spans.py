"""Spans: matches of a pattern with their places, as native column expressions.

A span is a struct ordered by its first fields (start, end, ord), so a plain array sort
gives the stable order of overlap resolution. Offsets count code points, half-open.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,ord:int,entity_type:string,text:string,confidence:double>"
SPANS = f"array<{SPAN}>"
# A word character as Python's re sees it; Java's own (?U)\b also takes combining marks.
_W = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"


_WORD_TOKEN = r"(?:\\d|\[(?:[A-Za-z0-9]|-)+\])"  # tokens that match word characters only
_AT_START = re.compile(rf"(?:\(\?:)?({_WORD_TOKEN}|[A-Za-z0-9])(?![*?]|\{{0)")
_AT_END = re.compile(rf"{_WORD_TOKEN}(?:\{{[1-9]\d*(?:,\d*)?\}}|\+)?(?:\)(?:\{{[1-9]\d*(?:,\d*)?\}}|\+)?)*$")


def _boundary(pattern: str, at: int) -> str:
    """Java form of the ``\\b`` at a place: one side's test where the other side is known to be a word character.

    The cheap test of the next character comes first, so that most places fail on it.
    """
    following = _AT_START.match(pattern, at + 2)
    if following:
        group = following.group().startswith("(?:")
        inner = pattern[at + 2 : pattern.find(")", at + 2)] if group else ""
        if "|" not in inner:
            return rf"(?={following.group(1)})(?<!{_W})"
    if _AT_END.search(pattern[:at]):
        return rf"(?!{_W})"
    return _BOUNDARY


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A pattern of Python's dialect (Unicode-aware classes) in Java's."""
    places = [m.start(1) for m in re.finditer(r"(?<!\\)(?:\\\\)*(\\b)", pattern)]
    out, last = [], 0
    for at in places:
        out += (pattern[last:at], _boundary(pattern, at))
        last = at + 2
    return ("(?Ui)" if ignore_case else "(?U)") + "".join(out) + pattern[last:]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it.

    A Column is an expression, not a result: named twice it runs twice, and inside a lambda
    once per element. Bound as a lambda variable of a one-element array it runs once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPANS)


#: Elements a fold works through before what it has gathered is appended to the rest.
BLOCK = 512


def gathered(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], element: str) -> Column:
    """Array of what a left fold emits: ``step(state, item)`` gives the next state and an array (mostly of none or one).

    Appending to one array copies it each time, which is quadratic in a long row; here each block of
    items gathers its own array, and those are appended block by block.
    """
    empty = F.array().cast(f"array<{element}>")

    def one(acc: Column, item: Column) -> Column:
        following, out = step(acc["state"], item)
        return F.struct(following.alias("state"), F.concat(acc["out"], out).alias("out"))

    def folded(items: Column) -> Column:
        def block(acc: Column, begin: Column) -> Column:
            inner = F.aggregate(F.slice(items, begin, BLOCK), F.struct(acc["state"].alias("state"), empty.alias("out")), one)
            return let(inner, lambda done: F.struct(done["state"].alias("state"), F.concat(acc["out"], done["out"]).alias("out")))

        begins = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.when(items.isNotNull(), F.aggregate(begins, F.struct(state.alias("state"), empty.alias("out")), block, lambda acc: acc["out"]))

    return let(items, folded)


#: A noncharacter, set around matches; in a text itself it would be read as the noncharacter before it.
_EDGE, _NO_EDGE = "\uffff", "\ufffe"


def matches(text: Column, pattern: str, entity_type: str, confidence: float | None = None, guard: Column | None = None) -> Column:
    """Array of the non-overlapping matches of a Java pattern, left to right. The pattern must not match the empty string.

    The text is scanned once: matches are set between edges, and what lies between edges is gap and match in turn.
    ``guard`` is a cheap test that must hold for any match to exist; it spares the scan. Null text gives null.
    """
    pieces = F.split(F.regexp_replace(F.translate(text, _EDGE, _NO_EDGE), pattern, f"{_EDGE}$0{_EDGE}"), _EDGE, -1)

    def spans_of(own: Column) -> Column:
        def placed(acc: Column, i: Column) -> tuple[Column, Column]:
            begin = (acc["end"] + F.length(F.get(own, i))).cast("int")
            end = (begin + F.length(F.get(own, i + 1))).cast("int")
            span = F.struct(
                begin.alias("start"), end.alias("end"), F.lit(0).alias("ord"), F.lit(entity_type).alias("entity_type"),
                F.get(own, i + 1).alias("text"), F.lit(confidence).cast("double").alias("confidence"),
            )
            return F.struct(end.alias("end")), F.array(span)

        return gathered(F.sequence(F.lit(0), F.size(own) - 3, F.lit(2)), F.struct(F.lit(0).alias("end")), placed, SPAN)

    spans = let(pieces, lambda own: F.when(F.size(own) > 1, spans_of(own)).when(own.isNotNull(), no_spans()))
    if guard is None:
        return spans
    return F.when(guard, spans).when(text.isNotNull(), no_spans())


def emitted(parts: list[Column]) -> Column:
    """Spans of several patterns in emission order, numbered by it."""
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.transform(
        every,
        lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("ord"), s["entity_type"].alias("entity_type"), s["text"].alias("text"), s["confidence"].alias("confidence")),
    )


def in_text_order(spans: Column) -> Column:
    return F.array_sort(spans)
