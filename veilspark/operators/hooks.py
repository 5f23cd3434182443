"""Callbacks around processing: they see DataFrames, not single texts."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


class Event(str, Enum):
    BEFORE_DETECT = "before_detect"
    AFTER_DETECT = "after_detect"
    BEFORE_ANONYMIZE = "before_anonymize"
    AFTER_ANONYMIZE = "after_anonymize"
    ERROR = "error"


Hook = Callable[[DataFrame], "DataFrame | None"]


class Hooks:
    """Registry of hooks. A hook may return a DataFrame that replaces the one it got.

    A failing hook doesn't stop the others: what was raised goes to the ERROR hooks.
    """

    def __init__(self) -> None:
        self._hooks: dict[Event, list[Hook]] = defaultdict(list)

    def register(self, event: Event, hook: Hook) -> None:
        self._hooks[Event(event)].append(hook)

    def unregister(self, event: Event, hook: Hook) -> None:
        if hook in self._hooks[Event(event)]:
            self._hooks[Event(event)].remove(hook)

    def clear(self, event: Event | None = None) -> None:
        if event is None:
            self._hooks.clear()
        else:
            self._hooks.pop(Event(event), None)

    def trigger(self, event: Event, df: DataFrame) -> DataFrame:
        for hook in list(self._hooks[Event(event)]):
            try:
                df = hook(df) or df
            except Exception as e:  # noqa: BLE001
                log.warning("hook failed at %s: %s", event, e)
                for other in self._hooks[Event.ERROR]:
                    other(df)
        return df


def audit_record(spans: Column, original: Column, anonymized: Column) -> Column:
    """What an audit hook keeps of a row: counts and lengths, no values."""
    return F.struct(
        F.size(spans).alias("entity_count"), F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity_type"]))).alias("entity_types"),
        F.length(original).alias("original_length"), F.length(anonymized).alias("anonymized_length"),
    )
