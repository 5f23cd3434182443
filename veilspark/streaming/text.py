"""Anonymizing and restoring streams of text chunks.

Rows are independent in the stateless forms. The stateful forms buffer per key in sequence
order; Spark has no arrival order, so chunks carry a sequence number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.functions.rewrite import anonymize, deanonymize_entries

FLUSH_CHARS = 100
#: A key whose next chunk has not come for so long is given up: what it holds is put out as far as it is in order.
#: None for runs over all input there is (``availableNow``), which would otherwise wait for the timeouts without end.
TIMEOUT_MS = 3_600_000
_OPEN_TAIL = re.compile(r"\[[A-Z_]*\d*$")


def anonymize_stream(chunks: DataFrame, text: str, **options) -> DataFrame:
    """Each chunk on its own, with the batch expressions; what a chunk border cuts in two is not found."""
    return chunks.withColumn("_a", anonymize(F.col(text), **options)).select("*", F.col("_a.text").alias("anonymized"), F.col("_a.entries").alias("entries")).drop("_a")


def _keep(st: GroupState, held: dict, ended: bool, timeout_ms: int | None) -> None:
    """Writes a key's state back, or removes it after its last chunk."""
    if ended:
        if st.exists:
            st.remove()
        return
    st.update((json.dumps(held),))
    if timeout_ms:
        st.setTimeoutDuration(timeout_ms)


def _timeout(timeout_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout


def buffered_chunks(chunks: DataFrame, key: str, seq: str, text: str, last: str, flush_chars: int = FLUSH_CHARS, timeout_ms: int | None = TIMEOUT_MS) -> DataFrame:
    """(key, part, text): chunks of a key joined until at least ``flush_chars`` characters are held; the rest at the key's last chunk.

    Chunks that arrive before their predecessors wait in the state. Anonymize the parts with
    ``anonymize_stream``. A part's numbering starts anew, as each flush is a text of its own.
    """
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())])
    state = T.StructType([T.StructField("s", T.StringType())])

    def run(k: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(st.get[0]) if st.exists else {"next": 0, "part": 0, "buffer": "", "waiting": {}}
        if st.hasTimedOut:
            st.remove()
            yield pd.DataFrame([(k[0], held["part"], held["buffer"])] if held["buffer"] else [], columns=["key", "part", "text"])
            return
        ended = False
        for pdf in batches:
            for n, t, end in zip(pdf["seq"], pdf["text"], pdf["last"]):
                held["waiting"].setdefault(str(n), [t if isinstance(t, str) else "", bool(end)])
        rows = []
        while (chunk := held["waiting"].pop(str(held["next"]), None)) is not None:
            held["next"] += 1
            held["buffer"] += chunk[0]
            ended = ended or chunk[1]
            if held["buffer"] and (chunk[1] or len(held["buffer"]) >= flush_chars):
                rows.append((k[0], held["part"], held["buffer"]))
                held["part"] += 1
                held["buffer"] = ""
        _keep(st, held, ended, timeout_ms)
        yield pd.DataFrame(rows, columns=["key", "part", "text"])

    laid = chunks.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("int").alias("seq"), F.col(text).alias("text"), F.col(last).alias("last"))
    return laid.groupBy("key").applyInPandasWithState(run, out, state, "append", _timeout(timeout_ms))


def restore_stream(chunks: DataFrame, text: str, entries: str) -> DataFrame:
    """Each chunk restored on its own; a placeholder cut by a border stays."""
    return chunks.withColumn("restored", deanonymize_entries(F.col(text), F.col(entries)))


def joined_placeholders(chunks: DataFrame, key: str, seq: str, text: str, last: str, timeout_ms: int | None = TIMEOUT_MS) -> DataFrame:
    """(key, seq, text): chunks with an unfinished ``[...`` at their end moved to the next chunk, so that restoring chunk by chunk loses nothing."""
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("text", T.StringType())])
    state = T.StructType([T.StructField("s", T.StringType())])

    def run(k: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(st.get[0]) if st.exists else {"next": 0, "tail": "", "waiting": {}}
        if st.hasTimedOut:
            st.remove()
            yield pd.DataFrame([(k[0], held["next"], held["tail"])] if held["tail"] else [], columns=["key", "seq", "text"])
            return
        ended = False
        for pdf in batches:
            for n, t, end in zip(pdf["seq"], pdf["text"], pdf["last"]):
                held["waiting"].setdefault(str(n), [t if isinstance(t, str) else "", bool(end)])
        rows = []
        while (chunk := held["waiting"].pop(str(held["next"]), None)) is not None:
            whole = held["tail"] + chunk[0]
            cut = None if chunk[1] else _OPEN_TAIL.search(whole)
            rows.append((k[0], held["next"], whole[: cut.start()] if cut else whole))
            held["tail"] = whole[cut.start() :] if cut else ""
            ended = ended or chunk[1]
            held["next"] += 1
        _keep(st, held, ended, timeout_ms)
        yield pd.DataFrame(rows, columns=["key", "seq", "text"])

    laid = chunks.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("int").alias("seq"), F.col(text).alias("text"), F.col(last).alias("last"))
    return laid.groupBy("key").applyInPandasWithState(run, out, state, "append", _timeout(timeout_ms))


def requests_per_window(requests: DataFrame, who: str, stamp: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(identity, window, requests) of a stream, closed once the watermark has passed the window."""
    at = F.col(stamp).cast("timestamp")
    return (
        requests.withColumn("_at", at)
        .withWatermark("_at", late)
        .groupBy(F.col(who), F.window("_at", window).alias("window"))
        .agg(F.count("*").alias("requests"))
    )


def observed(df: DataFrame, spans: Column, name: str | Observation = "pii") -> DataFrame:
    """Counts rows, rows with spans and spans while the data flows by."""
    n = F.size(spans)
    return df.observe(name, F.count(F.lit(1)).alias("requests"), F.count_if(n > 0).alias("with_pii"), F.sum(n).alias("spans"))
