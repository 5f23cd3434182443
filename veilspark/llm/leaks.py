"""Evaluation texts leaking into training text (problem 8): BM25 index with block-max WAND, exact verification.

The test items are indexed, the corpus asks. A passage of a document is a maximal run of
consecutive words that occur in the index; a run of at least ``n`` (12) consecutive words
of an item cannot cross its border, so asking passage by passage loses nothing. Impacts are
BM25 weights divided by the item's own threshold, the lowest score that any window of n of
its words reaches; every passage holding such a window scores at least 1, so retrieval
above 1 is complete. WAND with block maxima skips the items that cannot reach it. Retrieved
items are verified word by word.

Items are indexed in shards of bounded size (``shard_words``); each shard is one pass over
the corpus, and its index is given up before the next one is broadcast, so what is held at
a time has a fixed upper size whatever the number of items.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """Longest runs of letters and digits, without case; canonical composition first."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFC", text).lower())


class ItemIndex:
    """Inverted index of test items with BM25 impacts, in blocks of postings with their maxima."""

    def __init__(self, items: list[tuple[int, str]], n: int = 12, k1: float = 1.2, b: float = 0.75, block: int = 16) -> None:
        self.n, self.block, self.shortest_run = n, block, b"\1" * n
        self.item_ids: list[int] = []
        texts: list[list[str]] = []
        for item, text in sorted(items):
            w = words_of(text or "")
            if len(w) >= n:
                self.item_ids.append(item)
                texts.append(w)
        self.vocabulary: dict[str, int] = {}
        coded = [[self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w] for w in texts]
        documents = len(coded)
        average = sum(map(len, coded)) / documents if documents else 1.0
        frequency = Counter(t for c in coded for t in set(c))
        idf = {t: math.log(1 + (documents - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}
        postings: dict[int, list[tuple[int, float]]] = {}
        self.windows: list[set[tuple[int, ...]]] = []
        for d, c in enumerate(coded):
            tf = Counter(c)
            norm = k1 * (1 - b + b * len(c) / average)
            weight = {t: idf[t] * f * (k1 + 1) / (f + norm) for t, f in tf.items()}
            windows = {tuple(c[i : i + n]) for i in range(len(c) - n + 1)}
            threshold = min(sum(weight[t] for t in set(w)) for w in windows)
            self.windows.append(windows)
            for t, x in weight.items():
                # A little above the ratio, so rounding can't push a true window below 1.
                postings.setdefault(t, []).append((d, x / threshold * (1 + 1e-9)))
        self.items = documents
        self.postings = sum(map(len, postings.values()))
        self.scored = 0
        # Per term: items in order, their impacts, the highest impact of all and of each block of items.
        self.docs = {t: [d for d, _ in p] for t, p in postings.items()}
        self.impacts = {t: [x for _, x in p] for t, p in postings.items()}
        self.bound = {t: max(x) for t, x in self.impacts.items()}
        self.block_max: dict[int, dict[int, float]] = {}
        for t, p in postings.items():
            own = self.block_max[t] = {}
            for d, x in p:
                own[d // block] = max(own.get(d // block, 0.0), x)

    def retrieve(self, query: list[int], threshold: float = 1.0) -> list[int]:
        """Block-max WAND: all items whose score for the distinct query terms reaches the threshold, in order.

        Cursors stand on each term's next item. Terms in order of these items are added up by their bounds until the
        threshold can be reached: no item before that term's (the pivot) can reach it. If the maxima of the pivot's block
        can't either, the cursors leap over the block; only else are postings scored, counted in ``scored``.
        """
        bound = self.bound
        terms = list(set(query))
        if sum([bound[t] for t in terms]) < threshold:
            return []
        docs, impacts, block_max, block = self.docs, self.impacts, self.block_max, self.block
        cursors = [(docs[t][0], t, 0) for t in terms]
        found: list[int] = []

        def leap(moved: list[tuple[int, int, int]], to: int) -> list[tuple[int, int, int]]:
            out = []
            for _, t, at in moved:
                own = docs[t]
                at = bisect_left(own, to, at)
                if at < len(own):
                    out.append((own[at], t, at))
            return out

        while cursors:
            cursors.sort()
            reach, n = 0.0, 0
            for _, t, _ in cursors:
                reach += bound[t]
                n += 1
                if reach >= threshold:
                    break
            else:
                break
            pivot = cursors[n - 1][0]
            while n < len(cursors) and cursors[n][0] == pivot:
                n += 1
            number = pivot // block
            if sum([block_max[t].get(number, 0.0) for _, t, _ in cursors[:n]]) < threshold:
                to = (number + 1) * block
                if n < len(cursors):
                    to = min(to, cursors[n][0])
                cursors = leap(cursors[:n], to) + cursors[n:]
            elif cursors[0][0] == pivot:
                score = sum([impacts[t][at] for _, t, at in cursors[:n]])
                self.scored += n
                if score >= threshold:
                    found.append(pivot)
                cursors = leap(cursors[:n], pivot + 1) + cursors[n:]
            else:
                cursors = leap([c for c in cursors[:n] if c[0] < pivot], pivot) + [c for c in cursors if c[0] >= pivot]
        return found

    def leaked(self, text: str) -> list[int]:
        """Ids of the items of which the text holds n consecutive words."""
        vocabulary, n = self.vocabulary, self.n
        words = words_of(text)
        known = bytes([w in vocabulary for w in words])
        start = known.find(self.shortest_run)
        hits: set[int] = set()
        while start >= 0:
            end = known.find(b"\0", start)
            end = len(words) if end < 0 else end
            run = [vocabulary[w] for w in words[start:end]]
            candidates = [d for d in self.retrieve(run) if d not in hits]
            if candidates:
                grams = {tuple(run[i : i + n]) for i in range(len(run) - n + 1)}
                hits.update(d for d in candidates if not grams.isdisjoint(self.windows[d]))
            start = known.find(self.shortest_run, end)
        return [self.item_ids[d] for d in sorted(hits)]


def _shards(items: DataFrame, shard_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of at most ``shard_words`` words (a longer item is a shard of its own)."""
    own, size = [], 0
    for r in items.toLocalIterator():
        words = len(words_of(r["text"] or ""))
        if own and size + words > shard_words:
            yield own
            own, size = [], 0
        own.append((r["id"], r["text"]))
        size += words
    if own:
        yield own


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = 12, shard_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id) of each document holding at least ``n`` consecutive words of an item.

    Copies of a document count separately; rows repeated with one id give their pairs once.
    Null and empty texts, and items of fewer than n words, give nothing; empty tables give
    an empty result; other columns are ignored. Whole texts are read.
    """
    spark = documents.sparkSession
    schema = T.StructType([T.StructField(doc_id, T.LongType()), T.StructField(item_id, T.LongType())])
    wanted = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    corpus = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).where("t is not null and d is not null")
    shards = _shards(wanted, shard_words)
    shard, following = next(shards, None), next(shards, None)
    found = None
    while shard is not None:
        index = spark.sparkContext.broadcast(ItemIndex(shard, n))

        def ask(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            leaked = index.value.leaked
            for pdf in batches:
                rows = [(d, i) for d, t in zip(pdf["d"], pdf["t"]) for i in leaked(t)]
                yield pd.DataFrame(rows, columns=[doc_id, item_id])

        part = corpus.mapInPandas(ask, schema)
        if found is not None or following is not None:
            # Several shards: each one's result is written and its index given up, so one index is held at a time.
            part = written(part, "leaks")
            index.destroy()
        found = part if found is None else found.unionByName(part)
        shard, following = following, next(shards, None)
    return spark.createDataFrame([], schema) if found is None else found.distinct()
