"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

Spark splits the texts into words, once. Each task lays its documents into blocks of
bounded text; a block keeps its distinct words, and each document its words as positions in
that list. Both are written, so a text is never shuffled and a word occurrence is one small
integer. The words of all blocks meet by word, each distinct word is encoded once, and the
ids go back to their blocks, where the positions turn into ids.

A word that is in very many blocks is dealt out by a salt of its blocks (and then encoded
once per salt), so " the" is nobody's task alone. The number of blocks follows the size of
the input, the number of partitions is bounded apart from it (``MAX_PARTITIONS``).

The split runs in the JVM with the tokenizer's published pattern; the vocabulary file is
read on the driver (its path is a parameter) and sent to the executors (under 1 MB).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text of a block in bytes; bounds what is held at a time (a longer document is a block of its own).
BLOCK_BYTES = 4 << 20
#: Stored input for each partition of an exchange, up to so many partitions; beyond that a partition's share grows.
PARTITION_BYTES, MAX_PARTITIONS = 2 << 20, 20_000
#: Blocks of one word that a task is given at most.
BLOCKS_PER_WORD = 1 << 16


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoder(ranks: tuple[tuple[bytes, int], ...]):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


def split_words(text) -> F.Column:
    """Array of the words of a text column, in order; concatenated they give the text. Null and empty give []."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0)), F.array().cast("array<string>"))


_LAID = "block long, doc long, at array<int>, words array<string>"
_LAID_SCHEMA = pa.schema([("block", pa.int64()), ("doc", pa.int64()), ("at", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))])


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _lay(block_bytes: int):
    """Documents as lists of words -> their blocks: a row per document with its positions, and one row with the block's words."""

    def close(block: int, docs: list[pa.Array], lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        doc, words = pa.concat_arrays(docs), pa.concat_arrays(lists)
        coded = words.flatten().dictionary_encode()
        ends = _offsets(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        at = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), coded.indices.cast(pa.int32()))
        n = len(doc)
        blocks = pa.array(np.full(n, block), pa.int64())
        yield pa.record_batch([blocks, doc, at, pa.nulls(n, pa.list_(pa.string()))], schema=_LAID_SCHEMA)
        own = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        yield pa.record_batch([pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), own], schema=_LAID_SCHEMA)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        docs: list[pa.Array] = []
        lists: list[pa.Array] = []
        for batch in batches:
            sizes = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                # As many documents of the batch as the block has room for, at least one if it is empty.
                before = int(sizes[first - 1]) if first else 0
                last = int(np.searchsorted(sizes, before + block_bytes - size, side="right"))
                last = max(last, first + (size == 0))
                if last > first:
                    docs.append(batch.column(0).slice(first, last - first))
                    lists.append(batch.column(1).slice(first, last - first))
                    size += int(sizes[last - 1]) - before
                if last < batch.num_rows or size >= block_bytes:
                    yield from close(block, docs, lists)
                    block, size, docs, lists = block + 1, 0, [], []
                first = last
        if docs:
            yield from close(block, docs, lists)

    return lay


def _place(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Ids of a block's documents: positions in the block's list of words turn into ids, all in columns."""
    docs, words = docs.combine_chunks(), words.combine_chunks()
    order = pc.sort_indices(words.column("at"))
    ids = words.column("ids").combine_chunks()
    ids = (pa.concat_arrays(ids.chunks or [pa.array([], pa.list_(pa.int32()))]) if isinstance(ids, pa.ChunkedArray) else ids).take(order)
    at = docs.column("at").combine_chunks()
    at = pa.concat_arrays(at.chunks) if isinstance(at, pa.ChunkedArray) else at
    taken = ids.take(at.flatten())
    ends = _offsets(pc.list_value_length(taken).to_numpy(zero_copy_only=False))
    starts = _offsets(pc.list_value_length(at).to_numpy(zero_copy_only=False))
    out = pa.ListArray.from_arrays(pa.array(ends[starts].astype(np.int32)), taken.flatten().cast(pa.int32()))
    return pa.table({"doc": docs.column("doc"), "ids": out})


def _input_bytes(rows: DataFrame, text_col: str) -> int:
    """Size of the input by the planner's estimate from file sizes; where it has none, the texts are measured."""
    try:
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001  the estimate is an internal of the planner
        size = 1 << 62
    if size < 1 << 50:
        return size
    return rows.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def partitions_for(size: int, least: int) -> int:
    """Partitions of an exchange for so many bytes of stored input."""
    return max(least, min(-(-size // PARTITION_BYTES), MAX_PARTITIONS))


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES, blocks_per_word: int = BLOCKS_PER_WORD) -> DataFrame:
    """(id, ids): the token ids of every row's text, without special tokens (their strings are ordinary text).

    One output row per input row, repeated rows and null ids included; a null and an empty
    text give an empty list; an empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(tuple(sorted(read_ranks(vocabulary).items())))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    size = _input_bytes(documents, text_col)
    parts = partitions_for(size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = rows.select("doc", split_words(F.col("text")).alias("words"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    laid = written(split.mapInArrow(_lay(block_bytes), _LAID), "token-blocks")
    own = laid.where("words is not null").select("block", F.posexplode("words").alias("at", "word"))
    # Text takes several times its stored size: a generous guess of the blocks, which only has to see that a word's share is bounded.
    salts = max(1, 8 * size // block_bytes // blocks_per_word)
    salt = [F.pmod(F.xxhash64("block"), F.lit(salts))] if salts > 1 else []
    by_word = own.repartition(parts, "word", *salt).sortWithinPartitions("word")

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoder(ranks.value).encode_ordinary
        last, last_ids = None, None
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            found = coded.dictionary.to_pylist()
            ids = [last_ids if w == last else one(w) for w in found]
            if found:  # words come in order: only the last one can go on in the next batch
                last, last_ids = found[-1], ids[-1]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())).take(coded.indices)], names=["block", "at", "ids"])

    encoded = by_word.mapInArrow(encode_words, "block long, at int, ids array<int>").repartition(parts, "block")
    docs = laid.where("at is not null").select("block", "doc", "at").repartition(parts, "block")
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = docs.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_place, schema)
    return out.withColumnRenamed("doc", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): the text of each list of ids, by a join of its ids with the table of pieces; null gives null.

    The table (a property of the tokenizer, under 1 MB) is on every executor, and each batch of ids is joined
    with it by number, in place: nothing is shuffled, and a long list of ids needs no regrouping.
    """
    ranks = read_ranks(vocabulary)
    table = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    pieces = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(pieces.value, pa.binary())
        for batch in batches:
            ids = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            joined = pa.ListArray.from_arrays(pa.array(_offsets(lengths).astype(np.int32)), values.take(ids.flatten()))
            text = pc.binary_join(joined, b"").cast(pa.string())
            yield pa.record_batch([batch.column(0), pc.if_else(pc.is_valid(ids), text, pa.scalar(None, pa.string()))], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id bigint, text string").withColumnRenamed("id", id_col)
