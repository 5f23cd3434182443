"""Duplicates hidden by formatting differences (problem 4): canonical keys and an incremental ledger.

A text's canonical key keeps its letters and digits in order, whatever the case, white
space, punctuation and symbols; only between two digits the marks count (or one space, if
there is nothing but white space). Look-alike characters are rewritten first (see
``lookalike``); accents count. A text made of named fields only (a JSON object, or ``name:
value`` throughout) is keyed by its sorted (name, value) pairs, so the order and layout of
the fields don't matter; which names it must hold at least is a parameter. Plain ASCII
text is keyed by JVM expressions; only the rest goes through Python.

The ledger is a table of (grp, key, n, first_id) in bucket folders. A batch is counted
per key first; only the buckets it touches are read, full-outer-joined with it, and
written as a new version; a numbered manifest, renamed into place last, makes the version
visible. A ledger opened on a folder goes on from its newest manifest.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Collection
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.spans import let

from .lookalike import CYRILLIC, GREEK, OTHER_SCRIPTS, SCANNED, default_normalizer, fingerprint
from .storage import publish, shared_folder, texts_in, written



def _marks() -> str:
    """The combining marks of all scripts (accents, voicing marks, vowel signs), which belong to letters, as ranges of a
    character class; variation selectors, which only choose a symbol's look, are left out."""
    selectors = {*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x180B, 0x1810)}
    out: list[list[int]] = []
    for c in chain(*SCANNED):
        if unicodedata.category(chr(c)) in ("Mn", "Mc") and c not in selectors:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


_GAP = re.compile(f"(?:[^\\w{_marks()}]|_)+")
# Gaps of plain text, for Python and the JVM alike: those not between two digits go; between digits, white space goes, but white space alone stays as one space.
_LOOSE = r"(?:^|(?<=[a-z]))[^a-z0-9]++|(?<=[0-9])[^a-z0-9]++(?![0-9])"
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
_BLANK = rf"(?<=[0-9])[{_SPACE}]++(?=[0-9])"
_LOOSE_GAP, _BLANK_GAP, _HELD = re.compile(_LOOSE), re.compile(_BLANK), "\ue000"
_HOLD = str.maketrans({_HELD: " ", **dict.fromkeys(_SPACE)})
_SEPARATORS = (re.compile(r"[\r\n]+"), re.compile(r"\|"), re.compile(r";"), re.compile(r"[\r\n|;]+"))
_FIELD = re.compile(r"\s*(?:[-*•>]\s*)?[\"'“”]?\s*([^\W\d_][\w .-]*?)\s*[\"'“”]?\s*[:=]\s*(.*)", re.S)
_GREEK_ONLY = frozenset("γδθλξπσφψω")


def _case_links() -> dict[int, str]:
    """Case-folded letters joined through capitals drawn alike (Cyrillic ve and b, by their capitals)."""
    out: dict[int, str] = {}
    lower = {k: v for t in OTHER_SCRIPTS for k, v in t.items()}
    for table in (CYRILLIC, GREEK):
        for k, v in table.items():
            small = k.casefold()
            if len(small) == 1 and lower.get(small, v.casefold()) == v.casefold():
                out[ord(small)] = v.casefold()
    return out


_CASE_LINKS = _case_links()
_GREEK_NU = {ord("v"): "n", ord("ν"): "n"}


def _plain_key(text: str) -> str:
    folded = unicodedata.normalize("NFD", text.casefold())
    # Capital nu is drawn like N, small nu like v: in a text with letters only Greek has, both are nu.
    greek = not folded.isascii() and not _GREEK_ONLY.isdisjoint(folded)
    if not folded.isascii():
        folded = folded.translate(_CASE_LINKS)
        if greek:
            folded = folded.translate(_GREEK_NU)

    if folded.isascii():
        return _BLANK_GAP.sub(_HELD, _LOOSE_GAP.sub("", folded)).translate(_HOLD)

    def gap(m: re.Match) -> str:
        a, b = m.start() - 1, m.end()
        if a < 0 or b >= len(folded) or not (folded[a].isdecimal() and folded[b].isdecimal()):
            return ""
        return "".join(m.group().split()) or " "

    return _GAP.sub(gap, folded)


def _fields(text: str, required: Collection[str]) -> list[tuple[str, str]] | None:
    """The (name, value) pairs of a text made of at least two named fields only, the required ones among them, else None."""
    low = text.casefold()
    if not (":" in text or "=" in text) or not all(name in low for name in required):
        return None
    body = text.strip()
    inner = re.sub(r"^[\s\"'“”*>-]*(?=\{)|(?<=\})[\s\"'“”.!;,]*$", "", body)
    if inner[:1] == "{" and inner[-1:] == "}":
        try:
            parsed = json.loads(re.sub(r"[\r\n\t]", " ", inner), object_pairs_hook=list)
        except ValueError:
            parsed = None
        if isinstance(parsed, list) and all(not isinstance(v, list) for _, v in parsed):
            return [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in parsed]
    for separator in _SEPARATORS:
        pairs = []
        for piece in separator.split(body):
            if not piece.strip(" \t\"'“”.!?…*-"):
                continue
            m = _FIELD.fullmatch(piece)
            if not m:
                break
            pairs.append((m.group(1), m.group(2)))
        else:
            if len(pairs) > 1 and {*required} <= {_plain_key(k) for k, _ in pairs}:
                return pairs
    return None


def copy_key(text: str, required: Collection[str] = ()) -> str:
    """The string that is equal for two texts exactly if they are copies of each other; blank texts give a lone separator."""
    look = default_normalizer().rewrite(text)
    pairs = _fields(look, required)
    if pairs and {*required} <= {_plain_key(k) for k, _ in pairs}:
        return "\x1e" + "\x1e".join(sorted({f"{_plain_key(k)}\x1f{_plain_key(v)}" for k, v in pairs}))
    key = _plain_key(look)
    # A text of marks only has no letters to go by: it is a copy of the same marks.
    return key or "\x1d" + "".join(look.split())


def _key_column(text: Column, required: Collection[str]) -> Column:
    """The canonical key: ASCII text that can't be made of fields in the JVM, the rest by an Arrow UDF."""
    needed = frozenset(required)

    @F.arrow_udf(T.StringType())
    def in_python(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else copy_key(t, needed) for t in texts.to_pylist()], pa.string())

    # Declared nondeterministic so that the planner doesn't run it twice, below the filter on the key and above it.
    in_python = in_python.asNondeterministic()
    low = F.lower(text)
    plain = text.rlike(r"\A[\x00-\x7f]*\z") & ~(text.rlike("[:=]") & reduce(lambda a, b: a & b, [low.contains(n) for n in sorted(needed)], F.lit(True)))
    key = F.translate(F.regexp_replace(F.regexp_replace(low, _LOOSE, ""), _BLANK, _HELD), _HELD + _SPACE, " ")
    made = let(key, lambda k: F.when(k != "", k).otherwise(F.concat(F.lit("\x1d"), F.translate(text, _SPACE, ""))))
    return F.when(plain, made).otherwise(in_python(F.when(~plain, text)))


def keyed_records(records: DataFrame, group_col: str, id_col: str, text_col: str, required: Collection[str] = ()) -> DataFrame:
    """(grp, id, key) of every record with a non-blank text; key is 128 bits of the canonical key.

    ``required`` names the fields a text of named fields holds at least; without it, any two or more make one.
    """
    return (
        records.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        .where("t is not null and id is not null")
        .withColumn("k", _key_column(F.col("t"), required))
        .where(F.col("k") != "\x1d")
        .select("grp", "id", fingerprint(F.col("k")).alias("key"))
    )


class CopyLedger:
    """Counts of copies per canonical key, kept in bucket folders under a shared path.

    ``add`` folds in one batch of (grp, id, key): rows repeated with one id inside a batch
    count once; a batch may bring keys that older batches hold. Null ids and texts are
    left out by ``keyed_records``. An empty batch leaves the ledger as it is. Opened on the
    folder of an older ledger, it keeps that one's counts, schema and number of buckets; a new
    one has as many buckets as its first batch needs at ``keys_per_bucket``. Of two writers that start from one manifest the second fails: neither's batch is lost unseen.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, keys_per_bucket: int = 2_000_000) -> None:
        self.spark, self.buckets, self.keys_per_bucket = spark, buckets, keys_per_bucket
        self.path = path or shared_folder(spark, f"ledger-{uuid.uuid4().hex}")
        self.versions: dict[int, str] = {}
        self.schema: T.StructType | None = None
        self.manifest = 0
        self._load()

    def _load(self) -> None:
        kept = texts_in(self.spark, f"{self.path}/_manifests")
        if not kept:
            return
        self.manifest = max(int(name) for name in kept)
        state = json.loads(kept[f"{self.manifest:09d}"])
        self.buckets, self.schema = state["buckets"], T.StructType.fromJson(state["schema"])
        self.versions = {int(b): f"{self.path}/{folder}" for b, folder in state["versions"].items()}

    def _publish(self, versions: dict[int, str], schema: T.StructType) -> None:
        """Makes the versions visible: to other ledgers of the folder, then to this one."""
        folders = {str(b): v.rsplit("/", 1)[1] for b, v in versions.items()}
        state = {"buckets": self.buckets, "schema": schema.jsonValue(), "versions": folders}
        publish(self.spark, f"{self.path}/_manifests", f"{self.manifest + 1:09d}", json.dumps(state))
        self.manifest, self.versions, self.schema = self.manifest + 1, versions, schema

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _open(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(path)

    def add(self, batch: DataFrame) -> None:
        fresh = batch.distinct().groupBy("grp", "key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        name = f"{self.path}/v{self.manifest:06d}-{uuid.uuid4().hex[:8]}"
        if self.buckets is None:
            # Counted once, from a written batch, so that the number of buckets follows the number of keys.
            fresh = written(fresh, "ledger-batch")
            self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-fresh.count() // self.keys_per_bucket))
        fresh = fresh.withColumn("bucket", self._bucket())
        self.schema = self.schema or fresh.schema
        if not self.versions:
            self._write(fresh, name)
        else:
            staged = f"{name}-batch"
            self._write(fresh, staged)
            touched = self._open(staged)
            old = self._read([r["bucket"] for r in touched.select("bucket").distinct().collect()])
            self._write(self._merge(old, touched.select("grp", "key", "n", "first_id")), name)
        self._publish(self.versions | {r["bucket"]: name for r in self._open(name).select("bucket").distinct().collect()}, self.schema)

    def _merge(self, old: DataFrame, new: DataFrame) -> DataFrame:
        o = old.select("grp", "key", F.col("n").alias("on"), F.col("first_id").alias("of"))
        joined = new.join(o, (new["grp"].eqNullSafe(o["grp"])) & (new["key"] == o["key"]), "full_outer")
        return joined.select(
            F.coalesce(new["grp"], o["grp"]).alias("grp"),
            F.coalesce(new["key"], o["key"]).alias("key"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("on", F.lit(0))).alias("n"),
            F.least("first_id", "of").alias("first_id"),
        ).withColumn("bucket", self._bucket())

    def _read(self, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the named buckets (all without a list), each from the last version that wrote it."""
        by_version: dict[str, list[int]] = {}
        for b, version in self.versions.items():
            if buckets is None or b in buckets:
                by_version.setdefault(version, []).append(b)
        out = None
        for version, own in by_version.items():
            part = self._open(version).where(F.col("bucket").isin(own)).select("grp", "key", "n", "first_id")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "grp string, key binary, n long, first_id long")

    def table(self) -> DataFrame:
        """(grp, key, n, first_id): one row per set of copies, n its records, first_id the smallest id."""
        return self._read()


def copies_of(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """(grp, first_id, copy_id): every record that is a copy of a record of its group with a smaller id.

    Sets that hold more than a thousandth of all records are fewer than a thousand, so
    their ledger rows are broadcast; all others meet their records in a shuffled join.
    """
    sets = table.where("n > 1")
    records = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sets.where(F.col("n") * 1000 > records)
    rest = sets.where(F.col("n") * 1000 <= records)
    on_hot = keyed.join(F.broadcast(hot), ["grp", "key"])
    on_rest = keyed.join(F.broadcast(hot.select("grp", "key")), ["grp", "key"], "left_anti").join(rest, ["grp", "key"])
    both = on_hot.unionByName(on_rest)
    return both.where("id <> first_id").select("grp", "first_id", F.col("id").alias("copy_id")).distinct()
