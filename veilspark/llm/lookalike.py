"""Visually identical text with different characters (problem 2).

Look-alike classes are the connected components of a graph whose nodes are code
points and short strings: two nodes are joined if they are drawn alike. The edges come
from rules over the Unicode character database (full-width forms, ligatures, spaces,
hyphens) and from a small table of letters of other scripts; union-find closes them
transitively. Each class is represented by its most frequent code point in the corpus
(ties: the smallest), and an Aho-Corasick automaton rewrites every other member,
leftmost-longest. Canonical decomposition before and composition after the rewrite make
composed and separate accents equal; invisible characters are dropped.

What stays different: letter case, accents, raised digits, ordinary spaces, tabs and
line breaks, typographic quotes and dashes.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.sources.readers import spread

from .storage import written

# Letters of other scripts that are drawn like a Latin letter.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I",
}
GREEK = {
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
}
ARMENIAN = {"օ": "o", "ո": "n", "հ": "h", "ս": "u", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L"}
CHEROKEE = {
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭵ": "i", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
LISU = {
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M",
    "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
COPTIC = {"ⲟ": "o", "ⲥ": "c", "ⲣ": "p", "Ⲟ": "O", "Ⲥ": "C", "Ⲣ": "P", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T", "Ⲭ": "X"}
OTHER_SCRIPTS = (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, COPTIC)

#: Tags of compatibility decompositions that keep the look (others, such as <super>, change it).
_SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>")
#: Format characters that are drawn.
_VISIBLE_FORMAT = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD}
_FILLERS = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5}


def _is_invisible(cp: int) -> bool:
    if cp in _FILLERS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F:
        return True
    return unicodedata.category(chr(cp)) == "Cf" and cp not in _VISIBLE_FORMAT


class UnionFind:
    """Disjoint sets of strings with path halving and union by size."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}
        self.size: dict[str, int] = {}

    def find(self, x: str) -> str:
        if x not in self.parent:
            self.parent[x], self.size[x] = x, 1
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in out.values() if len(c) > 1]


#: Code points that can be looked at for rules: without ideographs, Hangul syllables, surrogates and private use, none of which qualifies.
SCANNED = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0xE0000, 0xE1000))


def look_alike_edges() -> Iterator[tuple[str, str]]:
    """Pairs of strings drawn alike: by rule over the character database, then by the letter table."""
    for cp in chain(*SCANNED):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs" and cp != 0x1680:
            yield c, " "
            continue
        tag, _, codes = unicodedata.decomposition(c).partition(" ")
        if tag in _SAME_LOOK_TAGS:
            target = "".join(chr(int(x, 16)) for x in codes.split())
            yield c, unicodedata.normalize("NFD", "-" if target == "‐" else target)
        elif tag == "<compat>" and ("LIGATURE" in (name := unicodedata.name(c, "")) or "ROMAN NUMERAL" in name):
            yield c, unicodedata.normalize("NFKD", c)
    yield "‐", "-"
    for table in OTHER_SCRIPTS:
        yield from table.items()


def invisible_code_points() -> list[int]:
    return [cp for cp in chain(*SCANNED) if _is_invisible(cp)]


@lru_cache(maxsize=1)
def look_alike_classes() -> tuple[tuple[str, ...], ...]:
    """Transitive classes of strings drawn alike (a function of the Unicode tables only)."""
    sets = UnionFind()
    for a, b in look_alike_edges():
        sets.union(a, b)
    return tuple(map(tuple, sets.classes()))


def rewrite_table(frequency: dict[str, int] | None = None) -> dict[str, str]:
    """Member -> representative, for members that are not their own representative.

    The representative of a class is its most frequent single code point; without
    frequencies, the smallest one (an ASCII character where the class has one). A string
    of several code points (a ligature's spelling) is rewritten code point by code point,
    so every member of its class ends in the same spelling.
    """
    single: dict[str, str] = {}
    spelled: dict[str, str] = {}
    for members in look_alike_classes():
        chars = [m for m in members if len(m) == 1]
        strings = [m for m in members if len(m) > 1]
        if strings:  # a ligature and its spelling: the spelling is what remains
            spelled.update({m: strings[0] for m in chars})
            continue
        count = (lambda m: (frequency or {}).get(m, 0)) if frequency else (lambda m: 0)
        best = min(chars, key=lambda m: (-count(m), m))
        single.update({m: best for m in chars if m != best})
    table = dict(single)
    for m, spelling in spelled.items():
        table[m] = "".join(single.get(c, c) for c in spelling)
    return table


class Normalizer:
    """Rewrites text into its one consistent form. Built on the driver or a worker from plain data."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table
        self.ascii_stable = not any(k.isascii() for k in table)
        automaton = ahocorasick.Automaton()
        for member, representative in table.items():
            automaton.add_word(member, (len(member), representative))
        for cp in invisible_code_points():
            automaton.add_word(chr(cp), (1, ""))
        automaton.make_automaton()
        self.automaton = automaton

        # Characters that are in their form already: text of these alone needs no work, accented Latin above all.
        stays = [c for c in map(chr, (*range(0x80, 0x250), *range(0x2010, 0x205F), 0x20AC)) if self._rewritten(c) == c]
        self.stable = re.compile("[\x00-\x7f" + "".join(map(re.escape, stays)) + "]*")

    def rewrite(self, text: str) -> str:
        if self.ascii_stable:
            if text.isascii() or self.stable.fullmatch(text):
                return text
        return self._rewritten(text)

    def _rewritten(self, text: str) -> str:
        text = unicodedata.normalize("NFD", text)
        parts, last = [], 0
        for end, (length, representative) in self.automaton.iter_long(text):
            parts += (text[last : end + 1 - length], representative)
            last = end + 1
        parts.append(text[last:])
        return unicodedata.normalize("NFC", "".join(parts))


    def aligned(self, text: str) -> tuple[str, Places]:
        """The consistent form with its places in the text, worked out cluster by cluster (a character with its marks)."""
        clean = self.rewrite(text)
        if clean == text:
            return clean, Places([], [], [])
        parts, at_clean, at_text, widths, c = [], [], [], [], 0
        for m in _CLUSTER.finditer(text):
            own = m.group()
            new = own if own.isascii() else self.rewrite(own)
            at_clean.append(c)
            at_text.append(m.start())
            widths.append(len(new) if len(new) == len(own) else -1)
            parts.append(new)
            c += len(new)
        at_clean.append(c)
        at_text.append(len(text))
        return "".join(parts), Places(at_clean, at_text, widths)


#: Plain runs, or one character outside ASCII (or before such marks) with the marks and invisible characters behind it.
_CLUSTER = re.compile(r"[\x00-\x7f]+(?![\u0300-\u036f\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff\u00ad])|[\s\S][\u0300-\u036f\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff\u00ad]*")


class Places:
    """Where positions of the consistent form lie in the text it was made from."""

    def __init__(self, clean: list[int], text: list[int], widths: list[int]) -> None:
        self.clean, self.text, self.widths = clean, text, widths

    def start(self, p: int) -> int:
        """The first character of the text that has part in position p."""
        if not self.clean:
            return p
        i = bisect_right(self.clean, p) - 1
        return self.text[i] + (p - self.clean[i] if i < len(self.widths) and self.widths[i] >= 0 else 0)

    def end(self, p: int) -> int:
        """One past the last character of the text that has part in what ends at p."""
        if not self.clean:
            return p
        i = bisect_left(self.clean, p) - 1
        if i < 0:
            return 0
        return self.text[i] + p - self.clean[i] if self.widths[i] >= 0 else self.text[i + 1]


@lru_cache(maxsize=4)
def _worker_normalizer(items: tuple[tuple[str, str], ...]) -> Normalizer:
    return Normalizer(dict(items))


@lru_cache(maxsize=1)
def default_normalizer() -> Normalizer:
    """Representatives without corpus counts: ASCII wherever a class has an ASCII member."""
    return Normalizer(rewrite_table())


def code_point_counts(texts: DataFrame, text_col: str) -> dict[str, int]:
    """Corpus counts of the code points that belong to a look-alike class.

    Counted in blocks on the executors and summed by code point; what reaches the driver
    is bounded by the members of all classes (a property of Unicode, not of the data).
    """
    members = sorted({m for c in look_alike_classes() for m in c if len(m) == 1})

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        wanted = set(members)
        for pdf in batches:
            for t in pdf.iloc[:, 0].dropna():
                total.update(t)
        kept = [(c, n) for c, n in total.items() if c in wanted]
        yield pd.DataFrame(kept, columns=["c", "n"])

    rows = (
        texts.select(F.col(text_col).cast("string"))
        .mapInPandas(count, "c string, n long")
        .groupBy("c")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return {r["c"]: r["n"] for r in rows}


def canonical_text(table: dict[str, str] | None = None):
    """Column -> Column: the consistent form of a text (null gives null, empty gives empty)."""
    items = tuple(sorted((rewrite_table() if table is None else table).items()))

    @F.arrow_udf(T.StringType())
    def canonical(texts: pa.Array) -> pa.Array:
        rewrite = _worker_normalizer(items).rewrite
        return pa.array([None if t is None else rewrite(t) for t in texts.to_pylist()], pa.string())

    # Declared nondeterministic so that the planner doesn't run it twice, below a filter on its result and above it.
    canonical = canonical.asNondeterministic()
    if any(k.isascii() for k, _ in items):
        return canonical
    # ASCII text is in its form already and stays in the JVM.

    def form(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        plain = text.rlike(r"\A[\x00-\x7f]*\z")
        return F.when(plain, text).otherwise(canonical(F.when(~plain, text)))

    return form


def fingerprint(c: Column) -> Column:
    """128 bits that stand for a string in shuffles (equal strings only, up to a chance below 2^-60 for 10^10 rows)."""
    return F.unhex(F.md5(c))


def _look_keys(records: DataFrame, group_col: str, id_col: str, text_col: str, table: dict[str, str] | None) -> DataFrame:
    """(g, id, look, spelling) of every record with a visible text, written once: the rewrite runs in Python and several branches read its result."""
    canonical = canonical_text(table)
    return written(
        records.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        .where("t is not null and id is not null")
        .withColumn("c", canonical("t"))
        .where(F.col("c").rlike(r"\S"))
        .select("g", "id", fingerprint(F.col("c")).alias("look"), fingerprint(F.col("t")).alias("spelling")),
        "look-keys",
    )


def _varied(keyed: DataFrame) -> DataFrame:
    """(g, look, spelling, n, first, class_id, kinds): the spellings of every look that has several, with their records and smallest ids.

    Looks with one spelling are most of the corpus; they leave before anything is joined.
    """
    spellings = keyed.groupBy("g", "look", "spelling").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    looks = spellings.groupBy("g", "look").agg(F.count("*").alias("kinds"), F.min("first").alias("class_id")).where("kinds > 1")
    return spellings.join(looks.withColumnsRenamed({"g": "_g", "look": "_l"}), F.col("g").eqNullSafe(F.col("_g")) & (F.col("look") == F.col("_l"))).drop("_g", "_l")


def look_classes(records: DataFrame, group_col: str, id_col: str, text_col: str, table: dict[str, str] | None = None) -> DataFrame:
    """(group, id, class_id, spelling_id, n_spellings): one row per record whose look is also written differently.

    ``class_id`` is the smallest id with that look, ``spelling_id`` the smallest with the very same text. Records of
    one class with different spelling_id are the pairs of ``same_look_pairs``; a class of any size stays one row per record.
    """
    keyed = _look_keys(records, group_col, id_col, text_col, table)
    kinds = written(_varied(keyed), "look-spellings")
    return _with_spellings(keyed, kinds).select(F.col("g").alias(group_col), "id", "class_id", F.col("first").alias("spelling_id"), F.col("kinds").alias("n_spellings")).distinct()


def _with_spellings(keyed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Records joined with their spellings; those of spellings that hold over a thousandth of all records (fewer than a thousand) by broadcast."""
    total = keyed.count()
    spread_over = ["g", "look", "spelling"]
    hot, rest = kinds.where(F.col("n") * 1000 > total), kinds.where(F.col("n") * 1000 <= total)
    known = keyed.where("g is not null").join(F.broadcast(hot), spread_over)
    return known.unionByName(keyed.where("g is not null").join(F.broadcast(hot.select(*spread_over)), spread_over, "left_anti").join(rest, spread_over))


def same_look_pairs(records: DataFrame, group_col: str, id_col: str, text_col: str, table: dict[str, str] | None = None, share: int = 100_000) -> DataFrame:
    """Pairs of records of one group whose texts look the same but differ in characters.

    Input: any DataFrame with the three named columns; other columns are ignored. Output:
    (group, id_a, id_b), id_a < id_b, each pair once. Null and blank texts (nothing but
    white space and invisible characters) give no pair; rows repeated with one id count
    once; equal texts are no pair; rows without a group give no pair. An empty input gives an empty result.

    Distinct spellings are paired inside their class, then spread to their records, so
    copies of one spelling are never joined with each other. The records of a spelling are dealt out to
    parts of about ``share`` records, which its pairs meet one by one, so a frequent spelling is nobody's task alone.
    """
    keyed = _look_keys(records, group_col, id_col, text_col, table)
    kinds = written(_varied(keyed), "look-spellings")
    salts = lambda n: F.ceil(F.col(n) / share).cast("int")
    members = _with_spellings(keyed, kinds).select("g", "look", "spelling", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / share)).cast("int").alias("salt")).distinct()
    a = kinds.select("g", "look", F.col("spelling").alias("sa"), F.col("n").alias("na"))
    b = kinds.select("g", "look", F.col("spelling").alias("sb"), F.col("n").alias("nb"))
    pairs = a.join(b, ["g", "look"]).where("sa < sb")
    parts = lambda n: F.explode(F.sequence(F.lit(0), salts(n) - 1))
    left = members.select("g", F.col("spelling").alias("sa"), F.col("salt").alias("pa"), F.col("id").alias("ida"))
    right = members.select("g", F.col("spelling").alias("sb"), F.col("salt").alias("pb"), F.col("id").alias("idb"))
    return (
        pairs.withColumn("pa", parts("na"))
        .join(left, ["g", "sa", "pa"])
        .withColumn("pb", parts("nb"))
        .join(right, ["g", "sb", "pb"])
        .where("ida <> idb")
        .select("g", F.least("ida", "idb").alias("id_a"), F.greatest("ida", "idb").alias("id_b"))
        .distinct()
        .withColumnRenamed("g", group_col)
    )


def corpus_table(texts: DataFrame, text_col: str) -> dict[str, str]:
    """Rewrite table with representatives chosen by the frequencies of this corpus."""
    return rewrite_table(code_point_counts(texts, text_col))


def normalized(df: DataFrame, text_col: str, out_col: str, table: dict[str, str] | None = None) -> DataFrame:
    """The operator itself: adds the consistent form of ``text_col`` as ``out_col``; all rows and columns stay."""
    return df.withColumn(out_col, canonical_text(table)(F.col(text_col)))


def session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two prompt tables as (src, rec_id, text)."""
    chats = spark.read.parquet(f"{sf_dir}/chat_requests.parquet").select(
        F.lit("chat_requests").alias("src"), F.col("request_id").cast("bigint").alias("rec_id"), F.col("prompt").alias("text")
    )
    samples = spark.read.parquet(f"{sf_dir}/sample_prompts.parquet").select(
        F.lit("sample_prompts").alias("src"), F.col("id").cast("bigint").alias("rec_id"), "text"
    )
    return spread(chats).unionByName(spread(samples))
