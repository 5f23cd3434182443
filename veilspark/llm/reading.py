"""Reading level of each document's prose (problem 9): pairwise ranker and isotonic calibration.

The author's own prose is cut out of a commit message (four export layouts); headers, the
subject line, trailers, quoted lines, fenced logs, links and the diff are left out. From
the prose come syntax features (sentence lengths, subordination, commas) and vocabulary
features (word lengths, long words). A linear ranker is trained on differences of the
features of graded document pairs; isotonic regression turns its scores into levels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import publish, texts_in, written

MIN_WORDS = 60
#: Bounds of training, both parameters: rated documents that are read, and pairs of them that are drawn.
SAMPLE, PAIRS = 8_000, 60_000

# Words that open subordinate clauses or link them.
SUBORDINATORS = frozenset("although because inasmuch notwithstanding that which whoever whose whereas unless until since though wherever whether while who whom given".split())
# Function words that tell English from the other languages seen in messages.
ENGLISH = frozenset("the of and to a in is that it was for on are as with his they at be this have from or had by but not what all were we when your can there an which their said if do into has more her two him see could no make than been its now my made did down only way find use may after before over throughout particularly".split())
FOREIGN = frozenset("der die das und ist nicht ein eine den dem mit für auf von zu wird werden im les des est une dans pour que qui sur pas avec du et le los las del el en una por con se para como más é não os uma een het van niet".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_HEADER = re.compile(r"(?:commit [0-9a-f]{7,}|From [0-9a-f]{7,}.*|(?:From|Date|Subject|Author|Merge|AuthorDate|Commit|CommitDate|Committer|To|Cc|Message-Id|sha|author|date|subject|parent|tree|committer)\s*:.*)$", re.I)
_TRAILER = re.compile(r"[A-Z][A-Za-z]*(?:-[A-Za-z]+)+:\s|(?:Link|Fixes|Closes|Refs?|See|Bug|Issue|Helped|Cc|Change-Id|Resolves|Related)\s*(?::|#)", re.I)
_END = re.compile(r"(?:diff --git |```diff|---\s*$|--- a/|Index: |@@ |-- $|# Conflicts:)")
_DIFF = re.compile(r"^ {0,4}(?:diff --git |```diff)", re.M)
_FENCE = re.compile(r"\s*(?:```|~~~)")
_LINK = re.compile(r"<?\b(?:https?|ssh|git|ftp)://\S+|www\.\S+")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
_LOG = re.compile(r"\s*\d{2}:\d{2}:\d{2}\s|\s*at \w+[.\w]*\(")
_SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")

FEATURES = ("sentence_length", "long_sentence_share", "short_sentence_share", "longest_sentences", "word_length", "long_word_share", "short_word_share", "subordination", "commas", "long_words_in_short_sentences")


def prose(text: str) -> list[str]:
    """The author's sentences in a message: text blocks and list items, without everything that isn't prose."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    i, kind = 0, ""
    while i < len(lines) and not lines[i].strip():
        i += 1
    first = lines[i] if i < len(lines) else ""
    if first.startswith("## "):  # title, then a line naming author, date and commit
        i += 1
        while i < len(lines) and (not lines[i].strip() or re.match(r"by .+ on \d{4}-\d{2}-\d{2}", lines[i])):
            i += 1
    else:
        kind = "git" if re.match(r"commit [0-9a-f]{7,}", first) else ""
        headed = False
        while i < len(lines) and _HEADER.match(lines[i].strip()):
            headed = True
            i += 1
            while i < len(lines) and kind == "" and lines[i][:1] in (" ", "\t") and lines[i].strip() and headed:
                i += 1  # a folded header goes on in an indented line
        if kind == "git":  # the indented subject comes first
            while i < len(lines) and not lines[i].strip():
                i += 1
            while i < len(lines) and lines[i].strip():
                i += 1
    blocks: list[str] = []
    current: list[str] = []
    fenced = False

    def close() -> None:
        if current:
            blocks.append(" ".join(current))
            current.clear()

    for line in lines[i:]:
        flat = line[4:] if kind == "git" and line.startswith("    ") else line
        if not fenced and _END.match(flat):
            break
        if _FENCE.match(flat):
            fenced = not fenced
            close()
            continue
        bare = flat.strip()
        if fenced:
            continue
        if not bare:
            close()
            continue
        if bare[0] in ">|" or _TRAILER.match(bare) or _LOG.match(flat):
            close()
            continue
        item = _ITEM.match(flat)
        if item:
            close()
            bare = flat[item.end() :]
        bare = _LINK.sub(" ", bare)
        if _WORD.search(bare):
            current.append(bare.strip())
    close()
    return [s for b in blocks for s in _SENTENCE_END.split(b) if _WORD.search(s)]


def features(text: str | None) -> list[float] | None:
    """Feature values of the English prose of a message; None below ``MIN_WORDS`` words or in another language."""
    if not text or len(text) < 2 * MIN_WORDS:
        return None
    end = _DIFF.search(text)
    if end and end.start() < 2 * MIN_WORDS:
        return None
    spoken = prose(text[: end.start()] if end else text)
    sentences = [_WORD.findall(s) for s in spoken]
    words = [w for s in sentences for w in s]
    n = len(words)
    if n < MIN_WORDS:
        return None
    low = [w.lower() for w in words]
    english, foreign = sum(w in ENGLISH for w in low), sum(w in FOREIGN for w in low)
    if foreign > english or sum(c.isascii() for w in low for c in w) < 0.9 * sum(map(len, low)):
        return None
    lengths = np.array([len(s) for s in sentences], float)
    letters = np.array([len(w) for w in words], float)
    weights = lengths / n
    inside = np.repeat(lengths, lengths.astype(int))
    return [
        float(np.log(n / len(sentences))),
        float(weights[lengths > 30].sum()),
        float(weights[lengths <= 9].sum()),
        float(np.log((lengths * weights).sum())),
        float(letters.mean()),
        float((letters >= 10).mean()),
        float((letters <= 3).mean()),
        sum(w in SUBORDINATORS for w in low) / n,
        sum(s.count(",") for s in spoken) / n,
        float(((letters >= 10) & (inside <= 20)).mean()),
    ]


_FEATURE_SCHEMA = T.ArrayType(T.DoubleType())


def document_features(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): feature vectors of the documents with enough prose; ids repeat if rows do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [features(t) for t in pdf["t"]]
            keep = [i for i, v in enumerate(x) if v is not None]
            yield pd.DataFrame({"id": pdf["id"].iloc[keep].to_numpy(), "x": [x[i] for i in keep]})

    return (
        documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
        .where("t is not null and id is not null")
        .mapInPandas(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("x", _FEATURE_SCHEMA)]))
    )


def train_ranker(x: np.ndarray, grade: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a linear pairwise ranker, with the mean and scale of the features.

    ``pairs`` bounds the drawn pairs of documents with different grades; the logistic loss
    on their feature differences is minimised by Newton's method.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(z), (2, 4 * pairs))
    keep = np.flatnonzero(np.abs(grade[a] - grade[b]) > 0.25)[:pairs]
    a, b = a[keep], b[keep]
    sign = np.sign(grade[a] - grade[b])
    d = (z[a] - z[b]) * sign[:, None]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ q / len(d) - ridge * w
        hessian = (d * (q * (1 - q))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w, mean, scale


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (right ends of score ranges, fitted grades), both ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, g in zip(score[order], grade[order]):
        blocks.append([g, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            g2, n2, s2 = blocks.pop()
            g1, n1, _ = blocks.pop()
            blocks.append([(g1 * n1 + g2 * n2) / (n1 + n2), n1 + n2, s2])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class LevelModel:
    """Ranker plus calibration; predicts levels 1 to 3. Can be saved and applied to other documents."""

    def __init__(self, x: np.ndarray, grade: np.ndarray, pairs: int = PAIRS) -> None:
        self.w, self.mean, self.scale = train_ranker(x, grade, pairs)
        score = self.scores(x)
        ends, fitted = isotonic(score, grade)
        # Score above which the calibrated grade rounds to the next level.
        self.cuts = []
        for half in (1.5, 2.5):
            above = fitted >= half
            i = int(np.argmax(above)) if above.any() else len(ends)
            if i == len(ends):
                self.cuts.append(np.inf)
            elif i == 0:
                self.cuts.append(-np.inf)
            else:
                over = score[score > ends[i - 1]]
                self.cuts.append((ends[i - 1] + over.min()) / 2)

    def save(self, spark: SparkSession, folder: str, name: str = "level-model") -> None:
        state = {"w": self.w.tolist(), "mean": self.mean.tolist(), "scale": self.scale.tolist(), "cuts": [float(c) for c in self.cuts]}
        publish(spark, folder, name, json.dumps(state))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, name: str = "level-model") -> LevelModel:
        state, model = json.loads(texts_in(spark, folder)[name]), cls.__new__(cls)
        model.w, model.mean, model.scale = (np.array(state[k]) for k in ("w", "mean", "scale"))
        model.cuts = state["cuts"]
        return model

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def levels(self, x: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(np.array(self.cuts), self.scores(x), side="right")


def fit_levels(feats: DataFrame, labels: DataFrame, id_col: str, grade_col: str, sample: int = SAMPLE, pairs: int = PAIRS) -> LevelModel | None:
    """Model from the rated documents among ``feats``; at most ``sample`` of them (by a hash of the id) train it, in at most ``pairs`` pairs.

    Ratings of one document are averaged. None if no document is rated or all have one grade.
    """
    rated = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(grade_col).cast("double").alias("g")).where("id is not null and g between 1 and 3").groupBy("id").agg(F.avg("g").alias("g"))
    rows = feats.join(rated, "id").orderBy(F.xxhash64("id")).limit(sample).select("x", "g").toPandas()
    if len(rows) == 0 or rows["g"].nunique() < 2:
        return None
    return LevelModel(np.array(rows["x"].tolist(), float), rows["g"].to_numpy(float), pairs)


def reading_levels(
    documents: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "reading_level",
    sample: int = SAMPLE, pairs: int = PAIRS, model: LevelModel | None = None,
) -> DataFrame:
    """(doc_id, reading_level) of each document with at least 60 words of English prose in its message.

    Null, empty and prose-free texts give no row; rows repeated with one id give one row;
    without usable ratings every such document gets level 2. With a model, such as a saved one,
    nothing is trained. Features are computed once and written; the linear score is evaluated in Spark.
    """
    feats = document_features(documents, id_col, text_col)
    if model is None:
        feats = written(feats, "reading-features")
        model = fit_levels(feats, labels, id_col, grade_col, sample, pairs)
    if model is None:
        level = F.lit(2)
    else:
        offset = float(-(model.mean / model.scale) @ model.w)
        score = F.lit(offset)
        for j, (w, s) in enumerate(zip(model.w, model.scale)):
            score = score + F.col("x")[j] * F.lit(float(w / s))
        level = F.lit(1)
        for cut in model.cuts:
            level = level + (score >= F.lit(float(cut))).cast("int")
    return feats.select(F.col("id").alias(id_col), level.cast("bigint").alias("reading_level")).groupBy(id_col).agg(F.max("reading_level").alias("reading_level"))
