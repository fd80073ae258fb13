"""Toxicity by compression distance.

Two zstandard dictionaries of raw content are made, one of words that mark toxic
text and one of words common in ordinary text; zstandard's own training found too
little (see the README).  Each window of a text (one word in a fixed frame) is
compressed with both; a window
that the toxic dictionary shortens by more than a calibrated threshold speaks for
toxicity, and a logistic curve fitted on held-apart folds turns a document's
windows into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a fit may take, per class; the rest of the labels is not needed.
SAMPLE_PER_CLASS = 4000
#: Bytes of a dictionary, and words that a worker remembers.
DICT_BYTES = 16384
CACHE_WORDS = 400_000
#: Both dictionaries end in this frame and every window does, so that zstandard, which
#: stores a block raw unless it saves some bytes, always compresses and a word's own bytes show.
FRAME = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
_EDGE = b".,;:!?\"'()[]|-*#$%&<>"
#: Distances whose counts are features; the fit calibrates what each is worth.
THRESHOLDS = (2, 3, 4, 5, 6, 7, 8)
#: Least documents of a word, and standard errors between its shares in both classes.
MIN_DOCS, MIN_SIGMA = 4, 3.5


def split_words(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(_EDGE) for x in (text or "").lower().encode("utf-8", "surrogatepass").split()) if w]


def _dictionary(words: list[bytes]) -> bytes:
    """Raw dictionary content: the weightiest words last, where zstandard reaches them most cheaply."""
    taken, size = [], 0
    for word in words:
        size += len(word) + 2
        if size > DICT_BYTES:
            break
        taken.append(word)
    return b"  " + b"  ".join(reversed(taken)) + b"  " + FRAME


def train_dictionaries(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary contents from the word sets of labelled documents.

    The toxic one holds the words whose document share differs most surely
    between the classes, the ordinary one those that ordinary text uses most.
    """
    in_toxic, in_ordinary = Counter(w for d in toxic for w in d), Counter(w for d in ordinary for w in d)
    n, m = len(toxic) + 1, len(ordinary) + 1

    def sigma(word: bytes) -> float:
        a, b = in_toxic[word] / n, in_ordinary[word] / m
        both = (in_toxic[word] + in_ordinary[word] + 1) / (n + m)
        return (a - b) / math.sqrt(both * (1 - both) * (1 / n + 1 / m)) if both < 1 else 0.0

    strong = {w: s for w, c in in_toxic.items() if c >= MIN_DOCS and len(w) > 2 and (s := sigma(w)) >= MIN_SIGMA}
    common = sorted((w for w in in_ordinary if len(w) > 2 and w not in strong), key=lambda w: (-in_ordinary[w], w))
    return _dictionary(sorted(strong, key=lambda w: (-strong[w], w))), _dictionary(common[:20000])


class Distance:
    """Bytes that a window takes more with the ordinary than with the toxic dictionary, by word."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        import zstandard as zs

        settings = zs.ZstdCompressionParameters.from_level(19, min_match=3, write_content_size=False, write_dict_id=False)
        make = lambda d: zs.ZstdCompressor(compression_params=settings, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT))
        self.toxic, self.ordinary, self.known = make(toxic), make(ordinary), {}

    def of(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            window = b"  " + word + b"  " + FRAME
            found = self.known[word] = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return found

    def features(self, words: list[bytes]) -> tuple[float, ...]:
        """For each of THRESHOLDS the windows at or over it, then the number of windows; on a log scale."""
        counts = Counter(map(self.of, words))
        over = [sum(c for d, c in counts.items() if d >= t) for t in THRESHOLDS]
        return (*map(math.log1p, over), math.log1p(len(words)))


@dataclass(frozen=True)
class ToxicModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def probability(self, features: tuple[float, ...]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_toxicity(texts: list[str | None], toxic: list[int], folds: int = 4) -> ToxicModel:
    """Fit on labelled texts; without both classes every text scores the share of toxic ones.

    Thresholds and weights are calibrated on distances to dictionaries that did
    not see the text; the final dictionaries come from all texts.
    """
    words, y = [split_words(t) for t in texts], np.array(toxic, float)
    sets = [set(w) for w in words]
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return ToxicModel(FRAME, FRAME, (math.log(share / (1 - share)), *[0.0] * (len(THRESHOLDS) + 1)))
    rows: list = [None] * len(words)
    for fold in range(folds):
        seen = [k for k in range(len(words)) if k % folds != fold]
        distance = Distance(*train_dictionaries([sets[k] for k in seen if y[k]], [sets[k] for k in seen if not y[k]]))
        for k in range(fold, len(words), folds):
            rows[k] = distance.features(words[k])
    weights = _logistic(np.array(rows), y)
    final = train_dictionaries([s for s, v in zip(sets, y, strict=True) if v], [s for s, v in zip(sets, y, strict=True) if not v])
    return ToxicModel(*final, tuple(map(float, weights)))


_LOADED: dict[ToxicModel, Distance] = {}


def _score_batch(model: ToxicModel):
    def run(texts: pa.Array) -> pa.Array:
        if model not in _LOADED:
            _LOADED.clear()
            _LOADED[model] = Distance(model.toxic, model.ordinary)
        distance = _LOADED[model]
        return pa.array([model.probability(distance.features(split_words(t))) for t in texts.to_pylist()], pa.float64())

    return run


def toxicity(text: Column, model: ToxicModel) -> Column:
    """P(toxic) of each whole text; a null or empty text has no windows and gets the value at none."""
    return F.arrow_udf(_score_batch(model), "double")(text)


def held_out(id_: Column) -> Column:
    """Rows that no fit may use: crc32 of the id as text, modulo 3, is 1.  A null id is held out."""
    return F.coalesce(F.crc32(F.encode(id_.cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def sample_labelled(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list, list]:
    """Texts and labels of at most SAMPLE_PER_CLASS training documents per class, in hash order.

    Only the sampled ids (a bounded number) are broadcast to find their texts.
    Unlabelled rows are left out; of several labels of an id the highest counts.
    """
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("y"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    drawn = [known.filter(F.col("y") == c).orderBy(*order).limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    found = df.select(id_col, text_col).join(F.broadcast(drawn[0].unionByName(drawn[1])), id_col)
    rows = found.orderBy(*order).limit(2 * SAMPLE_PER_CLASS).collect()
    return [r[1] for r in rows], [r[2] for r in rows]


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted``.

    Null ids and repeated rows pass through one for one, an empty table gives no
    rows; null and empty texts get the score of a text without windows.  Id,
    labels and other columns are no inputs of a score.
    """
    model = fit_toxicity(*sample_labelled(df, labels, id_col, text_col, label_col))
    scored = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), toxicity(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
