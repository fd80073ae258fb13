"""Weak supervision for document quality.

Rules look at a text's counts and vote good (1), bad (0) or abstain (-1).  No
rule decides alone: expectation-maximisation estimates from the agreement of the
rules over the whole corpus how often each one is right, and a document is kept
by its posterior probability of being good.  Only the counts of distinct vote
patterns, whose number is bounded by the rules and not by the corpus, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import WORD_SPACE, fresh, materialise, release

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_upper bigint, n_letters bigint, n_lines bigint, n_distinct bigint, n_marks bigint, n_symbol_words bigint"
_NAMES = [f.split()[0] for f in FEATURES.split(", ")]
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def repeated_words(words: list[bytes]) -> int:
    """Words inside some window of WINDOW words that occurs at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
            windows ^= windows >> np.uint64(29)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def features_of(text: str | None) -> tuple[int, ...]:
    """The counts of FEATURES for one whole text; a null text counts as empty."""
    if not text:
        return (0,) * len(_NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes, this splits on exactly the six ASCII white-space characters
    spaces = len(raw) - len(raw.translate(None, WORD_SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip(WORD_SPACE)]
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    symbol_words = sum(len(w) != len(w.translate(None, SYMBOLS)) for w in words) if symbols else 0
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words),
        count(_UPPER), count(_LETTERS), len(lines), len(set(words)), count(b"!?"), symbol_words,
    )


def _features_batch(texts: pa.Array) -> pa.Array:
    rows = [features_of(t.as_py()) for t in texts]  # one text at a time: a batch never exists twice
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)
    del rows, columns
    release()
    return found


def text_features(text: Column) -> Column:
    """The struct of FEATURES for a text column, computed in Arrow batches."""
    return F.arrow_udf(_features_batch, f"struct<{FEATURES.replace(' bigint', ':bigint')}>")(text)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1).cast("int")


def default_rules(f: Column | None = None) -> dict[str, Column]:
    """Rule name -> vote, from the feature columns (or from the fields of the struct ``f``).

    Each kind of defect is looked at by two rules from different sides, so that
    their agreement can say how much either is worth.
    """
    c = (lambda name: f[name]) if f is not None else F.col
    words, chars, letters = (F.greatest(c(n), F.lit(1)) for n in ("n_words", "word_chars", "n_letters"))
    never = F.lit(False)
    return {
        "symbols": _vote(20 * c("n_symbols") > words, never),
        "symbol_words": _vote(10 * c("n_symbol_words") > words, never),
        "repeats": _vote(5 * c("n_repeat_words") > words, never),
        # A text's distinct words grow with the root of its length, so their square is held against its words.
        "variety": _vote(c("n_distinct") * c("n_distinct") < 4 * words, (c("n_distinct") * c("n_distinct") >= 25 * words) & (words >= 20)),
        "dup_lines": _vote(2 * c("n_dup_lines") > c("n_lines"), never),
        "shouting": _vote(10 * c("n_upper") > 3 * letters, never),
        "marks": _vote(10 * c("n_marks") > words, never),
        "length": _vote(c("n_words") < 20, c("n_words") >= 60),
        "word_length": _vote((chars < 2 * words) | (chars > 15 * words), (chars >= 3 * words) & (chars <= 12 * words)),
    }


#: Start values and weak prior of P(vote | class), for votes abstain, bad, good.
_START = {1: (0.83, 0.02, 0.15), 0: (0.65, 0.25, 0.10)}
_WEIGHT = 20.0


@dataclass
class VoteModel:
    """P(good) of any document, and for each rule P(vote | good) and P(vote | bad)."""

    rules: list[str]
    prior: float = 0.8
    given: dict[str, dict[int, tuple[float, ...]]] = field(default_factory=dict)

    def odds(self, rule: str, vote: int) -> float:
        """The log odds that one vote adds for good."""
        return float(np.log(self.given[rule][1][vote + 1]) - np.log(self.given[rule][0][vote + 1]))

    def accuracy(self, rule: str) -> float:
        """Of a rule's votes, the share that the fitted model holds right."""
        good, bad = self.given[rule][1], self.given[rule][0]
        right = self.prior * good[2] + (1 - self.prior) * bad[1]
        return right / (right + self.prior * good[1] + (1 - self.prior) * bad[2])

    def posterior(self, votes: tuple[int, ...]) -> float:
        total = np.log(self.prior) - np.log1p(-self.prior) + sum(self.odds(r, v) for r, v in zip(self.rules, votes, strict=True))
        return float(1 / (1 + np.exp(np.clip(-total, -700, 700))))


def fit_votes(rules: list[str], patterns: dict[tuple[int, ...], int], rounds: int = 300) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    The start values say that a vote is better than chance and act as a weak
    prior; a vote never counts against its own meaning, so that "good" stays
    what the rules call good.  Without any pattern the start values stay.
    """
    model = VoteModel(rules, 0.8, {r: dict(_START) for r in rules})
    if not patterns:
        return model
    votes, weight = np.array(list(patterns)), np.array(list(patterns.values()), float)
    for _ in range(rounds):
        p = np.array([model.posterior(tuple(v)) for v in votes])
        before = model.prior
        for j, rule in enumerate(rules):
            found = {}
            for y, share in ((1, weight * p), (0, weight * (1 - p))):
                counts = np.array([share[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + _WEIGHT * np.array(_START[y])
                found[y] = counts / counts.sum()
            if found[1][1] > found[0][1]:  # "bad" is said more of good documents: it says nothing
                found[1][1] = found[0][1] = min(found[1][1], found[0][1])
            if found[0][2] > found[1][2]:
                found[1][2] = found[0][2] = min(found[1][2], found[0][2])
            model.given[rule] = {y: tuple(map(float, x / x.sum())) for y, x in found.items()}
        model.prior = float(((weight * p).sum() + 8) / (weight.sum() + 10))
        if abs(before - model.prior) < 1e-9:
            break
    return model


def _pattern(rules: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[v.cast("string") for v in rules.values()])


def count_patterns(df: DataFrame, rules: dict[str, Column]) -> dict[tuple[int, ...], int]:
    """Distinct vote patterns and their counts: 3 to the number of rules at most, whatever the input."""
    rows = df.groupBy(_pattern(rules).alias("votes")).count().collect()
    return dict(sorted((tuple(map(int, r[0].split(","))), r[1]) for r in rows))


def posterior_column(model: VoteModel, rules: dict[str, Column]) -> Column:
    """P(good) as a sum of log odds, which stays inside code generation."""
    total = F.lit(float(np.log(model.prior) - np.log1p(-model.prior)))
    for rule, vote in rules.items():
        total = total + F.when(vote == 1, model.odds(rule, 1)).when(vote == 0, model.odds(rule, 0)).otherwise(model.odds(rule, -1))
    return 1 / (1 + F.exp(-total))


def base_failed(c=F.col) -> Column:
    return (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``quality`` (posterior) and ``kept``.

    ``kept`` is false where ``base_failed``, else ``quality >= threshold``.  Null
    and empty texts have zero counts, so they fail.  Null ids and repeated rows
    pass through one for one; an empty table gives no rows.  Only the two named
    columns are read.
    """
    scored = df.select(F.col(id_col), text_features(F.col(text_col)).alias("f")).select(id_col, "f.*")
    scored = materialise(scored, "quality")  # the counts serve the fit and the result
    rules = default_rules()
    model = fit_votes(list(rules), count_patterns(scored, rules))
    return (
        scored.withColumn("base_failed", base_failed())
        .withColumn("quality", posterior_column(model, rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
        .select(id_col, *_NAMES[:5], "base_failed", "kept", "quality")
    )


def filter_quality(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that ``score_quality`` would keep, with all their columns and no join.

    The rows are written once with their counts, which serve the fit and the
    filter.  Same cases as ``score_quality``; a column that clashes with a
    helper's name is left alone.
    """
    f = fresh(df, "__features")
    held = materialise(df.withColumn(f, text_features(F.col(text_col))), "quality-rows")
    rules = default_rules(F.col(f))
    model = fit_votes(list(rules), count_patterns(held.select(f), rules))
    good = ~base_failed(lambda n: F.col(f)[n]) & (posterior_column(model, rules) >= threshold)
    return held.filter(good).drop(f)
