"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic), with every value that has no
target of its own folded into one "rest" category a margin; so the table of cells
is bounded by the targets a user writes, never by the corpus.  Raking scales the
cells until all three margins meet their targets, the scales become inclusion
probabilities, and each document is drawn by a hash of its id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import fresh, materialise

REST = "(rest)"
#: More cells than this are refused: targets of so many values are not a mixture.
MAX_CELLS = 1_000_000
#: Targets that leave less than this of a margin (sums of floats never leave exactly 0) leave nothing.
LEAST_LEFT = 1e-9


def word_count(text: Column) -> Column:
    """Words of a text between ASCII white space; 0 for null and empty."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " +"))).cast("long")


def text_form(text: Column) -> Column:
    """A stand-in for a topic column: the form of a text, by its length and layout."""
    length = F.length(F.coalesce(text, F.lit("")))
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(" | ")), "table").when(length < 800, "note").when(length < 4000, "article").otherwise("longread")


@dataclass
class Mixture:
    """Target shares of tokens, by margin; what the shares of a margin leave of 1 goes to its rest.

    The rest is every value without a target, null included.  Shares that sum to 1
    leave nothing for it: then it keeps its present share of the tokens, and the
    targets hold among the other tokens.  So no document is shut out by its values.
    ``fraction`` is the share of all tokens to draw (in expectation).
    """

    source: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    topic: dict[str, float] = field(default_factory=dict)
    fraction: float = 0.5
    seed: int = 7

    def margins(self) -> list[dict[str, float]]:
        return [self.source, self.lang, self.topic]


def rake(tokens: np.ndarray, keys: list[tuple[str, ...]], targets: list[dict[str, float]], rounds: int = 500) -> np.ndarray:
    """Scale the cells' tokens so that each margin has its target shares.

    Only shares of values that some cell has can be met; those of a margin are
    scaled to sum to one.  A value without a target (``REST``) takes what the
    targets leave, or keeps its present share where they leave nothing.  Structural zeros can keep margins from being met exactly;
    the rounds then end at the closest cycle.
    """
    weight = tokens.astype(float).copy()
    whole = weight.sum()
    if not whole:
        return weight
    plans = []
    for m, target in enumerate(targets):
        if not target:
            continue
        values = sorted({k[m] for k in keys})
        at = np.array([values.index(k[m]) for k in keys])
        have = np.bincount(at, tokens, len(values))
        rest, left = np.array([v == REST for v in values]), 1 - sum(target.values())
        wanted = np.where(have > 0, [left if v == REST else target.get(v, 0.0) for v in values], 0)
        if left < LEAST_LEFT:
            share, given = have[rest].sum() / whole, wanted[~rest].sum()
            wanted = np.where(rest, share, wanted * ((1 - share) / given if given > 0 else 0))
        if wanted.sum() > 0:
            plans.append((at, whole * wanted / wanted.sum()))
    for _ in range(rounds):
        worst = 0.0
        for at, wanted in plans:
            have = np.bincount(at, weight, len(wanted))
            scale = np.divide(wanted, have, out=np.zeros_like(wanted), where=have > 0)
            worst = max(worst, float(np.abs(have - wanted).max()) / whole)
            weight *= scale[at]
        if worst < 1e-12:
            break
    return weight


def inclusion(tokens: np.ndarray, weight: np.ndarray, fraction: float) -> np.ndarray:
    """Probabilities in proportion to weight over tokens, at most 1, that draw ``fraction`` of all tokens.

    What a full cell cannot give is spread over the others; where even that is
    not enough (all cells with weight are full) everything with weight is drawn.
    """
    ratio = np.divide(weight, tokens, out=np.zeros(len(weight)), where=tokens > 0)
    wanted, full = fraction * tokens.sum(), np.zeros(len(weight), bool)
    probability = np.zeros(len(weight))
    for _ in range(len(weight) + 1):
        open_ = ~full & (ratio > 0)
        rest = wanted - tokens[full].sum()
        mass = (tokens * ratio)[open_].sum()
        if rest <= 0 or mass <= 0:
            probability = np.where(full, 1.0, 0.0)
            break
        probability = np.where(full, 1.0, ratio * rest / mass)
        over = open_ & (probability >= 1)
        if not over.any():
            break
        full |= over
    return np.clip(np.where(full, 1.0, probability), 0, 1)


def _folded(column: Column, target: dict[str, float]) -> Column:
    """The value where it has a target, else the rest; null is a value of the rest."""
    return F.when(column.isin(*target), column).otherwise(REST) if target else F.lit(REST)


def _uniform(id_: Column, seed: int) -> Column:
    """A number in [0, 1) that the id and the seed alone decide."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(16**12)


def fit(rows: DataFrame, mixture: Mixture) -> dict[tuple[str, ...], tuple[float, float]]:
    """(source, lang, topic) of folded cells -> (token weight, inclusion probability).

    ``rows`` has those three columns folded, and ``tokens``.
    """
    limit = (len(mixture.source) + 1) * (len(mixture.lang) + 1) * (len(mixture.topic) + 1)
    if limit > MAX_CELLS:
        raise ValueError(f"the targets span {limit} cells; at most {MAX_CELLS} are allowed")
    found = rows.groupBy("s", "l", "t").agg(F.sum("tokens").alias("n")).orderBy("s", "l", "t").collect()
    keys, tokens = [(r.s, r.l, r.t) for r in found], np.array([r.n or 0 for r in found], float)
    if not keys:
        return {}
    weight = rake(tokens, keys, mixture.margins())
    probability = inclusion(tokens, weight, mixture.fraction)
    # A document without tokens adds nothing to a margin; its cell's probability still applies.
    ratio = np.divide(weight, tokens, out=np.ones(len(weight)), where=tokens > 0)
    return {k: (float(w), float(p)) for k, w, p in zip(keys, ratio, np.where(tokens > 0, probability, mixture.fraction), strict=True)}


def _with_cells(df: DataFrame, cells: dict[tuple[str, ...], tuple[float, float]], names: list[str], out: list[str]) -> DataFrame:
    """``df`` with weight and probability of each row's cell; the table has MAX_CELLS rows at most."""
    schema = ", ".join([f"`{n}` string" for n in names] + [f"`{n}` double" for n in out])
    table = df.sparkSession.createDataFrame([(*k, *v) for k, v in cells.items()], schema)
    return df.join(F.broadcast(table), names, "left")


def mix(
    df: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", topic: Column | None = None,
) -> DataFrame:
    """One row per document: id, source, lang, topic, ``tokens``, ``weight``, ``probability``, ``sampled``.

    ``weight`` is the raked scale of the document's tokens.  Null sources,
    languages and topics belong to the rest of their margin, a null or empty
    text has 0 tokens, a null id is drawn like the id "null", rows with equal
    ids are drawn together; an empty table gives no rows.  Other columns are not read.
    """
    topic = text_form(F.col(text_col)) if topic is None else topic
    rows = materialise(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), topic.cast("string").alias("topic"), word_count(F.col(text_col)).alias("tokens")), "mixing")
    folded = [_folded(F.col(c), t) for c, t in zip(("source", "lang", "topic"), mixture.margins(), strict=True)]
    rows = rows.withColumns(dict(zip("slt", folded, strict=True)))
    cells = fit(rows, mixture)
    return (
        _with_cells(rows, cells, list("slt"), ["weight", "probability"])
        .withColumn("sampled", _uniform(F.col("id"), mixture.seed) < F.col("probability"))
        .withColumnRenamed("id", id_col)
        .drop(*"slt")
    )


def sample_mixture(
    df: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", topic: Column | None = None,
) -> DataFrame:
    """The rows of ``df`` that ``mix`` would sample, with all their columns and without a join."""
    topic = text_form(F.col(text_col)) if topic is None else topic
    folded = [_folded(c, t) for c, t in zip((F.col(source_col), F.col(lang_col), topic.cast("string")), mixture.margins(), strict=True)]
    cells = fit(df.select(*[c.alias(n) for c, n in zip(folded, "slt", strict=True)], word_count(F.col(text_col)).alias("tokens")), mixture)
    names = [fresh(df, n) for n in ("__s", "__l", "__t")]
    out = [fresh(df, n) for n in ("__weight", "__probability")]
    held = _with_cells(df.withColumns(dict(zip(names, folded, strict=True))), cells, names, out)
    return held.filter(_uniform(F.col(id_col), mixture.seed) < F.col(out[1])).select(*[F.col(f"`{c}`") for c in df.columns])
