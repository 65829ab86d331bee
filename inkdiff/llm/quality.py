"""Quality by ordinal regression: a cumulative-link (proportional odds) model on graded ratings.

P(grade <= k) = sigmoid(threshold[k] - w . x). The weights w are shared by all grades; the thresholds are kept in order
by their form (a first one and positive steps). x are hashed features of the whole text: its distinct words, the shapes
of its words (letter case, digits and marks, runs shortened) and coarse shares (marks, capitals, repeated words and
lines, mean word length). Each group is scaled by its number, so a text's length alone decides nothing.

From the grades' probabilities come the expected grade and the tail probability P(grade >= `floor`), by which documents
are selected. The model is fitted on the driver on a bounded sample of labelled rows outside fold 0 (LIMIT rows for each
grade, see _labels.py) and has a fixed size; all documents are scored. Null and empty texts have the features of no
words. Without ratings, the expected grade and tail probability are null and nothing is selected. Rows that repeat an id
or text are scored alike, each by its own text alone; an empty table gives an empty result. A column of the result's name
is replaced; all others stay.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import fold, grades, sample

LIMIT = 6000
DIMENSIONS = 1 << 18
_SHAPE = str.maketrans({c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "0" for c in "0123456789"} | {c: "a" for c in "abcdefghijklmnopqrstuvwxyz"})
_OTHER_LETTERS = re.compile(r"[^\W\d_Aa]")
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
_MARK = re.compile(r"[^\w\s]")
_RUN = re.compile(r"(.)\1+")
#: Weights of the groups words, shapes, shares.
GROUPS = (1.0, 2.0, 2.0)


@dataclass(frozen=True)
class Model:
    grades: tuple[int, ...]
    weights: np.ndarray | None
    thresholds: tuple[float, ...]


def _slot(group: int, token: str) -> int:
    return zlib.crc32(token.encode(), group) & (DIMENSIONS - 1)


@lru_cache(100_000)
def _shape(word: str) -> str:
    return _RUN.sub(r"\1", _OTHER_LETTERS.sub(lambda m: "A" if m[0].isupper() else "a", word.translate(_SHAPE)))[:12]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values; a slot may repeat."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    lowered = {w.lower() for w in words}
    shapes: dict[str, int] = {}
    for w in words:
        s = _shape(w)
        shapes[s] = shapes.get(s, 0) + 1
    letters = sum(map(len, words)) or 1
    lines = text.splitlines()
    shares = {
        "marks": len(_MARK.findall(text)) / letters,
        "capitals": len(_CAPITAL.findall(text)) / letters,
        "again": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "distinct": len(lowered) / n,
        "lines": len(set(lines)) / max(1, len(lines)),
        "width": min(1.0, letters / n / 20),
    }
    slots = [_slot(1, w) for w in lowered] + [_slot(2, s) for s in shapes] + [_slot(3, f"{k}:{int(v * 20)}") for k, v in shares.items()]
    values = [GROUPS[0] / max(1, len(lowered)) ** 0.5] * len(lowered) + [GROUPS[1] * (c / n) ** 0.5 for c in shapes.values()] + [GROUPS[2] / len(shares) ** 0.5] * len(shares)
    return np.array(slots, np.int64), np.array(values)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grade_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """A row for each linear score, a column for each grade."""
    below = _sigmoid(np.array(model.thresholds)[None, :] - x[:, None])
    return np.diff(np.column_stack([np.zeros(len(x)), below, np.ones(len(x))]), axis=1)


def train(texts: list[str], ratings: list[int], known: list[int], epochs: int = 6, rate: float = 0.15, ridge: float = 1e-5) -> Model:
    """Minibatch Adagrad on the log-likelihood of the ratings, each grade weighted alike up to a factor of 4."""
    if len(set(ratings)) < 2:
        return Model(tuple(known), None, ())
    order = {g: k for k, g in enumerate(known)}
    y = np.array([order[r] for r in ratings])
    x = [features(t) for t in texts]
    counts = np.bincount(y, minlength=len(known))
    below = np.cumsum(counts)[:-1] + 0.5
    first = np.log(below / (len(y) + 1 - below))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    w, seen_w, seen_t = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8), np.full(len(theta), 1e-8)
    weight = np.minimum(4.0, len(y) / np.maximum(1, counts) / len(known))[y]
    random = np.random.default_rng(7)
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(len(y)), max(1, len(y) // 64)):
            slots = np.concatenate([x[k][0] for k in batch])
            values = np.concatenate([x[k][1] for k in batch])
            row = np.repeat(np.arange(len(batch)), [len(x[k][0]) for k in batch])
            score = np.bincount(row, w[slots] * values, len(batch))
            cuts = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
            c = np.concatenate([[-np.inf], cuts, [np.inf]])
            upper, lower = _sigmoid(np.where(np.isinf(c[y[batch] + 1]), 30, c[y[batch] + 1]) - score), _sigmoid(np.where(np.isinf(c[y[batch]]), -30, c[y[batch]]) - score)
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            g_score = weight[batch] * (du - dl) / p  # of the loss, since its sign turns with the score's
            g = np.bincount(slots, g_score[row] * values / len(batch), DIMENSIONS)
            hit = np.unique(slots)
            g[hit] += ridge * w[hit]
            seen_w[hit] += g[hit] ** 2
            w[hit] -= rate * g[hit] / np.sqrt(seen_w[hit])
            g_cut = np.zeros(len(cuts))
            for j in range(len(cuts)):
                g_cut[j] = -(weight[batch] * np.where(y[batch] == j, du, 0) / p).sum() + (weight[batch] * np.where(y[batch] == j + 1, dl, 0) / p).sum()
            g_cut /= len(batch)
            g_t = np.array([g_cut.sum(), *(g_cut[j:].sum() * np.exp(theta[j]) for j in range(1, len(theta)))])
            seen_t += g_t**2
            theta -= rate * g_t / np.sqrt(seen_t)
    cuts = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
    return Model(tuple(known), w.astype(np.float32), tuple(cuts.tolist()))


def score_quality(df: DataFrame, model: Model, floor: int | None = None, text: str = "text", into: str = "quality") -> DataFrame:
    """df with a struct (expected, tail) in column `into`; tail is P(grade >= floor), by default of the highest grade."""
    floor = max(model.grades, default=0) if floor is None else floor
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("expected", pa.float64()), ("tail", pa.float64())])

    def score(texts: pa.Array) -> pa.Array:
        m = sent.value
        if m.weights is None:
            return pa.array([{"expected": None, "tail": None}] * len(texts), kind)
        x = np.array([float(m.weights[s] @ v) for s, v in (features(t.as_py()) for t in texts)])
        p, g = grade_probabilities(m, x), np.array(m.grades, float)
        return pa.StructArray.from_arrays([pa.array(p @ g), pa.array(p[:, g >= floor].sum(axis=1))], fields=list(kind))

    return df.withColumn(into, F.arrow_udf(score, "struct<expected: double, tail: double>").asNondeterministic()(df[text]))


def fit(docs: DataFrame, labels: DataFrame, rating: str = "quality") -> Model:
    known = grades(labels, rating)
    rows = sample(docs, labels, rating, dict.fromkeys(known, LIMIT)) if known else []
    return train([t for _, _, t in rows], [g for _, g, _ in rows], known)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability and keep of every document."""
    from ._shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold("doc_id") == 0).alias("held_out"),
        F.col("quality.expected").alias("expected_grade"),
        F.col("quality.tail").alias("tail_probability"),
        F.coalesce(F.col("quality.tail") >= 0.5, F.lit(False)).alias("keep"),
    )
