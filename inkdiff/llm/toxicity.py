"""Toxicity by compression distance: a zstandard dictionary of toxic text against one of ordinary text.

A text is cut into windows of two words that overlap by one, lower-cased. Each window is compressed twice, with the
ordinary dictionary alone and with the ordinary dictionary followed by the toxic one; the bytes that the toxic dictionary
saves are the window's evidence, and what both kinds of text share cancels. A place in the text counts by the lesser of
the two windows over it, so a neighbour that compresses well by chance does not count. A window is followed by a run of
zero bytes, which costs the same with any dictionary: zstandard looks for no match in the last bytes of its input, and
stores a block as it is that gains less than its headers take. A match has MATCH bytes at least; windows that share no so
many with the toxic dictionary gain nothing from it and are not compressed. MATCH was chosen among 4, 5 and 6 by the loss
of the calibration, which sees folds 1 to 4 only.

Training (on a bounded sample of labelled rows outside fold 0, see LIMITS and _labels.py): the ordinary dictionary is
trained on ordinary texts, the toxic one on toxic texts, of which most is ordinary too. So the toxic side is refined by
the distance itself: dictionaries trained on the toxic texts of the other folds measure each fold's texts, the windows
around the PLACES places that gain most become the next samples, and the dictionary shrinks to TOXIC_BYTES in ROUNDS
rounds. No window is measured with a dictionary that has seen its own text. Passages of PASSAGE words that another
training text has too (copies, licences) are cut from the toxic texts first: they would gain most, and tell nothing. Calibration is by the same crossing: toxic
texts of all folds, measured with the others' dictionary, and ordinary texts of fold 4, which the ordinary dictionary
has not seen, measured with each of those in turn, choose the threshold for a place and fit a logistic curve over the largest saving, the mean of the three
largest and the number of places beyond the threshold.

A null or empty text, or one of white space, has no windows and is scored as one without evidence. Rows that repeat an id
or text are scored alike, each by its own text alone; an empty table gives an empty result. Without labels of both kinds
nothing can be told: every score is 0, so nothing is rejected. A column of the result's name is replaced; all others stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import fold, sample
from ._words import run_hashes, word_hashes

#: Rows of each label that are learned from, at most.
LIMITS = {1: 2500, 0: 6000}
#: Ordinary texts that calibrate, at most: the first ones of fold 4 by the hash of their keys.
CALIBRATE = 1200
ORDINARY_BYTES, TOXIC_BYTES = 65536, 4096
ORDINARY_SEGMENT, TOXIC_SEGMENT = 64, 18
ROUNDS, PLACES, LEAST, LEVEL = 5, 4, 3, 9
MATCH = 5  # bytes of the shortest match
PASSAGE = 8
FOLDS = (1, 2, 3, 4)
KEPT = 100_000
TAIL = bytes(24)
_kernels: dict = {}


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]  # intercept first; none if there was nothing to learn
    base: float = 0.0  # every score of a model without weights


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


class Compressed:
    """Length of a window, compressed with a dictionary."""

    def __init__(self, content: bytes) -> None:
        import zstandard

        held = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_checksum=False, write_content_size=False, write_dict_id=False, min_match=MATCH)
        held.precompute_compress(compression_params=how)
        self.least_match = how.min_match
        self.compress = zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress

    def __call__(self, window: bytes) -> int:
        return len(self.compress(window + TAIL))


class Savings:
    """Bytes that the toxic dictionary saves on a window; a bounded number of results is kept for windows that come again."""

    def __init__(self, ordinary: bytes, toxic: bytes, shared: Compressed | None = None) -> None:
        whole = Compressed(ordinary + toxic)
        self._plain, self._short = (shared or Compressed(ordinary)).compress, whole.compress
        self._known: dict[bytes, int] = {}
        self._least = whole.least_match
        self._grams = np.zeros(1 << 16, bool)
        self._grams[_grams(np.frombuffer(ordinary[-self._least + 1 :] + toxic, np.uint8), self._least)] = True

    def may_save(self, words: list[bytes]) -> np.ndarray:
        """For each two words: do they share as many bytes with the toxic dictionary as the shortest match has?

        Without such a match the toxic dictionary only moves the ordinary one away, and saves nothing.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        met = self._grams[_grams(np.frombuffer(b" %b " % b" ".join(words), np.uint8), self._least)]
        before = np.concatenate(([0], np.cumsum(met)))
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # each of the space in front of a word
        ends = np.minimum(np.maximum(starts[2:] + 2 - self._least, starts[:-2]), len(met))
        return before[ends] > before[np.minimum(starts[:-2], len(met))]

    def __call__(self, window: bytes) -> int:
        found = self._known.get(window)
        if found is None:
            framed = window + TAIL
            found = len(self._plain(framed)) - len(self._short(framed))
            if len(window) < 64:
                if len(self._known) >= KEPT:
                    self._known.clear()
                self._known[window] = found
        return found


def _grams(content: np.ndarray, width: int) -> np.ndarray:
    """A 16-bit hash of each `width` consecutive bytes."""
    n = max(0, len(content) - width + 1)
    h = np.zeros(n, np.uint32)
    for k in range(width):
        h = h * np.uint32(0x01000193) ^ content[k : k + n]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(16)


def places(words: list[bytes], saved: Savings) -> list[tuple[int, int]]:
    """(saving, word) of the words whose windows all save something: the lesser saving of the two windows over the word.

    Every word is in just one of the windows that begin at even places; only beside those that save are others measured.
    """
    n, found = len(words), []
    if n == 1:
        return [(s, 0)] if (s := saved(b" %b " % words[0])) > 0 else []
    told = getattr(saved, "may_save", None)  # any function of a window will do; without it all windows are measured
    may = told(words) if n and told else np.ones(max(0, n - 1), bool)
    window = lambda k: saved(b" %b %b " % (words[k], words[k + 1])) if may[k] else 0
    for k in (np.flatnonzero(may[::2]) * 2).tolist():
        s = window(k)
        if s > 0:
            left = min(s, window(k - 1)) if k else s
            right = min(s, window(k + 1)) if k + 2 < n else s
            if left > 0:
                found.append((left, k))
            if right > 0:
                found.append((right, k + 1))
    if n > 1 and n % 2 and (s := window(n - 2)) > 0:
        found.append((s, n - 1))
    return found


def evidence(found: list[int], threshold: int) -> tuple[float, float, float]:
    """Largest saving, mean of the three largest, log of one more than the places at the threshold or beyond."""
    top = sorted(found, reverse=True)[:3]
    return float(top[0]) if top else 0.0, sum(top) / 3, math.log1p(sum(x >= threshold for x in found))


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, f=20, split_point=1.0, accel=1).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights, intercept first, and the loss of weighted rows, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    w[0] = math.log(((weight * y).sum() + 0.5) / ((weight * (1 - y)).sum() + 0.5))
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))  # a full step may overshoot
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def own_words(toxic: list[bytes], plain: list[str]) -> list[bytes]:
    """The words of each toxic text that are in no PASSAGE words of a plain text or an earlier toxic one, joined by spaces."""

    def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h, bounds = word_hashes(texts)
        each = [run_hashes(h[a:b], PASSAGE) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])

    own, of = runs(toxic)
    known, first, which = np.unique(own, return_index=True, return_inverse=True)
    common = np.zeros(len(known), bool)
    for k in range(0, len(plain), 256):
        common |= np.isin(known, runs([t.lower().encode() for t in plain[k : k + 256]])[0])
    again = common[which] | (of[first][which] < of)
    out = []
    for k, words in enumerate(map(bytes.split, toxic)):
        gone = np.zeros(len(words) + 1, np.int64)
        starts = np.flatnonzero(again[of == k])
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + PASSAGE, -1)
        out.append(b" ".join(w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g))
    return out


def refine(toxic: dict[int, list[bytes]], ordinary: bytes, shared: Compressed) -> tuple[bytes, dict[int, bytes]]:
    """The toxic dictionary of all folds' texts, and for each fold the one of the other folds' texts."""
    samples = dict(toxic)
    others = lambda f, size: _dictionary([s for g, own in samples.items() if g != f for s in own], size, TOXIC_SEGMENT)
    for turn in range(ROUNDS):
        size = max(TOXIC_BYTES, ORDINARY_BYTES >> (2 * turn + 1))
        chosen = {}
        for f, texts in toxic.items():
            saved = Savings(ordinary, others(f, size), shared)
            chosen[f] = [around for text in texts for around in _best_windows(text.split(), saved)]
        samples = chosen
    every = [s for own in samples.values() for s in own]
    return _dictionary(every, TOXIC_BYTES, TOXIC_SEGMENT), {f: others(f, TOXIC_BYTES) for f in toxic}


def _best_windows(words: list[bytes], saved: Savings) -> list[bytes]:
    """What stands around the places that gain most."""
    found = sorted(places(words, saved), key=lambda p: (-p[0], p[1]))[:PLACES]
    return [b" " + b" ".join(words[max(0, k - 1) : k + 2]) + b" " for s, k in found if s >= LEAST]


def train(rows: list[tuple[int, int, str]]) -> Model:
    """A model of (fold, label, text) rows."""
    toxic = {f: [b" ".join(words_of(t)) for g, y, t in rows if y == 1 and g == f] for f in FOLDS}
    toxic = {f: texts for f, texts in toxic.items() if texts}
    plain = [t for f, y, t in rows if y == 0 and f != 4] or [t for _, y, t in rows if y == 0]
    if not plain or len(toxic) < 2:
        return Model(b"", b"", 0, ())
    ordinary = _dictionary([b" ".join(words_of(t)) for t in plain], ORDINARY_BYTES, ORDINARY_SEGMENT)
    shared = Compressed(ordinary)
    fresh = iter(own_words([text for texts in toxic.values() for text in texts], plain))
    content, crossed = refine({f: [next(fresh) for _ in texts] for f, texts in toxic.items()}, ordinary, shared)
    if not content:
        return Model(b"", b"", 0, ())
    measured, labels = [], []
    for f, texts in toxic.items():
        saved = Savings(ordinary, crossed[f], shared)
        measured += [[s for s, _ in places(text.split(), saved)] for text in texts]
        labels += [1.0] * len(texts)
    unseen = ([t for f, y, t in rows if y == 0 and f == 4] or plain)[:CALIBRATE]
    turns = [Savings(ordinary, crossed[f], shared) for f in crossed]
    measured += [[s for s, _ in places(words_of(t), turns[k % len(turns)])] for k, t in enumerate(unseen)]
    y = np.array(labels + [0.0] * len(unseen))
    weight = np.where(y == 1, 1.0, sum(r[1] == 0 for r in rows) / len(unseen))
    fits = []
    for threshold in range(1, 9):
        w, loss = _logistic(np.array([evidence(found, threshold) for found in measured]), y, weight)
        fits.append((loss, threshold, tuple(w.tolist())))
    _, threshold, weights = min(fits)
    return Model(ordinary, content, threshold, weights)


def score_text(text: str | None, model: Model, saved: Savings | None) -> float:
    if not model.weights:
        return model.base
    found = [s for s, _ in places(words_of(text), saved)]
    x = model.weights[0] + sum(w * v for w, v in zip(model.weights[1:], evidence(found, model.threshold), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def score_toxicity(df: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """df with the probability that its text is toxic in column `into`. The model's size is fixed."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        m = sent.value
        key = (m.threshold, m.weights, hash(m.ordinary), hash(m.toxic))
        if key not in _kernels:
            _kernels.clear()
            _kernels[key] = Savings(m.ordinary, m.toxic) if m.weights else None
        return pa.array((score_text(x.as_py(), m, _kernels[key]) for x in texts), pa.float64())

    return df.withColumn(into, F.arrow_udf(score, "double").asNondeterministic()(df[text]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(sample(docs, labels, "toxic", LIMITS))


def query(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")), into="score")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
