"""The few computations that built-in expressions cannot state, as Arrow functions."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def sequence_ratio(old: str | None, new: str | None) -> float | None:
    """difflib's ratio of the two texts, in this order."""
    if old is None or new is None:
        return None
    return 1.0 if old == new else difflib.SequenceMatcher(None, old, new).ratio()


def ratio_or_error(old: Column, new: Column, ratio: Callable[[str, str], float] = sequence_ratio) -> Column:
    """struct(ratio, error) of the two texts; equal texts, and nulls, do not leave the JVM's fast path."""

    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
            try:
                out.append({"ratio": None if x is None or y is None else ratio(x, y), "error": None})
            except Exception as e:  # one text's failure is told and does not end the others
                out.append({"ratio": None, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("ratio", pa.float64()), ("error", pa.string())]))

    asked = F.arrow_udf(run, "struct<ratio: double, error: string>")(F.when(old != new, old), F.when(old != new, new))
    return F.when(old == new, F.struct(F.lit(1.0).alias("ratio"), F.lit(None).cast("string").alias("error"))).otherwise(asked)


def similarity_ratio(old: Column, new: Column) -> Column:
    """difflib's ratio of the two texts, in this order; equal texts do not leave the JVM's fast path."""
    return ratio_or_error(old, new)["ratio"]


def ratio_bound(old: Column, new: Column) -> Column:
    """A native upper bound of the ratio: by the letters that both texts have, each as often as in the one that has fewer."""
    letters = "abcdefghijklmnopqrstuvwxyz 0123456789"
    count = lambda text, c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    rest = lambda text: F.char_length(F.regexp_replace(text, "[a-z 0-9]", ""))
    both = rest(old), rest(new)
    common = F.least(*both)
    for c in letters:
        common = common + F.least(count(old, c), count(new, c))
    return F.when(old == new, 1.0).otherwise(2.0 * common / (F.char_length(old) + F.char_length(new)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    if not a or not b:
        return 0
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(y) + 1, np.int64)
    for c in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == c)))
    return int(row[-1])


@F.arrow_udf(DoubleType())
def _indel(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = x.as_py(), y.as_py()
        out.append(None if p is None or q is None else 2 * common_subsequence(p, q) / (len(p) + len(q)) if p or q else 1.0)
    return pa.array(out, pa.float64())


def token_sort_similarity(a: Column, b: Column) -> Column:
    """Similarity of two headings whose words are put in order; 0 if both are empty, case counts."""
    from .text import words_of

    p, q = (F.array_join(F.array_sort(words_of(F.coalesce(x, F.lit("")))), " ") for x in (a, b))
    both = (F.coalesce(a, F.lit("")) == "") & (F.coalesce(b, F.lit("")) == "")
    hard = (p != q) & (p != "") & (q != "")
    easy = F.when(both, 0.0).when(p == q, 1.0).when((p == "") | (q == ""), 0.0)
    return F.coalesce(easy, _indel(F.when(hard, p), F.when(hard, q)))


def assign(scores: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of least total -score: min(rows, columns) of them, by shortest augmenting paths with potentials.

    Rows are placed in their order and columns are searched in theirs, so ties fall to the lowest row and column.
    """
    if not scores.size:
        return []
    cost = -scores if scores.shape[0] <= scores.shape[1] else -scores.T
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[column] = True
            reduced = cost[owner[column] - 1] - u[owner[column]] - v[1:]
            better = ~used[1:] & (reduced < least[1:] - 1e-12)
            least[1:][better], way[1:][better] = reduced[better], column
            following = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[following]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            column = following
            if owner[column] == 0:
                break
        while column:
            owner[column] = owner[way[column]]
            column = way[column]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted(pairs if scores.shape[0] <= scores.shape[1] else [(j, i) for i, j in pairs])


class HeadingIndex:
    """Headings to compare others with: for each letter, the places where it stands, a bit for each place."""

    def __init__(self, headings: list[str]) -> None:
        self.sizes = np.array([len(h) for h in headings], np.int64)
        self.short = np.flatnonzero(self.sizes < 64)
        self.long = np.flatnonzero(self.sizes >= 64).tolist()
        self.full = np.array([(1 << n) - 1 for n in self.sizes[self.short].tolist()], np.uint64)
        self.at: dict[str, np.ndarray] = {}
        self.bits: dict[int, dict[str, int]] = {}
        for j, k in enumerate(self.short.tolist()):
            for i, c in enumerate(headings[k]):
                if c not in self.at:
                    self.at[c] = np.zeros(len(self.short), np.uint64)
                self.at[c][j] |= np.uint64(1 << i)
        for k in self.long:
            own = self.bits[k] = {}
            for i, c in enumerate(headings[k]):
                own[c] = own.get(c, 0) | 1 << i

    def common_lengths(self, a: str) -> np.ndarray:
        """Length of the longest common subsequence of a and each heading."""
        out = np.zeros(len(self.sizes), np.int64)
        state = self.full.copy()
        for c in a:
            if c in self.at:
                met = state & self.at[c]
                state = ((state + met) | (state - met)) & self.full
        out[self.short] = np.bitwise_count(self.full & ~state)
        for k in self.long:
            own, full = self.bits[k], (1 << int(self.sizes[k])) - 1
            rest = full
            for c in a:
                met = rest & own.get(c, 0)
                rest = ((rest + met) | (rest - met)) & full
            out[k] = (full & ~rest).bit_count()
        return out


def heading_matrix(a: list[str], b: list[str]) -> np.ndarray:
    """Similarity of headings whose words are in order, each distinct pair once; 0 where a side is empty."""
    rows, i = np.unique(np.array(a, object), return_inverse=True)
    columns, j = np.unique(np.array(b, object), return_inverse=True)
    index = HeadingIndex(list(columns))
    out = np.zeros((len(rows), len(columns)))
    for k, x in enumerate(rows):
        if x:
            out[k] = np.where(index.sizes > 0, 2 * index.common_lengths(x) / (len(x) + index.sizes), 0.0)
            out[k][columns == x] = 1.0
    return out[i][:, j]


def number_matrix(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """1 for equal clause numbers, 0.5 if one's text starts the other's, else 0."""
    rows, i = np.unique(np.array([x or "" for x in a], object), return_inverse=True)
    columns, j = np.unique(np.array([x or "" for x in b], object), return_inverse=True)
    out = np.zeros((len(rows), len(columns)))
    place = {y: k for k, y in enumerate(columns) if y}
    begins: dict[str, list[int]] = {}  # the columns that begin with it
    for y, k in place.items():
        for end in range(1, len(y) + 1):
            begins.setdefault(y[:end], []).append(k)
    for k, x in enumerate(rows):
        out[k, begins.get(x, [])] = 0.5
        out[k, [place[x[:end]] for end in range(1, len(x)) if x[:end] in place]] = 0.5
        if x in place:
            out[k, place[x]] = 1.0
    return out[i][:, j]


class TermRows:
    """Sparse rows: row k has terms[starts[k]:starts[k + 1]], with their weights."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        self.starts, self.terms, self.weights = starts, terms, weights

    def __len__(self) -> int:
        return len(self.starts) - 1

    def part(self, first: int, end: int) -> TermRows:
        at = slice(self.starts[first], self.starts[end])
        return TermRows(self.starts[first : end + 1] - self.starts[first], self.terms[at], self.weights[at])


def tfidf_rows(clauses: list[list[str]], max_terms: int) -> TermRows:
    """Normalised weights of each clause's words and word pairs: its max_terms most frequent terms count, ties in their order."""
    place: dict[str, int] = {}
    words = np.array([place.setdefault(w, len(place)) for c in clauses for w in c], np.int64)
    owner = np.repeat(np.arange(len(clauses)), [len(c) for c in clauses])
    v = max(1, len(place))
    follows = owner[1:] == owner[:-1]
    keys = np.concatenate((words, v + words[:-1][follows] * v + words[1:][follows]))
    known, term = np.unique(keys, return_inverse=True)
    n = max(1, len(known))
    cell, tf = np.unique(np.concatenate((owner, owner[1:][follows])) * n + term, return_counts=True)
    row, term = np.divmod(cell, n)
    df = np.bincount(term, minlength=n)
    idf = np.log((1 + len(clauses)) / (1 + df)) + 1
    if len(known) > max_terms:
        total = np.bincount(term, weights=tf, minlength=n)
        edge = np.partition(total, -max_terms)[-max_terms]
        kept, names = total > edge, list(place)
        name = lambda k: names[k] if k < v else " ".join((names[(k - v) // v], names[(k - v) % v]))
        equal = sorted(np.flatnonzero(total == edge).tolist(), key=lambda t: name(int(known[t])))
        kept[equal[: max_terms - int(kept.sum())]] = True
        row, term, tf = row[kept[term]], term[kept[term]], tf[kept[term]]
    weights = tf * idf[term]
    norm = np.sqrt(np.bincount(row, weights=weights * weights, minlength=len(clauses)))
    starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(clauses)))))
    return TermRows(starts, term, weights / norm[row])


def sparse_product(a: TermRows, b: TermRows, most: int = 1 << 21) -> np.ndarray:
    """Dot products of all rows of a with all of b, by b's inverted index; `most` products are held at a time."""
    out = np.zeros((len(a), len(b)))
    if not len(a.terms) or not len(b.terms):
        return out
    order = np.argsort(b.terms, kind="stable")
    posted, weight = np.repeat(np.arange(len(b)), np.diff(b.starts))[order], b.weights[order]
    span = int(max(a.terms.max(), b.terms.max())) + 1
    first = np.concatenate(([0], np.cumsum(np.bincount(b.terms, minlength=span))))
    lengths = first[a.terms + 1] - first[a.terms]
    work = np.concatenate(([0], np.cumsum(lengths)))[a.starts]
    begin = 0
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(work, work[begin] + most, side="right")) - 1)
        own = slice(a.starts[begin], a.starts[end])
        n = lengths[own]
        at = np.arange(n.sum()) + np.repeat(first[a.terms[own]] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        row = np.repeat(np.arange(end - begin), np.diff(a.starts[begin : end + 1]))
        cell = np.repeat(row, n) * len(b) + posted[at]
        found = np.bincount(cell, weights=np.repeat(a.weights[own], n) * weight[at], minlength=(end - begin) * len(b))
        out[begin:end] = found.reshape(end - begin, len(b))
        begin = end
    return np.clip(out, 0.0, 1.0)


def twin_products(words: pa.ListArray, max_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """sparse_product of the tfidf_rows of many pairs of clauses at once, rows 2k and 2k + 1 of `words` being one, to the bit.

    And which pairs have at most max_terms terms: the others' products are not theirs.
    """
    n = len(words) // 2
    if not len(words.flatten()):
        return np.zeros(n), np.ones(n, bool)
    codes = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(2 * n), pc.list_value_length(words).to_numpy())
    pair, span = row >> 1, int(codes.max()) + 1
    # as in tfidf_rows, a word is its place in the order of the pair's words: sums then run in the same order
    own, first, word = np.unique(pair * span + codes, return_index=True, return_inverse=True)
    seen = np.empty(len(own), np.int64)
    seen[np.argsort(first)] = np.arange(len(own))
    known = np.bincount(own // span, minlength=n)
    place, v = seen[word] - (np.cumsum(known) - known)[pair], known[pair]
    follows = row[1:] == row[:-1]
    key = np.concatenate((place, (v[1:] + place[:-1] * v[1:] + place[1:])[follows]))
    width = int(key.max()) + 1
    if 2 * n * width >= 1 << 62:
        raise OverflowError("too many words for one number each pair and term")
    cell, tf = np.unique(np.concatenate((row, row[1:][follows])) * width + key, return_counts=True)
    row, key = np.divmod(cell, width)
    terms, term, df = np.unique((row >> 1) * width + key, return_inverse=True, return_counts=True)
    weights = tf * (np.log((1 + 2) / (1 + df)) + 1)[term]
    weights = weights / np.sqrt(np.bincount(row, weights=weights * weights, minlength=2 * n))[row]
    shared = df[term] == 2
    a, b = (shared & (row & 1 == side) for side in (0, 1))  # in the same order of pairs and terms
    found = np.bincount(row[a] >> 1, weights=weights[a] * weights[b], minlength=n)
    return np.clip(found, 0.0, 1.0), np.bincount(terms // width, minlength=n) <= max_terms


def vector_matrix(a: list, b: list) -> np.ndarray:
    """Cosines of the vectors within 0 and 1, 0 for one without length; NaN where either is missing."""
    out = np.full((len(a), len(b)), np.nan)
    rows, columns = ([k for k, v in enumerate(side) if v is not None] for side in (a, b))
    if rows and columns:
        unit = lambda vectors: (lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1.0))(np.array(vectors, float))
        out[np.ix_(rows, columns)] = np.clip(unit([a[k] for k in rows]) @ unit([b[k] for k in columns]).T, 0.0, 1.0)
    return out
