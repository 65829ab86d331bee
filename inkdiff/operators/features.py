"""What clauses are compared by: weighted terms, numbers, headings, vectors; and the scores of two sets of clauses."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions.kernels import TermRows, heading_matrix, number_matrix, sparse_product, tfidf_rows, twin_products, vector_matrix
from ..functions.text import all_matches, first_match, strip, words_of

TERM = r"(?U)\b\w\w+\b"
SCORES = ("tfidf_score", "number_score", "heading_score", "embedding_score", "match_score")


def terms_of(text: str) -> Column:
    return all_matches(F.lower(F.coalesce(text, F.lit(""))), TERM)


def clause_number(heading: Column) -> Column:
    return first_match(strip(F.coalesce(heading, F.lit(""))), r"\A(\d+(?:\.\d+)*)", 1)


def weighted_terms(clauses: DataFrame, max_terms: int) -> DataFrame:
    """tfidf_terms with `place`, the term's rank in its pair: 1 to max_terms."""
    words = terms_of("text")
    neighbours = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.concat_ws(" ", F.element_at("words", k), F.element_at("words", k + 1)))
    pairs = F.when(F.size("words") > 1, neighbours).otherwise(F.array().cast("array<string>"))
    # a clause has some hundred terms: they are made, and counted, after the clauses are dealt to as many tasks as there are
    dealt = clauses.select("pair_id", "side", "ordinal", "text").repartition("pair_id", "side", "ordinal")
    rows = dealt.select("pair_id", "side", "ordinal", words.alias("words"))
    terms = rows.select("pair_id", "side", "ordinal", F.explode(F.concat("words", pairs)).alias("term"))
    counted = terms.groupBy("pair_id", "side", "ordinal", "term").agg(F.count("*").alias("tf"))
    sizes = clauses.groupBy("pair_id").agg(F.count("*").alias("n"))
    by_term = counted.groupBy("pair_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("total"), "term"))
    kept = by_term.withColumn("place", rank).where(F.col("place") <= max_terms).join(sizes, "pair_id")
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    # both sides are as many as the terms, which the planner takes for as few as the clauses: it must not broadcast them
    raw = counted.join(kept.select("pair_id", "term", "place", idf.alias("idf")).hint("merge"), ["pair_id", "term"]).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("pair_id", "side", "ordinal")))
    return raw.select("pair_id", "side", "ordinal", "term", "place", (F.col("raw") / norm).alias("weight"))


def tfidf_terms(clauses: DataFrame, max_terms: int = 5000) -> DataFrame:
    """(pair_id, side, ordinal, term, weight): L2-normalised weights of words and word pairs, fitted on each pair.

    idf = ln((1 + n) / (1 + df)) + 1 over the pair's clauses of both sides; its max_terms most frequent terms count,
    ties in the terms' order.
    """
    return weighted_terms(clauses, max_terms).drop("place")


def clause_rows(clauses: DataFrame) -> DataFrame:
    """pair_id, side, ordinal, number, heading (its words in order), embedding, and what `clauses` has as text."""
    vector = F.col("embedding").cast("array<double>") if "embedding" in clauses.columns else F.lit(None).cast("array<double>")
    heading = F.array_join(F.array_sort(words_of(F.coalesce("heading", F.lit("")))), " ")
    places = ["pair_id", "side", F.col("ordinal").cast("int").alias("ordinal")]
    return clauses.select(*places, clause_number(F.col("heading")).alias("number"), heading.alias("heading"), vector.alias("embedding"), "text")


@dataclass
class Side:
    """Clauses of one document in the order of their ordinals."""

    ordinal: np.ndarray
    terms: TermRows
    number: list[str | None]
    heading: list[str]
    embedding: list
    price: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ordinal)


def both_sides(table: pa.Table, max_terms: int) -> tuple[Side, Side]:
    """A pair's clauses (clause_rows with `words` for text) as two sides, their terms fitted on both."""
    a, b = (table.filter(pc.equal(table["side"], s)).sort_by("ordinal").to_pydict() for s in "ab")
    terms = tfidf_rows([*a["words"], *b["words"]], max_terms)
    n = len(a["ordinal"])
    parts = terms.part(0, n), terms.part(n, len(terms))
    return tuple(Side(np.array(x["ordinal"], np.int32), t, x["number"], x["heading"], x["embedding"]) for x, t in zip((a, b), parts, strict=True))


def scores(a: Side, b: Side, config: Config, names: Sequence[str] = SCORES) -> dict[str, np.ndarray]:
    """The scores of all clauses of a with all of b that are named; match_score needs the others."""
    out = {"tfidf_score": sparse_product(a.terms, b.terms)}
    if "match_score" not in names:
        return out
    out |= {"number_score": number_matrix(a.number, b.number), "heading_score": heading_matrix(a.heading, b.heading)}
    return _combined(out, vector_matrix(a.embedding, b.embedding), config)


def _combined(out: dict[str, np.ndarray], vectors: np.ndarray, config: Config) -> dict[str, np.ndarray]:
    """The scores with those of the vectors, or else the texts, and the weighted sum of all."""
    out["embedding_score"] = np.where(np.isnan(vectors), out["tfidf_score"], vectors)
    weights = {"number_score": config.number_weight, "heading_score": config.heading_weight, "embedding_score": config.embedding_weight}
    return out | {"match_score": sum(w * out[name] for name, w in weights.items())}


def lone_scores(table: pa.Table, config: Config, names: Sequence[str] = SCORES) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """scores() of many document pairs at once that have one clause a side, rows 2k and 2k + 1 of `table` being one.

    And which of them have at most max_terms terms: the others' scores are not theirs.
    """
    products, fits = twin_products(table["words"].combine_chunks(), config.max_terms)
    out = {"tfidf_score": products}
    if "match_score" not in names:
        return out, fits

    def each(name: str, matrix: Callable, none: float) -> np.ndarray:
        values = table[name].to_pylist()
        return np.array([matrix([x], [y])[0, 0] if x not in (None, "") and y not in (None, "") else none for x, y in zip(values[::2], values[1::2], strict=True)], float)

    out |= {"number_score": each("number", number_matrix, 0.0), "heading_score": each("heading", heading_matrix, 0.0)}
    return _combined(out, each("embedding", vector_matrix, np.nan), config), fits


def picked(a: Side, b: Side, found: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> dict[str, pa.Array]:
    """a_ordinal, b_ordinal and the scores at some places."""
    places = {"a_ordinal": a.ordinal[i], "b_ordinal": b.ordinal[j]}
    return {k: pa.array(v) for k, v in (places | {name: m[i, j] for name, m in found.items()}).items()}
