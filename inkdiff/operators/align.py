"""Scores and one-to-one alignment of the clauses of document pairs.

Clauses are rows (pair_id, side 'a' or 'b', ordinal, text, heading, …). Everything is keyed by pair_id: no step compares
clauses of different pairs, and there is no global cross join. A pair's n + m clauses meet in one group, as words and
headings; their n * m scores are made there, and the assignment, which by its definition needs them all at once, is
found there too, so no row is made for two clauses unless the scores themselves are asked for. To align pairs of one
clause a side, as labelled pairs are, whole batches of them are scored at once. Pairs of more than
MOST_CELLS scores or MOST_CLAUSES clauses are scored in blocks instead (`blocks`), which has no limit.

A step that fails on a pair gives one row for it, with the pair and the error only; the others are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.calls import loaded
from ..functions.kernels import assign, token_sort_similarity  # noqa: F401
from .blocks import _filled, best_of_blocks, features, in_blocks
from .features import SCORES, Side, both_sides, clause_number, clause_rows, lone_scores, picked, scores, terms_of, tfidf_terms  # noqa: F401

#: Of one group: five matrices of so many scores are 160 MB.
MOST_CELLS, MOST_CLAUSES = 4_000_000, 50_000


def tfidf_cosine(clauses: DataFrame, config: Config = Config()) -> DataFrame:
    """(pair_id, a_ordinal, b_ordinal, tfidf_score) of the clause pairs that share a term; all others score 0."""

    def solve(a: Side, b: Side) -> dict:
        found = scores(a, b, config, ("tfidf_score",))
        return picked(a, b, found, *np.nonzero(found["tfidf_score"]))

    return or_raise(_all_scores(clauses, solve, "a_ordinal int, b_ordinal int, tfidf_score double", config))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, within 0 and 1; 0 if either has no length, null if either is null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    value = F.try_divide(dot, norm(a) * norm(b))
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)))))


def number_score(a: Column, b: Column) -> Column:
    """1 for equal clause numbers, 0.5 if one's text starts the other's, else 0."""
    return F.when(a == b, 1.0).when(F.startswith(a, b) | F.startswith(b, a), 0.5).otherwise(0.0)


def combined_score(number: Column, heading: Column, text: Column, config: Config) -> Column:
    return F.lit(config.number_weight) * number + F.lit(config.heading_weight) * heading + F.lit(config.embedding_weight) * text


def _in_pairs(clauses: DataFrame, solve: Callable[[Side, Side], dict], fields: str, config: Config, lone: Callable[[pa.Table], tuple[dict, np.ndarray]] | None = None) -> DataFrame:
    """solve(a, b) of each document pair in a group of its own; where it fails, a row that has the pair and the error only.

    lone: gives what solve does, a row each, for many pairs of one clause a side at once (rows 2k and 2k + 1 of a table),
    and which of them it could do; the others, and all if it fails, are solved alone.
    """
    rows = clause_rows(clauses).withColumn("words", terms_of("text")).drop("text")
    kind = clauses.schema["pair_id"].dataType.simpleString()
    schema = f"pair_id {kind}, {fields}, error string"

    def solved(pair, table: pa.Table) -> pa.RecordBatch:
        try:
            out = solve(*both_sides(table, config.max_terms))
            n, error = len(out["a_ordinal"]), None
        except Exception as e:  # one pair's failure is told and does not end the others
            out, n, error = {}, 1, f"{type(e).__name__}: {e}"
        return _filled(out, n, pair, table.schema.field("pair_id").type, error, fields)

    if lone is None:
        return rows.groupBy("pair_id").applyInArrow(lambda key, table: pa.Table.from_batches([solved(key[0].as_py(), table)]), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_pairs(batches):
            first = pair_starts(table["pair_id"].combine_chunks())
            size = np.diff(np.append(first, len(table)))
            a, b = (pc.fill_null(pc.equal(table["side"], s), False).to_numpy() for s in "ab")
            twos = first[size == 2]
            twos = twos[a[twos] & b[twos + 1]]
            try:
                out, done = lone(table.take(np.stack((twos, twos + 1), axis=1).ravel()))
                twos, out = twos[done], {name: v.filter(pa.array(done)) for name, v in out.items()}
                together = _filled(out, len(twos), table["pair_id"].take(twos).combine_chunks(), table.schema.field("pair_id").type, None, fields)
            except Exception:  # told by the pair that fails, when it is solved alone
                twos, together = twos[:0], None
            if len(twos):
                yield together
            done = set(twos.tolist())
            for k, n in zip(first.tolist(), size.tolist(), strict=True):
                if k not in done:
                    yield solved(table["pair_id"][k].as_py(), table.slice(k, n))

    return rows.repartition("pair_id").sortWithinPartitions("pair_id", "side", "ordinal").mapInArrow(run, schema)


def pair_starts(pairs: pa.Array) -> np.ndarray:
    """The first row of each run of equal values; nulls are equal."""
    x, y = pairs[1:], pairs[:-1]
    other = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False) | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate(([0], 1 + np.flatnonzero(other)))[: len(pairs)]


def whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole pairs, from batches in their order: about a batch each, or one pair that is larger."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        before = held[-1]["pair_id"][-1:] if held else batch["pair_id"][:0]
        starts = pair_starts(pa.concat_arrays([before, batch["pair_id"]]))[1 if held else 0 :] - len(before)
        if held and len(starts):  # the last pair of this batch may go on
            held.append(batch[: starts[-1]])
            yield pa.Table.from_batches(held)
            held, batch = [], batch[starts[-1] :]
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _by_size(clauses: DataFrame, most_cells: int) -> tuple[DataFrame, DataFrame | None]:
    """The clauses of pairs that fit in one group, and those of larger pairs (None if there are none). Counts once."""
    side = lambda s: F.count_if(F.col("side") == s)
    sizes = clauses.groupBy("pair_id").agg(side("a").alias("_n"), side("b").alias("_m"))
    large = sizes.where((F.col("_n") * F.col("_m") > most_cells) | (F.col("_n") + F.col("_m") > MOST_CLAUSES)).select("pair_id")
    if large.isEmpty():
        return clauses, None
    return clauses.join(large, "pair_id", "left_anti"), clauses.join(large, "pair_id", "left_semi")


def _all_scores(clauses: DataFrame, solve: Callable[[Side, Side], dict], fields: str, config: Config) -> DataFrame:
    small, large = _by_size(clauses, MOST_CELLS)
    out = _in_pairs(small, solve, fields, config)
    return out if large is None else out.union(in_blocks(features(large, config), solve, fields))


def or_raise(rows: DataFrame) -> DataFrame:
    """rows without `error`; where one has an error, the job fails with it."""
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("pair "), F.col("pair_id").cast("string"), F.lit(": "), "error")).isNull()).otherwise(True)).drop("error")


_FIELDS = ", ".join(f"{s} double" for s in SCORES)


def score_pairs(clauses: DataFrame, config: Config = Config()) -> DataFrame:
    """All clause pairs of each document pair with number, heading, tfidf, embedding and match scores.

    clauses may have an `embedding` column; where both clauses have one it gives the text score, else TF-IDF does.
    """

    def solve(a: Side, b: Side) -> dict:
        return picked(a, b, scores(a, b, config), *np.divmod(np.arange(len(a) * len(b)), max(1, len(b))))

    return or_raise(_all_scores(clauses, solve, f"a_ordinal int, b_ordinal int, {_FIELDS}", config))


def match_type(score: Column, config: Config) -> Column:
    return F.when(score >= config.accept_threshold, "hybrid").when(score >= config.review_threshold, "needs_review")


def review_reason(score: Column, candidates: Column, config: Config) -> Column:
    banded = F.format_string(
        f"Match score %.3f is below accept threshold ({config.accept_threshold}) but above review threshold ({config.review_threshold}). Manual verification recommended.", score
    )
    several = F.format_string("Possible 1-to-many restructuring: clause matches %s candidates in document B.", candidates.cast("string"))
    return F.concat_ws(" ", F.when((score < config.accept_threshold) & (score >= config.review_threshold), banded), F.when(candidates > 1, several))


def restructure_counts(scores: DataFrame, config: Config = Config()) -> DataFrame:
    """(pair_id, a_ordinal, candidates): B clauses that reach the review threshold, of all scored ones."""
    return scores.groupBy("pair_id", "a_ordinal").agg(F.count_if(F.col("match_score") >= config.review_threshold).alias("candidates"))


def best_assignment(
    clauses: DataFrame, config: Config = Config(), score: str = "match_score", solver: Callable[[np.ndarray], list] = assign, most_cells: int = MOST_CELLS
) -> DataFrame:
    """The one-to-one alignment of greatest total score of each document pair (min(n, m) rows), with scores, `candidates`, `error`.

    candidates counts the B clauses of all scored ones that reach the review threshold for the same A clause. By
    tfidf_score alone, only that score is made. A pair that fails has one row, with its error; `or_raise` ends the job then.
    """
    names = SCORES if score == "match_score" else (score,)

    def solve(a: Side, b: Side) -> dict:
        found = scores(a, b, config, names)
        pairs = solver(found[score])
        i, j = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
        reach = (found[score] >= config.review_threshold).sum(axis=1).astype(np.int32) if pairs else np.zeros(0, np.int32)
        return picked(a, b, found, i, j) | {"candidates": pa.array(reach[i])}

    def lone(table: pa.Table) -> tuple[dict, np.ndarray]:
        found, done = lone_scores(table, config, names)
        ordinals = table["ordinal"].combine_chunks()
        if ordinals.null_count:
            raise ValueError("a clause without an ordinal")
        reach = (found[score] >= config.review_threshold).astype(np.int32)
        return {"a_ordinal": ordinals[::2], "b_ordinal": ordinals[1::2]} | {k: pa.array(v) for k, v in found.items()} | {"candidates": pa.array(reach)}, done

    fields = ", ".join(["a_ordinal int", "b_ordinal int", *(f"{s} double" for s in names), "candidates int"])
    small, large = _by_size(clauses, most_cells)
    out = _in_pairs(small, solve, fields, config, lone if solver is assign else None)
    return out if large is None else out.unionByName(best_of_blocks(large, config, score, names))


def embed_clauses(clauses: DataFrame, encode: Callable | None = None, text: str = "text", load: Callable | None = None, model: str = "") -> DataFrame:
    """clauses with `embedding`, by encode(list of texts) -> list of vectors, a batch at a time in Python workers.

    Instead of encode, load() may give it: it runs once in each worker process, and what it gives is kept there under the
    name `model` for all batches, tasks and queries that name it. Texts of a batch that the encoder fails on have no
    vector: TF-IDF scores them, as it does wherever one side has none; so do all texts of a process whose load failed.
    """

    def vectors_of(use: Callable, texts: list[str | None]) -> list:
        try:
            found = [None if v is None else [float(x) for x in v] for v in use([t or "" for t in texts])]
            if len(found) != len(texts):
                raise ValueError("a vector for each text is needed")
            return found
        except Exception:  # an encoder may fail in any way, and the comparison goes on without it
            return [None] * len(texts)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        use = encode if load is None else loaded(model, load)
        for texts in batches:
            yield pa.array([None] * len(texts) if use is None else vectors_of(use, texts.to_pylist()), pa.list_(pa.float64()))

    return clauses.withColumn("embedding", F.arrow_udf(run, "array<double>").asNondeterministic()(F.col(text)))


def complete(matched: DataFrame, clauses: DataFrame) -> DataFrame:
    """matched pairs, then the clauses of A without one as removed and those of B as added; empty sides need no case."""
    a = clauses.where("side = 'a'").select("pair_id", F.col("ordinal").alias("a_ordinal"))
    b = clauses.where("side = 'b'").select("pair_id", F.col("ordinal").alias("b_ordinal"))
    all_a = a.join(matched, ["pair_id", "a_ordinal"], "left")
    both = all_a.join(b.withColumn("_b", F.lit(True)), ["pair_id", "b_ordinal"], "full_outer")
    phase = F.when(F.col("a_ordinal").isNull(), 2).when(F.col("match_type").isNull(), 1).otherwise(0)
    kind = F.when(F.col("a_ordinal").isNull(), "added_candidate").when(F.col("match_type").isNull(), "removed_candidate").otherwise(F.col("match_type"))
    return both.withColumn("phase", phase).withColumn("match_type", kind).drop("_b")


def baseline_match(clauses: DataFrame, config: Config = Config(), best: DataFrame | None = None) -> DataFrame:
    """Alignment by TF-IDF alone, without a threshold. best: what best_assignment gave, without errors."""
    best = or_raise(best_assignment(clauses, config, "tfidf_score")) if best is None else best
    matched = best.select("pair_id", "a_ordinal", "b_ordinal", F.col("tfidf_score").alias("match_score"), "tfidf_score", F.lit("baseline").alias("match_type"), F.lit(False).alias("needs_review"), F.lit("").alias("review_reason"))
    return complete(matched, clauses)


def hybrid_match(clauses: DataFrame, config: Config = Config(), best: DataFrame | None = None) -> DataFrame:
    """Alignment by the combined score; pairs under the review threshold fall apart into removed and added."""
    best = or_raise(best_assignment(clauses, config)) if best is None else best
    review = (F.col("match_score") < config.accept_threshold) | (F.col("candidates") > 1)
    banded = best.withColumn("match_type", match_type(F.col("match_score"), config)).where("match_type is not null")
    matched = banded.withColumn("needs_review", review).withColumn("review_reason", review_reason(F.col("match_score"), F.col("candidates"), config)).drop("candidates")
    return complete(matched, clauses)


def with_clauses(matches: DataFrame, clauses: DataFrame) -> DataFrame:
    """matches with the texts and headings of both sides; the slots of a and b stay apart even for added clauses."""
    keep = [c for c in ("clause_id", "document_id", "document_name", "heading", "text", "original_text", "page_number") if c in clauses.columns]
    side = lambda s: clauses.where(F.col("side") == s).select("pair_id", F.col("ordinal").alias(f"{s}_ordinal"), *[F.col(c).alias(f"{c}_{s}") for c in keep])
    return matches.join(side("a"), ["pair_id", "a_ordinal"], "left").join(side("b"), ["pair_id", "b_ordinal"], "left")


#: What aligns clauses: (clauses, config) to pairs as `complete` gives them. Any other function of this shape will do.
MATCHERS = {"baseline": baseline_match, "hybrid": hybrid_match}
