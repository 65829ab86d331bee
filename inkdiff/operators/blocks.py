"""Document pairs with too many clauses for one group: scores in blocks, and a proven best alignment.

A pair's clauses are dealt into blocks of about BLOCK by their ordinals' hash, each packed in one row; blocks of one side
meet those of the other, and a task holds the scores of two blocks. All n * m scores of a pair are made so, but none is
kept unless it is asked for: the alignment keeps, for each clause, its KEEP best partners of each block and then of all.

These few are one group a pair (some hundred bytes a clause), where `sparse_assign` finds their best alignment and prices.
The prices then go back to all blocks: a pair of clauses that was not kept can only matter if its score exceeds the sum
of its two prices. Those that do are added, and it is solved again, until there are none. Then the prices prove that no
alignment of all n * m scores has a greater total.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions.kernels import TermRows
from ..functions.matching import sparse_assign
from ..storage import kept
from .features import SCORES, Side, clause_rows, picked, scores, weighted_terms

BLOCK, KEEP = 1000, 12
#: What a score must exceed its prices by to be added; they carry the errors of sums of doubles.
ROOM = 1e-9
_ROWS = "array<struct<ordinal: int, terms: array<int>, weights: array<double>, number: string, heading: string, embedding: array<double>, price: double>>"


def features(clauses: DataFrame, config: Config) -> DataFrame:
    """A row for each clause, with the sparse weights of its terms."""
    terms = weighted_terms(clauses, config.max_terms).groupBy("pair_id", "side", F.col("ordinal").cast("int").alias("ordinal"))
    terms = terms.agg(F.sort_array(F.collect_list(F.struct("place", "weight"))).alias("t"))
    terms = terms.select("pair_id", "side", "ordinal", F.col("t.place").alias("terms"), F.col("t.weight").alias("weights"))
    return clause_rows(clauses).drop("text").join(terms, ["pair_id", "side", "ordinal"], "left").withColumn("price", F.lit(0.0))


def block_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair_id, a, b): each block of A clauses with each block of B clauses of the same pair."""
    sizes = rows.groupBy("pair_id", "side").agg(F.ceil(F.count("*") / F.lit(block)).alias("_blocks"))
    dealt = rows.join(sizes, ["pair_id", "side"]).withColumn("_block", F.pmod(F.xxhash64("ordinal"), F.col("_blocks")))
    fields = ["ordinal", "terms", "weights", "number", "heading", "embedding", "price"]
    packs = dealt.groupBy("pair_id", "side", "_block").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    # a task has a block of A with all of B: the packs of B go to each block of A, as one place for a pair would do all alone
    of_a = sizes.where("side = 'a'").select("pair_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    of_b = packs.where("side = 'b'").select("pair_id", F.col("rows").alias("b"))
    return packs.where("side = 'a'").select("pair_id", "_block", F.col("rows").alias("a")).join(of_b.join(of_a, "pair_id"), ["pair_id", "_block"]).drop("_block")


def _side(rows: pa.StructArray) -> Side:
    get = lambda name: rows.field(name).to_pylist()
    terms = [t or [] for t in get("terms")]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in terms]))).astype(np.int64)
    weights = np.array([w for ws in get("weights") for w in ws or []], float)
    flat = TermRows(starts, np.array([t for ts in terms for t in ts], np.int64), weights)
    return Side(np.array(get("ordinal"), np.int32), flat, get("number"), get("heading"), get("embedding"), np.array(get("price"), float))


def in_blocks(rows: DataFrame, solve: Callable[[Side, Side], dict], fields: str, block: int = BLOCK) -> DataFrame:
    """solve(a, b) of all blocks; where it fails, a row that has the pair and the error only."""
    kind = rows.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                try:
                    out = solve(*(_side(batch[s][k].values) for s in "ab"))
                    n, error = len(out["a_ordinal"]), None
                except Exception as e:  # one pair's failure is told and does not end the others
                    out, n, error = {}, 1, f"{type(e).__name__}: {e}"
                yield _filled(out, n, batch["pair_id"][k].as_py(), batch.schema.field("pair_id").type, error, fields)

    return block_pairs(rows, block).mapInArrow(run, f"pair_id {kind}, {fields}, error string")


def _filled(out: dict, n: int, pair, kind: pa.DataType, error: str | None, fields: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "double": pa.float64()}
    columns = {"pair_id": pair if isinstance(pair, pa.Array) else pa.array([pair] * n, kind)}
    for name, t in (f.split() for f in fields.split(", ")):
        columns[name] = out[name].cast(types[t]) if name in out else pa.nulls(n, types[t])
    return pa.RecordBatch.from_pydict(columns | {"error": pa.array([error] * n, pa.string())})


def _best_places(value: np.ndarray, a: Side, b: Side, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the greatest positive values of each row and each column; equal ones are chosen by chance, not by place."""
    chance = (a.ordinal.astype(np.uint64)[:, None] * np.uint64(2654435761) ^ b.ordinal.astype(np.uint64)[None, :] * np.uint64(40503)) % np.uint64(65521)
    ranked = value + 1e-9 * chance.astype(float) / 65521
    chosen = np.zeros(value.shape, bool)
    for axis, size in ((1, value.shape[1]), (0, value.shape[0])):
        if size <= keep:
            chosen[:] = True
        else:
            np.put_along_axis(chosen, np.argpartition(-ranked, keep, axis=axis).take(range(keep), axis=axis), True, axis=axis)
    return np.nonzero(chosen & (value > 0))


def _reduced(edges: DataFrame, score: str, keep: int) -> DataFrame:
    """The best `keep` of each clause of either side."""
    chance = F.xxhash64("a_ordinal", "b_ordinal")
    for side in ("a", "b"):
        order = Window.partitionBy("pair_id", f"{side}_ordinal").orderBy(F.desc(score), chance)
        edges = edges.withColumn(f"_{side}", F.row_number().over(order))
    return edges.where(f"_a <= {keep} or _b <= {keep}").drop("_a", "_b")


def _solved(edges: DataFrame, score: str) -> DataFrame:
    """(pair_id, side, ordinal, price, partner) of the clauses in edges."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, i = np.unique(table["a_ordinal"].to_numpy(), return_inverse=True)
        b, j = np.unique(table["b_ordinal"].to_numpy(), return_inverse=True)
        partner, u, v = sparse_assign(len(a), len(b), i, j, table[score].to_numpy())
        of_b = np.full(len(b), -1)
        of_b[partner[partner >= 0]] = np.flatnonzero(partner >= 0)
        partners = [pa.array(other[p], pa.int32(), mask=p < 0) for p, other in ((partner, b), (of_b, a))]
        return pa.table(
            {
                "pair_id": pa.array([key[0].as_py()] * (len(a) + len(b)), table.schema.field("pair_id").type),
                "side": ["a"] * len(a) + ["b"] * len(b),
                "ordinal": pa.array(np.concatenate((a, b)), pa.int32()),
                "price": np.concatenate((u, v)),
                "partner": pa.concat_arrays(partners),
            }
        )

    kind = edges.schema["pair_id"].dataType.simpleString()
    return edges.groupBy("pair_id").applyInArrow(run, f"pair_id {kind}, side string, ordinal int, price double, partner int")


def best_of_blocks(clauses: DataFrame, config: Config, score: str = "match_score", names: tuple = SCORES, block: int = BLOCK, keep: int = KEEP) -> DataFrame:
    """The min(n, m) rows of each pair's best alignment: a_ordinal, b_ordinal, the named scores, candidates, error."""
    rows = kept(features(clauses, config))
    fields = ", ".join(["a_ordinal int", "b_ordinal int", *(f"{s} double" for s in names), "candidates int"])

    def first(a: Side, b: Side) -> dict:
        found = scores(a, b, config, names)
        out = picked(a, b, found, *_best_places(found[score], a, b, keep))
        reach = (found[score] >= config.review_threshold).sum(axis=1)
        tail = {"a_ordinal": pa.array(a.ordinal), "candidates": pa.array(reach, pa.int32())}  # no b_ordinal: a count
        n, extra = len(out["a_ordinal"]), len(reach)
        out["candidates"] = pa.nulls(n, pa.int32())
        return {k: pa.concat_arrays([v, tail.get(k, pa.nulls(extra, v.type)).cast(v.type)]) for k, v in out.items()}

    def worth_more(a: Side, b: Side) -> dict:
        found = scores(a, b, config, names)
        excess = found[score] - a.price[:, None] - b.price[None, :] - ROOM
        return picked(a, b, found, *_best_places(excess, a, b, keep))

    met = kept(in_blocks(rows, first, fields, block))
    failed = met.where("error is not null").groupBy("pair_id").agg(F.min("error").alias("error"))
    good = met.where("error is null").join(failed, "pair_id", "left_anti")
    reach = good.where("b_ordinal is null").groupBy("pair_id", "a_ordinal").agg(F.sum("candidates").cast("int").alias("candidates"))
    edges = kept(_reduced(good.where("b_ordinal is not null").drop("candidates", "error"), score, keep))
    settled = rows.join(failed, "pair_id", "left_anti")
    while True:
        solved = kept(_solved(edges, score))
        priced = settled.drop("price").join(solved.drop("partner"), ["pair_id", "side", "ordinal"], "left").fillna({"price": 0.0})
        told = kept(in_blocks(priced, worth_more, fields, block))
        failed = failed.union(told.where("error is not null").groupBy("pair_id").agg(F.min("error").alias("error")))
        more = told.where("error is null").drop("candidates", "error")
        if more.isEmpty():
            break
        edges = kept(edges.union(more).dropDuplicates(["pair_id", "a_ordinal", "b_ordinal"]))
    pairs = solved.where("side = 'a' and partner is not null").select("pair_id", F.col("ordinal").alias("a_ordinal"), F.col("partner").alias("b_ordinal"))
    matched = pairs.join(edges, ["pair_id", "a_ordinal", "b_ordinal"]).join(failed, "pair_id", "left_anti")
    # Clauses that stay alone on both sides have no score with each other, and are paired in their order.
    alone = settled.select("pair_id", "side", "ordinal").join(failed, "pair_id", "left_anti").join(solved.where("partner is not null"), ["pair_id", "side", "ordinal"], "left_anti")
    alone = alone.withColumn("_n", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("ordinal")))
    side = lambda s: alone.where(F.col("side") == s).select("pair_id", "_n", F.col("ordinal").alias(f"{s}_ordinal"))
    rest = side("a").join(side("b"), ["pair_id", "_n"]).select("pair_id", "a_ordinal", "b_ordinal", *[F.lit(0.0).alias(s) for s in names])
    out = matched.unionByName(rest).join(reach, ["pair_id", "a_ordinal"], "left").withColumn("error", F.lit(None).cast("string"))
    return out.unionByName(failed.groupBy("pair_id").agg(F.min("error").alias("error")), allowMissingColumns=True)
