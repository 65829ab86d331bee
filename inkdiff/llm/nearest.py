"""Nearest neighbours by a forest of random-projection trees, one priority queue over all trees, and exact reranking.

A tree projects vectors (scaled to length 1) on a few orthogonal random directions, one a level, and halves each node at
the median of a sample; its leaves are cells. The square of a query's distance from a cell, in the projected space, is
the sum of the squares of its margins to the cuts that part them: a lower bound of its true distance. A search starts with
the roots of all trees in one queue, always takes the node with the least bound, and stops when the leaves taken hold
`share` of the rows of all trees. The share is found in the sample itself: the one at which TARGET of the true neighbours
of its PROBES vectors are reached. In more rows neighbours are nearer than in their sample, so recall is above that.

Equal vectors are one candidate with its k + 1 least ids, so copies are never expanded. Every other row is indexed in all
trees: rows and queries meet by piece (a subtree of about PIECE rows; larger ones are split by the vectors' hash, and
queries of one piece into blocks of BLOCK), each packed in one row, so no group grows with the data. In a piece the
cosines of a query with the rows of its leaves are one matrix product; of each piece the k + 1 best stay, with their
cosines in double precision by a sum in fixed order. Cosines that agree in 13 decimals are ties there, to the least
id; the result is ordered by the cosines as returned, then by id.

Bounds: the sample (SAMPLE vectors on the mean, chosen by their hash, on the driver), the forest (trees * 2 ** depth cuts,
depth so that a leaf has 8 vectors of the sample at least; broadcast), rows of a leaf and of a piece (small tables, by the
forest's size). Beyond 12 * SAMPLE rows leaves grow with the table: give a larger sample there.

Vectors that are null, zero, or hold null or non-finite components, vectors of another length than most, and rows without
an id take no part. A row that repeats id and vector counts once. Other columns are not read. A query without any other
row has no rows in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import discard, materialize, table

TREES, LEAF, SAMPLE, PROBES, TARGET = 4, 96, 20_000, 300, 0.96
PIECE, BLOCK = 8192, 512
SPREAD = 1 << 20  # of the hash that chooses the sample


@dataclass
class Forest:
    """directions[t]: dimensions x depth; cuts[t][l]: the 2 ** l cuts of level l. sizes: rows of each leaf, all trees."""

    directions: list[np.ndarray]
    cuts: list[list[np.ndarray]]
    share: float = 1.0
    sizes: np.ndarray | None = None

    @property
    def depth(self) -> int:
        return len(self.cuts[0])

    def leaves(self, units: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: rows x trees."""
        out = np.zeros((len(units), len(self.cuts)), np.int64)
        for t, (directions, cuts) in enumerate(zip(self.directions, self.cuts, strict=True)):
            margins = units @ directions
            for level, cut in enumerate(cuts):
                out[:, t] = 2 * out[:, t] + (margins[:, level] > cut[out[:, t]])
        return out

    def queue(self, unit: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, tree, leaf) of all trees' leaves, nearest first, by one queue."""
        margins = [(unit @ d).tolist() for d in self.directions]
        heap = [(0.0, 0, t, 0) for t in range(len(self.cuts))]
        while heap:
            bound, level, t, node = heapq.heappop(heap)
            while level < self.depth:  # go down on the query's side, and leave the other for later
                margin = margins[t][level] - self.cuts[t][level][node]
                right = margin > 0
                heapq.heappush(heap, (bound + margin * margin, level + 1, t, 2 * node + (not right)))
                level, node = level + 1, 2 * node + right
            yield bound, t, node

    def search(self, unit: np.ndarray) -> list[tuple[int, int]]:
        """The leaves that a query visits."""
        left, found = self.share * self.sizes.sum(), []
        for _, t, leaf in self.queue(unit):
            found.append((t, leaf))
            left -= self.sizes[t, leaf]
            if left <= 0:
                break
        return found


def fit(sample: np.ndarray, rows: int, trees: int = TREES, k: int = 5, target: float = TARGET, seed: int = 7) -> Forest:
    """A forest for so many rows, from a sample of unit vectors. The share of rows to visit is found in the sample."""
    rng = np.random.default_rng(seed)
    n, dims = sample.shape
    depth = max(0, min(int(np.log2(max(1, rows / LEAF))), int(np.log2(max(1, n / 8))), dims))
    forest = Forest([], [])
    for _ in range(trees):
        directions = np.linalg.qr(rng.standard_normal((dims, max(1, depth))))[0]
        margins, node, cuts = sample @ directions, np.zeros(n, np.int64), []
        for level in range(depth):
            order = np.argsort(node, kind="stable")
            split = np.split(margins[order, level], np.searchsorted(node[order], np.arange(1, 2**level)))
            cuts.append(np.array([np.median(m) if len(m) else 0.0 for m in split]))
            node = 2 * node + (margins[:, level] > cuts[-1][node])
        forest.directions.append(directions)
        forest.cuts.append(cuts)
    leaves = forest.leaves(sample)
    forest.sizes = np.stack([np.bincount(leaves[:, t], minlength=2**depth) for t in range(trees)])
    probes = rng.choice(n, min(n, PROBES), replace=False)
    needed = []
    for p in probes:
        cosines = sample @ sample[p]
        cosines[p] = -2
        wanted = np.argsort(-cosines)[:k][: n - 1]
        place = np.zeros(forest.sizes.shape)
        seen = 0
        for _, t, leaf in forest.queue(sample[p]):
            seen += forest.sizes[t, leaf]
            place[t, leaf] = seen
        needed += place[np.arange(trees), leaves[wanted]].min(axis=1).tolist()
    forest.share = float(np.quantile(needed, target) / (n * trees)) if needed else 1.0
    return forest


def _units(vectors: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, of one length, in double precision, scaled to length 1."""
    x = _matrix(vectors)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The same in double precision, each scaled by a power of two, so that no cosine changes and no square overflows."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) if len(x) else x


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vector: Column) -> Column:
    """No null, infinite or undefined component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN counts as larger than infinity
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, trees: int = TREES, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest cosines found for each row where is_query holds."""
    kind = df.schema[vector].dataType
    rows = df.where(df[key].isNotNull() & usable(df[vector])).select(df[key].cast("long").alias("_id"), df[vector].alias("_v"), is_query.alias("_q"))
    lengths = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, total = rows.where(F.size("_v") == lengths["n"]), lengths["count"]
    chosen = F.pmod(F.xxhash64("_v"), F.lit(SPREAD)) < int(min(1.0, sample / total) * SPREAD)
    forest = fit(_units(rows.where(chosen).select("_v").distinct().toArrow()["_v"].combine_chunks()), total, trees, k, target)
    placed = _place(rows, forest, k, kind)
    counts = placed.select(F.posexplode("_leaves").alias("_t", "_leaf")).groupBy("_t", "_leaf").count().collect()
    forest.sizes = np.zeros((trees, 2**forest.depth), np.int64)
    for r in counts:
        forest.sizes[r["_t"], r["_leaf"]] = r["count"]
    visits = _visits(placed.where("_q"), forest, kind)
    best = _scored(placed, visits, forest, kind, k)
    queries = rows.where("_q").select("_id", "_v").distinct().join(placed.select(F.col("_v"), F.col("_ids")[0].alias("_query")), "_v").select("_id", "_query")
    order = "over (partition by _id, _query order by _score desc, _candidate)"
    out = queries.join(best, "_query").select("_id", "_query", "_score", F.explode("_ids").alias("_candidate")).where("_candidate <> _id")
    out = out.selectExpr("_id as query_id", f"row_number() {order} as rank", "_candidate as vec_id", "_score as score").where(F.col("rank") <= k)
    return out.withColumn("rank", F.col("rank").cast("int"))


def _place(rows: DataFrame, forest: Forest, k: int, kind: T.DataType) -> DataFrame:
    """Each distinct vector once: _v, its k + 1 least _ids, whether any of its rows is a query (_q), its _leaves."""
    asks = rows.groupBy("_v").agg(F.max("_q").alias("_q"))
    few = rows.select("_id", "_v").distinct().withColumn("_n", F.expr("row_number() over (partition by _v order by _id)")).where(F.col("_n") <= k + 1)
    few = few.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    distinct = few.join(asks, "_v").select("_v", "_ids", "_q")
    model = rows.sparkSession.sparkContext.broadcast(forest)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(list(model.value.leaves(_units(b["_v"]))) if len(b) else [], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "_leaves"])

    return materialize(distinct.mapInArrow(leaves, f"_v {kind.simpleString()}, _ids array<long>, _q boolean, _leaves array<int>"), "placed")


def _visits(queries: DataFrame, forest: Forest, kind: T.DataType) -> DataFrame:
    """_query (its least id), _v, _piece and the _visited leaves of each piece that a query searches."""
    model, below = queries.sparkSession.sparkContext.broadcast(forest), _below(forest)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pieces, visited = [], [], []
            for i, unit in enumerate(_units(b["_v"]) if len(b) else []):
                found: dict[int, list[int]] = {}
                for t, leaf in model.value.search(unit):
                    found.setdefault((t << model.value.depth | leaf) >> below, []).append(leaf)
                at += [i] * len(found)
                pieces += found
                visited += found.values()
            first = pa.array([ids[0] for ids in b["_ids"].to_pylist()], pa.int64())
            columns = [first.take(pa.array(at, pa.int64())), b["_v"].take(pa.array(at, pa.int64())), pa.array(pieces, pa.int64()), pa.array(visited, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["_query", "_v", "_piece", "_visited"])

    return materialize(queries.mapInArrow(search, f"_query long, _v {kind.simpleString()}, _piece long, _visited array<int>"), "visits")


def _below(forest: Forest) -> int:
    """Levels of a piece: those of the lowest subtree that holds PIECE rows on the mean."""
    mean = max(1.0, forest.sizes.sum() / forest.sizes.size)
    return max(0, min(forest.depth, int(np.log2(max(1.0, PIECE / mean)))))


def _packed(rows: DataFrame, most: int, fields: list[str], name: str) -> DataFrame:
    """rows of each _piece in packs of about `most`, one row a pack."""
    sizes = rows.groupBy("_piece").agg(F.ceil(F.count("*") / F.lit(most)).alias("_packs"))
    dealt = rows.join(sizes, "_piece").withColumn("_pack", F.pmod(F.xxhash64("_v"), F.col("_packs")))
    return dealt.groupBy("_piece", "_pack").agg(F.collect_list(F.struct(*fields)).alias(name)).drop("_pack")


def _scored(placed: DataFrame, visits: DataFrame, forest: Forest, kind: T.DataType, k: int) -> DataFrame:
    """_query, _ids, _score: the k + 1 best distinct vectors of each query."""
    depth, below = forest.depth, _below(forest)
    rows = placed.select("_v", "_ids", F.posexplode("_leaves").alias("_t", "_leaf"))
    rows = rows.withColumn("_piece", F.shiftright(F.shiftleft(F.col("_t").cast("long"), depth).bitwiseOR(F.col("_leaf").cast("long")), below))
    met = _packed(rows, PIECE, ["_leaf", "_v", "_ids"], "_rows").join(_packed(visits, BLOCK, ["_query", "_v", "_visited"], "_queries"), "_piece")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                own, asked = b["_rows"][i].values, b["_queries"][i].values
                leaf, vectors, x = own.field("_leaf").to_numpy(), own.field("_v"), _matrix(own.field("_v"))
                least = np.array([ids[0] for ids in own.field("_ids").to_pylist()])
                q, units = _matrix(asked.field("_v")), _units(vectors)
                near = np.round(_units(asked.field("_v")) @ units.T, 13)
                seen = np.zeros((len(q), 1 << depth), bool)
                lists = asked.field("_visited")
                seen[np.repeat(np.arange(len(q)), lists.value_lengths()), lists.flatten().to_numpy()] = True
                near[~seen[:, leaf]] = -np.inf
                order = np.lexsort((np.broadcast_to(least, near.shape), -near), axis=1)[:, : k + 1] if near.shape[1] <= 4 * k else _first(near, least, k + 1)
                row, place = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
                there = near[row, place] > -np.inf
                row, place = row[there], place[there]
                out = [asked.field("_query").take(pa.array(row)), own.field("_ids").take(pa.array(place)), pa.array(cosine(q[row], x[place]), pa.float64())]
                yield pa.RecordBatch.from_arrays(out, ["_query", "_ids", "_score"])

    found = met.select("_rows", "_queries").mapInArrow(score, "_query long, _ids array<long>, _score double")
    found = found.groupBy("_query", "_ids").agg(F.max("_score").alias("_score"))
    best = found.withColumn("_n", F.expr("row_number() over (partition by _query order by _score desc, _ids[0])"))
    out = materialize(best.where(F.col("_n") <= k + 1).drop("_n"), "nearest")
    discard(visits)
    return out


def _first(near: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row, ties to the least id."""
    out = np.zeros((len(near), k), np.int64)
    edge = np.partition(near, -k, axis=1)[:, -k]
    for i, row in enumerate(near):
        at = np.flatnonzero(row >= edge[i]) if edge[i] > -np.inf else np.flatnonzero(row > -np.inf)
        at = at[np.lexsort((least[at], -row[at]))][:k]
        rest = np.flatnonzero(row == -np.inf)[: k - len(at)]
        out[i] = np.concatenate((at, rest))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of each row whose id 50 divides."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors["vec_id"] % 50 == 0)
