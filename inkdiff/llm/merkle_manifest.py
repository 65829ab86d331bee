"""A Merkle manifest of a dataset: one tree a source, one over the sources, and a witness for every row.

Leaves of a source ascend by id; every ARITY consecutive nodes become the digest of their digests, until one is left. A
row's place in its source comes from a range exchange: its place in its partition plus the rows that earlier partitions
have of the source. Places are cut into aligned blocks of ARITY ** LEVELS leaves, and each block is one group of bounded
size. In it leaves are appended one after another (`append_all`): an open subtree holds the witnesses of its leaves, and
when a later sibling completes its run, the witnesses of all the run's members are extended by the others' digests. The
roots of the blocks are appended in the same way in the next round, as leaves of blocks of blocks, and the roots of the
sources at last. So a source of any size, a third of all rows too, is many small groups; only digests are shuffled, never
texts. A row's whole witness is its own, then its block's, then those of the blocks of blocks, then its source's.

Null ids come first in their source, null sources first among the sources. Rows that repeat an id are ordered by their
leaf; rows that repeat everything have equal leaves, so that their order does not matter. Null and empty texts differ
(`-`, `0:`). An empty table gives an empty result. Columns that are not named take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize, table

ARITY, LEVELS = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<left: string, right: string>>"


def digest_of(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as `-` if null, else as its UTF-8 byte count, a colon and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def append_all(nodes: Sequence[str], levels: int, arity: int = ARITY) -> tuple[str, list[list[tuple[str, str]]]]:
    """Append nodes to an empty tree of so many levels; its root, and for each node (left, right) siblings by level.

    open_runs[k] are the subtrees of height k that wait for their siblings: (digest, its first node, the one past its last).
    """
    witnesses: list[list[tuple[str, str]]] = [[] for _ in nodes]
    open_runs: list[list[tuple[str, int, int]]] = [[] for _ in range(levels + 1)]

    def complete(k: int) -> None:
        run, open_runs[k] = open_runs[k], []
        digests = [d for d, _, _ in run]
        for i, (_, first, end) in enumerate(run):
            siblings = "".join(digests[:i]), "".join(digests[i + 1 :])
            for w in witnesses[first:end]:
                w.append(siblings)
        merged = hashlib.sha256("".join(digests).encode()).hexdigest()
        open_runs[k + 1].append((merged, run[0][1], run[-1][2]))

    for i, node in enumerate(nodes):
        open_runs[0].append((node, i, i + 1))
        k = 0
        while k < levels and len(open_runs[k]) == arity:
            complete(k)
            k += 1
    for k in range(levels):  # the last runs have fewer members
        if open_runs[k]:
            complete(k)
    return open_runs[levels][0][0], witnesses


def height(n: int, arity: int = ARITY) -> int:
    """Levels over n nodes until one is left."""
    k, reach = 0, 1
    while reach < n:
        k, reach = k + 1, reach * arity
    return k


def _places(rows: DataFrame, group: str, by: Sequence[str], label: str) -> DataFrame:
    """rows with _place (from 0) in their group and the group's _n. Written twice: in order, and with places."""
    ordered = rows.repartitionByRange(group, *by).sortWithinPartitions(group, *by)
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), f"{label}-ordered")
    part = F.shiftrightunsigned("_at", 33)
    runs = ordered.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = f"sum(_rows) over (partition by {group} order by _part rows between unbounded preceding and 1 preceding)"
    runs = runs.selectExpr(group, "_part", f"coalesce({earlier}, 0) - _first as _shift", f"sum(_rows) over (partition by {group}) as _n")
    runs = runs.withColumnsRenamed({group: "_group", "_part": "_of"})
    same = (part == runs["_of"]) & ordered[group].eqNullSafe(runs["_group"])
    placed = ordered.join(runs, same).withColumn("_place", F.col("_at") + F.col("_shift")).drop("_at", "_of", "_group", "_shift")
    out = materialize(placed, label)
    discard(ordered)
    return out


def _append_blocks(nodes: DataFrame, group: str, round_: int, height_of_block: int) -> DataFrame:
    """nodes(group, _place, _n, _node, ...) with _block, the block's _root and the node's _witness in it.

    _n is the number of the group's leaves in the first round; a block of round r has the levels from r * height_of_block on.
    """
    fields = nodes.schema.fieldNames()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema), "_block long", "_root string", f"_witness {WITNESS}"])
    witness = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def one(block: pa.Table) -> pa.Table:
        block = block.sort_by("_place")
        levels = min(height_of_block, max(0, height(block["_n"][0].as_py()) - round_ * height_of_block))
        root, witnesses = append_all(block["_node"].to_pylist(), levels)
        made = [[{"left": a, "right": b} for a, b in w] for w in witnesses]
        block = block.select([*fields, "_block"]).append_column("_root", pa.array([root] * len(block), pa.string()))
        return block.append_column("_witness", pa.array(made, witness))

    block = F.floor(F.col("_place") / F.lit(ARITY**height_of_block)).cast("long")
    return nodes.withColumn("_block", block).groupBy(group, "_block").applyInArrow(one, schema)


def _grow(nodes: DataFrame, group: str, label: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """Trees over placed nodes: the nodes, each with its whole _witness, and (group, _root)."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    carried = [c for c in nodes.columns if c not in (group, "_place", "_n", "_node")]
    rounds = [materialize(_append_blocks(nodes, group, 0, levels), f"{label}-0")]
    while height(most) > len(rounds) * levels:
        roots = rounds[-1].where(F.col("_place") % ARITY**levels == 0).select(group, F.col("_block").alias("_place"), "_n", F.col("_root").alias("_node"))
        rounds.append(materialize(_append_blocks(roots, group, len(rounds), levels), f"{label}-{len(rounds)}"))
    upper = None  # of a block of the round below: the rest of its witness
    for r in reversed(range(1, len(rounds))):
        upper = _extended(rounds[r], upper, group).select(F.col(group).alias("_group"), F.col("_place").alias("_of"), F.col("_witness").alias("_rest"))
    whole = _extended(rounds[0], upper, group).select(group, "_node", "_witness", *carried)
    tops = rounds[-1].where("_place = 0").select(group, "_root")
    return whole, tops


def _extended(nodes: DataFrame, upper: DataFrame | None, group: str) -> DataFrame:
    if upper is None:
        return nodes
    both = nodes.join(upper, (nodes["_block"] == upper["_of"]) & nodes[group].eqNullSafe(upper["_group"]))
    return both.withColumn("_witness", F.concat("_witness", "_rest")).drop("_of", "_group", "_rest")


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, leaf, lambda d, w: F.sha2(F.concat(w["left"], d, w["right"]), 256))


def manifest(
    df: DataFrame, key: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, carry: dict[str, Column] | None = None, levels: int = LEVELS
) -> DataFrame:
    """key, source, leaf, witness, subroot and root for each row of df, and what `carry` names. levels: of a block."""
    carry = carry or {}
    kept = {f"_c{i}": c for i, c in enumerate(carry.values())}
    leaves = df.select(df[key].alias("_key"), df[source].alias("_source"), digest_of([df[f] for f in fields]).alias("_node"), *[c.alias(k) for k, c in kept.items()])
    placed = _places(leaves, "_source", ["_key", "_node"], "leaves")
    rows, subroots = _grow(placed, "_source", "trees", levels)
    sources = subroots.select(F.col("_source").alias("_name"), F.col("_root").alias("_node"), F.lit(0).alias("_all"))
    tops, root = _grow(_places(sources, "_all", ["_name"], "sources"), "_all", "top", levels)
    tops = tops.join(root, "_all").select("_name", F.col("_node").alias("_subroot"), F.col("_witness").alias("_rest"), "_root")
    both = rows.join(tops, rows["_source"].eqNullSafe(tops["_name"]))
    out = [F.col("_key").alias(key), F.col("_source").alias(source), F.col("_node").alias("leaf"), F.concat("_witness", "_rest").alias("witness")]
    return both.select(*out, F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), *[F.col(k).alias(name) for k, name in zip(kept, carry, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    """Every row's digests, and whether its witness holds for its text after half of the rows were tampered with."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    text = docs["text"]
    changed = F.when(hit & F.contains(text, F.lit("\n")), digest_of([*[docs[f] for f in FIELDS[:-1]], F.replace(text, F.lit("\n"), F.lit(""))]))
    rows = manifest(docs, carry={"tampered": changed})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("witness"))
    proof = F.sha2(F.array_join(F.transform("witness", lambda w: F.concat(w["left"], w["right"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC_ODD = """list_reduce([4294967295] || [unicode(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')], lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) & 1"""
_LEAF = """sha256(concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id::VARCHAR, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
    coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars::VARCHAR, '-'),
    coalesce(octet_length(encode({text})) || ':' || {text}, '-')))"""
#: The crc32 is the complement of what the list gives, so it is even where that is odd.
SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
           CASE WHEN {_CRC_ODD} = 1 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS given
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves
), levels AS (
    SELECT source, 0 AS lvl, place, n, leaf AS node FROM placed
    UNION ALL
    SELECT source, lvl + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM levels WHERE n > 1 GROUP BY source, lvl, place // 3
), subroots AS (
    SELECT source, node, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM levels WHERE n = 1
), tops AS (
    SELECT 0 AS lvl, place, n, node FROM subroots
    UNION ALL
    SELECT lvl + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY lvl, place // 3
), root AS (SELECT node AS root FROM tops WHERE n = 1),
steps AS (
    SELECT p.doc_id, p.leaf, p.given, l.lvl, p.place AS leaf_place, p.source,
           string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < l.place) AS left_ones, string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > l.place) AS right_ones
    FROM placed p JOIN levels l ON l.source IS NOT DISTINCT FROM p.source AND l.n > 1 AND l.place = p.place // (3 ** l.lvl)::BIGINT
    JOIN levels s ON s.source IS NOT DISTINCT FROM p.source AND s.lvl = l.lvl AND s.place // 3 = l.place // 3
    GROUP BY ALL
    HAVING count(*) > 0
), inner_lists AS (
    SELECT source, leaf_place, list({{'a': coalesce(left_ones, ''), 'b': coalesce(right_ones, '')}} ORDER BY lvl) AS w
    FROM steps GROUP BY source, leaf_place
), top_steps AS (
    SELECT p.source, l.lvl, string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < l.place) AS left_ones, string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > l.place) AS right_ones
    FROM subroots p JOIN tops l ON l.n > 1 AND l.place = p.place // (3 ** l.lvl)::BIGINT JOIN tops s ON s.lvl = l.lvl AND s.place // 3 = l.place // 3
    GROUP BY p.source, l.lvl, l.place
), top_lists AS (
    SELECT source, list({{'a': coalesce(left_ones, ''), 'b': coalesce(right_ones, '')}} ORDER BY lvl) AS w FROM top_steps GROUP BY source
), whole AS (
    SELECT p.doc_id, p.leaf, p.given, u.node AS subroot, root.root, coalesce(i.w, []) || coalesce(t.w, []) AS w
    FROM placed p JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source CROSS JOIN root
    LEFT JOIN inner_lists i ON i.source IS NOT DISTINCT FROM p.source AND i.leaf_place = p.place
    LEFT JOIN top_lists t ON t.source IS NOT DISTINCT FROM p.source
), folded AS (
    SELECT *, list_reduce([{{'a': given, 'b': ''}}] || w, lambda d, s: {{'a': sha256(s.a || d.a || s.b), 'b': ''}}).a AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.a || s.b FOR s IN w], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
