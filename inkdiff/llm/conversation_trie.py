"""Prefixes that conversations share, by double-array tries over shards of their sorted turn sequences.

A turn is a token of 20 bytes: a digest of its role and text, and the text's length. A conversation is the tokens of its
turns in one binary, so that the byte order of these is the order of a depth-first walk; texts are never shuffled. Equal
conversations are counted first (partial aggregates); what is left is distinct and is dealt by ranges of that order. A
partition is cut into shards of TURNS turns, whatever its size, so a first turn that a third of all conversations share is
many shards. Each shard is one group: its turns get dense ids, its nodes are packed into BASE and CHECK arrays
(`DoubleArray`), and its sequences are walked through them for the nodes' numbers.

A node stands in two shards only if their border runs through it: the last sequence of the one and the first of the other
begin with it. Shards learn from their neighbours' borders how deep these upper nodes go; a node, a child and a leaf are
counted by the first shard that has them, so that the parts of upper nodes are added up globally. All other nodes are
final within their shard. Bounds: a shard is TURNS turns, or one conversation that is longer by itself; the 20 bytes a
turn of one conversation are one row.

Order: by turn, null first; rows that repeat a turn number are ordered by their token. Null roles and texts count as
empty, rows without a conversation id take no part, other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize, table

TURNS = 1 << 17
WIDTH, DIGEST = 20, 16  # bytes of a token, and of its digest
NEAR = 128  # slots that are tried for a node with several children
CHUNK = 4096  # ids that are joined into one piece of a list of ids
#: Nodes of a shard. key and parent_key stand at upper nodes and their children, upper only at upper nodes.
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "upper boolean, key binary, parent_key binary"
)
_NODE = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("upper", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary())]
)


class DoubleArray:
    """A trie in two arrays: the child of the node in slot s by id i is in slot base[s] + i, if check[that slot] == s.

    Built from nodes in depth-first order: parent[k] is a node before k (the root is node 0), label[k] the id that leads to
    it. Nodes with most children are placed first, where a free slot fits all of them; only children fill what is left.
    """

    def __init__(self, parent: np.ndarray, label: np.ndarray, ids: int) -> None:
        n = len(parent)
        children = np.bincount(parent[1:], minlength=n)
        order = np.argsort(parent[1:], kind="stable") + 1
        starts = np.concatenate(([0], np.cumsum(children)))
        size = n + ids + 2
        used, base_of = np.zeros(size, bool), np.zeros(n, np.int64)
        used[0] = True  # the root
        lowest, end = 1, 1  # below lowest all is used; from end on all is free
        for node in np.flatnonzero(children > 1)[np.argsort(-children[children > 1], kind="stable")]:
            own = np.sort(label[order[starts[node] : starts[node + 1]]])
            base = max(0, end - int(own[0]))
            for slot in np.flatnonzero(~used[lowest : min(end, lowest + NEAR)]) + lowest:  # else after all others
                at = slot - own[0]
                if at >= 0 and not used[own[own + at < len(used)] + at].any():
                    base = int(at)
                    break
            if base + int(own[-1]) >= len(used):
                used = np.concatenate((used, np.zeros(len(used) + int(own[-1]), bool)))
            used[base + own] = True
            base_of[node], end = base, max(end, base + int(own[-1]) + 1)
            while lowest < len(used) and used[lowest]:
                lowest += 1
        single = np.flatnonzero(children == 1)
        labels = label[order[starts[single]]]
        # slots from the number of ids on can take any only child, as base is never below 0
        free = np.concatenate((np.flatnonzero(~used[ids:]) + ids, np.arange(len(single)) + max(len(used), ids)))[: len(single)]
        base_of[single] = free - labels
        slot = np.zeros(n, np.int64)
        slot[1:] = base_of[parent[1:]] + label[1:]
        self.slot = slot
        self.base = np.zeros(int(max(slot.max(initial=0), len(used))) + 1, np.int64)
        self.check = np.full(len(self.base), -1, np.int64)
        self.base[slot] = base_of
        self.check[slot[1:]] = slot[parent[1:]]

    def step(self, slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of nodes by ids; -1 where there is none."""
        to = self.base[slots] + ids
        ok = (to < len(self.check)) & (to >= 0)
        return np.where(ok & (self.check[np.where(ok, to, 0)] == slots), to, -1)


def shared_depth(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences begin with alike; -1 without one of them."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(s, np.uint8, n * WIDTH).reshape(n, WIDTH) for s in (a, b))
    differ = (x != y).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def shard_nodes(blobs: list[bytes], convs: np.ndarray, weights: np.ndarray, ends: list[str], up: int, down: int) -> pa.Table:
    """The nodes of a shard of sorted distinct sequences.

    up, down: turns that its first and last sequence share with the ones next to them in other shards; -1 without such.
    """
    lengths = np.array([len(b) // WIDTH for b in blobs], np.int64)
    tokens = np.frombuffer(b"".join(blobs), np.dtype((np.void, WIDTH)))
    if len(tokens):
        known, ids = np.unique(tokens, return_inverse=True)
        size_of = np.frombuffer(known.tobytes(), np.uint8).reshape(-1, WIDTH)[:, DIGEST:].copy().view(">u4").ravel().astype(np.int64)
    else:
        known, ids, size_of = tokens, np.zeros(0, np.int64), np.zeros(0, np.int64)
    offset = np.concatenate(([0], np.cumsum(lengths)))

    # Logical nodes: each sequence adds those below what it shares with the one before it.
    parent, label, depth = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    path, count = np.zeros(1, np.int64), 1
    last = np.zeros(0, np.int64)
    for i in range(len(blobs)):
        own = ids[offset[i] : offset[i + 1]]
        m = min(len(own), len(last))
        differ = own[:m] != last[:m]
        lcp = int(differ.argmax()) if differ.any() else m
        new = np.arange(count, count + len(own) - lcp)
        path = np.concatenate((path[: lcp + 1], new))
        parent.append(path[lcp:-1])
        label.append(own[lcp:])
        depth.append(np.arange(lcp + 1, len(own) + 1))
        count, last = count + len(new), own
        if i == 0:
            first_path = path
    last_path = path
    parent, label, depth = (np.concatenate(x) for x in (parent, label, depth))

    trie = DoubleArray(parent, label, max(1, len(known)))
    slots = len(trie.base)
    n_convs, n_len = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    least = np.full(slots, np.iinfo(np.int64).max)
    end_of = np.zeros(len(blobs), np.int64)
    node_len = np.zeros(slots, np.int64)
    # Walk all sequences down together, level by level; left: the length of what each has from its node's own turn on.
    left = np.array([size_of[ids[offset[i] : offset[i + 1]]].sum() for i in range(len(blobs))], np.int64)
    at, alive = np.zeros(len(blobs), np.int64), np.arange(len(blobs))
    for d in range(int(lengths.max(initial=0)) + 1):
        s = at[alive]
        np.add.at(n_convs, s, weights[alive])
        np.minimum.at(least, s, convs[alive])
        own = size_of[ids[offset[alive] + d - 1]] if d else np.zeros(len(alive), np.int64)
        node_len[s] = own
        np.add.at(n_len, s, weights[alive] * left[alive])
        left[alive] -= own if d else 0
        done = lengths[alive] == d
        end_of[alive[done]] = s[done]
        alive = alive[~done]
        at[alive] = trie.step(at[alive], ids[offset[alive] + d])
    slot = trie.slot
    counted = np.ones(count, bool)
    counted[first_path[: up + 1]] = False  # by an earlier shard
    leaf = np.bincount(parent[1:], minlength=count) == 0
    if down == len(last):
        leaf[last_path[-1]] = False  # it goes on in a later shard
    n_children = np.bincount(parent[1:], weights=counted[1:], minlength=count).astype(np.int64)
    n_leaves, distinct = (leaf & counted).astype(np.int64), np.where(counted, node_len[slot], 0)
    for k in range(count - 1, 0, -1):  # depth-first order: parents come before their children
        n_leaves[parent[k]] += n_leaves[k]
        distinct[parent[k]] += distinct[k]

    upper = np.zeros(count, bool)
    upper[first_path[: up + 1]] = True
    upper[last_path[: down + 1]] = True
    upper[0] = True
    key: list[bytes | None] = [None] * count
    for nodes, blob in ((first_path, blobs[0]), (last_path, blobs[-1])):
        running = hashlib.sha256()
        for d, k in enumerate(nodes):
            running.update(blob[(d - 1) * WIDTH : d * WIDTH] if d else b"")
            if not upper[k]:
                break
            key[k] = running.copy().digest()[:DIGEST]
    sha: list[str | None] = [None] * count
    node_at = dict(zip(slot.tolist(), range(count), strict=True))
    for i, s in enumerate(end_of.tolist()):
        sha[node_at[s]] = ends[i]
    conv = least[slot]
    under = upper[parent]  # the parent's least conversation is known only after the parts are merged
    parents = pa.array(conv[parent], mask=under)
    parent_key = [key[p] if k and under[k] else None for k, p in enumerate(parent.tolist())]
    saved = n_len[slot] - distinct
    columns = [conv, depth, parents, n_convs[slot], n_children, n_leaves, saved, sha, upper, key, parent_key]
    return pa.Table.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _NODE, strict=True)], schema=_NODE)


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, blob): each conversation with the first turns of the one that its hundred begins with; see `query`."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    token = F.concat(digest, F.lpad(F.hex(F.length(text).cast("long")), 2 * (WIDTH - DIGEST), "0"))
    giver = (F.col("conv_id") - F.col("conv_id") % 100).alias("_giver")
    rows = turns.where("conv_id is not null").select("conv_id", giver, F.struct("turn", token.alias("token")).alias("_turn"))
    # Dealt by the giver, each conversation and the one that gives it turns are in one partition.
    convs = rows.repartition("_giver").groupBy("_giver", "conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    convs = convs.select("_giver", "conv_id", F.col("_turns.token").alias("_own"))
    given = F.expr("max(case when conv_id = _giver then slice(_own, 1, 5) end) over (partition by _giver)")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    convs = convs.select("conv_id", "_own", given.alias("_given"), h.alias("_h"))
    start = F.coalesce(F.slice("_given", F.lit(1), F.col("_h")), F.array().cast("array<string>"))
    whole = F.concat(start, F.slice("_own", F.col("_h") + 1, F.size("_own")))
    return convs.select("conv_id", F.unhex(F.array_join(whole, "")).alias("blob"))


def _id_lists(rows: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of each key's ids, ascending, comma-joined. rows(key, conv_id). Lists of any length are streamed."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [key], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for k, c in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if k != key or len(ids) == CHUNK:
                    if ids:
                        yield out()
                    key, ids = k, []
                ids.append(c)
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if k != key:
                    if running:
                        yield pa.RecordBatch.from_pydict({"key": [key], "ends": [running.hexdigest()]})
                    key, running = k, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
        if running:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends": [running.hexdigest()]})

    lists = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key string, first long, ids string")
    return lists.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key string, ends string")


def _distinct(convs: DataFrame) -> DataFrame:
    """(blob, conv_id, n, ends): each distinct sequence with its least conversation and their number."""
    counted = convs.groupBy("blob").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).withColumn("key", F.sha2("blob", 256))
    counted = materialize(counted, "sequences")
    often = counted.where("n > 1").select("blob", "key")
    lists = _id_lists(convs.join(often, "blob").select("key", "conv_id"))
    found = counted.join(lists, "key", "left")
    ends = F.coalesce("ends", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
    out = materialize(found.select("blob", "conv_id", "n", ends.alias("ends")), "distinct")
    discard(counted)
    return out


def _shards(sequences: DataFrame, turns: int) -> DataFrame:
    """sequences with _part and _shard: sorted, dealt by ranges, and cut after so many turns."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = 0, 0
        for batch in batches:
            out = []
            for size in pc.binary_length(batch["blob"]).to_pylist():
                if held and held + size // WIDTH + 1 > turns:
                    shard, held = shard + 1, 0
                held += size // WIDTH + 1
                out.append(shard)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "_shard"])

    dealt = sequences.repartitionByRange("blob").sortWithinPartitions("blob").withColumn("_part", F.spark_partition_id())
    return dealt.mapInArrow(cut, "blob binary, conv_id long, n long, ends string, _part int, _shard long")


def prefix_nodes(convs: DataFrame, turns: int = TURNS) -> DataFrame:
    """A row for each distinct prefix of the sequences in convs(conv_id, blob); columns as `query` names them."""
    convs = materialize(convs, "convs")
    sequences = _distinct(convs)
    sharded = materialize(_shards(sequences, turns), "shards")
    discard(convs, sequences)
    borders = sharded.groupBy("_part", "_shard").agg(F.min("blob").alias("_first"), F.max("blob").alias("_last"))
    # The first and last shard of each partition meet those of the partitions next to it that have rows.
    in_part = "over (partition by _part order by _shard)"
    borders = borders.selectExpr("*", f"lag(_last) {in_part} as _before", f"lead(_first) {in_part} as _after")
    parts = borders.groupBy("_part").agg(F.min("_first").alias("_f"), F.max("_last").alias("_l"))
    parts = parts.selectExpr("_part", "lag(_l) over (order by _part) as _pl", "lead(_f) over (order by _part) as _nf")
    borders = borders.join(parts, "_part").withColumns({"_before": F.coalesce("_before", "_pl"), "_after": F.coalesce("_after", "_nf")})

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, first, last, after = (b[c].to_pylist() for c in ("_before", "_first", "_last", "_after"))
            up, down = (pa.array(map(shared_depth, *x), pa.int64()) for x in ((before, first), (last, after)))
            yield pa.RecordBatch.from_arrays([b["_part"], b["_shard"], up, down], ["_part", "_shard", "_up", "_down"])

    borders = borders.select("_part", "_shard", "_before", "_first", "_last", "_after").mapInArrow(depths, "_part int, _shard long, _up long, _down long")

    def one(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("blob")
        weights, ids = shard["n"].to_numpy(), shard["conv_id"].to_numpy()
        return shard_nodes(shard["blob"].to_pylist(), ids, weights, shard["ends"].to_pylist(), shard["_up"][0].as_py(), shard["_down"][0].as_py())

    nodes = materialize(sharded.join(borders, ["_part", "_shard"]).groupBy("_part", "_shard").applyInArrow(one, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    rest = [F.first(c, ignorenulls=True).alias(c) for c in ("depth", "ends_sha256", "parent_key")]
    merged = nodes.where("upper").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *rest)
    merged = materialize(merged, "upper")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = nodes.where("not upper and parent_key is not null").select(*[c for c in columns if c != "parent_conv_id"], "parent_key")
    under = top.unionByName(merged.drop("key")).where("parent_key is not null")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    root = merged.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = nodes.where("not upper and parent_key is null").select(columns).union(root.select(columns)).union(under.join(parents, "parent_key").select(columns))
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))


def query(spark, sf_dir: str) -> DataFrame:
    """Each conversation c takes its first crc32(c) % 6 turns from conversation c - c % 100; then the nodes of all."""
    return prefix_nodes(rebuilt(table(spark, sf_dir, "conversations")))


_CRC = """4294967295 - list_reduce([4294967295] || [unicode(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')], lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""
SQL = f"""
WITH own AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (SELECT *, ({_CRC}) % 6 AS h, conv_id - conv_id % 100 AS giver FROM own),
whole AS (
    SELECT o.conv_id, coalesce(g.turns[1:o.h], []) || o.turns[o.h + 1:] AS turns FROM hashed o LEFT JOIN own g ON g.conv_id = o.giver
), members AS (
    SELECT conv_id, len(turns) AS size, d AS depth, turns[1:d] AS prefix FROM whole, unnest(range(len(turns) + 1)) AS u(d)
), nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(prefix[-1].t), 0) AS own,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
    FROM members GROUP BY prefix, depth
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
), below AS (
    SELECT x.prefix[1:d] AS prefix, d AS depth, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.own) AS saved_tokens
    FROM linked x, unnest(range(x.depth + 1)) AS u(d) GROUP BY ALL
)
SELECT conv_id, l.depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked l JOIN below b ON b.depth = l.depth AND b.prefix = l.prefix
"""
