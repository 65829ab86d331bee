"""The Merkle manifest, the conversation trie and the nearest neighbours, by brute force on odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from inkdiff.llm import conversation_trie, merkle_manifest, nearest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, _node string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def grow(nodes):
    """All levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = grow([leaf_of(r) for r in by_source[s]])
    top = grow([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            tampered = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            leaf, given, siblings = leaf_of(r), leaf_of((*r[:4], r[4].replace("\n", ""))) if tampered else leaf_of(r), []
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    left, right = level[at // 3 * 3 : at], level[at + 1 : at // 3 * 3 + 3]
                    siblings += left + right
                    given, at = H(*left, given, *right), at // 3
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], H(*siblings), given, given == top[-1][0]))
    return sorted(out, key=repr)


def documents(n, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["hot", "hot", "hot", None, "", "é", "z", "Z"]), r.choice([None, "en"]), r.choice([None, i]), r.choice([None, "", "a\nb\n", "long " * 3000, "ü\n" * i]), "x") for i in range(n)]
    return rows + rows[:3] + [(None, "hot", None, None, "a\n", "y"), (None, "hot", None, None, None, "y"), (rows[0][0], rows[0][1], "other", 1, "again", "y"), (-5, "alone", "en", 3, "\n", "y")]


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def test_manifest_by_brute_force(spark, tmp_path):
    rows = documents(90, 1)
    written(spark, tmp_path, "documents", rows, DOCS)
    found = merkle_manifest.query(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_manifest(rows)
    verified = {r.doc_id: r.verified for r in found.collect()}
    assert not verified[-5] if zlib.crc32(b"-5") % 2 == 0 else verified[-5]


def test_manifest_in_rounds_of_small_blocks(spark):
    """Blocks of nine leaves: the witness of a row goes on through blocks of blocks."""
    rows = documents(300, 2)
    found = merkle_manifest.manifest(spark.createDataFrame(rows, DOCS), levels=2).collect()
    want = brute_manifest(rows)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, H(*(w.left + w.right for w in r.witness))) for r in found), key=repr) == sorted((w[:5] for w in want), key=repr)
    for r in found:
        node = r.leaf
        for w in r.witness:
            node = H(w.left, node, w.right)
        assert node == r.root


def test_manifest_of_an_empty_table_and_one_row(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).collect() == []
    row = (1, None, None, None, None, "x")
    (one,) = merkle_manifest.manifest(spark.createDataFrame([row], DOCS)).collect()
    assert one.leaf == one.subroot == one.root == leaf_of(row) and one.witness == []


def test_append_extends_open_witnesses():
    """A node's witness grows when its siblings complete its run, whatever the number of nodes."""
    for n in range(1, 40):
        nodes = [H(str(i)) for i in range(n)]
        levels = grow(nodes)
        root, witnesses = merkle_manifest.append_all(nodes, merkle_manifest.height(n))
        assert root == levels[-1][0] and len(witnesses) == n
        for i, w in enumerate(witnesses):
            assert "".join(a + b for a, b in w) == "".join("".join(x for k, x in enumerate(level[i // 3 ** (d + 1) * 3 : i // 3 ** (d + 1) * 3 + 3]) if k != i // 3**d % 3) for d, level in enumerate(levels[:-1]))


TURNS = "conv_id long, turn long, role string, text string, _turn string"


def brute_nodes(rows):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    for c, turns in own.items():
        own[c] = [(r[2] or "", r[3] or "") for r in sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0))]
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        ends = ",".join(str(c) for c in sorted(members) if whole[c] == p)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        n_children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), n_children, len(leaves), saved, H(ends)))
    return sorted(out, key=repr)


def conversations(n, seed):
    r = random.Random(seed)
    texts = ["", None, "ü", "hello", "x" * 5000, "a\nb"]
    rows = []
    for c in r.sample(range(-150, 400), n):
        for t in r.choice([range(r.randint(1, 9)), [None, 3, 7], range(2)]):
            rows.append((c, t, r.choice(["user", "user", None, ""]), r.choice(texts[: r.choice([2, 6])]), "z"))
    return rows + [(10**12, t, "user", "hello", "z") for t in range(70)] + [(None, 1, "user", "lost", "z")] + rows[:1] * 2


@pytest.mark.parametrize("turns", [1, 7, 60, 1 << 17])
def test_trie_by_brute_force(spark, tmp_path, turns):
    """The same nodes from shards of any size: from one sequence each to one shard for all."""
    rows = conversations(70, turns)
    rows = [r for i, r in enumerate(rows) if r not in rows[:i] or r[:2] == rows[0][:2]]
    found = conversation_trie.prefix_nodes(conversation_trie.rebuilt(spark.createDataFrame(rows, TURNS).repartition(3)), turns=turns)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_nodes(rows)


def test_trie_of_copies_and_of_nothing(spark):
    """A conversation that most others copy: its list of ids goes on over several pieces."""
    assert conversation_trie.prefix_nodes(conversation_trie.rebuilt(spark.createDataFrame([], TURNS))).collect() == []
    n = conversation_trie.CHUNK * 2 + 5
    convs = spark.range(n).selectExpr("id as conv_id", f"unhex(repeat('0', {2 * conversation_trie.WIDTH * 3})) as blob")
    found = sorted(conversation_trie.prefix_nodes(convs).collect(), key=lambda r: r.depth)
    assert [(r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in found] == [(0, n, 1, 1, 0)] * 3 + [(0, n, 0, 1, 0)]
    assert found[3].ends_sha256 == H(",".join(map(str, range(n)))) and found[0].ends_sha256 == H("")


def test_double_array_finds_its_nodes_only():
    r = random.Random(5)
    words = sorted({tuple(r.randrange(30) for _ in range(r.randint(1, 5))) for _ in range(400)})
    index, parent, label = {(): 0}, [0], [0]
    for w in words:
        for d in range(1, len(w) + 1):
            if w[:d] not in index:
                index[w[:d]] = len(parent)
                parent.append(index[w[: d - 1]])
                label.append(w[d - 1])
    trie = conversation_trie.DoubleArray(np.array(parent), np.array(label), 30)
    assert len(set(trie.slot.tolist())) == len(parent)
    for p, k in index.items():
        for i in range(30):
            to = trie.step(trie.slot[[k]], np.array([i]))[0]
            assert to == (trie.slot[index[(*p, i)]] if (*p, i) in index else -1)


VECTORS = "vec_id long, embedding array<double>, label string, _v string, rank int"


def brute_nearest(rows, asks, k=5):
    """Ties, to 13 decimals, go to the smaller id."""
    usable = sorted({(r[0], tuple(r[1])) for r in rows if r[0] is not None and r[1] and len(r[1]) == 3 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])})
    units = {v: np.array(v) / np.max(np.abs(v)) / np.linalg.norm(np.array(v) / np.max(np.abs(v))) for _, v in usable}
    out = {}
    for q, v in usable:
        if asks(q):
            near = sorted((-round(float(units[v] @ units[w]), 13), i) for i, w in usable if i != q)[:k]
            out[q, v] = [(rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return out


def test_nearest_on_odd_rows(spark):
    """Few rows: every leaf is visited, so the result is exact. Parallel vectors may differ in the last bit of their cosines."""
    r = random.Random(3)
    rows = [(i, [r.choice([-2.0, 0.0, 1.0, 3.0]) for _ in range(3)], "x", "y", 1) for i in range(60)]
    rows += [(i, [1.0, 1.0, 1.0], "x", "y", 1) for i in range(100, 130)] + rows[:2]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 1.0], [float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0], [1.0, 1.0]]
    rows += [(200 + i, v, None, None, None) for i, v in enumerate(odd)] + [(None, [1.0, 2.0, 3.0], "x", "y", 1), (300, [1e300, -1e300, 0.0], None, None, 1), (301, [1e-300, -1e-300, 7e-300], None, None, 1)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = {}
    for row in nearest.nearest(table, table["vec_id"] % 5 == 0, target=1.0).collect():
        found.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    want = brute_nearest(rows, lambda q: q % 5 == 0)
    want_all = {q: near for (q, _), near in brute_nearest(rows, lambda q: q % 5 == 0, k=999).items()}
    assert {q for q, _ in want} == set(found)
    for (q, _), near in want.items():
        got = sorted(found[q])
        assert [a for a, _, _ in got] == [a for a, _, _ in near] and [c for *_, c in got] == pytest.approx([c for *_, c in near], abs=1e-11)
        ids, units = {i for _, i, _ in got}, {i: c for _, i, c in want_all[q]}
        assert len(ids) == len(got) and all(units[i] == pytest.approx(c, abs=1e-11) for _, i, c in got)


def test_nearest_of_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    for rows in ([], [(1, [0.0], "", "", 0)], [(50, [1.0, 2.0], "", "", 0)]):
        table = make(rows)
        assert nearest.nearest(table, table["vec_id"] % 50 == 0).collect() == []
    table = make([(50, [1.0, 2.0], "", "", 0), (3, [2.0, 1.0], "", "", 0)])
    (one,) = nearest.nearest(table, table["vec_id"] % 50 == 0).collect()
    assert tuple(one) == (50, 1, 3, 0.8) or abs(one.score - 0.8) < 1e-12


def test_nearest_recall_with_a_dense_group(spark, monkeypatch):
    """Recall above 0.9, for queries of a dense group too, from a sample of an eighth of the rows."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8000, 24))
    x[::3] = x[0] + 0.05 * rng.standard_normal((len(x[::3]), 24))
    table = spark.createDataFrame([(i, v.tolist(), None, None, None) for i, v in enumerate(x)], VECTORS)
    found = {}
    for row in nearest.nearest(table, F.col("vec_id") % 50 == 0, sample=1000).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for own in (lambda q: q % 3 == 0, lambda q: q % 3):
        hits = [len(found[q] & set(np.argsort(-np.where(np.arange(8000) == q, -2, u @ u[q]))[:5])) / 5 for q in range(0, 8000, 50) if own(q)]
        assert np.mean(hits) >= 0.9


def test_one_queue_over_all_trees():
    """Leaves come nearest first, each once; the bound is the distance from the leaf's cell."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = nearest.fit(x, 3000, trees=3)
    seen = list(forest.queue(x[5]))
    assert [b for b, _, _ in seen] == sorted(b for b, _, _ in seen) and len({s[1:] for s in seen}) == len(seen) == 3 * 2**forest.depth
    leaves = forest.leaves(x)
    assert [leaf for b, t, leaf in sorted(seen[:3], key=lambda s: s[1])] == leaves[5].tolist()
    bound = {s[1:]: s[0] for s in seen}
    for i in range(0, 3000, 17):
        assert all(bound[t, leaves[i, t]] <= ((x[i] - x[5]) ** 2).sum() + 1e-9 for t in range(3))
