"""Plans that must hold for many rows, and that what they do at once is what was done one by one."""

import random
import re

import pyarrow as pa
import pytest

from inkdiff.config import Config
from inkdiff.functions.kernels import assign
from inkdiff.operators import align, evaluate
from inkdiff.schemas import LABELLED_PAIRS


def test_terms_are_not_broadcast(spark, tmp_path):
    rows = [("p", s, k, "", "red dog runs") for s in "ab" for k in range(3)]
    spark.createDataFrame(rows, "pair_id string, side string, ordinal int, heading string, text string").write.parquet(f"{tmp_path}/clauses")
    table = spark.read.parquet(f"{tmp_path}/clauses")
    plan = align.tfidf_terms(table)._jdf.queryExecution().executedPlan().toString()
    by_term = [line for line in plan.splitlines() if re.search(r"Join .*term#", line)]
    assert by_term and not any("Broadcast" in line for line in by_term)


def lone_pairs(spark, path, bad, n=300):
    """Labelled pairs and others, some with headings, vectors, no words, a lone side, a third clause, no name, or bad vectors."""
    random_, words = random.Random(5), ["red", "dog", "Shall", "pay", "5", "été", "a", "12.5", "x_y"]
    text = lambda: " ".join(random_.choice(words) for _ in range(random_.choice((0, 1, 3, 8, 40))))
    rows = []
    for k in range(n):
        name, same = (None if k == 7 else f"p{k:03}"), text()
        heading, vector = (lambda: "") if k % 3 else (lambda: random_.choice(("1. Pay", "1.2 Pay day", "2 Leave"))), (lambda: None) if k % 4 else (lambda: [random_.random(), 1.0])
        for side in "a" if k % 50 == 1 else "b" if k % 50 == 2 else "aab" if k % 10 == 4 else "ab":
            rows.append((name, side, len(rows), heading(), same if k % 5 == 0 else text(), [1.0] * (1 + (side == "b")) if bad and k == 20 else vector()))
    random_.shuffle(rows)
    spark.createDataFrame(rows, "pair_id string, side string, ordinal int, heading string, text string, embedding array<double>").write.parquet(f"{path}/clauses")
    return spark.read.parquet(f"{path}/clauses")


@pytest.mark.parametrize("bad", [False, True])
def test_lone_pairs_are_scored_together_to_the_bit(spark, tmp_path, bad):
    table = lone_pairs(spark, tmp_path, bad)
    for score in ("match_score", "tfidf_score"):
        for config in (Config(), Config(max_terms=9)):
            told = [{tuple(r) for r in align.best_assignment(table, config, score, solver).collect()} for solver in (assign, lambda s: assign(s))]
            assert told[0] == told[1] and len(told[0]) > 280
            assert sum(r[-1] is not None for r in told[0]) == (bad and score == "match_score")  # the pair whose vectors differ in length


def test_whole_pairs_of_any_batches():
    keys = [None, None, "a", "b", "b", "b", "b", "c", "d", "d"]
    for cut in range(1, 6):
        batches = [pa.RecordBatch.from_pydict({"pair_id": pa.array(keys[k : k + cut], pa.string())}) for k in range(0, len(keys), cut)]
        tables = [t["pair_id"].to_pylist() for t in align.whole_pairs(iter([batches[0][:0], *batches]))]
        assert sum(tables, []) == keys and sum(len(set(t)) for t in tables) == 5
        assert all(len(t) <= cut + 4 for t in tables)


def test_labelled_pairs_are_no_group_each(spark, tmp_path):
    spark.createDataFrame([("p", "s", "red dog", "red cat", True, "substantive", "")], LABELLED_PAIRS).write.parquet(f"{tmp_path}/pairs")
    plan = evaluate.evaluate_pairs(spark.read.parquet(f"{tmp_path}/pairs"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
