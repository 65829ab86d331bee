"""Alignment beyond one group, the proof of its result, and errors that stay with their pair."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkdiff.compare import compare
from inkdiff.config import Config
from inkdiff.functions import kernels
from inkdiff.functions.kernels import assign
from inkdiff.functions.matching import sparse_assign
from inkdiff.operators import align, blocks, detect


def test_sparse_assignment_and_its_prices():
    random_ = np.random.default_rng(0)
    for _ in range(400):
        n, m = random_.integers(0, 9, 2)
        s = np.round(random_.random((n, m)), random_.integers(1, 4)) * (random_.random((n, m)) < random_.choice([0.3, 0.7, 1]))
        i, j = np.nonzero(s)
        partner, u, v = sparse_assign(n, m, i, j, s[i, j])
        taken = partner[partner >= 0]
        assert len(set(taken.tolist())) == len(taken)
        total = sum(s[a, b] for a, b in enumerate(partner) if b >= 0)
        assert total == pytest.approx(sum(s[a, b] for a, b in assign(s)))
        assert (u >= 0).all() and (v >= 0).all() and u.sum() + v.sum() == pytest.approx(total)
        assert ((u[:, None] + v[None, :] - s)[i, j] > -1e-9).all()


def test_many_equal_scores_are_assigned():
    n = 600
    random_ = np.random.default_rng(1)
    i, j = np.repeat(np.arange(n), 10), random_.integers(0, n, 10 * n)
    partner, u, v = sparse_assign(n, n, i, j, np.full(len(i), 0.5))
    assert u.sum() + v.sum() == pytest.approx(0.5 * (partner >= 0).sum()) and (partner >= 0).mean() > 0.99


def corpus(seed, n, m):
    r = random.Random(seed)
    words = "fee leave staff shall must may not notice data term lot item buyer supplier ship order pay month".split()
    heads = ["", "1. Scope", "2. Fees and terms", "2.1 Fees", "3. Leave", "Terms and fees", "9. " + "very long heading of many words " * 3]
    text = lambda: " ".join(r.choices(words, k=r.randint(0, 9)))
    return [("p%d" % seed, s, k, r.choice(heads), text()) for s, size in (("a", n), ("b", m)) for k in range(size)]


CLAUSES = "pair_id string, side string, ordinal int, heading string, text string"


def test_blocks_give_the_best_total(spark):
    """Tiny blocks and two partners a clause: prices must call for the scores that were left out."""
    rows = [r for seed, (n, m) in enumerate([(23, 31), (40, 12), (1, 5), (7, 0), (15, 15)]) for r in corpus(seed, n, m)]
    clauses = spark.createDataFrame(rows, CLAUSES)
    for score, names in (("match_score", align.SCORES), ("tfidf_score", ("tfidf_score",))):
        one = align.best_assignment(clauses, score=score)
        many = blocks.best_of_blocks(clauses, Config(), score, names, block=6, keep=2)
        total = lambda df: {r["pair_id"]: (r["n"], round(r["s"], 9), r["c"]) for r in df.groupBy("pair_id").agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.countDistinct("a_ordinal").alias("c")).collect()}
        assert total(many) == total(one) and not many.where("error is not null").count()
    reach = lambda df: {(r["pair_id"], r["a_ordinal"]): r["candidates"] for r in df.collect()}
    small, large = reach(align.best_assignment(clauses)), reach(blocks.best_of_blocks(clauses, Config(), block=6))
    assert all(large[k] == small[k] for k in small.keys() & large.keys())


def test_scores_in_blocks_are_the_same(spark):
    clauses = spark.createDataFrame(corpus(5, 13, 9), CLAUSES)
    as_set = lambda df: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}
    config = Config(max_terms=12)

    def solve(a, b):
        found = align.scores(a, b, config)
        return align.picked(a, b, found, *np.divmod(np.arange(len(a) * len(b)), len(b)))

    fields = "a_ordinal int, b_ordinal int, " + ", ".join(f"{s} double" for s in align.SCORES)
    split = blocks.in_blocks(blocks.features(clauses, config), solve, fields, block=4)
    assert as_set(split.drop("error")) == as_set(align.score_pairs(clauses, config)) and split.count() == 117


def test_sparse_scores_with_a_small_vocabulary():
    """Sparse products equal dense ones, whatever the cap of terms and the products held at a time."""
    r = random.Random(2)
    texts = [[r.choice("ab bc cd de ef fg gh".split()) for _ in range(r.randint(0, 12))] for _ in range(30)]
    for cap in (3, 10, 5000):
        rows = kernels.tfidf_rows(texts, cap)
        dense = np.zeros((30, int(rows.terms.max()) + 1))
        dense[np.repeat(np.arange(30), np.diff(rows.starts)), rows.terms] = rows.weights
        assert len(set(rows.terms.tolist())) <= cap
        found = kernels.sparse_product(rows.part(0, 18), rows.part(18, 30), most=40)
        assert np.allclose(found, np.clip(dense[:18] @ dense[18:].T, 0, 1), atol=1e-12)


def document(name, *sections):
    return [(name, name.upper(), "v", 1, "\n".join(f"{k}. Part {k}\n{text}" for k, text in enumerate(sections, 1)))]


def test_a_failing_pair_leaves_the_others(spark):
    """One pair breaks in alignment, one in detection, one has no document; the rest are whole."""
    same = "This policy applies to all members of staff."
    pages = [
        *document("a1", same, "Fees are due each month at the office.", "third part of the first document, long enough"),
        *document("b1", same),
        *document("a2", same, "The words of boom are changed a little here."),
        *document("b2", same, "The words of boom were changed a bit here."),
        *document("a3", same, "Fees are due each month at the office."),
        *document("b3", same, "Fees are due each month at our office."),
    ]
    frame = spark.createDataFrame(pages, "document_id string, document_name string, version string, page_number int, original_text string")
    pairs = spark.createDataFrame([("p1", "a1", "b1"), ("p2", "a2", "b2"), ("p3", "a3", "b3"), ("p4", "a3", "gone")], "pair_id string, document_id_a string, document_id_b string")

    def solver(scores):
        if scores.shape == (3, 1):
            raise ArithmeticError("no alignment today")
        return assign(scores)

    def ratio(old, new):
        if "boom" in old:
            raise ValueError("boom")
        return difflib.SequenceMatcher(None, old, new).ratio()

    out = compare(frame, pairs, solver=solver, ratio=ratio)
    status = {r["pair_id"]: (r["processing_complete"], r["errors"]) for r in out["status"].collect()}
    late = "ArithmeticError: no alignment today"
    assert status == {
        "p1": (False, [f"Stage 4 — baseline matching failed: {late}", f"Stage 4 — hybrid matching failed: {late}"]),
        "p2": (False, ["Stage 5 — change detection failed: ValueError: boom"]),
        "p3": (True, []),
        "p4": (False, ["Stage 1 — document B not found: gone"]),
    }
    assert {r["pair_id"] for r in out["matches"].collect()} == {"p2", "p3", "p4"} == {r["pair_id"] for r in out["baseline"].collect()}
    kinds = {}
    for r in out["rows"].collect():
        kinds.setdefault(r["pair_id"], []).append(r["change_type"])
    assert {k: sorted(v) for k, v in kinds.items()} == {"p3": ["unchanged", "wording_only"], "p4": ["removed", "removed"]}
    stats = {r["pair_id"]: (r["total_changes"], r["total_clauses_a"], r["total_clauses_b"]) for r in out["stats"].collect()}
    assert stats == {"p1": (0, 3, 1), "p2": (0, 2, 2), "p3": (2, 2, 2), "p4": (2, 2, 0)}
    out.release()
    with pytest.raises(Exception, match="pair p1: ArithmeticError"):
        align.or_raise(align.best_assignment(out["clauses"], solver=solver)).collect()


def test_ratio_only_where_it_tells(spark):
    r = random.Random(9)
    words = "must may pay 5 6 days of order and the buyer ships goods quite soon xyz".split()
    rows = []
    for _ in range(150):
        a = r.choices(words, k=r.randint(1, 30))
        b = list(a) if r.random() < 0.6 else r.choices(words, k=r.randint(1, 30))
        if r.random() < 0.7:
            b[r.randrange(len(b))] = r.choice(words)
        rows.append((" ".join(a), " ".join(b), "hybrid", False, ""))
    frame = spark.createDataFrame(rows, "text_a string, text_b string, match_type string, needs_review boolean, review_reason string")
    told = detect.detect_changes(frame).withColumn("by", detect.settled_by(F.col("text_a"), F.col("text_b"))).withColumn("bound", detect.ratio_bound(F.col("text_a"), F.col("text_b"))).collect()
    assert {x["by"] for x in told} == {"equal", "signals", "bound", "ratio"}
    for x in told:
        want = difflib.SequenceMatcher(None, x["text_a"], x["text_b"]).ratio()
        assert x["bound"] >= want - 1e-12
        assert x["ratio"] == (None if x["by"] == "signals" else want) and (x["by"] == "signals") == (x["change_type"] == "substantive")
        band = "unchanged" if want >= 0.98 else "wording_only" if want >= 0.6 else "uncertain"
        assert x["change_type"] == ("substantive" if x["by"] == "signals" else band)
