"""Alignment against brute force, plug-ins, fallbacks, errors of pages and documents, the evaluation record."""

import itertools
import json
import random
import time

import numpy as np
import pytest
from test_whole import brute_scores, common, parts

from inkdiff import compare
from inkdiff.config import Config
from inkdiff.corpus import clauses
from inkdiff.functions import kernels
from inkdiff.operators import align, evaluate, provenance, report
from inkdiff.plans import changes
from inkdiff.sources import pdf


def test_heading_matrix_by_brute_force():
    r = random.Random(1)
    words = ["".join(r.choices("abc .", k=r.randint(0, 12))) for _ in range(12)] + ["x" * 70, "ab" * 40, ""]
    found = kernels.heading_matrix(words, words[::-1])
    for i, a in enumerate(words):
        for j, b in enumerate(words[::-1]):
            assert found[i, j] == pytest.approx(2 * common(a, b) / (len(a) + len(b)) if a and b else 0.0)


def test_assignments_by_brute_force(spark):
    """Small document pairs of unlike sizes: no other one-to-one alignment has a greater total, and bands follow the score."""
    r = random.Random(2)
    vocabulary = ["fee", "leave", "staff", "library", "notice", "hostel", "exam", "appeal", "late", "month"]
    rows = []
    for p in range(20):
        for side, n in (("a", r.randint(1, 4)), ("b", r.randint(1, 4))):
            for k in range(n):
                heading = r.choice([f"{k + 1}. ", f"{k + 1}.{k} ", "Part "]) + " ".join(r.choices(vocabulary, k=2))
                rows.append((f"p{p}", side, k, heading, " ".join(r.choices(vocabulary, k=r.randint(1, 8)))))
    table = spark.createDataFrame(rows, "pair_id string, side string, ordinal int, heading string, text string")
    scores = {(x["pair_id"], x["a_ordinal"], x["b_ordinal"]): x for x in align.score_pairs(table).collect()}
    found = {name: match(table).collect() for name, match in align.MATCHERS.items()}
    for p in {row[0] for row in rows}:
        n, m = (sum(x[0] == p and x[1] == s for x in rows) for s in "ab")
        for name, column in (("baseline", "tfidf_score"), ("hybrid", "match_score")):
            value = lambda pairs: sum(scores[p, i, j][column] for i, j in pairs)  # noqa: B023, E731
            best = max(value(zip(range(n), q, strict=False) if n <= m else zip(q, range(m), strict=False)) for q in itertools.permutations(range(max(n, m)), min(n, m)))
            own = [x for x in found[name] if x["pair_id"] == p]
            both = [(x["a_ordinal"], x["b_ordinal"]) for x in own if x["a_ordinal"] is not None and x["b_ordinal"] is not None]
            assert sorted(i for i in (x["a_ordinal"] for x in own) if i is not None) == list(range(n))
            assert sorted(j for j in (x["b_ordinal"] for x in own) if j is not None) == list(range(m))
            if name == "baseline":
                assert len(both) == min(n, m) and value(both) == pytest.approx(best)
            else:
                assert all(scores[p, i, j]["match_score"] >= Config().review_threshold for i, j in both)
                kinds = {(x["a_ordinal"], x["b_ordinal"]): x["match_type"] for x in own}
                assert all(kinds[i, j] == ("hybrid" if scores[p, i, j]["match_score"] >= 0.5 else "needs_review") for i, j in both)
    assert {"needs_review", "added_candidate", "removed_candidate"} <= {x["match_type"] for x in found["hybrid"]}


def test_baseline_of_the_corpus(spark, tmp_path):
    folder = parts(spark, tmp_path, 40)
    scores = {(a, b): s[2] for (_, a, b), s in brute_scores(clauses(spark, folder).collect()).items()}
    found = [r for r in changes.baseline_match(spark, folder).collect() if r["match_type"] == "baseline"]
    matrix = np.zeros((40, 40))
    for (a, b), s in scores.items():
        matrix[a, b] = s
    best = sum(matrix[i, j] for i, j in kernels.assign(matrix))
    assert sum(scores[r["a_ordinal"], r["b_ordinal"]] for r in found) == pytest.approx(best)
    assert all(abs(r["match_score"] - scores[r["a_ordinal"], r["b_ordinal"]]) < 1e-5 for r in found)


def test_encoder_plug_in(spark):
    rows = [("p", "a", 0, "", "red"), ("p", "b", 0, "", "scarlet"), ("q", "a", 0, "", "bad"), ("q", "b", 0, "", "bad")]
    table = spark.createDataFrame(rows, "pair_id string, side string, ordinal int, heading string, text string").repartition(2, "pair_id")

    def encode(texts):
        if "bad" in texts:
            raise RuntimeError("no model")
        return [[1.0, 0.0] for _ in texts]

    got = {r["pair_id"]: (r["tfidf_score"], r["embedding_score"]) for r in align.score_pairs(align.embed_clauses(table.where("pair_id = 'p'").coalesce(1), encode).union(align.embed_clauses(table.where("pair_id = 'q'"), encode))).collect()}
    assert got["p"] == (0.0, pytest.approx(1.0)) and got["q"] == (pytest.approx(1.0), pytest.approx(1.0))


class Fake(report.Provider):
    def __init__(self, name, reply, available=True):
        self.name, self.reply, self.available = name, reply, available

    def is_available(self):
        if self.available is None:
            raise OSError("no key store")
        return self.available

    def generate(self, prompts, timeout):
        return [self.reply(p) for p in prompts]


def test_one_bad_clause_costs_no_other_its_summary():
    def fails_on_x(prompt):
        if prompt == "x":
            raise ValueError("x is bad")
        return f"A {prompt}"

    got = report.ask_providers(["x", "y"], (Fake("none", str, False), Fake("first", fails_on_x), Fake("second", lambda p: f"B {p}")), 5)
    assert [(r["reply"], r["name"], r["reason"]) for r in got] == [("B x", "second", "first failed: x is bad"), ("A y", "first", "none not available (no API key)")]
    slow = report.ask_providers(["x"], (Fake("slow", lambda p: time.sleep(1.5)),), 0.2)
    assert slow[0]["reply"] is None and slow[0]["reason"] == "slow failed: no reply after 0.2 s"
    assert report.ask_providers(["x"], (Fake("odd", str, None),), 1)[0] == {"reply": None, "name": None, "reason": "no key store", "failed": True}


def test_a_bad_page_leaves_the_others(spark, tmp_path):
    page = b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n%d 0 obj << %s >> stream\n%s\nendstream endobj\n"
    good = b"BT (1. Scope of the policy) Tj T* (It applies to all members of the staff from now on.) Tj ET"
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n" + page % (1, 2, 2, b"/Filter /FlateDecode", b"broken") + page % (3, 4, 4, b"", good))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\n" + page % (3, 4, 4, b"", good))
    (tmp_path / "c.pdf").write_bytes(b"nothing")
    read = pdf.read_pages(spark, str(tmp_path))
    rows = {(r["document_id"], r["page_number"]): (r["original_text"], list(r["errors"])) for r in read.collect()}
    assert rows["a", 1][0] == "" and rows["a", 1][1][0].startswith("Page 1: failed to extract text — ") and rows["a", 2] == rows["b", 1]
    pairs = spark.createDataFrame([("ab", "a", "b"), ("bc", "b", "c"), ("bd", "b", "d")], "pair_id string, document_id_a string, document_id_b string")
    status = {r["pair_id"]: r for r in compare(read, pairs)["status"].collect()}
    assert {p: r["processing_complete"] for p, r in status.items()} == {"ab": True, "bc": False, "bd": False}
    assert len(status["ab"]["errors"]) == 1 and status["ab"]["has_errors"] and len(status["ab"]["warnings"]) == 1
    assert status["bc"]["errors"] == ["not a PDF file"] and status["bd"]["errors"] == ["Stage 1 — document B not found: d"]


def test_pages_lead_on_to_their_file(spark):
    rows = [
        ("https://a.org/x", "text/html", b"<a HREF='f.pdf?v=2'>"),
        ("https://a.org/x", "text/html", b"nothing"),
        ("https://a.org/x.PDF", "text/html", b"<a href='f.pdf'>"),
        ("https://a.org/x", None, b"%PDF-" + b"0" * 2000),
        ("ftp://a.org/x", "text/html", b"<a href='f.pdf'>"),
        ("https://a.org/x", "text/plain", None),
    ]
    got = [(r["next_url"], r["error"]) for r in provenance.fetch_outcomes(spark.createDataFrame(rows, "url string, content_type string, content binary")).collect()]
    page = "Server returned HTML webpage, not a direct PDF file."
    assert got == [("https://a.org/f.pdf?v=2", None), (None, page), (None, "Downloaded file is too small to be a valid PDF."), (None, None), (None, "Only HTTP/HTTPS URLs are supported."), (None, page)]


def test_evaluation_record(spark):
    rows = [(True, True, "unchanged", "unchanged")] * 3 + [(True, False, "wording_only", "wording_only"), (False, True, "substantive", "wording_only"), (False, False, "added", "added")]
    table = spark.createDataFrame(rows, "predicted_match boolean, expected_match boolean, predicted_type string, expected_change_type string")
    got = evaluate.evaluation_report({"own": table, "none": table.limit(0)}).collect()
    own = next(r for r in got if r["name"] == "own")
    assert (own["precision"], own["recall"], own["f1"], own["correct_count"], own["total_count"], own["matching_accuracy"]) == (0.75, 0.75, 0.75, 4, 6, 0.6667)
    assert own["per_class_f1"] == {"added": 1.0, "substantive": 0.0, "unchanged": 1.0, "wording_only": 0.6667} and own["macro_f1"] == 0.6667
    assert own["wording_test"].asDict() == {"total": 2, "correct": 1, "wrong_as_substantive": 1, "passed": False}
    assert own["limitations"][-1].startswith("Dataset size (6 pairs)") and own["timestamp"] is not None
    assert json.loads(json.dumps(next(r for r in got if r["name"] == "none")["per_class_f1"])) == {}
