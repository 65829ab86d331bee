"""Operators of the comparison on small, hand-made cases."""

import difflib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkdiff.compare import compare
from inkdiff.config import Config, load_config
from inkdiff.functions.kernels import assign, common_subsequence
from inkdiff.operators import align, detect, evaluate, logs, provenance, report, segment
from inkdiff.sources import datasets, pdf


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "old, new, expected",
    [
        ("3.1 Pay 75% in 5 days", "4.2 Pay 75% in 5 days", []),
        ("Pay within 5 days", "Pay within 6 days", ["numeric_change"]),
        ("From 5 March 2024", "From 6 March 2024", ["numeric_change", "date_change"]),
        ("From 31st August", "From 30th August", []),
        ("Fee $10", "Fee $20", ["numeric_change", "monetary_change"]),
        ("You shall go", "You shall not go", ["negation_change"]),
        ("You shall go in May", "You shall go in June", ["modal_change"]),
        ("Go", "Go provided that it rains", ["condition_change"]),
        ("", "", []),
        (None, "no", ["negation_change"]),
    ],
)
def test_signals(spark, old, new, expected):
    found = one(spark, detect.signals(F.col("a"), F.col("b")), a=old, b=new)
    assert [s["signal_type"] for s in found] == expected


def test_signal_values(spark):
    found = one(spark, detect.signals(F.col("a"), F.col("b")), a="You must pay 5, 7", b="You may pay 5")
    assert [(s["old_value"], s["new_value"]) for s in found] == [("5, 7", "5"), ("must", "may")]


def test_change_types(spark):
    none = F.array().cast("array<struct<signal_type: string, description: string, old_value: string, new_value: string>>")
    kinds = [one(spark, detect.change_type(none, F.col("x")), x=x) for x in (1.0, 0.98, 0.9, 0.7, 0.5)]
    assert kinds == ["unchanged", "unchanged", "wording_only", "wording_only", "uncertain"]
    found = detect.signals(F.col("a"), F.col("b"))
    assert one(spark, detect.change_type(found, F.lit(0.99)), a="1 x", b="you 2") == "substantive"
    assert one(spark, detect.change_type(found, F.lit(0.9)), a="go", b="go subject to x") == "wording_only"
    assert one(spark, detect.change_type(found, F.lit(0.9), Config(conditions_are_substantive=True)), a="go", b="go subject to x") == "substantive"


def test_ratio_is_difflibs(spark):
    rows = [("a" * 30 + "xyz" * 80, "b" + "xyz" * 90), ("same", "same"), ("", "x"), (None, "x")]
    got = [r["r"] for r in spark.createDataFrame(rows, "a string, b string").select(detect.similarity_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got[:3] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in rows[:3]]
    assert got[3] is None


def test_assignment_is_optimal():
    random = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 5), (5, 2), (4, 4), (6, 6), (0, 3)]:
        s = random.random((n, m)).round(2)
        pairs = assign(s)
        assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        if n and m:
            wide = s if n <= m else s.T
            best = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
            assert sum(s[i, j] for i, j in pairs) == pytest.approx(best)


def test_common_subsequence():
    assert common_subsequence("abcde", "xaczde") == 4
    assert common_subsequence("", "a") == 0


def test_number_and_heading_scores(spark):
    score = align.number_score(align.clause_number(F.col("a")), align.clause_number(F.col("b")))
    cases = [("1. A", "1. B", 1.0), ("1. A", "10. B", 0.5), ("2 A", "3 B", 0.0), ("Section 3", "3. X", 0.0)]
    assert [one(spark, F.coalesce(score, F.lit(0.0)), a=a, b=b) for a, b, _ in cases] == [x for *_, x in cases]
    head = align.token_sort_similarity(F.col("a"), F.col("b"))
    assert one(spark, head, a="Data Protection", b="Protection Data") == 1.0
    assert one(spark, head, a="", b="") == 0.0
    assert one(spark, head, a="abc", b="abd") == pytest.approx(4 / 6)


def clauses(spark, a, b):
    rows = [("p", s, k, h, t) for s, side in (("a", a), ("b", b)) for k, (h, t) in enumerate(side)]
    return spark.createDataFrame(rows, "pair_id string, side string, ordinal int, heading string, text string")


def test_matching_and_empty_sides(spark):
    x, y = ("1. Leave", "Staff shall apply for leave in writing."), ("2. Pay", "Pay is due on the last working day.")
    found = {(r["a_ordinal"], r["b_ordinal"], r["match_type"]) for r in align.hybrid_match(clauses(spark, [x, y], [y, x, ("9. New", "Zebras roam.")])).collect()}
    assert found == {(0, 1, "hybrid"), (1, 0, "hybrid"), (None, 2, "added_candidate")}
    assert {r["match_type"] for r in align.hybrid_match(clauses(spark, [x], [])).collect()} == {"removed_candidate"}
    assert {r["match_type"] for r in align.baseline_match(clauses(spark, [], [x])).collect()} == {"added_candidate"}
    assert align.hybrid_match(clauses(spark, [], [])).count() == 0


def test_tfidf_weights_are_normalised(spark):
    w = align.tfidf_terms(clauses(spark, [("", "red red dog"), ("", "a I")], [("", "red cat")]))
    assert {r["ordinal"]: round(r["n"], 9) for r in w.where("side = 'a'").groupBy("ordinal").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()} == {0: 1.0}
    assert {r["term"] for r in w.where("side = 'b'").collect()} == {"red", "cat", "red cat"}


def test_segmentation(spark):
    text = "intro\n1. Scope\nThis applies.\n\nSection 2\nBody of two\nALL CAPS LINE\nshort"
    pages = [("d", "D", "v1", 1, text), ("d", "D", "v1", 2, "tail of the page"), ("d", "D", "v1", 3, "  "), ("e", "E", "v1", 1, None)]
    df = segment.normalize_pages(spark.createDataFrame(pages, "document_id string, document_name string, version string, page_number int, original_text string"))
    got = segment.segment(df).orderBy("ordinal").collect()
    assert [r["heading"] for r in got] == ["", "1. Scope", "Section 2", "ALL CAPS LINE", ""]
    assert [r["clause_id"] for r in got] == [f"d_clause_000{k}" for k in range(5)]
    assert got[1]["original_text"] == "1. Scope\nThis applies."
    assert got[0]["review_reason"] == "preamble (before first heading); short clause (5 < 20 chars)"
    assert got[2]["section_metadata"]["section_number"] == "Section 2" and got[2]["section_metadata"]["section_title"] is None
    assert got[3]["section_metadata"]["section_title"] == "ALL CAPS LINE"
    assert got[3]["review_reason"] == "short clause (19 < 20 chars)" and not got[1]["flagged_for_review"]


def test_normalization(spark):
    assert one(spark, segment.normalize(F.col("a")), a="  a­b   c \f\n d\t\te  ") == "ab c\n\nd e"


def test_citations(spark):
    truth = spark.createDataFrame([("d", "c1", 1, "text")], "document_id string, clause_id string, page_number int, original_text string")
    cited = spark.createDataFrame([("d", "c1", 1, "text"), ("d", "c9", 1, "text"), ("d", "c1", 2, "text"), ("d", "c1", 1, "other")], "document_id string, clause_id string, page_number int, exact_text string")
    got = {(r["clause_id"], r["page_number"], r["exact_text"]): (r["citation_valid"], r["warning"].split(" ")[0]) for r in report.validate_citations(cited, truth).collect()}
    assert got == {("c1", 1, "text"): (True, ""), ("c9", 1, "text"): (False, "clause_id"), ("c1", 2, "text"): (False, "Page"), ("c1", 1, "other"): (False, "Text")}


def test_providers_fall_back(spark):
    class Echo(report.Provider):
        name = "echo"

        def __init__(self, fails):
            self.fails = fails

        def is_available(self):
            return True

        def generate(self, prompts, timeout):
            if self.fails:
                raise TimeoutError("late")
            return ['```json\n{"summary": "s", "confidence": "HIGH"}\n```'] * len(prompts)

    a = clauses(spark, [("1. X", "You shall go now.")], [("1. X", "You may go now.")])
    rich = a.withColumns({"clause_id": F.lit("c"), "document_id": F.lit("d"), "document_name": F.lit("D"), "original_text": F.col("text"), "page_number": F.lit(1)})
    changes = detect.detect_changes(align.with_clauses(align.hybrid_match(rich), rich))
    good = report.generate_summaries(changes, (Echo(True), Echo(False))).first()["summary"]
    assert (good["summary"], good["confidence"], good["provider_used"], good["fallback_reason"]) == ("s", 0.9, "echo", "echo failed: late")
    plain = report.generate_summaries(changes, (Echo(True),)).first()["summary"]
    assert plain["provider_used"] == "deterministic" and "was: shall — now: may" in plain["summary"] and plain["fallback_reason"] == "echo failed: late"


def test_metrics(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "predicted boolean, gold boolean")
    m = evaluate.alignment_metrics(rows).first()
    assert (m["precision"], m["recall"], m["f1"], m["correct_count"], m["total_count"]) == (0.5, 0.5, 0.5, 2, 4)
    assert evaluate.alignment_metrics(rows.where("false")).first()["f1"] == 0.0
    with pytest.raises(Exception, match="lacks its prediction"):
        evaluate.alignment_metrics(spark.createDataFrame([(None, True)], "predicted boolean, gold boolean")).collect()
    typed = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "gold string, predicted string")
    got = {r["label"]: (r["f1"], r["macro_f1"]) for r in evaluate.class_metrics(typed).collect()}
    assert got["b"][0] == 0.0 and got["c"] == (1.0, round((2 / 3 + 0 + 1) / 3, 4))
    assert {(r["gold"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(typed).collect()}["b", "a"] == 1
    with pytest.raises(Exception, match="more than 1000 labels"):
        evaluate.confusion_matrix(spark.range(1200).selectExpr("concat('l', id) as gold", "'x' as predicted")).collect()
    gate = evaluate.wording_gate(spark.createDataFrame([("wording_only", "unchanged")], "gold string, predicted string")).first()
    assert (gate["total"], gate["correct"], gate["wrong_as_substantive"], gate["passed"]) == (1, 0, 0, True)


def test_labelled_pairs(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text('[{"id": "x", "category": "c", "clause_a_text": "You shall pay.", "clause_b_text": "You shall pay.", "expected_match": true, "expected_change_type": "unchanged", "notes": ""},'
                    ' {"id": "y", "category": "c", "clause_a_text": "", "clause_b_text": "New.", "expected_match": false, "expected_change_type": "added", "notes": ""}]')  # fmt: skip
    got = {r["id"]: (r["predicted_match"], r["predicted_type"]) for r in evaluate.evaluate_pairs(datasets.labelled_pairs(spark, str(path))).collect()}
    assert got == {"x": (True, "unchanged"), "y": (False, "added")}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        datasets.labelled_pairs(spark, str(tmp_path / "none.json"))


def test_provenance(spark):
    rows = [("s", 1, "https://a.edu/x.pdf", "a.edu", "Library Policy 2022", "State University rules", "State University", "", "Library Policy", "2024-25"), ("s", 2, "https://www.scribd.com/1", "www.scribd.com", "", None, "State", "", "Library Policy", "")]
    got = provenance.rank_candidates(spark.createDataFrame(rows, "session_id string, ordinal int, source_url string, source_domain string, document_title string, snippet string, institution string, university string, policy_title string, newer_year string")).orderBy("rank").collect()
    assert [(r["provenance_status"], r["provenance_score"]) for r in got] == [("VERIFIED_PROVENANCE", 12), ("UNVERIFIED", -2)]


def test_log_operators(spark):
    audit = spark.createDataFrame([("s", 1, "IDLE"), ("s", 2, "FAILED")], "session_id string, seq long, state string")
    assert [r["from_state"] for r in logs.transitions(audit).orderBy("seq").collect()] == ["IDLE", "IDLE"]
    assert logs.current_states(audit).first()["description"] == logs.STATES["FAILED"]
    with pytest.raises(Exception, match="Unknown state"):
        logs.transitions(audit.withColumn("state", F.lit("LOST"))).collect()


def test_pdf_pages(spark, tmp_path):
    body = b"BT (Hello \\(1\\)) Tj T* (World) Tj ET"
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << /Length 9 >> stream\n" + body + b"\nendstream endobj\n")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    got = {r["document_id"]: (r["page_number"], r["original_text"], list(r["errors"])) for r in pdf.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"a": (1, "Hello (1)\nWorld", []), "b": (None, "", ["not a PDF file"])}


def test_whole_comparison(spark):
    text = "1. Scope\nThis policy applies to all staff members.\n2. Fees\nThe fee is {} rupees a month for everyone."
    pages = spark.createDataFrame([("x", "X", "v1", 1, text.format(100)), ("y", "Y", "v2", 1, text.format(200) + "\n3. Leave\nA wholly different thing about zebras.")], "document_id string, document_name string, version string, page_number int, original_text string")
    out = compare(pages, spark.createDataFrame([("p", "x", "y")], "pair_id string, document_id_a string, document_id_b string"))
    rows = {(r["change_type"], r["heading_a"], r["heading_b"]) for r in out["rows"].collect()}
    assert rows == {("unchanged", "1. Scope", "1. Scope"), ("substantive", "2. Fees", "2. Fees"), ("added", "3. Leave", "—")}
    assert out["status"].first()["processing_complete"]


def test_config():
    assert load_config({"INKDIFF_ACCEPT_THRESHOLD": "0.6"}).accept_threshold == 0.6
    with pytest.warns(UserWarning):
        Config(number_weight=0.9)
