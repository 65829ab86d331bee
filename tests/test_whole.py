"""Queries that once covered a part of their rows only."""

import math
import re
from collections import Counter

from inkdiff.corpus import clauses
from inkdiff.operators import report
from inkdiff.plans import changes, documents


def parts(spark, tmp_path, n):
    rows = [(k, f"part {k}", "SMALL PLATED TIN", 1 + k % 50, 900.0 + k) for k in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def lone_cosine(a, b):
    """TF-IDF cosine of two texts that are a corpus of their own."""
    counts = []
    for text in (a, b):
        words = re.findall(r"\b\w\w+\b", text.lower())
        counts.append(Counter(words + [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)]))
    weight = [{t: n * (math.log(3 / (1 + sum(t in c for c in counts))) + 1) for t, n in own.items()} for own in counts]
    norms = [math.sqrt(sum(w * w for w in own.values())) for own in weight]
    return sum(w * weight[1].get(t, 0.0) for t, w in weight[0].items()) / (norms[0] * norms[1])


def test_evaluation_judges_every_pair(spark, tmp_path):
    folder = parts(spark, tmp_path, 100)
    rows = changes.labelled_pairs(spark, folder).collect()
    assert len(rows) == len({r["id"] for r in rows}) == 100
    judged = {r["name"]: r for r in changes.evaluation_report(spark, folder).collect()}
    for name, least in (("baseline", 0.0), ("hybrid", 0.35)):
        told = [bool(r["clause_a_text"] and r["clause_b_text"]) and 0.5 ** (name == "hybrid") * lone_cosine(r["clause_a_text"], r["clause_b_text"]) >= least for r in rows]
        right = sum(x == r["expected_match"] for x, r in zip(told, rows, strict=True))
        caught = sum(x and r["expected_match"] for x, r in zip(told, rows, strict=True))
        assert (judged[name]["total_count"], judged[name]["correct_count"]) == (100, right)
        assert judged[name]["recall"] == round(caught / sum(r["expected_match"] for r in rows), 4)


def web_pages(spark, tmp_path):
    urls = {k: f"https://a{k % 7}.org/p/{k}" + ("?page=2&ref=x" if k % 6 == 0 else "?q=a+b%20c" if k % 6 == 1 else "") for k in range(60)}
    spark.createDataFrame([(k, u, "") for k, u in urls.items()], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return urls, str(tmp_path)


def test_links_of_every_page(spark, tmp_path):
    urls, folder = web_pages(spark, tmp_path)
    expected = [(k, 1, u, f"A & B {k}", f"it's {k}") for k, u in urls.items()] + [(k, 3, "http://second.example.org/", "", "") for k in urls]
    assert sorted(tuple(r) for r in documents.link_scrape(spark, folder).collect()) == sorted(expected)


def test_first_source_of_every_session(spark, tmp_path):
    urls, folder = web_pages(spark, tmp_path)
    rows = [(f"s{k % 20}", k // 20, k % 3 + 1) for k in urls]
    least = {s: min(x[2] for x in rows if x[0] == s) for s, *_ in rows}
    assert len(least) == 20
    assert sorted(tuple(r) for r in documents.search_fallback(spark, folder).collect()) == sorted(x for x in rows if x[2] == least[x[0]])


def numbers(text):
    return ", ".join(x for x in re.findall(r"[A-Za-z]?[0-9]+(?:\.[0-9]+)?", text) if x[0].isdigit())


def test_summaries_and_prompts_are_whole(spark, tmp_path):
    folder = parts(spark, tmp_path, 96)
    text = {(r["pair_id"], r["ordinal"], r["side"]): (r["k"], r["text"]) for r in clauses(spark, folder).collect()}
    kinds = {11: "added", 12: "removed", 13: "wording_only", 14: "wording_only", 15: "uncertain"} | dict.fromkeys(range(6), "unchanged") | dict.fromkeys(range(6, 11), "substantive")
    fixed = {7: ("negation_change", "Negation words added or removed", "now: not"), 8: ("modal_change", "Modal/obligation words changed", "was: must — now: may"), 14: ("condition_change", "Conditional phrases added or removed", "now: provided that")}
    summaries, prompts = {}, {}
    for p, o in {(p, o) for p, o, _ in text}:
        (k, old), (_, new) = (text.get((p, o, s), (0, "")) for s in "ab")
        k = max(k, text.get((p, o, "b"), (0,))[0])
        told = [fixed[k]] if k in fixed else []
        if k in (6, 9, 10):
            told.append(("numeric_change", "Numeric values differ between versions", f"was: {numbers(old)} — now: {numbers(new)}"))
        if k == 9:
            told.append(("date_change", "Date references differ between versions", "was: 5 March 2024 — now: 6 April 2025"))
        if k == 10:
            told.append(("monetary_change", "Monetary values differ between versions", f"was: {re.search(r'[$][0-9]+', old)[0]} — now: {re.search(r'[$][0-9]+', new)[0]}"))
        summaries[p, o] = report.TEMPLATES[kinds[k]] + (" Detected: " + "; ".join(f"{d} — {v}" for _, d, v in told) + "." if told else "")
        if old and new:
            place = lambda s: f"({p} {s}, Clause {p}_{s}_clause_{o:04d}, Page {o // 10 + 1}):"  # noqa: B023, E731
            signals = "; ".join(f"{t}: {d}" for t, d, _ in told) or "none"
            prompts[p, o] = (
                f"OLD CLAUSE {place('a')}\n{old}\n\nNEW CLAUSE {place('b')}\n{new}\n\nDETECTED SIGNALS: {signals}\n\nRespond ONLY in JSON:\n"
                '{"summary": "...", "classification_suggestion": "wording_only|substantive|uncertain", "confidence": "high|medium|low"}\n\n'
                "Do NOT invent citations, legal consequences, or information not in the text above."
            )
    assert len(summaries) == 96
    assert {(r["pair_id"], r["ordinal"]): r["summary"] for r in changes.summaries(spark, folder).collect()} == summaries
    assert {(r["pair_id"], r["ordinal"]): r["prompt"] for r in changes.prompts(spark, folder).collect()} == prompts


def test_flags_of_every_clause(spark, tmp_path):
    docs = [
        (1, "Short one.", "en"),
        (2, "Über 12 Zeilen und Zeichen hinaus geht das.", "de"),
        (3, "What stands before the headings is long.\n1. Scope\nAll rules here apply to everyone.\n2. End\nx", "en"),
        (4, "", "fr"),
    ]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    first = "preamble (before first heading)"
    assert sorted(tuple(r) for r in changes.clause_flags(spark, str(tmp_path)).collect()) == [
        (1, 0, True, f"{first}; short clause (10 < 20 chars)"),
        (2, 0, True, first),
        (3, 0, True, first),
        (3, 1, False, ""),
        (3, 2, True, "short clause (8 < 20 chars)"),
    ]


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def brute_scores(rows):
    """{(pair, a, b): (number, heading, text, match)} of all clause pairs of each document pair."""
    out = {}
    for pair in {r["pair_id"] for r in rows}:
        own = [r for r in rows if r["pair_id"] == pair]
        counts, df = [], Counter()
        for r in own:
            words = re.findall(r"\b\w\w+\b", r["text"].lower())
            counts.append(Counter(words + [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)]))
            df.update(counts[-1].keys())
        assert len(df) <= 5000
        weights = []
        for c in counts:
            raw = {t: n * (math.log((1 + len(own)) / (1 + df[t])) + 1) for t, n in c.items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            weights.append({t: w / norm for t, w in raw.items()})
        for a, wa in zip(own, weights, strict=True):
            for b, wb in zip(own, weights, strict=True):
                if (a["side"], b["side"]) == ("a", "b"):
                    m, n = (str(r["ordinal"] + 1) for r in (a, b))
                    number = 1.0 if m == n else 0.5 if m.startswith(n) or n.startswith(m) else 0.0
                    p, q = (" ".join(sorted(r["heading"].split())) for r in (a, b))
                    heading = 2 * common(p, q) / (len(p) + len(q))
                    text = min(1.0, sum(w * wb.get(t, 0.0) for t, w in wa.items()))
                    out[pair, a["ordinal"], b["ordinal"]] = number, heading, text, 0.2 * number + 0.3 * heading + 0.5 * text
    return out


def test_scores_of_all_clause_pairs(spark, tmp_path):
    folder = parts(spark, tmp_path, 60)
    expected = brute_scores(clauses(spark, folder).collect())
    found = {(r["pair_id"], r["a_ordinal"], r["b_ordinal"]): (r["number_score"], r["heading_score"], r["tfidf_score"], r["match_score"]) for r in changes.hybrid_score(spark, folder).collect()}
    assert found.keys() == expected.keys()
    assert all(abs(x - y) < 1.1e-5 for key in found for x, y in zip(found[key], expected[key], strict=True))
    assert all(min(abs(s[3] - 0.35), abs(s[3] - 0.5)) > 1e-9 for s in expected.values())
    bands = Counter("hybrid" if s[3] >= 0.5 else "needs_review" if s[3] >= 0.35 else None for s in expected.values())
    assert {r["match_type"]: r["n"] for r in changes.match_bands(spark, folder).collect()} == bands and None in bands
    flags = Counter({key[:2]: 0 for key in expected})
    flags.update(key[:2] for key, s in expected.items() if s[3] >= 0.35)
    assert {(r["pair_id"], r["a_ordinal"]): r["candidates"] for r in changes.restructure_flags(spark, folder).collect()} == dict(flags)
