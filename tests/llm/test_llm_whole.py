"""Training-data operators on rows that they once left out."""

import collections
import os
import random

import pytest

from inkdiff.llm import _labels, secret_scan, toxicity


def test_toxic_words_of_a_small_language_are_learned():
    """3 % of the toxic texts are in a language of their own: its words stand in 1 % of the toxic texts each, or less."""
    r, rows = random.Random(3), []
    for i in range(6000):
        toxic = i < 3000
        small = i % 33 == 0
        words = r.choices(["%s%d" % ("q" if small else "v", k) for k in range(200)], k=40)
        if toxic:
            words[r.randrange(40)] = r.choice(["zhukrab", "myxolpt", "dwefgon"] if small else ["idiot", "clown", "pathetic"])
        rows.append((i % 5, int(toxic), " ".join(words), small))
    model = toxicity.train([row[:3] for row in rows if row[0]])
    saved = toxicity.Savings(model.ordinary, model.toxic)
    for small in (False, True):
        caught = [toxicity.score_text(t, model, saved) >= 0.5 for f, y, t, s in rows if f == 0 and y and s == small]
        assert caught and sum(caught) / len(caught) > 0.8
    clean = [toxicity.score_text(t, model, saved) >= 0.5 for f, y, t, s in rows if f == 0 and not y]
    assert sum(clean) / len(clean) < 0.05


def test_weak_spans_inside_a_long_strong_one():
    """A strong value with more than eight strong spans inside covers its whole length."""
    value = "/".join(["0123456789abcdef" * 2] * 12) + "/pin=abcd1234"
    found = secret_scan.find_spans(f"username: someone token={value}")
    assert sum(s["base"] for s in found) == 13
    strong = [s for s in found if s["base"]]
    assert not [s for s in found if not s["base"] and any(s["start"] < b["end"] and b["start"] < s["end"] for b in strong)]


def test_the_sample_bound_cuts_evenly(spark, monkeypatch):
    """Beyond the bound the rows of a table ordered by label are a part of each label, whatever the order of the files."""
    docs = [(i, f"{i:010d}") for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i >= 800)) for i, _ in docs], "doc_id long, toxic int")
    monkeypatch.setattr(_labels, "TOTAL", 3000)
    found = [_labels.sample(spark.createDataFrame(d, "doc_id long, text string").coalesce(1), labels, "toxic", {1: 1000, 0: 1000}) for d in (docs, docs[::-1])]
    assert found[0] == found[1] and 295 <= len(found[0]) <= 300
    assert 0.15 < sum(y for _, y, _ in found[0]) / len(found[0]) < 0.25
    firsts = sum(int(t) < 400 for _, y, t in found[0] if not y) / sum(not y for _, y, _ in found[0])
    assert 0.35 < firsts < 0.65


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_the_stated_figures_of_toxicity(spark):
    """What the README states for the held-out rows at sf0.1: all toxic ones and those caught, the ordinary ones and false alarms."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    seen = collections.Counter((r["toxic"], r["predicted"]) for r in toxicity.query(spark, folder).where("held_out").join(labels, "doc_id").collect())
    assert (seen[1, 0] + seen[1, 1], seen[1, 1], seen[0, 0] + seen[0, 1], seen[0, 1]) == (97, 45, 728, 9)
