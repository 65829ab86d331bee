"""Training-data operators: linked spans by brute force, windows of the main text, odd tables for each operator."""

import random
import re

import pytest

from inkdiff.llm import bpe, decontaminate, exact_dedup, html_text, ngram_join, quality, secret_scan, substring_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string"


def brute_linked(text, reach=240):
    """Every weak span against every other span."""
    strong = secret_scan.base_spans(text)
    weak = [(m.start(), m.end(), kind) for kind, _, pattern in secret_scan.WEAK for m in pattern.finditer(text)]
    weak = [w for w in weak if not any(s[0] < w[1] and w[0] < s[1] for s in strong)]
    scope = lambda at: len([m for m in re.finditer(r"\n[^\S\n]*\n", text) if m.start() <= at])
    needs = {"secret": [("id", "endpoint")], "id": [("secret",)], "endpoint": [("id",), ("secret",)]}

    def near(w, part):
        return any(
            secret_scan.PART[s[2]] == part and s[:2] != w[:2] and scope(s[0]) == scope(w[0]) and s[0] <= w[1] + 2 * reach and s[1] >= w[0] - 2 * reach
            for s in [*strong, *weak]
        )

    return [w for w in weak if all(any(near(w, p) for p in one) for one in needs[secret_scan.PART[w[2]]])]


@pytest.mark.parametrize("seed", range(4))
def test_linked_spans_by_brute_force(seed):
    r = random.Random(seed)
    long = "/".join(["0123456789abcdef" * 2] * 11)
    parts = ["password: ", "token=", "AKIA" + "Q" * 12, "f" * 33, "abcdefgh1", " ", "\n\n", "user=bob99 ", "host: db.example.org ", "pwd=abcd1 ", f"secret={long}-pwd=abcd1 ", "x" * 150, " \n \n", "https://a.example.org/x ", "k" * 400]
    for _ in range(60):
        text = "".join(r.choices(parts, k=r.randint(1, 25)))
        assert secret_scan.linked_spans(text, secret_scan.base_spans(text)) == brute_linked(text)


def test_rules_of_one_length_or_one_name(spark):
    """Of equally long rules the least name wins, of one name `allow`; whatever the rules' order, and as the SQL says."""
    import duckdb

    given = (("b.org", "/", "block"), ("www.b.org", "/", "block"), ("b.org", "/", "allow"), ("c.org", "/x", "block"), ("x.c.org", "/", "allow"))
    urls = [(1, "http://a.b.org/"), (2, "http://www.b.org/q"), (3, "http://x.c.org/xy"), (4, "http://c.org/x"), (5, None)] + [(k, "http://c.org/x") for k in range(6, 60)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    seen = []
    for order in (given, given[::-1]):
        rules = tuple(url_filter.prefix_rule(*x) for x in order)
        seen.append(sorted(map(str, map(tuple, url_filter.filter_urls(df, rules=rules).select("input.page_id", "host", "path", "rule", "verdict").collect()))))
        db = duckdb.connect()
        db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
        db.executemany("INSERT INTO pages VALUES (?, ?)", urls)
        assert seen[-1] == sorted(map(str, db.execute(url_filter.sql(rules)).fetchall()))
    assert seen[0] == seen[1] and any("'b.org/', 'allow'" in r for r in seen[0])


def test_a_bare_secret_has_upper_and_lower_case():
    secret = next(pattern for kind, _, pattern in secret_scan.WEAK if kind == "weak_secret")
    assert not secret.search("z" * 40) and not secret.search("A1" * 20) and not secret.search("0" * 40)
    assert secret.search("aB" * 20) and secret.search("z" * 39 + "Q") and not secret.search("aB" * 21)
    assert secret.search("PWD: abcd") and secret.search("Private_Key=abcd")
    text = "user=bob99 " + "z" * 40 + " https://a.example.org/x"
    assert all(kind != "weak_secret" for *_, kind in secret_scan.linked_spans(text, secret_scan.base_spans(text)))


def test_windows_decide_beside_a_marked_article():
    """Beside a marked article a line counts by what stands around it: one is left out, several long ones are kept."""
    line = "Some running text that is long enough to be a paragraph of its own, but stands outside. " * 2
    page = "<body>{}<article><h1>T</h1><p>short</p><p>Body text of the article itself, of some length.</p></article>{}</body>"
    inside = "T\n\nshort\n\nBody text of the article itself, of some length."
    assert html_text.main_text(page.format("", f"<div>{line[:90]}</div>")) == inside
    more = html_text.main_text(page.format("", f"<div>{line}</div>" * 4))
    assert more.startswith(inside) and more.count("Some running text") > 1
    assert html_text.main_text(page.format(f"<nav>{line}</nav>", f"<footer>{line * 5}</footer>")) == inside


def test_surge_and_dive_on_pages_without_an_article():
    text = "A long paragraph of the text itself that any reader would want to keep. "
    page = f"<p>Login</p><ul><li><a href=1>{text}</a></ul><div><br></div><p>x</p><ul><li><a href=2>One link</a></li><li><a href=3>More</a></li><li><a href=4>Rest</a></li></ul><div>{text * 3}</div><div>End.</div>"
    assert html_text.main_text(page) == f"{(text * 3).strip()}\n\nEnd."


def test_names_inside_an_article():
    page = "<article>{}</article>"
    for kept in ("<section id='form-and-function'><p>kept</p></section>", "<div class='author-side-note'>kept</div>", "<p class='promotion-history'>kept</p>", "<math><mi>kept</mi></math>"):
        assert html_text.main_text(page.format("<p>a</p>" + kept)) == "a\n\nkept"
    for gone in ("<div class='ad-slot'>x</div>", "<aside>x</aside>", "<div class='cookie-notice'>x</div>", "<div id='comments'>x</div>", "<div class='newsletter-signup'>x</div>"):
        assert html_text.main_text(page.format("<p>a</p>" + gone)) == "a"
    assert html_text.main_text(page.format("<p>a<button>Click</button>b</p>")) == "ab"


ODD = [(None, "null id"), (1, None), (1, ""), (2, "same words here again and again"), (2, "same words here again and again"), (None, None), (3, "   "), (4, "long words " * 30_000), (5, "ſ É ​")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c", 0.5, "d") for i, t in ODD], SCHEMA + ", n string, input string, secrets string, score double, _text string")


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        words = r.choices(["an", "ther", "ston", "erle", "ble", "oner"], k=30)
        if i % 4 == 0:
            words[r.randrange(30)] = words[r.randrange(30)] = r.choice(["blarghzork", "quimblyfax"])
        rows.append((1 + i % 4, int(i % 8 == 0 or i % 4 == 0), " ".join(words)))
    return toxicity.train(rows)


@pytest.mark.parametrize("rows", [len(ODD), 0])
def test_odd_and_empty_tables(spark, odd, model, rows):
    """Null ids, null, empty, blank and long texts, repeated rows, clashing names: each row is answered, none crashes."""
    df = odd.limit(rows) if not rows else odd
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    benchmark = spark.createDataFrame([(1, "same words here again"), (None, "null id"), (2, None)], "item_id long, text string")
    found = {
        "bpe": bpe.bpe_encode(df, *how),
        "leaks": decontaminate.find_leaks(df, benchmark),
        "secrets": secret_scan.scan_secrets(df, into="secrets"),
        "toxicity": toxicity.score_toxicity(df, model, into="score"),
        "quality": quality.score_quality(df, quality.Model((0, 1), None, ())),
        "html": html_text.extract_text(df, "text", into="n"),
        "urls": url_filter.filter_urls(df, "text"),
        "repeats": substring_dedup.remove_repeats(df, window=5, width=1 << 12),
        "copies": exact_dedup.mark_duplicates(df),
        "groups": ngram_join.group_near_copies(df),
    }
    for name, out in found.items():
        assert len(out.collect()) == rows, name
    if rows:
        groups = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found["groups"].collect()}
        assert groups[2, 2] == 2 and groups[1, 0] == 1 and groups[None, 0] is None
        assert {r["keep_id"] for r in found["copies"].collect()} == {None, 1, 2, 3, 4, 5}
        assert "secrets" in found["toxicity"].columns and found["toxicity"].columns.count("score") == 1


def test_a_model_without_both_labels_drops_nothing(spark):
    rows = [(k % 4 + 1, 1, f"some text number {k}") for k in range(50)]
    docs = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(rows)], SCHEMA)
    assert toxicity.train(rows).weights == () and toxicity.train([]).weights == ()
    assert {r["toxicity"] for r in toxicity.score_toxicity(docs, toxicity.train(rows)).collect()} == {0.0}


def test_places_need_all_their_windows():
    saving = {b" a b ": 3, b" b c ": 5, b" c d ": 0, b" d e ": 4}
    saved = lambda w: saving.get(w, -1)
    assert toxicity.places(b"a b c d e".split(), saved) == [(3, 0), (3, 1), (4, 4)]
    assert toxicity.places([b"x"], lambda w: 2) == [(2, 0)] and toxicity.places([], saved) == []


def test_stars_meet_by_their_members(spark):
    """Two hubs with copies each, linked only through one copy of either."""
    base = ["h%d" % k for k in range(80)]

    def changed(words, at, name):
        out = list(words)
        for k in at:
            out[k] = f"{name}{k}"
        return out

    rows = [(0, base)] + [(k, changed(base, [k * 3], f"a{k}")) for k in range(1, 9)]
    edge = changed(base, [2, 60], "e")
    bridge = changed(edge, [20], "f")
    other = changed(bridge, [33, 48], "g")
    rows += [(100, edge), (101, bridge), (200, other)] + [(200 + k, changed(other, [k * 4], f"b{k}")) for k in range(1, 9)]
    r = random.Random(3)
    for k in range(30):  # unlike texts that share a passage with them
        rows.append((500 + k, base[10:40] + [f"r{k}_{j}" for j in range(r.randint(5, 60))]))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)
    from test_llm import brute_components

    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.group_near_copies(docs).collect()}
    assert got == brute_components([(i, " ".join(w)) for i, w in rows])


@pytest.mark.parametrize("most", [100_000, 10])
def test_thousands_of_rules(spark, monkeypatch, most):
    """Generated prefix rules, as a list and as a table, broadcast and shuffled, against all of them in turn."""
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", most)
    r = random.Random(4)
    hosts = [f"site{k}.example{k % 90}.org" for k in range(2500)]
    given = [(h, r.choice(["/", "/a/", "/a/b", "/news/"]), r.choice(["allow", "block"])) for h in hosts]
    rules = tuple(url_filter.prefix_rule(*x) for x in given)
    urls = [f"http://{r.choice(['', 'www.', 'x'])}{r.choice(hosts)}{r.choice(['', '/', '/a/', '/a/bc', '/news/1'])}" for _ in range(300)]

    def brute(u):
        host, _, path = u.removeprefix("http://").partition("/")
        path = "/" + path if "/" in u.removeprefix("http://") else ""
        fits = [(len(h + p), h + p, v) for h, p, v in given if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for form in (rules, url_filter.rule_table(spark, rules)):
        got = {x["input"]["page_id"]: (x["rule"], x["verdict"]) for x in url_filter.filter_urls(df, rules=form).collect()}
        assert got == {k: brute(u) for k, u in enumerate(urls)}


def test_other_expressions_are_not_cut(spark):
    """Runs of this expression swallow line ends, so a cut before white space would change the ids."""
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), r"[^\s\p{L}\p{N}]+[\r\n]*|\p{L}+|\p{N}+|\s+"
    text = ("!!!\n\nabc 12 " * 12_000) + "!\n"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    got = bpe.bpe_encode(spark.createDataFrame([(1, text)], SCHEMA), path, pattern).first()["token_ids"]
    assert np.frombuffer(bytes(got), "<u4").tolist() == enc.encode_ordinary(text)


def test_pipeline_by_brute_force(spark, tmp_path):
    """Stages two to five against brute force, on a table with nulls, copies, near copies, passages of items and odd columns."""
    import base64
    import hashlib

    import corpus_pipeline
    import numpy as np
    import public_tokenizers
    import tiktoken
    from test_llm import brute_components, brute_leaks

    r = random.Random(8)
    base = [" ".join(r.choices(["w%d" % k for k in range(80)], k=r.randint(3, 60))) for _ in range(40)]
    item = "the item has twelve words of its own to be found in texts"
    texts = [*base, *base[:8], None, "", "  ", *(t.replace("w1", "W1", 1) for t in base[8:14]), *(f"{t} {item}" for t in base[14:20]), item]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    last = {t or "": k for k, t in enumerate(texts)}
    kept = [(k, texts[k]) for k in sorted(last.values())]
    groups = brute_components(kept)
    kept = [(k, t) for k, t in kept if groups[k][1] == k]
    leaks = brute_leaks(kept, [(1, item)])
    kept = [(k, t) for k, t in kept if not leaks[k][1]]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    expected = {k: (len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for k, t in kept}
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == expected and 20 < len(got) < 45


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
