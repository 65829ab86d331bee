"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties and odd columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from inkdiff.llm import _labels, _shared, bpe, decontaminate, exact_dedup, html_text, ngram_join, quality, secret_scan, substring_dedup, toxicity, url_filter
from inkdiff.llm._components import components

SCHEMA = "doc_id long, text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["w%d" % k for k in range(60)] + ["É", "of", "the", "The"]
    base = [" ".join(r.choices(vocabulary, k=r.randint(1, 90))) for _ in range(60)]
    passage = " ".join("p%d" % k for k in range(70))
    out = [*base, *base[:12], None, "", "   ", "\n\t", "one two", "one two"]
    for t in base[12:24]:  # near copies
        words = t.split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    out += [f"{t} {passage} {t}" for t in base[30:36]]
    out.append("long " * 3000 + passage)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], SCHEMA + ", kept string, _id string, n_words int")


def test_bpe_round_trip(spark, docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = [(1000, "a'll  \n\n x  é　 z<|endoftext|> " * 50), (1001, "x" * 5000)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA))
    got = {r["doc_id"]: r for r in bpe.round_trip(df).collect()}
    for i, t in [*texts, *more]:
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_bpe_cuts_are_safe():
    enc = bpe.encoding_of(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choices(["a", "'", "s", " ", "  ", "\n", " ", "1", "é", "!", "\x85", " " * 5000], [5, 1, 2, 4, 1, 1, 1, 1, 1, 1, 1, 0.1], k=200))
        assert bpe.encode_text(enc, t, chunk=16) == enc.encode_ordinary(t)
    assert enc.decode_bytes(bpe.encode_text(enc, " " * 2_000_000 + "x")) == b" " * 2_000_000 + b"x"


def test_html_text():
    f = html_text.main_text
    assert f(None) == f("") == f("<nav>a</nav>") == ""
    page = "<html><head><title>T</title><style>p{}</style><script>if (a<b) '</p>'</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One <b>bo</b>ld<br>x &nbsp; y<p>Two<form><input>F</form><aside>S</aside></article><div id=comments><p>Nice</div><footer>&copy;</footer>"
    assert f(page) == "A & B\n\nOne bold x y\n\nTwo"
    plain = "<body><ul class=menu><li><a href=1>Menu item</a></ul><div class='content no-sidebar'><p>" + "Long words stand here. " * 9 + "<p>End.</div><div class=cookie-notice>We use cookies on this page.</div>"
    assert f(plain) == ("Long words stand here. " * 9).strip() + "\n\nEnd."
    assert f("<p>short") == "short"
    assert f("<!-- <p>no</p> --><main><p>" + "x " * 100_000 + "</main>") == ("x " * 100_000).strip()
    assert f("<article><p>text < 5 <q") == "text < 5 <q"


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.NET/en/1?q", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("https://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
        ("https://x.example.com/de/a#b", "x.example.com", "/de/a", "example.com/de/", "block"),
        ("https://a.org/fr/?x", "a.org", "/fr/", "org/fr/", "allow"),
        ("http://www.spam-farm.example.org/en/", "www.spam-farm.example.org", "/en/", None, "block"),
        ("http://notspam-farm.com/", "notspam-farm.com", "/", None, "allow"),
        ("http://casino.com/responsible-gaming/", "casino.com", "/responsible-gaming/", None, "allow"),
        ("a?b=://c.net/", "c.net", "/", "net/", "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url), (1, url)], "page_id long, url string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == 2 and all((r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict) for r in got)


def test_url_filter_equals_its_sql(spark):
    import duckdb

    hosts = ["a.net", "spam-farm.org", "x.example.com", "EXAMPLE.net", "b.org", "cheap-pills.x.com", "my-casino.de"]
    urls = [f"{s}{h}{p}" for s in ("http://", "", "x://y://") for h in hosts for p in ("", "/", "/en/", "/de/a", "/fr/?q=porn1", "#casino", "?a/b")]
    rows = list(enumerate([*urls, None]))
    got = sorted(map(str, (tuple(r) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).select("input.page_id", "host", "path", "rule", "verdict").collect())))
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert got == sorted(map(str, db.execute(url_filter.SQL).fetchall()))


def brute_leaks(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, t in texts:
        w, hit, named = fold(t), set(), set()
        for item, body in items:
            v = fold(body)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[k : k + n]:
                        hit.update(range(s, s + n))
                        named.add(str(item))
        out[i] = (len(w), len(hit), sorted(named))
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination(spark, docs, texts, block):
    items = [(1, " ".join("P%d" % k for k in range(20, 35))), (2, "one, TWO"), (3, None), (4, "..."), (5, "p3-p4 p5"), (10, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = docs.where("doc_id < 110")
    found = decontaminate.find_leaks(some, bench, block=block).collect()
    got = {r["input"]["doc_id"]: (r["leak"]["n_words"], sum(s["end"] - s["start"] for s in r["leak"]["spans"]), r["leak"]["items"]) for r in found}
    assert got == brute_leaks([x for x in texts if x[0] < 110], items)
    assert decontaminate.find_leaks(some, bench.limit(0), block=block).where("size(leak.spans) > 0").count() == 0
    assert decontaminate.find_leaks(some.limit(0), bench, block=block).count() == 0


def test_secret_spans(spark):
    def brute(t):
        out = [(m.start(), m.end(), "assign") for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t or "", re.A) if len(m[1]) >= 8]
        out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        return out + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]

    r = random.Random(2)
    parts = ["password: ", "token=", "token = '", "API_KEY\":", "AKIA" + "Q" * 12, "AKIAX", "f" * 33, "abcdefgh1", "é ", " ", "secret=token:abcd", "\n\n", "ſecret=abcdefghi", "user=bob99", "host: db.example.org", "pwd=abcd1"]
    rows = [(k, "".join(r.choices(parts, k=30))) for k in range(120)] + [(500, None), (501, "")]
    got = {x["doc_id"]: x["secrets"] for x in secret_scan.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in rows:
        assert sorted((s["start"], s["end"], s["kind"]) for s in got[i] if s["base"]) == sorted(brute(t))
        assert [s["start"] for s in got[i]] == sorted(s["start"] for s in got[i])


def test_weak_parts_need_their_complements():
    kinds = lambda t: [s["kind"] for s in secret_scan.find_spans(t)]
    assert kinds("user=bob99") == kinds("pwd=abcd1") == kinds("host: db.example.org") == []
    assert kinds("user=bob99 pwd=abcd1") == ["weak_id", "weak_secret"]
    assert kinds("user=bob99 pwd=abcd1 host: db.example.org") == ["weak_id", "weak_secret", "endpoint"]
    assert kinds("user=bob99\n\npwd=abcd1") == []
    assert kinds("user=bob99" + " " * 600 + "pwd=abcd1") == []
    assert kinds("password=abcdefgh host=db.example.org user=bob99") == ["assign", "endpoint", "weak_id"]


def brute_components(texts, words=5):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sets = {}
    for i, t in texts:
        w = split(t)
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_groups(spark, docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.group_near_copies(docs).collect()}
    assert got == brute_components(texts)
    assert ngram_join.group_near_copies(docs.limit(0)).count() == 0


def test_ngram_chain_of_copies(spark):
    """Each text is near the next one only, and a hub is near to all of its copies, which are not near each other."""
    words = ["c%d" % k for k in range(120)]
    rows, r = [], random.Random(4)
    for k in range(14):
        rows.append((k, " ".join(words)))
        words[r.randrange(120)] = f"n{k}"
        words[r.randrange(120)] = f"m{k}"
    hub = ["h%d" % k for k in range(100)]
    rows.append((100, " ".join(hub)))
    for k in range(20):
        copy = list(hub)
        copy[5 * k % 100] = f"x{k}"
        copy[(5 * k + 37) % 100] = f"y{k}"
        rows.append((101 + k, " ".join(copy)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.group_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (5, 5), (4, 1)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def brute_repeats(texts, window=50):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for i, t in texts:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in texts:
        w, gone = split(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window, width", [(50, 1 << 20), (12, 1 << 10)])
def test_substring_dedup(spark, docs, texts, window, width):
    """The second width is far too small: more windows pass on, none is lost."""
    got = {r["input"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs, window=window, width=width).collect()}
    assert got == brute_repeats(texts, window)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [2048, 1])
def test_exact_dedup(spark, docs, texts, blocks):
    got = {r["doc_id"]: r for r in exact_dedup.mark_duplicates(docs, blocks=blocks).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    for i, t in texts:
        same = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    twice = docs.union(docs)
    kept = exact_dedup.drop_duplicates(twice, blocks=blocks)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(map(max, groups.values()))
    assert exact_dedup.mark_duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_stays_in_the_jvm(docs):
    plan = exact_dedup.mark_duplicates(docs)._jdf.queryExecution().toString() + url_filter.filter_urls(docs.selectExpr("doc_id page_id", "text url"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    ordinary = ["".join(r.choices(["an", "the", "er", "on", "st", "le"], k=r.randint(1, 4))) for _ in range(400)]
    rude = ["blargh", "zorkface", "quimbly"]
    docs, labels = [(5000, None), (5001, "")], [(5000, 0, 1), (7777, 1, 1), (5001, None, None)]
    for i in range(900):
        toxic, poor = i % 5 == 0, i % 4 == 0
        words = r.choices(ordinary, k=r.randint(15, 60))
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(rude)
        docs.append((i, " ".join(w.upper() + "!!" if poor else w for w in words)))
        labels.append((i, int(toxic), 0 if poor else 1 + i % 2))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, labels), into="score").collect()
    rows = [(r["score"], r["doc_id"] % 5 == 0) for r in out if r["doc_id"] < 5000 and held_out(r["doc_id"])]
    assert sum((s >= 0.5) == y for s, y in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == 902
    assert toxicity.fit(docs, labels.where("toxic = 0")).base == 0.0
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels.limit(0)), into="score").collect()} == {0.0}


def test_labels_of_fold_zero_are_not_learned(labelled):
    docs, labels = labelled
    assert {f for f, *_ in _labels.sample(docs, labels, "toxic", {0: 1000, 1: 1000})} == {1, 2, 3, 4}
    assert sum(y for _, y, _ in _labels.sample(docs, labels, "toxic", {0: 10, 1: 7})) == 7


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    assert model.grades == (0, 1, 2) and model.thresholds[0] < model.thresholds[1]
    out = quality.score_quality(docs, model, floor=1).collect()
    rows = [(r["quality"]["tail"], r["doc_id"] % 4 != 0) for r in out if r["doc_id"] < 5000 and held_out(r["doc_id"])]
    assert sum((s >= 0.5) == y for s, y in rows) / len(rows) > 0.95
    assert all(0 <= r["quality"]["expected"] <= 2 for r in out)
    none = quality.score_quality(docs, quality.fit(docs, labels.limit(0))).first()["quality"]
    assert none["tail"] is None


def test_written_tables_go_to_the_shared_folder(spark, docs):
    copy = _shared.materialize(docs, "test")
    assert copy.count() == docs.count() and _shared.shared_dir(spark).split(":")[-1] in copy.inputFiles()[0]


def test_pipeline_stages(spark, tmp_path, labelled):
    import corpus_pipeline

    docs, labels = labelled
    leak = " ".join("leak%d" % k for k in range(12))
    extra = spark.createDataFrame([(9000, leak + " end"), (9001, "plain copy text of some words"), (9002, "plain copy text of some words")], SCHEMA)
    docs.union(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 9000 not in out and 9001 not in out and 9002 in out
    clean = [i for i in range(900) if i % 5]
    assert len([i for i in clean if i in out]) > 0.97 * len(clean) and len([i for i in range(0, 900, 5) if i in out]) < 20
    assert out[9002]["decoded_sha256"] == hashlib.sha256(b"plain copy text of some words").hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "byte_bpe"]
