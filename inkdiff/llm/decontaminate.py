"""Benchmark decontamination by a prefix-filtered join of exact windows.

Each benchmark item becomes windows of `window` consecutive words (a shorter item is one window). A window is found only
where all of its words stand in their order, so of its words, ordered by rarity in the documents, one prefix token (the
rarest) is enough: a document without it cannot hold the window. The words of a document that are prefix tokens give
candidate places; the token's offset in the window and the window's length must fit inside the document, and the
document's window at that place must equal the item's exactly.

The counts that order the words cover all documents. The documents are never shuffled: the windows, a query set with
its own size, go to them. They are counted first and broadcast in blocks of at most `block` windows; more of them mean
more passes over the documents, not more memory. Hits of several blocks are merged for each document.

Words are lower-cased (A-Z only) runs of a-z, 0-9 and non-ASCII characters. Null texts have no words; items without
words have no windows; equal windows of several items count for each of them. Items are named by the text of item_id;
windows of a null item_id hit words but are no item. Rows that repeat an id or text are answered alike, empty tables on
either side give no hits, and all of the table's columns stand in the struct `input`, so none of their names can clash.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BLOCK = 200_000
_SPANS = "array<struct<start: int, end: int>>"
_HITS = f"struct<n_words: long, spans: {_SPANS}, items: array<string>>"
_KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
#: A-Z to a-z; every ASCII byte that is in no word to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    if len(words) < window:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def item_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(_window, _items): the distinct windows and the sorted names of the items that have them."""

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([list(dict.fromkeys(windows_of(words_of(x.as_py()), window))) for x in texts], pa.list_(pa.binary()))

    rows = items.select(items[item].cast("string").alias("_item"), F.explode(F.arrow_udf(cut, "array<binary>")(items[text])).alias("_window"))
    return rows.groupBy("_window").agg(F.sort_array(F.collect_set("_item")).alias("_items"))


def word_counts(docs: DataFrame, text: str, vocabulary: set[bytes]) -> Counter:
    """How often each word of the vocabulary stands in the documents."""
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        words, found = wanted.value, Counter()
        for batch in batches:
            for x in batch.column(0):
                found.update(filter(words.__contains__, words_of(x.as_py())))
        yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select(docs[text]).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return Counter({bytes(r["word"]): r["n"] for r in rows})


def prefix_index(windows: list[tuple[bytes, list[str]]], counts: Counter) -> dict[bytes, dict[tuple[int, int], dict[bytes, list[str]]]]:
    """rarest word -> (its offset, words in the window) -> window -> items."""
    index: dict = {}
    for window, items in windows:
        words = window.split(b" ")
        rarest = min(words, key=lambda w: (counts[w], w))
        index.setdefault(rarest, {}).setdefault((words.index(rarest), len(words)), {})[window] = items
    return index


def find_windows(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], list[str]]:
    """Merged word spans of all windows that occur, and their items."""
    spans, items, n = [], set(), len(words)
    for at in [k for k, w in enumerate(words) if w in index]:
        for (offset, length), windows in index[words[at]].items():
            start = at - offset
            if start >= 0 and start + length <= n and (found := windows.get(b" ".join(words[start : start + length]))) is not None:
                spans.append((start, start + length))
                items.update(found)
    return merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _finder(docs: DataFrame, text: str, windows: DataFrame):
    rows = [(bytes(r["_window"]), r["_items"]) for r in windows.toLocalIterator()]
    vocabulary = {w for window, _ in rows for w in window.split(b" ")}
    index = docs.sparkSession.sparkContext.broadcast(prefix_index(rows, word_counts(docs, text, vocabulary)))

    def find(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            words = words_of(x.as_py())
            spans, items = find_windows(words, index.value)
            out.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "items": items})
        return pa.array(out, _KIND)

    return F.arrow_udf(find, _HITS).asNondeterministic()


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs' columns in a struct `input`, and a struct `leak` of n_words, merged word spans and the items found."""
    from ._shared import materialize

    windows = materialize(item_windows(items, item, item_text, window), "windows")
    blocks = max(1, -(-windows.count() // block))
    if blocks == 1:
        rows = docs.select(F.struct("*").alias("input"), docs[text].alias("_text"))
        return rows.select("input", _finder(docs, text, windows)(F.col("_text")).alias("leak"))
    keyed = docs.select(F.struct("*").alias("input"), docs[text].alias("_text"), F.sha2(F.coalesce(docs[text], F.lit("")), 256).alias("_sha"))
    texts = keyed.select("_text", "_sha")
    part = F.pmod(F.xxhash64("_window"), F.lit(blocks))
    hits = None
    for k in range(blocks):
        one = texts.select("_sha", _finder(docs, text, windows.where(part == k))(F.col("_text")).alias("leak"))
        one = one.where(F.size("leak.spans") > 0).dropDuplicates(["_sha"])
        hits = one if hits is None else hits.unionByName(one)
    flat = hits.groupBy("_sha").agg(F.flatten(F.collect_list("leak.spans")).alias("_spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("leak.items")))).alias("_items"))

    def tidy(lists: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in x or ()])] for x in lists.to_pylist()], _KIND.field("spans").type)

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(words_of(x.as_py())) for x in texts], pa.int64())

    joined = keyed.select("input", "_sha", F.arrow_udf(count, "long")(F.col("_text")).alias("_n")).join(flat, "_sha", "left")
    none = F.array().cast(_SPANS), F.array().cast("array<string>")
    leak = F.struct(F.col("_n").alias("n_words"), F.coalesce(F.arrow_udf(tidy, _SPANS)(F.col("_spans")), none[0]).alias("spans"), F.coalesce("_items", none[1]).alias("items"))
    return joined.select("input", leak.alias("leak"))


def query(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "input.doc_id",
        F.col("leak.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM places JOIN wins USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
