"""Repeated passages: words covered by a window that a document with a smaller id has too.

A window is `window` consecutive words. Each window is led by the least hash among its runs of ANCHOR words: equal
windows have equal leaders, and neighbouring windows mostly share one, so there are about 20 times fewer leaders than
windows. The passes:

1. Count-min prefilter. Each partition sketches its documents' leaders (two counters for each leader and document, of
   fixed number, that stop at 2) and sends its sketch once, in PARTS slices, each as pairs or as plain counters, whichever
   is smaller. Slices are merged in two steps, a stream of them at a time, so no task holds more than one slice. The
   sums stop at 2 too, so a leader's lesser counter is at least the number of documents that have it (up to 2), and that
   is at least the number that have any of its windows. Only the bits "2 or more" are broadcast: `width` of them twice, a
   size fixed by the parameter. A corpus beyond the width passes more windows on and loses none.
2. Windows whose leader is estimated repeated, and only they, are grouped exactly by two independent 64-bit hashes of
   all their words: the least id of each group comes from partial aggregates, and a join (both of whose sides Spark may
   split where a window is very frequent) tells each document which of its windows stand in a smaller one.
3. The documents that have such windows are joined with them by id and text hash, and the covered words are left out.
   A bitmap of the text hashes, of fixed size, lets all other documents pass without a shuffle.

Texts of fewer words have no window. A null text has no words. A row with a null id is never larger than another, so it
loses nothing; rows of one id never remove each other's words, whether they repeat a text or not. Windows are judged on
the input. An empty table gives an empty result. All of the table's columns stand in the struct `input`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from ._words import U, run_hashes, word_hashes
from .exact_dedup import BLOCK_BITS, BLOCKS, is_set

WINDOW, ANCHOR = 50, 10
WIDTH = 1 << 26
PARTS, FAN = 64, 16  # slices of a sketch row; first merges of each
_ODD = U(0xD6E8FEB86659FD93)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    out, held = h, 1
    while held < width:
        step = min(held, width - held)
        out = np.minimum(out[:-step], out[step:])
        held += step
    return out


def leaders(words: np.ndarray, window: int) -> np.ndarray:
    """Of each window, the least hash of its runs."""
    anchor = min(ANCHOR, window)
    if len(words) < window:
        return words[:0]
    return sliding_least(run_hashes(words, anchor), window - anchor + 1)


def slots(leader: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    bits = U(64 - width.bit_length() + 1)
    return (leader * _ODD) >> bits, ((leader ^ (leader >> U(32))) * U(0x9E3779B97F4A7C15)) >> bits


def _documents(column: pa.Array, size: int = 8 << 20):
    """(index of the first, list of word hash arrays) for consecutive texts of about `size` bytes."""
    first, held, total = 0, [], 0
    for k in range(len(column) + 1):
        if held and (k == len(column) or total >= size):
            h, bounds = word_hashes(held)
            yield first, [h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            first, held, total = k, [], 0
        if k < len(column):
            held.append((column[k].as_py() or "").encode())
            total += len(held[-1])


def repeated_slots(docs: DataFrame, text: str, window: int, width: int) -> bytes:
    """The merged sketch's bits "2 or more": two rows of width bits."""
    part = width // PARTS

    def add(total: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        total[at] = np.minimum(total[at] + n, 2)

    def gathered(pairs: list) -> np.ndarray:
        total = np.zeros(part, np.uint8)
        for at, n in pairs:
            add(total, at.astype(np.int64), n)
        return total

    def sketch(batches):
        """The partition's slices: each a list of slots until plain counters are smaller."""
        held: dict[int, list | np.ndarray] = {}
        for batch in batches:
            for _, texts in _documents(batch.column(0)):
                own = [np.unique(leaders(w, window)) for w in texts if len(w) >= window]
                for turn, found in enumerate(slots(np.concatenate(own), width) if own else ()):
                    at, n = np.unique(found, return_counts=True)
                    n = np.minimum(n, 2).astype(np.uint8)
                    cuts = np.searchsorted(at, np.arange(PARTS + 1, dtype=U) * U(part))
                    for k in range(PARTS):
                        a, b = cuts[k], cuts[k + 1]
                        if b > a:
                            own_slots, slice_of = (at[a:b] - U(k * part)).astype(np.uint32), held.setdefault(turn * PARTS + k, [])
                            if isinstance(slice_of, list):
                                slice_of.append((own_slots, n[a:b]))
                                if 5 * sum(len(x) for x, _ in slice_of) > part:
                                    held[turn * PARTS + k] = gathered(slice_of)
                            else:
                                add(slice_of, own_slots.astype(np.int64), n[a:b])
        task = TaskContext.get()
        for k in list(held):
            found = held.pop(k)
            yield _slice(k, task.partitionId() if task else 0, gathered(found) if isinstance(found, list) else found)

    def merge(batches):
        """One slice of all that come, a batch in memory at a time."""
        total, k, turn = np.zeros(part, np.uint8), 0, 0
        for batch in batches:
            k, turn = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            for at, n in zip(batch.column(2), batch.column(3), strict=True):
                if at.as_py() is None:
                    total = np.minimum(total + _wide(n.as_buffer(), part), 2)
                else:
                    add(total, np.frombuffer(at.as_buffer(), np.uint32).astype(np.int64), np.frombuffer(n.as_buffer(), np.uint8))
        yield _slice(k, turn, total)

    schema = "part int, turn int, slots binary, counts binary"
    partial = docs.select(docs[text]).mapInArrow(sketch, schema)
    first = partial.withColumn("turn", F.pmod("turn", F.lit(FAN))).groupBy("part", "turn").applyInArrow(_streamed(merge), schema)
    merged = first.groupBy("part").applyInArrow(_streamed(merge), schema)
    bits = np.zeros(2 * width // 8, np.uint8)
    for r in merged.toLocalIterator():
        total = np.zeros(part, np.uint8)
        if r["slots"] is None:
            total = _wide(r["counts"], part)
        else:
            total[np.frombuffer(bytes(r["slots"]), np.uint32)] = np.frombuffer(bytes(r["counts"]), np.uint8)
        at = r["part"] * (part // 8)
        bits[at : at + part // 8] = np.packbits(total >= 2, bitorder="little")
    return bits.tobytes()


def _slice(k: int, turn: int, total: np.ndarray) -> pa.RecordBatch:
    """A slice's counters: those that are not 0 as pairs, or all of them, four in a byte."""
    at = np.flatnonzero(total)
    if 5 * len(at) < len(total) // 4:
        packed = at.astype(np.uint32).tobytes(), total[at].tobytes()
    else:
        fours = np.concatenate([total, np.zeros(-len(total) % 4, np.uint8)]).reshape(-1, 4)
        packed = None, (fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([turn], pa.int32()), pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary())], names=["part", "turn", "slots", "counts"])


def _wide(packed, size: int) -> np.ndarray:
    b = np.frombuffer(packed, np.uint8)
    return np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], axis=1).reshape(-1)[:size]


def _streamed(merge):
    """merge as a function that Spark gives a group's batches one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merge(batches)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def estimated_repeated(leader: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    out = np.ones(len(leader), bool)
    for turn, at in enumerate(slots(leader, width)):
        at = at.astype(np.int64) + turn * width
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _candidate_windows(rows: DataFrame, window: int, width: int, bits: bytes) -> DataFrame:
    """(h1, h2, _key, _text_id, start) of rows(_key, _text, _text_id)' windows that are estimated repeated."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def emit(batches):
        held = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            ids, text_ids = batch.column(0), batch.column(2)
            for first, texts in _documents(batch.column(1)):
                owner, starts, h1, h2 = [], [], [], []
                for k, words in enumerate(texts):
                    at = np.flatnonzero(estimated_repeated(leaders(words, window), held, width))
                    if len(at):
                        owner.append(np.full(len(at), first + k))
                        starts.append(at)
                        h1.append(run_hashes(words, window, 0)[at])
                        h2.append(run_hashes(words, window, 1)[at])
                if owner:
                    of = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(h1).view(np.int64)), pa.array(np.concatenate(h2).view(np.int64)), ids.take(of), text_ids.take(of), pa.array(np.concatenate(starts).astype(np.int32))],
                        names=["h1", "h2", "_key", "_text_id", "start"],
                    )

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.select("_key", "_text", "_text_id").mapInArrow(emit, f"h1 long, h2 long, _key {kind}, _text_id long, start int")


def covered_words(n: int, starts, window: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.asarray(starts, np.int64), 1)
    np.add.at(edges, np.minimum(np.asarray(starts, np.int64) + window, n), -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """docs' columns in a struct `input`, with n_words, n_removed and kept_text (the words left, joined by one space)."""
    rows = docs.select(F.struct("*").alias("input"), docs[key].alias("_key"), docs[text].alias("_text"), F.xxhash64(docs[text]).alias("_text_id"))
    bits = repeated_slots(docs, text, window, width)
    windows = _candidate_windows(rows, window, width, bits)  # read twice; written, they would be larger than the texts
    groups = windows.groupBy("h1", "h2").agg(F.min("_key").alias("least"), F.max("_key").alias("most")).where("least < most")
    groups = materialize(groups.select("h1", "h2", "least"), "repeats")
    hits = windows.join(groups, ["h1", "h2"]).where("_key > least")
    # rows that repeat both id and text give each start more than once
    own = materialize(hits.groupBy("_key", "_text_id").agg(F.collect_set("start").alias("_starts")), "starts")

    def remove(texts: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, starts, strict=True):
            words, gone = (t.as_py() or "").encode().split(), 0
            n = len(words)
            if s.is_valid:
                mask = covered_words(n, s.values.to_numpy(), window)
                gone = int(mask.sum())
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            out.append({"n_words": n, "n_removed": gone, "kept_text": b" ".join(words).decode()})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))

    # only texts that may have such windows are shuffled: a bitmap of fixed size tells the others
    block, bit = F.pmod("_text_id", F.lit(BLOCKS)).cast("int"), F.shiftrightunsigned("_text_id", 24).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("long")
    filled = own.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bitmap"))
    tested = rows.withColumn("_block", block).join(F.broadcast(filled), "_block", "left").withColumn("_maybe", F.coalesce(is_set(bit), F.lit(False))).drop("_block", "_bitmap")
    some = tested.where("_maybe").join(own, ["_key", "_text_id"], "left").select("input", "_text", "_starts")
    joined = some.union(tested.where("not _maybe").select("input", "_text", F.lit(None).cast("array<int>").alias("_starts")))
    kernel = F.arrow_udf(remove, "struct<n_words: long, n_removed: long, kept_text: string>").asNondeterministic()
    return joined.select("input", kernel("_text", "_starts").alias("_out")).select("input", "_out.*")


def query(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("input.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW} - 1], ' ')) AS h
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM docs WHERE len(w) >= {WINDOW})),
least AS (SELECT h, min(doc_id) AS m FROM wins GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM wins JOIN least USING (h) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
