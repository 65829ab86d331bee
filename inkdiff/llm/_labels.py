"""Bounded samples of labelled rows for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize

#: A sampled text's length at most, in characters; longer ones are scored like any other but not learned from.
LONGEST = 200_000
#: All sampled texts' characters together.
TOTAL = 48_000_000
#: Parts in which the sample is written, each read by the driver in turn.
SLICES = 16


def fold(key: str | Column, folds: int = 5) -> Column:
    """crc32 of the key's decimal text, modulo folds."""
    return F.pmod(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(folds)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], key: str = "doc_id", text: str = "text") -> list[tuple[int, int, str]]:
    """(fold, label, text) of labelled rows outside fold 0: for each label value, `most` rows at most, by the hash of the key.

    The labels alone are sorted and cut, so the documents are joined with a small, bounded table. Rows without a key,
    text or label are left out; of several labels of one key the largest counts. If the texts have more than TOTAL
    characters, each label keeps the same part of its rows, the first ones by the hash. The documents are read once, in
    parallel: the chosen texts are written to the shared folder and their lengths and texts read from there.
    """
    known = labels.select(labels[key].alias("_key"), labels[label].cast("int").alias("_label")).where("_key is not null and _label is not null")
    chosen = None
    for value, n in most.items():
        one = known.where((F.col("_label") == value) & (fold("_key") != 0)).orderBy(F.xxhash64("_key"), "_key").limit(n)
        chosen = one if chosen is None else chosen.union(one)
    chosen = chosen.groupBy("_key").agg(F.max("_label").alias("_label"))
    texts = docs.select(docs[key].alias("_key"), docs[text].alias("_text")).where(F.char_length("_text") <= LONGEST)
    found = texts.join(F.broadcast(chosen), "_key").select(fold("_key").alias("_fold"), "_label", "_text", "_key", F.xxhash64("_key").alias("_hash"))
    written = materialize(found.repartition(SLICES, "_hash"), "sample")
    rows, sizes = written, written.groupBy("_label", "_hash").agg(F.sum(F.char_length("_text")).alias("n")).collect()
    if sum(r["n"] for r in sizes) > TOTAL:
        rows = rows.where(_within([tuple(r) for r in sizes]))
    out = [(r["_hash"], r["_key"], r["_fold"], r["_label"], r["_text"]) for r in rows.toLocalIterator()]
    discard(written)
    out.sort(key=lambda r: (r[0], r[1], r[4]))
    return [r[2:] for r in out]


def _within(sizes: list[tuple[int, int, int]]) -> Column:
    """Which rows to keep of (label, hash, characters): an equal part of each label, by the hash, up to TOTAL characters."""
    placed = []
    for label in sorted({x[0] for x in sizes}):
        own = sorted(x for x in sizes if x[0] == label)
        placed += [((k + 1) / len(own), *x) for k, x in enumerate(own)]
    last, total = {}, 0
    for _, label, key, n in sorted(placed):
        total += n
        if total > TOTAL:
            break
        last[label] = key
    keep = F.lit(False)
    for label, key in last.items():
        keep = keep | ((F.col("_label") == label) & (F.col("_hash") <= F.lit(key)))
    return keep


def grades(labels: DataFrame, label: str) -> list[int]:
    """The distinct values of the label column: at most 100 of them."""
    rows = labels.select(labels[label].cast("int").alias("g")).where("g is not null").distinct().limit(101).collect()
    if len(rows) > 100:
        raise ValueError(f"{label} has more than 100 values; it is no grade")
    return sorted(r["g"] for r in rows)
