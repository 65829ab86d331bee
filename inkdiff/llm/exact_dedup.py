"""Exact duplicate removal with a two-pass Bloom filter, in DataFrame operations only.

Pass 1 sets two bits for each row's text hash in a blocked Bloom filter and keeps the bits that two rows or more have
set. The blocks (4 KB bitmaps) form a table of `blocks` rows at most, by default as many as the rows ask for (16 bits a
row) within MOST_BLOCKS, 64 MB in all, so it is broadcast. Pass 2 tests each row's bits. Only rows whose bits are all set
repeatedly can have a copy; they alone are shuffled and grouped by the SHA-256 of their text, and the rest passes straight
through. With more rows than the filter is made for, more rows are shuffled and none is lost.

Groups of two rows or more are counted by partial aggregates and written; then the rows are joined with them. Both sides
of that join are plain shuffles, so Spark may split a group of any size, and no task gathers one. Null texts count as
empty. Of equal texts the row with the largest id stays; rows that repeat both id and text are all marked as kept by
`mark_duplicates`, and `drop_duplicates` leaves one of them. A null id loses against any other; a group that has null
ids only has keep_id null and keeps its rows (`drop_duplicates`: one of them). An empty table gives an empty result.
Other columns are not touched; `mark_duplicates` returns the key and its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

BLOCK_BITS = 32768  # of one bitmap of bitmap_construct_agg
BLOCKS, MOST_BLOCKS = 2048, 16384
BITS_A_ROW = 16


def _block(blocks: int) -> Column:
    return F.pmod(F.col("_hash"), F.lit(blocks)).cast("int")


def _bits() -> list[Column]:
    return [F.shiftrightunsigned("_hash", n).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("long") for n in (15, 40)]


def repeated_bits(hashes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(_block, _bitmap) with the bits that two rows or more of hashes(_hash) have set."""
    bits = hashes.select(_block(blocks).alias("_block"), F.explode(F.array(*_bits())).alias("_bit"))
    often = bits.groupBy("_block", "_bit").agg(F.count("*").alias("_n")).where("_n >= 2")
    return often.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def is_set(bit: Column) -> Column:
    """Is this bit of _bitmap set? Null without a bitmap."""
    byte = F.substring(F.col("_bitmap"), (bit / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1


def blocks_for(rows: int) -> int:
    """A power of two within BLOCKS and MOST_BLOCKS."""
    return min(MOST_BLOCKS, max(BLOCKS, 1 << (rows * BITS_A_ROW // BLOCK_BITS).bit_length()))


def _split(rows: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The rows that may have a copy, and the rest."""
    filled = F.broadcast(repeated_bits(rows.select("_hash"), blocks))
    tested = rows.withColumn("_block", _block(blocks)).join(filled, "_block", "left")
    maybe = F.coalesce(is_set(_bits()[0]) & is_set(_bits()[1]), F.lit(False))
    tested = tested.withColumn("_maybe", maybe).drop("_block", "_bitmap")
    return tested.where("_maybe").drop("_maybe"), tested.where("not _maybe").drop("_maybe")


def _groups(maybe: DataFrame) -> DataFrame:
    """(_sha, _keep, _size, _times) of the texts of two rows or more: the id that stays, and how many rows have it."""
    by_id = maybe.groupBy("_sha", "_id").agg(F.count("*").alias("_n"))
    grouped = by_id.groupBy("_sha").agg(F.max(F.struct("_id", "_n")).alias("_m"), F.sum("_n").alias("_size")).where("_size > 1")
    return materialize(grouped.select("_sha", F.col("_m._id").alias("_keep"), "_size", F.col("_m._n").alias("_times")), "copies")


def mark_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """One row for each row of df: the key, keep_id, group_size, kept, text_sha256."""
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(df[key].alias("_id"), F.xxhash64(body).alias("_hash"), F.sha2(body, 256).alias("_sha"))
    maybe, alone = _split(rows, blocks or blocks_for(df.count()))
    found = maybe.join(_groups(maybe.select("_sha", "_id")), "_sha", "left").withColumn("_single", F.col("_size").isNull())
    keep = F.when(F.col("_single"), F.col("_id")).otherwise(F.col("_keep"))
    grouped = found.select("_id", keep.alias("_keep"), F.coalesce("_size", F.lit(1).cast("long")).alias("_size"), F.col("_id").eqNullSafe(keep).alias("_kept"), "_sha")
    passed = alone.select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"), "_sha")
    return grouped.union(passed).toDF(key, "keep_id", "group_size", "kept", "text_sha256")


def drop_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """The rows of df that stay, with df's columns. Rows that cannot have a copy are not shuffled."""
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(df[key].alias("_id"), F.struct("*").alias("_row"), F.xxhash64(body).alias("_hash"), F.sha2(body, 256).alias("_sha"))
    maybe, alone = _split(rows, blocks or blocks_for(df.count()))
    found = maybe.join(_groups(maybe.select("_sha", "_id")), "_sha", "left").where(F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    once = found.where("_size is null or _times = 1")
    again = found.where("_size is not null and _times > 1").dropDuplicates(["_sha"])  # rows that repeat both id and text
    return once.select("_row.*").union(again.select("_row.*")).union(alone.select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    return mark_duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
"""
