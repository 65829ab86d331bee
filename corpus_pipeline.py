"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns documents' columns; the
last returns the token ids. Stages are written as Parquet in the shared folder and read again, so a lost executor costs
its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkdiff.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from inkdiff.llm._shared import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under 0.5. Null and empty texts have no evidence; without labels of both kinds all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("input"), docs["text"].alias("text"))
    return toxicity.score_toxicity(rows, model, into="score").where("score < 0.5").select("input.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; null and empty texts are equal."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least doc_id. Texts without words are alone and stay, null ids too."""
    groups = ngram_join.group_near_copies(docs.select("doc_id", "text"))
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"]), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null texts have no words and stay."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leak.spans") == 0).select("input.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian uint32) and the digests of the ids and of what they decode to. Null texts count as empty."""
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.bpe_both(docs.select("doc_id", "text"), *how)
    return both.select("doc_id", bpe.n_tokens(F.col("token_ids")).alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: The toxicity stage and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is removed once the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(written)
        written = docs
    return docs
