"""Byte-level BPE encoding and decoding with a local rank file.

`bpe_encode` appends the ids of each text as little-endian unsigned 32-bit integers in one binary column, the form in
which token shards are stored; `bpe_decode` turns such a column back into raw bytes. The rank file is read on the
driver and broadcast: its size is checked against `max_rank_bytes`, and it does not grow with the data. `bpe_both` does
both in one step: encoding and decoding as two steps of a task take two Python workers for it, each with its own ranks.

Long texts are cut before the tokenizer's regular expression runs, if it is the public one, for which the rule holds;
with any other expression a text is encoded whole. A cut falls only between a character that is not
white space and a white space one: no match of the pattern spans such a place, so the ids are those of the whole text.
White space runs of RUN characters or more, which overflow the expression's stack, are encoded as the single match
that they are. Null texts count as empty and have no ids; rows that repeat an id or text are encoded alike; an empty
table gives an empty one. A column of the result's name is replaced, other columns are kept as they are.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What \s of the tokenizer's expression matches.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN, CHUNK = 4096, 1 << 16
_LONG_RUN = re.compile(f"[{WHITE}]{{{RUN},}}")
_SAFE = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
_MAX_RANK_BYTES = 64 << 20
_encoders: dict = {}


def segments(text: str, chunk: int = CHUNK):
    """(is_single_match, piece) for consecutive pieces of text, cut at places that no match spans."""
    if len(text) <= chunk:
        yield False, text
        return
    at = 0
    for run in [*_LONG_RUN.finditer(text), None]:
        end = run.start() if run else len(text)
        while end - at > chunk and (cut := _SAFE.search(text, at + chunk, end)):
            yield False, text[at : cut.start()]
            at = cut.start()
        if end > at:
            yield False, text[at:end]
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1  # the last one joins what follows
            yield True, text[end:at]


def encode_text(encoding, text: str, chunk: int = CHUNK) -> list[int]:
    ids: list[int] = []
    for single, piece in segments(text, chunk):
        ids += encoding._encode_single_piece(piece) if single else encoding.encode_ordinary(piece)
    return ids


def encoding_of(rank_lines: bytes, pattern: str):
    """A tiktoken Encoding without special tokens; built once in each Python process."""
    import tiktoken

    key = (hash(rank_lines), len(rank_lines), pattern)
    if key not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_lines.splitlines()) if token}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        lines = f.read(_MAX_RANK_BYTES + 1)
    if len(lines) > _MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {_MAX_RANK_BYTES} bytes; it is no rank file")
    return spark.sparkContext.broadcast(lines)


def bpe_encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """df with the ids of column `text` as little-endian uint32 bytes in column `into`."""
    import public_tokenizers

    lines, cut = _ranks(df.sparkSession, rank_file), pattern == public_tokenizers.PATTERN

    def encode(texts: pa.Array) -> pa.Array:
        return _packed_ids(encoding_of(lines.value, pattern), texts, cut)

    kernel = F.arrow_udf(encode, "binary").asNondeterministic()  # evaluated once, whatever uses its column
    return df.withColumn(into, kernel(F.coalesce(df[text], F.lit(""))))


def bpe_decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """df with the raw bytes of the ids in column `ids` in column `into` (null ids: no bytes)."""
    lines = _ranks(df.sparkSession, rank_file)

    def decode(packed: pa.Array) -> pa.Array:
        return _raw_bytes(encoding_of(lines.value, pattern), packed)

    kernel = F.arrow_udf(decode, "binary").asNondeterministic()
    return df.withColumn(into, kernel(F.coalesce(df[ids], F.lit(b""))))


def bpe_both(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of column `text` in column `ids` and the raw bytes of those ids in column `decoded`, by one worker a task."""
    import public_tokenizers

    lines, cut = _ranks(df.sparkSession, rank_file), pattern == public_tokenizers.PATTERN

    def both(texts: pa.Array) -> pa.Array:
        enc = encoding_of(lines.value, pattern)
        packed = _packed_ids(enc, texts, cut)
        return pa.StructArray.from_arrays([packed, _raw_bytes(enc, packed)], names=["ids", "decoded"])

    kernel = F.arrow_udf(both, "ids binary, decoded binary").asNondeterministic()
    coded = df.withColumn("_coded", kernel(F.coalesce(df[text], F.lit(""))))
    return coded.withColumns({ids: F.col("_coded.ids"), decoded: F.col("_coded.decoded")}).drop("_coded")


def _packed_ids(encoding, texts: pa.Array, cut: bool) -> pa.Array:
    import numpy as np

    ids = (encode_text(encoding, x.as_py()) if cut else encoding.encode_ordinary(x.as_py()) for x in texts)
    return pa.array((np.array(own, dtype="<u4").tobytes() for own in ids), pa.binary())


def _raw_bytes(encoding, packed: pa.Array) -> pa.Array:
    import numpy as np

    return pa.array((encoding.decode_bytes(np.frombuffer(x.as_py(), dtype="<u4").tolist()) for x in packed), pa.binary())


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs."""
    import public_tokenizers

    where, how = rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    both = bpe_both(docs.select("doc_id", "text"), where, how)
    return both.select(
        "doc_id",
        n_tokens(F.col("token_ids")).alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
