"""How many Python workers a task has, and what the largest group of the n-gram join holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

import corpus_pipeline
from inkdiff.llm import bpe, ngram_join

SCHEMA = "doc_id long, text string"
HOW = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def python_steps(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(name) for name in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow"))


def test_encoding_and_decoding_take_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (3, "é  \n" * 50)], SCHEMA)
    assert python_steps(corpus_pipeline.encode(spark, docs, "")) == 1 and python_steps(bpe.round_trip(docs)) == 1
    both = bpe.bpe_both(docs, *HOW)
    assert both.columns == ["doc_id", "text", "token_ids", "decoded"] and python_steps(both) == 1
    apart = bpe.bpe_decode(bpe.bpe_encode(docs, *HOW), *HOW)
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))


def bucket_of(classes: int, each: int, shared: int) -> pa.Table:
    """Tokens of many classes, in batches of 100 classes; `shared` of each class's are also its neighbour's."""
    r = np.random.default_rng(7)
    own = r.integers(0, 1 << 40, (classes, each), dtype=np.uint64)
    own[1::2, :shared] = own[0:-1:2, :shared]
    rows = []
    for k in range(0, classes, 100):
        some = np.sort(own[k : k + 100], axis=1)
        names = np.arange(k, k + len(some), dtype=np.int64)
        rows.append((0, ngram_join._narrow(some.ravel()), np.full(len(some), each, np.int32).tobytes(), names.tobytes(), np.full(len(some), 9 * each, np.int32).tobytes()))
    return pa.table({name: pa.array([x[j] for x in rows], pa.int32() if not j else pa.binary()) for j, name in enumerate(("bucket", "tokens", "held", "names", "sizes"))})


def test_a_bucket_holds_few_bytes_a_posting():
    group = bucket_of(4000, 50, 10)
    some = np.unique(ngram_join._wide(group.column("tokens")[0].as_py()))[:300]
    for known, most in ((some, 60), (some[:0], 40)):  # 93 and 51 when the classes of tokens that are alone were held too
        tracemalloc.start()
        out = ngram_join.count_bucket(group, 4, known, dict.fromkeys(known.tolist(), 99))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * 4000 * 50
    held = np.concatenate([np.frombuffer(x, np.int32) for x in out.column("held").to_pylist()])
    assert len(held) == 4000 and set(held.tolist()) == {10}


def test_a_known_token_keeps_its_number_of_classes():
    group = bucket_of(20, 5, 2)
    token = int(ngram_join._wide(group.column("tokens")[0].as_py())[0])
    out = ngram_join.count_bucket(group, 1, np.array([token], np.uint64), {token: 77})
    assert sorted(set(np.concatenate([np.frombuffer(x, np.int32) for x in out.column("dfs").to_pylist()]).tolist()))[-1] == 77
