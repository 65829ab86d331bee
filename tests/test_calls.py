"""Providers that hang, fail or die, and models that are loaded once."""

import multiprocessing
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from inkdiff.functions.calls import WORKERS, call_each
from inkdiff.operators import align, report


def test_a_thousand_calls_of_a_dead_function_take_one_limit():
    began, threads = time.monotonic(), threading.active_count()
    found = call_each(lambda x: time.sleep(600), list(range(1000)), 1.0)
    assert time.monotonic() - began < 5
    assert all(isinstance(x, TimeoutError) for x in found) and len(found) == 1000
    assert sum("no reply after 1.0 s" in str(x) for x in found) == WORKERS
    assert threading.active_count() == threads and not multiprocessing.active_children()


def test_each_call_has_its_own_limit_and_error():
    def odd(x):
        if x % 5 == 0:
            time.sleep(600)
        if x % 5 == 1:
            raise ValueError(f"bad {x}")
        if x == 7:
            os._exit(1)
        return x * x

    found = call_each(odd, list(range(20)), 1.0, workers=5)
    for x, r in enumerate(found):
        if x % 5 == 0:
            assert isinstance(r, TimeoutError)
        elif x % 5 == 1:
            assert isinstance(r, RuntimeError) and str(r) == f"bad {x}"
        elif x == 7:
            assert str(r) == "the call's process ended"
        else:
            assert r == x * x
    assert call_each(odd, [], 1.0) == []


class Hanging(report.Provider):
    def __init__(self, name, sleeps, available=True):
        self.name, self.sleeps, self.available = name, sleeps, available

    def is_available(self):
        if self.available is None:
            time.sleep(600)
        return True

    def generate(self, prompts, timeout):
        time.sleep(self.sleeps)
        return [f"{self.name}: {p}" for p in prompts]


def test_a_hanging_provider_is_passed_over():
    prompts, dead = [str(k) for k in range(1000)], set()
    began = time.monotonic()
    got = report.ask_providers(prompts, (Hanging("late", 600), Hanging("quick", 0)), 1.0, dead)
    assert time.monotonic() - began < 8 and dead == {"late"}
    assert [r["reply"] for r in got] == [f"quick: {p}" for p in prompts] and all(r["reason"].startswith("late failed: ") for r in got)
    began = time.monotonic()
    again = report.ask_providers(["x"], (Hanging("late", 600), Hanging("quick", 0)), 1.0, dead)
    assert time.monotonic() - began < 0.9 and again[0]["reply"] == "quick: x" and again[0]["reason"] == "late failed: it gave no reply before"
    (mute,) = report.ask_providers(["x"], (Hanging("mute", 0, None),), 0.3)
    assert mute["reply"] is None and mute["reason"] == "mute failed: no reply after 0.3 s" and not mute["failed"]


@pytest.mark.parametrize("fails", [False, True])
def test_a_model_is_loaded_once_a_process(spark, tmp_path, fails):
    """Loads are counted, not batches: many batches and tasks, as many loads as processes."""
    log = tmp_path / "loads"
    log.mkdir()

    def load():
        (log / f"{os.getpid()}-{time.monotonic_ns()}").write_text("")
        if fails:
            raise OSError("no model here")
        return lambda texts: [[float(len(t)), float(os.getpid())] for t in texts]

    rows = spark.range(400).repartition(8).selectExpr("concat('text ', id) as text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for _ in range(2):
            got = align.embed_clauses(rows, load=load, model=f"m-{tmp_path}").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pids = [p.name.split("-")[0] for p in log.iterdir()]
    assert len(pids) == len(set(pids)) <= 8
    if fails:
        assert all(r["embedding"] is None for r in got)
    else:
        assert all(r["embedding"][0] == len(r["text"]) for r in got) and {str(int(r["embedding"][1])) for r in got} <= set(pids)


def test_a_reply_that_is_no_object_is_a_failure():
    class Says(Hanging):
        def generate(self, prompts, timeout):
            return [{"a": "sorry, no", "b": "[1]", "c": '\n```json\n{"summary": "s"}\n```\n'}[p] for p in prompts]

    got = report.ask_providers(["a", "b", "c"], (Says("model", 0),), 5, check=report.readable)
    assert [r["reply"] is None for r in got] == [True, True, False]
    assert got[0]["reason"].startswith("model failed: Expecting value") and got[1]["reason"] == "model failed: the reply is no JSON object"


def test_summaries_of_hanging_providers(spark):
    class Late(report.Provider):  # here, so that workers get it by value
        name = "late"

        def is_available(self):
            return True

        def generate(self, prompts, timeout):
            time.sleep(600)

    changes = spark.range(300).select(
        F.lit("substantive").alias("change_type"), F.expr("array(named_struct('signal_type', 's', 'description', 'd', 'old_value', 'o', 'new_value', 'n'))").alias("signals"),
        *[F.lit("x").alias(f"{c}_{s}") for c in ("document_name", "clause_id", "text") for s in "ab"], *[F.lit(1).alias(f"page_number_{s}") for s in "ab"],
    ).coalesce(1)
    began = time.monotonic()
    got = report.generate_summaries(changes, (Late(),), 1).select("summary.*").collect()
    assert time.monotonic() - began < 20 and {r["provider_used"] for r in got} == {"deterministic"} and all(r["fallback_reason"].startswith("late failed: ") for r in got)
