from inkdiff.streaming import states


def test_session_states_of_a_stream(spark, tmp_path):
    rows = [("s", 1, "IDLE"), ("s", 2, "COMPLETED"), ("t", 1, "FAILED")]
    spark.createDataFrame(rows, "session_id string, seq long, state string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, seq long, state string").parquet(str(tmp_path / "in"))
    out = states.current_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").start()
    out.processAllAvailable()
    out.stop()
    assert {r["session_id"]: (r["state"], r["transitions"]) for r in spark.table("states").collect()} == {"s": ("COMPLETED", 2), "t": ("FAILED", 1)}
