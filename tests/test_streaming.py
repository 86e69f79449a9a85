import pandas as pd
from pyspark.sql import functions as F

from runweave.operators import signals as S
from runweave.streaming import sinks, stateful


def feed(spark, tmp_path, batches, schema):
    """A stream that takes one batch a file, in order."""
    src = tmp_path / "src"
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
    return spark.readStream.schema(spark.createDataFrame(batches[0], schema).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(src))


def drain(spark, stream, tmp_path):
    sinks.collect_rows(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_idempotency_equals_its_batch_form(spark, tmp_path):
    schema = "key long, seq long, at long, hash string"
    batches = [[(1, 1, 0, "a"), (2, 2, 1, "a")], [(1, 3, 5, "a"), (1, 4, 6, "b")], [(1, 5, 10, "b"), (2, 6, 30, "z")]]
    got = drain(spark, stateful.idempotency(feed(spark, tmp_path, batches, schema), 10), tmp_path)
    want = S.idempotency(spark.createDataFrame(sum(batches, []), schema), 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_gates_fire_once(spark, tmp_path):
    schema = "name string, seq long, gate_id long, signal_id long"
    batches = [[("a", 0, None, 100), ("a", 1, 7, None), ("a", 2, 8, None), ("b", 3, 9, None)], [("a", 4, None, 101)], [("a", 5, None, 102), ("a", 6, 10, None)], [("b", 7, None, 103), ("a", 8, None, 104)]]
    got = drain(spark, stateful.one_shot_gates(feed(spark, tmp_path, batches, schema), 3), tmp_path)
    assert sorted(map(tuple, got.collect())) == [(7, 101), (8, 101), (9, 103), (10, 104)]


def test_frontier_moves_over_late_records_and_gaps(spark, tmp_path):
    batches = [[(1, 2, 2), (1, 0, 0)], [(1, 5, 5)], [(1, 1, 1)], [(1, 3, 4)]]
    got = drain(spark, stateful.log_frontiers(feed(spark, tmp_path, batches, "stream long, first long, last long")), tmp_path)
    assert sorted(r.frontier for r in got.collect()) == [0, 2, 5]


def test_liveness_reports_silence(spark, tmp_path):
    t = lambda s: pd.Timestamp(s, unit="s").to_pydatetime()
    batches = [[("x", t(1000)), ("y", t(1000))], [("x", t(1050))], [("x", t(1500))], [("x", t(1501))]]
    got = drain(spark, stateful.liveness(feed(spark, tmp_path, batches, "key string, ts timestamp"), 120), tmp_path)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [("x", "Healthy", 1000), ("x", "Healthy", 1500), ("x", "Unhealthy", 1170), ("y", "Healthy", 1000), ("y", "Unhealthy", 1120)]


def test_append_numbers_new_ids_once(spark, tmp_path):
    batches = [[(1, 0), (2, 0), (2, 0)], [(2, 0), (5, 0)], [(3, 0)]]
    s = feed(spark, tmp_path, batches, "id long, ts long")
    sinks.append_events(s, str(tmp_path / "log"), str(tmp_path / "state"), ["id", "ts"]).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).select("id", "seq").collect())) == [(1, 1), (2, 2), (3, 4), (5, 3)]


def test_upsert_refuses_rows_that_are_not_terminal(spark, tmp_path):
    batches = [[(1, "Completed", 1), (2, "InProgress", 1)], [(1, "Failed", 2), (3, "Completed", 1)]]
    s = feed(spark, tmp_path, batches, "id long, state string, arrival int")
    sinks.upsert_runs(s, str(tmp_path / "runs"), str(tmp_path / "state"), "id", "arrival").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "runs" / "batch=1")).select("id", "state", F.lit(1))
    assert sorted(map(tuple, got.collect())) == [(1, "Failed", 1), (3, "Completed", 1)]


def test_idempotency_calls_python_by_bucket_and_not_by_key(spark, tmp_path):
    schema = "key long, seq long, at long, hash string"
    big = 2**60 + 1
    batches = [[(big + i, i, 0, "a") for i in range(300)] + [(None, 300, 0, "a")], [(big + i, 400 + i, 5, "ab"[i % 2]) for i in range(300)] + [(None, 700, 5, "b")]]
    s = stateful.idempotency(feed(spark, tmp_path, batches, schema), 10, 2)
    q = s.writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    got = {(r.key, r.seq): (r.outcome, r.original) for r in spark.table("held").collect()}
    want = {(big + i, i): ("Fresh", i) for i in range(300)} | {(big + i, 400 + i): (("Dedup", "Conflict")[i % 2], i) for i in range(300)} | {(None, 300): ("Fresh", 300), (None, 700): ("Conflict", 300)}
    assert got == want


def test_gates_keep_every_digit_of_their_ids(spark, tmp_path):
    big = 2**60 + 1
    batches = [[("a", big, big, None), ("a", big + 2, None, big + 7), ("a", big + 4, big + 9, None)], [("a", big + 6, big, None), ("a", big + 8, None, big + 11), ("a", big + 8, big + 13, None)]]
    got = drain(spark, stateful.one_shot_gates(feed(spark, tmp_path, batches, "name string, seq long, gate_id long, signal_id long"), 3), tmp_path)
    assert sorted(map(tuple, got.collect())) == [(big, big + 7), (big, big + 11), (big + 9, big + 11), (big + 13, big + 11)]
