"""Streaming forms over the fixtures, each run to the end and read back, checked by the SQL of the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators import signals as S
from runweave.operators.events import append_new
from runweave.sources import log_objects
from runweave.sources.fixtures import Fixtures
from runweave.streaming import sinks, stateful

from .catalogue import query
from .loops import cut, shared


def _stream(x: Fixtures, name: str) -> DataFrame:
    schema = x.spark.read.parquet(f"{x.sf}/{name}.parquet").schema
    r = x.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "4")
    return r.parquet(f"{x.sf}/{name}.parquet")


def _run(x: Fixtures, stream: DataFrame) -> DataFrame:
    """What an append stream wrote."""
    base = f"{shared(x.spark)}/stream-{uuid.uuid4().hex}"
    sinks.collect_rows(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return x.spark.read.schema(stream.schema).parquet(f"{base}/out")


class Streamed(Fixtures):
    """The same relations, read as a stream."""

    def raw(self, name: str) -> DataFrame:
        df = _stream(self, name)
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


@query("T1_stream_idempotency", """SELECT key, seq, CASE WHEN seq = first_value(seq) OVER w THEN 'Fresh' WHEN hash = first_value(hash) OVER w THEN 'Dedup' ELSE 'Conflict' END AS outcome, first_value(seq) OVER w AS original
  FROM (SELECT user_id * 100 + k AS key, signal_id AS seq, (v // 40)::VARCHAR AS hash FROM signals) WINDOW w AS (PARTITION BY key ORDER BY seq)""", "signals")
def _(x: Fixtures) -> DataFrame:
    s = Streamed(x.spark, x.sf).signals()
    return _run(x, stateful.idempotency(s.select((F.col("user_id") * 100 + F.col("k")).alias("key"), F.col("signal_id").alias("seq"), F.lit(0).cast("long").alias("at"), F.floor(F.col("v") / 40).cast("string").alias("hash")), 600))


@query("T5_stream_one_shot_gates", "SELECT gate_id, signal_id FROM (SELECT gate_id, (SELECT min(signal_id) FROM signals s WHERE s.name = gates.name AND s.signal_id > gates.gate_id) AS signal_id FROM gates) WHERE signal_id IS NOT NULL", "signals",
       "gates AS (SELECT signal_id AS gate_id, name FROM signals WHERE k % 4 = 0)")
def _(x: Fixtures) -> DataFrame:
    s = Streamed(x.spark, x.sf).signals()
    # every signal wakes its name's gates; those with k a multiple of 4 then register one
    none = F.lit(None).cast("long")
    kinds = F.array(F.struct((F.col("signal_id") * 2).alias("seq"), none.alias("gate_id"), F.col("signal_id").alias("signal_id")), F.when(F.col("k") % 4 == 0, F.struct((F.col("signal_id") * 2 + 1).alias("seq"), F.col("signal_id").alias("gate_id"), none.alias("signal_id"))))
    e = s.select("name", F.explode(kinds).alias("e")).where("e is not null").select("name", "e.seq", "e.gate_id", "e.signal_id")
    return _run(x, stateful.one_shot_gates(e))


@query("T6_stream_frontier", "SELECT stream, CASE WHEN stream % 3 = 1 THEN 1 ELSE max(sequence) END AS frontier FROM logs WHERE stream % 3 <> 1 OR sequence <> 2 GROUP BY stream", "logs")
def _(x: Fixtures) -> DataFrame:
    r = Streamed(x.spark, x.sf).logs().where("stream % 3 <> 1 or sequence <> 2").select("stream", F.col("sequence").alias("first"), F.col("sequence").alias("last"))
    return _run(x, stateful.log_frontiers(r)).groupBy("stream").agg(F.max("frontier").alias("frontier"))


@query("T8_stream_liveness")
def _(x: Fixtures) -> DataFrame:
    b = Streamed(x.spark, x.sf).raw("events").select(F.col("user_id").alias("key"), "ts")
    return _run(x, stateful.liveness(b, 7200))


@query("S3_event_source", "SELECT seq, event_type FROM evs", "evs")
def _(x: Fixtures) -> DataFrame:
    return _run(x, Streamed(x.spark, x.sf).events().select("seq", "event_type"))


@query("T3_stream_append", "SELECT id, row_number() OVER (ORDER BY id) AS seq FROM evs", "evs")
def _(x: Fixtures) -> DataFrame:
    base = f"{shared(x.spark)}/stream-{uuid.uuid4().hex}"
    e = Streamed(x.spark, x.sf).events().select("id", "ts", "event_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).drop("copy")
    sinks.append_events(e, f"{base}/log", f"{base}/state", ["id", "ts"]).awaitTermination()
    return x.spark.read.parquet(f"{base}/log").select("id", "seq")


@query("S6_terminal_run_sink", "SELECT id, state FROM archive", "archive")
def _(x: Fixtures) -> DataFrame:
    base = f"{shared(x.spark)}/stream-{uuid.uuid4().hex}"
    r = Streamed(x.spark, x.sf).runs().select("id", "state", F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"))
    sinks.upsert_runs(r, f"{base}/runs", f"{base}/state", "id", "arrival").awaitTermination()
    last = x.spark.read.parquet(f"{base}/runs").agg(F.max("batch")).first()[0]
    return x.spark.read.parquet(f"{base}/runs/batch={last}").select("id", "state")


@query("T11_repeated_batch_converges", "SELECT id, row_number() OVER (ORDER BY id) AS seq FROM evs", "evs")
def _(x: Fixtures) -> DataFrame:
    # the same batch delivered twice: the second adds nothing
    e = x.events().select("id", "ts")
    log = cut(append_new(e.limit(0).withColumn("seq", F.lit(0).cast("long")), e, ["id", "ts"]).select("id", "ts", "seq"))
    return log.select("id", "seq").unionByName(append_new(log, e, ["id", "ts"]).select("id", "seq"))


@query("S13_S7_log_objects", "SELECT stream, sequence, bytes FROM logs", "logs")
def _(x: Fixtures) -> DataFrame:
    path = f"{shared(x.spark)}/logs-{uuid.uuid4().hex}"
    log_objects.write_logs(x.logs(), path)
    return log_objects.read_logs(x.spark, path)


@query("T13_grace_sweep", "SELECT signal_id FROM signals WHERE NOT (k % 2 = 0 AND ts < TIMESTAMP '2024-01-15')", "signals")
def _(x: Fixtures) -> DataFrame:
    settled = F.when(F.col("k") % 2 == 0, F.col("ts"))
    return x.signals().where(settled.isNull() | ~(settled < F.expr("timestamp'2024-01-15'"))).select("signal_id")


@query("T10_lease_claim", "SELECT id FROM runs WHERE state = 'InProgress' AND (scheduled_at IS NULL OR scheduled_at <= '1998-01-01') ORDER BY archived_at, id LIMIT 16", "runs")
def _(x: Fixtures) -> DataFrame:
    r = x.runs().where((F.col("state") == "InProgress") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= F.expr("timestamp'1998-01-01'"))))
    return r.orderBy("archived_at", "id").limit(16).select("id")


@query("T17_exit_against_liveness", "SELECT k AS dispatch, arg_min(CASE WHEN v > 50 THEN 'exit' ELSE 'lost' END, signal_id) AS winner FROM signals GROUP BY k", "signals")
def _(x: Fixtures) -> DataFrame:
    s = x.signals().select(F.col("k").alias("dispatch"), "signal_id", F.when(F.col("v") > 50, "exit").otherwise("lost").alias("winner"))
    return S.first_wins(s, ["dispatch"], ["signal_id"]).select("dispatch", "winner")


@query("T2_reservations", "SELECT k AS key, CASE WHEN max(v) > 95 THEN 'Rejected' WHEN max(v) > 80 THEN 'Relayed' WHEN max(v) > 60 THEN 'Ready' ELSE 'Reserved' END AS stage FROM signals GROUP BY k", "signals")
def _(x: Fixtures) -> DataFrame:
    stages = ["Reserved", "Ready", "Relayed", "Rejected"]
    rank = F.when(F.col("v") > 95, 3).when(F.col("v") > 80, 2).when(F.col("v") > 60, 1).otherwise(0)
    return x.signals().groupBy(F.col("k").alias("key")).agg(F.element_at(F.array(*[F.lit(s) for s in stages]), F.max(rank) + 1).alias("stage"))


@query("Q14_patch_by_key", "SELECT id, version, status FROM definitions WHERE content_hash = md5('STANDARD ANODIZED') OR id = 3 AND version = 1", "definitions")
def _(x: Fixtures) -> DataFrame:
    return x.definitions().where((F.col("content_hash") == F.md5(F.lit("STANDARD ANODIZED"))) | (F.col("id") == 3) & (F.col("version") == 1)).select("id", "version", "status")


@query("Q15_health", "SELECT CASE WHEN max(ts) >= TIMESTAMP '2024-01-30' THEN 'healthy' ELSE 'degraded' END AS status, count(DISTINCT user_id) AS observed FROM signals", "signals")
def _(x: Fixtures) -> DataFrame:
    fresh = F.max("ts") >= F.expr("timestamp'2024-01-30'")
    return x.signals().agg(F.when(fresh, "healthy").otherwise("degraded").alias("status"), F.count_distinct("user_id").alias("observed"))
