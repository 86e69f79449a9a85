"""Workflow-history relations over the driver's tables, as DataFrames and as SQL CTEs.

Each relation is defined twice, once for Spark and once for the SQL that checks it; the
definitions are pure projections, so predicates and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: event types an event log may hold, in the order of their index
EVENT_TYPES = [
    "CreateWorkflowInstance", "CancelWorkflowInstance", "TickReceived", "WorkflowSubmitted", "WorkflowInstanceCreated", "WorkflowTriggered", "WorkflowCompleted", "WorkflowFailed",
    "TaskInstanceCreated", "TaskQueued", "TaskDelivered", "TaskAssigned", "TaskStarted", "TaskCompleted", "TaskFailed", "TaskParked", "TaskCancelled",
    "GateDispatched", "GateOutcome", "GateTimeoutFired", "SomethingNew",
]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def _at(base: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(base) + seconds)


class Fixtures:
    """Relations of one table folder."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def raw(self, name: str) -> DataFrame:
        return _read(self.spark, self.sf, name)

    def runs(self) -> DataFrame:
        k = F.col("o_orderkey")
        planned = _at(F.col("o_orderdate"), k * 7919 % 86400)
        state = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "P", "Failed").otherwise("InProgress")
        return self.raw("orders").select(
            k.alias("id"), (F.col("o_custkey") % 50).alias("workflow_id"), state.alias("state"), F.when(k % 97 != 0, planned).alias("scheduled_at"), _at(planned, k % 7200).alias("archived_at"), (k % 5).alias("task_count"))

    def archive(self) -> DataFrame:
        return self.runs().where(F.col("state").isin("Completed", "Failed"))

    def live(self) -> DataFrame:
        r = self.runs().where((F.col("state") == "InProgress") | (F.col("id") % 10 == 0))
        state = F.when(F.col("id") % 7 == 0, "Scheduled").when(F.col("id") % 11 == 0, "PendingSchedule").when(F.col("id") % 13 == 0, "Triggered").otherwise("InProgress")
        return r.select("id", "workflow_id", state.alias("state"), "scheduled_at", "task_count", F.least("task_count", F.lit(2)).alias("completed_tasks"))

    def attempts(self) -> DataFrame:
        n = F.col("l_linenumber")
        state = F.when(F.col("l_linestatus") == "F", "Failed").when(F.col("l_returnflag") == "N", "Running").otherwise("Completed")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("task_id"), (n - 1).cast("int").alias("attempt"), F.col("l_suppkey").alias("executor_id"), state.alias("state"),
            F.col("l_shipdate").alias("started_at"), F.when(state != "Running", _at(F.col("l_shipdate"), (F.col("l_quantity") * 60).cast("long"))).alias("completed_at"),
            F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice").alias("pos"))

    def definitions(self) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("p_size") % 5
        status = F.when(s == 0, "Building").when(s == 1, "BuildFailed").when(s == 2, "Submitted").otherwise("Ready")
        return self.raw("part").select((k % 50).alias("id"), F.floor(k / 50).alias("version"), status.alias("status"), F.col("p_name").alias("name"), (k * 37 % 1000).alias("inserted_at"), F.md5("p_type").alias("content_hash"), F.md5("p_brand").alias("cosmetic_hash"))

    def events(self) -> DataFrame:
        e = F.col("event_id")
        kind = F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (e % len(EVENT_TYPES) + 1).cast("int"))
        u = F.col("user_id").cast("string")
        body = F.concat(F.lit('{"workflow_instance_id":"'), u, F.lit('","task_instance_id":"'), (e % 37).cast("string"), F.lit('","reason":"r'), (e % 3).cast("string"), F.lit('"}'))
        payload = F.when(e % 50 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"'), kind, F.lit('":'), body, F.lit("}")))
        return self.raw("events").select((e + 1).alias("seq"), e.alias("id"), "ts", kind.alias("event_type"), payload.alias("payload"), _at(F.col("ts"), e % 17).alias("archived_at"))

    def signals(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        v = F.floor("value")
        payload = F.concat(F.lit('{"v":'), v.cast("string"), F.lit(',"k":'), k.cast("string"), F.lit(',"user":{"id":'), F.col("user_id").cast("string"), F.lit(',"tags":["a","t'), (k % 4).cast("string"), F.lit('"]},"none":null}'))
        return self.raw("events").select(F.col("event_id").alias("signal_id"), F.col("event_type").alias("name"), "ts", payload.alias("payload"), k.alias("k"), v.cast("long").alias("v"), "user_id")

    def logs(self) -> DataFrame:
        return self.raw("conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("sequence"), F.col("text").alias("bytes"))

    def nodes(self) -> DataFrame:
        k = F.col("p_partkey")
        ground = F.when(k % 6 == 0, "failed").when(k % 6 < 4, "success").otherwise("pending")
        return self.raw("part").select(k.alias("id"), ground.alias("ground"), F.when(k % 9 == 0, "sentinel").otherwise("task").alias("kind"), (k % 4 != 0).alias("minted"), "p_name")

    def edges(self) -> DataFrame:
        """Hyperedges: k and, for every third, its neighbour below, to 2k and 2k + 1; every tenth is on a loop."""
        n = self.nodes().select("id")
        span = n.agg(F.max("id").alias("top"), F.min("id").alias("low"))
        e = n.join(F.broadcast(span)).where("id > 0 and id * 2 <= top")
        sources = F.when((F.col("id") % 3 == 0) & (F.col("id") - 1 > F.col("low")), F.array(F.col("id") - 1, F.col("id"))).otherwise(F.array("id"))
        targets = F.filter(F.array(F.col("id") * 2, F.col("id") * 2 + 1), lambda x: x <= F.col("top"))
        fwd = e.select(F.col("id").alias("edge"), F.lit("plain").alias("kind"), sources.alias("sources"), targets.alias("targets"))
        loop = e.where("id % 10 = 0")
        back = loop.select((F.col("id") * -2).alias("edge"), F.lit("loop").alias("kind"), F.array(F.col("id") * 2).alias("sources"), F.array("id").alias("targets"))
        again = loop.select((F.col("id") * -2 - 1).alias("edge"), F.lit("loop").alias("kind"), F.array("id").alias("sources"), F.array(F.col("id") * 2).alias("targets"))
        return fwd.unionByName(back).unionByName(again)


_TYPES = "[" + ", ".join(f"'{t}'" for t in EVENT_TYPES) + "]"

CTES = {
    "runs": """SELECT o_orderkey AS id, o_custkey % 50 AS workflow_id,
  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Failed' ELSE 'InProgress' END AS state,
  CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate + to_seconds(o_orderkey * 7919 % 86400) END AS scheduled_at,
  o_orderdate + to_seconds(o_orderkey * 7919 % 86400) + to_seconds(o_orderkey % 7200) AS archived_at, o_orderkey % 5 AS task_count FROM orders""",
    "archive": "SELECT * FROM runs WHERE state IN ('Completed', 'Failed')",
    "live": """SELECT id, workflow_id, CASE WHEN id % 7 = 0 THEN 'Scheduled' WHEN id % 11 = 0 THEN 'PendingSchedule' WHEN id % 13 = 0 THEN 'Triggered' ELSE 'InProgress' END AS state,
  scheduled_at, task_count, least(task_count, 2) AS completed_tasks FROM runs WHERE state = 'InProgress' OR id % 10 = 0""",
    "attempts": """SELECT *, CASE WHEN state <> 'Running' THEN started_at + to_seconds((q * 60)::BIGINT) END AS completed_at FROM (
  SELECT l_orderkey AS run_id, l_partkey AS task_id, (l_linenumber - 1)::INTEGER AS attempt, l_suppkey AS executor_id,
  CASE WHEN l_linestatus = 'F' THEN 'Failed' WHEN l_returnflag = 'N' THEN 'Running' ELSE 'Completed' END AS state, l_shipdate AS started_at, l_quantity AS q, l_extendedprice AS price FROM lineitem)""",
    "definitions": """SELECT p_partkey % 50 AS id, p_partkey // 50 AS version, CASE p_size % 5 WHEN 0 THEN 'Building' WHEN 1 THEN 'BuildFailed' WHEN 2 THEN 'Submitted' ELSE 'Ready' END AS status,
  p_name AS name, p_partkey * 37 % 1000 AS inserted_at, md5(p_type) AS content_hash, md5(p_brand) AS cosmetic_hash FROM part""",
    "evs": f"""SELECT event_id + 1 AS seq, event_id AS id, ts, event_type, CASE WHEN event_id % 50 = 0 THEN '{{}}' ELSE '{{"' || event_type || '":{{"workflow_instance_id":"' || user_id || '","task_instance_id":"' || (event_id % 37) || '","reason":"r' || (event_id % 3) || '"}}}}' END AS payload,
  ts + to_seconds(event_id % 17) AS archived_at, user_id FROM (SELECT event_id, ts, user_id, ({_TYPES})[event_id % {len(EVENT_TYPES)} + 1] AS event_type FROM events)""",
    "signals": """SELECT event_id AS signal_id, event_type AS name, ts, (props->>'$.k')::INTEGER AS k, floor(value)::BIGINT AS v, user_id FROM events""",
    "logs": "SELECT conv_id AS stream, turn AS sequence, text AS bytes FROM conversations",
    "nodes": """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'failed' WHEN p_partkey % 6 < 4 THEN 'success' ELSE 'pending' END AS ground,
  CASE WHEN p_partkey % 9 = 0 THEN 'sentinel' ELSE 'task' END AS kind, p_partkey % 4 <> 0 AS minted, p_name FROM part""",
    "edges": """SELECT id AS edge, 'plain' AS kind, CASE WHEN id % 3 = 0 AND id - 1 > low THEN [id - 1, id] ELSE [id] END AS sources, [x FOR x IN [id * 2, id * 2 + 1] IF x <= top] AS targets
  FROM (SELECT p_partkey AS id FROM part), (SELECT max(p_partkey) AS top, min(p_partkey) AS low FROM part) WHERE id > 0 AND id * 2 <= top
  UNION ALL SELECT x, 'loop', CASE WHEN x % 2 = 0 THEN [id * 2] ELSE [id] END, CASE WHEN x % 2 = 0 THEN [id] ELSE [id * 2] END
  FROM (SELECT id, unnest([id * -2, id * -2 - 1]) AS x FROM (SELECT p_partkey AS id FROM part), (SELECT max(p_partkey) AS top FROM part) WHERE id > 0 AND id * 2 <= top AND id % 10 = 0)""",
    "adj": "SELECT edge, kind, s, unnest(targets) AS t FROM (SELECT edge, kind, unnest(sources) AS s, targets FROM edges)",
}
NEEDS = {"archive": ["runs"], "live": ["runs"], "adj": ["edges"]}


def with_relations(names: str, body: str, recursive: str = "") -> str:
    """`body` after the CTEs it names (and those they need); `recursive` holds further CTEs."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
