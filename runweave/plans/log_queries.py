"""Log streams and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.operators import logs as L
from runweave.operators import timeline as T
from runweave.sources.fixtures import Fixtures

from .catalogue import query

#: records left out, and spans declared missing, to give the streams holes
_KEPT = "NOT (stream % 3 = 1 AND sequence = 2 OR stream % 5 = 2 AND sequence = 0)"
_RECS = f"recs AS (SELECT * FROM logs WHERE {_KEPT}), gaps AS (SELECT DISTINCT stream, 2 AS first, 2 AS last FROM logs WHERE stream % 6 = 1)"
_FRONT = "front AS (SELECT s.stream, (SELECT max(hi) FROM cover c WHERE c.stream = s.stream AND c.ok) AS frontier FROM (SELECT DISTINCT stream FROM cover) s)"
_COVER = """cover AS (SELECT stream, hi, count(*) OVER (PARTITION BY stream ORDER BY lo) = hi + 1 AS ok FROM (SELECT stream, sequence AS lo, sequence AS hi FROM recs UNION ALL SELECT stream, first, last FROM gaps))"""


def _records(x: Fixtures) -> DataFrame:
    return x.logs().where(_KEPT)


def _gaps(x: Fixtures) -> DataFrame:
    return x.logs().where("stream % 6 = 1").select("stream").distinct().select("stream", F.lit(2).cast("long").alias("first"), F.lit(2).cast("long").alias("last"))


@query("T6_frontier", "SELECT stream, frontier FROM front", "logs", f"{_RECS}, {_COVER}, {_FRONT}")
def _(x: Fixtures) -> DataFrame:
    return L.frontiers(_records(x), _gaps(x))


@query("T6_replay", "SELECT * FROM (SELECT stream, sequence AS first, 'record' AS kind FROM recs UNION ALL SELECT stream, first, 'gap' FROM gaps) JOIN front USING (stream) WHERE first <= frontier", "logs", f"{_RECS}, {_COVER}, {_FRONT}")
def _(x: Fixtures) -> DataFrame:
    f = L.frontiers(_records(x), _gaps(x))
    return L.replay(_records(x), _gaps(x)).select("stream", "first", "kind").join(f, "stream")


@query("T6_islands", "SELECT stream, min(sequence) AS lo, max(sequence) AS hi FROM (SELECT stream, sequence, sequence - row_number() OVER (PARTITION BY stream ORDER BY sequence) AS i FROM recs) GROUP BY stream, i", "logs", _RECS)
def _(x: Fixtures) -> DataFrame:
    return L.islands(_records(x))


@query("T19_evicted_chunks_are_gaps", "SELECT stream, count(*) AS n FROM gaps JOIN front USING (stream) WHERE first <= frontier GROUP BY stream", "logs", f"{_RECS}, {_COVER}, {_FRONT}")
def _(x: Fixtures) -> DataFrame:
    return L.replay(_records(x), _gaps(x)).where("kind = 'gap'").groupBy("stream").agg(F.count("*").alias("n"))


@query("T7_violations", """SELECT stream, sequence, arrival, CASE WHEN stream % 7 = 3 AND arrival > 1000 THEN 'AppendAfterTerminal' WHEN stream % 11 = 5 THEN 'InvalidContentDigest' WHEN arrival > 1000 AND stream % 2 = 0 THEN 'AlreadyAccepted' WHEN arrival > 1000 THEN 'IdentityContentConflict' WHEN stream % 6 = 1 AND sequence = 2 THEN 'AcceptedIdentityCoveredByGap' ELSE 'Accepted' END AS outcome
  FROM (SELECT stream, sequence, sequence AS arrival FROM logs UNION ALL SELECT stream, sequence, 1001 + sequence FROM logs WHERE sequence = 0)""", "logs")
def _(x: Fixtures) -> DataFrame:
    first = x.logs().select("stream", "sequence", F.col("sequence").alias("arrival"), F.coalesce("bytes", F.lit("")).alias("bytes"))
    again = first.where("sequence = 0").select("stream", "sequence", F.lit(1001).cast("long").alias("arrival"), F.when(F.col("stream") % 2 == 0, F.col("bytes")).otherwise(F.concat("bytes", F.lit("!"))).alias("bytes"))
    bad = F.col("stream") % 11 == 5
    s = first.unionByName(again).withColumn("digest", F.when(bad, "0").otherwise(F.sha2("bytes", 256))).withColumn("terminal_at", F.when(F.col("stream") % 7 == 3, 1000))
    return L.violations(s, _gaps(x))


@query("O12_log_tail", "SELECT stream, sequence, (SELECT count(*) FROM logs b WHERE b.stream = a.stream) > 2 AS has_earlier FROM logs a QUALIFY row_number() OVER (PARTITION BY stream ORDER BY sequence DESC) <= 2", "logs")
def _(x: Fixtures) -> DataFrame:
    return L.tails(x.logs(), 2).select("stream", "sequence", "has_earlier")


@query("O12_log_tail_before", "SELECT stream, sequence, (SELECT count(*) FROM logs b WHERE b.stream = a.stream AND b.sequence < 3) > 2 AS has_earlier FROM logs a WHERE sequence < 3 QUALIFY row_number() OVER (PARTITION BY stream ORDER BY sequence DESC) <= 2", "logs")
def _(x: Fixtures) -> DataFrame:
    return L.tails(x.logs(), 2, 3).select("stream", "sequence", "has_earlier")


@query("O13_log_cursor", "SELECT stream, sequence FROM logs WHERE sequence > 1", "logs")
def _(x: Fixtures) -> DataFrame:
    return L.after(x.logs(), 1).select("stream", "sequence")


@query("O17_bounded_tail_of_lines", "SELECT stream, sequence, greatest(0, len(l) - 2) AS hidden, array_to_string(l[greatest(1, len(l) - 1):], chr(10)) AS tail FROM (SELECT stream, sequence, string_split(coalesce(bytes, ''), chr(10)) AS l FROM logs)", "logs")
def _(x: Fixtures) -> DataFrame:
    n = F.size("l")
    d = x.logs().withColumn("l", F.split(F.coalesce("bytes", F.lit("")), "\n"))
    return d.select("stream", "sequence", F.greatest(F.lit(0), n - 2).cast("long").alias("hidden"), F.array_join(F.slice("l", F.greatest(F.lit(1), n - 1), n), "\n").alias("tail"))


@query("S8_store_fallback", "SELECT stream, sequence, CASE WHEN stream % 2 = 0 THEN 0 WHEN stream % 3 = 0 THEN 1 ELSE 2 END AS store FROM logs", "logs")
def _(x: Fixtures) -> DataFrame:
    d = x.logs().select("stream", "sequence")
    return L.with_fallback([d.where("stream % 2 = 0"), d.where("stream % 3 = 0"), d])


@query("Q10_log_view", "SELECT stream, sequence, CASE WHEN stream % 2 = 0 THEN 0 ELSE 1 END AS store FROM logs QUALIFY row_number() OVER (PARTITION BY stream ORDER BY sequence DESC) <= 3", "logs")
def _(x: Fixtures) -> DataFrame:
    d = x.logs()
    return L.tails(L.with_fallback([d.where("stream % 2 = 0"), d]), 3).select("stream", "sequence", "store")


@query("S10_prefix_scan", "SELECT stream, sequence FROM logs WHERE starts_with(stream || '/' || sequence, '1/') OR starts_with(stream || '/' || sequence, '2')", "logs")
def _(x: Fixtures) -> DataFrame:
    key = F.concat_ws("/", F.col("stream").cast("string"), F.col("sequence").cast("string"))
    return x.logs().where(key.startswith("1/") | key.startswith("2")).select("stream", "sequence")


@query("X20_exit_mapping", """SELECT stream, sequence, CASE WHEN sequence % 4 = 0 THEN stream ELSE -1 END AS exit_status,
  CASE sequence % 4 WHEN 1 THEN 'terminated without exit status' WHEN 2 THEN 'boom' WHEN 3 THEN 'Executor closed without controlled End-of-stream' END AS reason FROM logs""", "logs")
def _(x: Fixtures) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Status", "NoStatus", "Error", "Abnormal")]), (F.col("sequence") % 4 + 1).cast("int"))
    return x.logs().select("stream", "sequence", L.exit_marker(kind, F.col("stream"), F.lit("boom")).alias("e")).select("stream", "sequence", "e.exit_status", "e.reason")


@query("A13_record_set_digest", """SELECT stream, sha256('[' || string_agg('{"sequence":' || sequence || ',"digest":"' || sha256(bytes) || '"}', ',' ORDER BY sequence) || ']') AS digest FROM logs GROUP BY stream""", "logs")
def _(x: Fixtures) -> DataFrame:
    return L.record_digests(x.logs())


@query("X6_content_digest", "SELECT stream, sequence, sha256(bytes) AS digest FROM logs", "logs")
def _(x: Fixtures) -> DataFrame:
    return x.logs().select("stream", "sequence", F.sha2("bytes", 256).alias("digest"))


#: transitions of each run: which path it takes, by id
_PATHS = [
    ("Completed", ["PendingSchedule", "Triggered", "InProgress", "Completed"]), ("Failed", ["Queued", "Running", "Parked", "Queued", "Running", "Failed"]),
    ("Completed", ["Queued", "Assigned", "Running", "Parked", "Assigned", "Running", "Parked"]), ("Running", ["Queued", "Running", "Parked", "Running"]), ("Cancelled", ["Running", "Parked", "Cancelled"]),
]


def _instances(x: Fixtures) -> DataFrame:
    k = F.col("id")
    paths = F.array(*[F.struct(F.lit(s).alias("state"), F.array(*[F.lit(v) for v in p]).alias("p")) for s, p in _PATHS])
    d = x.runs().select("id", F.element_at(paths, (k % len(_PATHS) + 1).cast("int")).alias("q"))
    steps = F.transform("q.p", lambda v, i: F.struct(v.alias("to"), (k * 10 + i).alias("at")))
    return d.select("id", "q.state", steps.alias("transitions"), F.when(F.col("q.state") != "Running", k * 10 + 100).alias("completed_at"))


_INST = "inst AS (SELECT id, q.state AS state, q.p AS p FROM (SELECT id, ([" + ", ".join(f"{{'state': '{s}', 'p': {p}}}" for s, p in _PATHS) + "])[id % 5 + 1] AS q FROM runs))"


@query("P4_first_transitions", "SELECT id, CASE WHEN list_contains(p, 'Triggered') THEN id * 10 + list_position(p, 'Triggered') - 1 END AS triggered_at, CASE WHEN list_contains(p, 'InProgress') THEN id * 10 + list_position(p, 'InProgress') - 1 END AS first_started_at, CASE id % 5 WHEN 0 THEN id * 10 + 3 WHEN 1 THEN id * 10 + 5 WHEN 4 THEN id * 10 + 2 END AS first_completed_at FROM inst", "runs", _INST)
def _(x: Fixtures) -> DataFrame:
    return T.pivot_first(_instances(x)).select("id", "triggered_at", "first_started_at", "first_completed_at")


# windows each path draws: (index, state, token, outcome), worked out by hand
_DRAWN = {
    0: [(0, "PendingSchedule", "neutral", "PendingSchedule"), (1, "Triggered", "neutral", "Triggered"), (2, "InProgress", "success", "Completed")],
    1: [(1, "Running", "info", "Running"), (2, "Parked", "warning", "Parked"), (3, "Queued", "warning", "Queued"), (4, "Running", "destructive", "Failed")],
    3: [(1, "Running", "info", "Running"), (2, "Parked", "warning", "Parked"), (3, "Running", "info", "Running")],
    4: [(0, "Running", "info", "Running"), (1, "Parked", "warning", "Parked")],
}
_SEGS = "segs(m, i, state, token, outcome, is_last) AS (VALUES " + ", ".join(f"({m}, {i}, '{s}', '{t}', '{o}', {i + 1 >= len(_PATHS[m][1])})" for m, rows in _DRAWN.items() for i, s, t, o in rows) + ")"


@query("W8_segments", "SELECT id, i, state, id * 10 + i AS start, CASE WHEN NOT is_last THEN id * 10 + i + 1 END AS \"end\", token, outcome FROM runs JOIN segs ON m = id % 5", "", "runs AS (SELECT o_orderkey AS id FROM orders), " + _SEGS)
def _(x: Fixtures) -> DataFrame:
    return T.segments(_instances(x)).withColumn("i", F.col("i").cast("int"))


@query("W9_terminal_marker", "SELECT id, id * 10 + 2 AS at, 'destructive' AS token FROM runs WHERE id % 5 = 4", "runs")
def _(x: Fixtures) -> DataFrame:
    i = _instances(x)
    return T.terminal_markers(i, T.segments(i))


@query("A11_park_turns", "SELECT id, len([v FOR v IN p IF v = 'Parked'])::INTEGER AS turns FROM inst", "runs", _INST)
def _(x: Fixtures) -> DataFrame:
    return _instances(x).select("id", T.park_turns().alias("turns"))


@query("A17_loop_turns", "SELECT edge, nullif(greatest(coalesce(a, 0), coalesce(b, 0)), 0) AS turns FROM (SELECT edge, sources[1] AS s, targets[1] AS t FROM edges WHERE kind = 'loop') LEFT JOIN (SELECT id, id % 3 AS a FROM nodes) x ON x.id = s LEFT JOIN (SELECT id, id % 3 AS b FROM nodes) y ON y.id = t", "edges nodes")
def _(x: Fixtures) -> DataFrame:
    e = x.edges().where("kind = 'loop'").select("edge", F.get("sources", F.lit(0)).alias("s"), F.get("targets", F.lit(0)).alias("t"))
    p = x.nodes().select("id", (F.col("id") % 3).alias("n"))
    j = e.join(p.select(F.col("id").alias("s"), F.col("n").alias("a")), "s", "left").join(p.select(F.col("id").alias("t"), F.col("n").alias("b")), "t", "left")
    return j.select("edge", F.nullif(F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))), F.lit(0).cast("long")).alias("turns"))


_DEBOUNCED = "SELECT key, seq, last_value(CASE WHEN seq = first OR status = prev THEN status END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq) AS shown FROM (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY seq) AS prev, min(seq) OVER (PARTITION BY key) AS first FROM (SELECT user_id AS key, signal_id AS seq, CASE WHEN v > 50 THEN 'healthy' ELSE 'degraded' END AS status FROM signals))"


@query("W11_debounce", _DEBOUNCED, "signals")
def _(x: Fixtures) -> DataFrame:
    r = x.signals().select(F.col("user_id").alias("key"), F.col("signal_id").alias("seq"), F.when(F.col("v") > 50, "healthy").otherwise("degraded").alias("status"))
    return T.debounced(r, "key")


@query("W11_debounced_status", _DEBOUNCED, "signals")
def _(x: Fixtures) -> DataFrame:
    r = x.signals().select(F.col("user_id").alias("key"), F.col("signal_id").alias("seq"), F.when(F.col("v") > 50, "healthy").otherwise("degraded").alias("status"))
    return T.debounced(r, "key")


@query("X18_abnormal_end", "SELECT id, id % 2 = 0 AND id % 3 <> 0 AND state IN ('Completed', 'Failed') AS abnormal FROM runs", "runs")
def _(x: Fixtures) -> DataFrame:
    return x.runs().select("id", T.abnormal_end(F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("state")).alias("abnormal"))


def _gate_rows(x: Fixtures) -> DataFrame:
    k = F.col("id")
    return x.runs().select("id", F.element_at(F.array(F.lit("predicate"), F.lit("signal"), F.lit("timer")), (k % 3 + 1).cast("int")).alias("kind"), F.when(k % 2 == 0, k % 100).alias("secs"), "scheduled_at")


def _expression(kind: Column, secs: Column) -> Column:
    return F.when(kind == "predicate", F.concat(F.lit("x > "), F.coalesce(secs.cast("string"), F.lit("?")))).when(kind == "signal", F.concat_ws(" · ", F.lit("go"), F.when(secs.isNotNull(), "$.a"))).otherwise(F.coalesce(F.concat(F.lit("after "), secs.cast("string"), F.lit("s")), F.lit("timer")))


@query("P11_gate_expression", "SELECT id, CASE id % 3 WHEN 0 THEN 'x > ' || coalesce(s::VARCHAR, '?') WHEN 1 THEN 'go' || CASE WHEN s IS NOT NULL THEN ' · $.a' ELSE '' END ELSE coalesce('after ' || s || 's', 'timer') END AS expression FROM (SELECT id, CASE WHEN id % 2 = 0 THEN id % 100 END AS s FROM runs)", "runs")
def _(x: Fixtures) -> DataFrame:
    return _gate_rows(x).select("id", _expression(F.col("kind"), F.col("secs")).alias("expression"))


@query("X24_gate_reject_time", "SELECT id, strftime(scheduled_at + to_seconds(id % 100), '%Y-%m-%d %H:%M:%S') AS reject_at FROM runs WHERE id % 2 = 0", "runs")
def _(x: Fixtures) -> DataFrame:
    at = F.col("scheduled_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("secs"))
    return _gate_rows(x).where("secs is not null").select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("reject_at"))


@query("Q17_gates_tab", "SELECT g.id, n.name AS awaiting FROM (SELECT id, workflow_id FROM runs WHERE id % 3 = 0 AND id % 2 = 1) g LEFT JOIN (SELECT id, arg_max(name, version) AS name FROM definitions GROUP BY id) n ON n.id = g.workflow_id", "runs definitions")
def _(x: Fixtures) -> DataFrame:
    from runweave.operators.runs import latest_names

    waiting = x.runs().where("id % 3 = 0 and id % 2 = 1").select("id", "workflow_id")
    return latest_names(waiting, x.definitions()).select("id", F.col("name").alias("awaiting"))


@query("Q16_timeline_tab", "SELECT id, i, state, token FROM runs JOIN segs ON m = id % 5", "", "runs AS (SELECT o_orderkey AS id FROM orders), " + _SEGS)
def _(x: Fixtures) -> DataFrame:
    return T.segments(_instances(x)).select("id", F.col("i").cast("int").alias("i"), "state", "token")
