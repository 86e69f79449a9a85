"""Runs, attempts and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators import runs as R
from runweave.sources.fixtures import Fixtures

from .catalogue import query, text_time

T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_FUTURE = "('PendingSchedule', 'Scheduled')"


def _cal(zone: str, year: int, live: str = "live") -> str:
    half = f"SELECT id, workflow_id, state, timezone('{zone}', timezone('UTC', scheduled_at))::DATE AS day FROM {{}} WHERE scheduled_at >= '{year - 1}-12-31' AND scheduled_at < '{year + 1}-01-02'"
    both = half.format("archive") + (" UNION ALL " + half.format(live) if live else "")
    return f"""SELECT workflow_id, day::VARCHAR AS day, count(*) FILTER (state = 'Completed') AS completed, count(*) FILTER (state = 'Failed') AS failed,
  count(*) FILTER (state = 'InProgress') AS in_progress, count(*) FILTER (state IN ('Scheduled', 'Triggered', 'PendingSchedule')) AS scheduled, count(*) AS total
  FROM ({both}) WHERE year(day) = {year} AND (state IN ('Completed', 'Failed', 'InProgress', 'Scheduled', 'Triggered', 'PendingSchedule')) GROUP BY ALL"""


def _days(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


@query("Q3_calendar_utc", _cal("UTC", 1996), "archive live")
def _(x: Fixtures) -> DataFrame:
    return _days(R.calendar(x.archive(), x.live(), "UTC", 1996))


@query("Q3_calendar_kathmandu", _cal("Asia/Kathmandu", 1997), "archive live")
def _(x: Fixtures) -> DataFrame:
    return _days(R.calendar(x.archive(), x.live(), "Asia/Kathmandu", 1997))


@query("Q3_calendar_without_live", _cal("America/New_York", 1998, ""), "archive")
def _(x: Fixtures) -> DataFrame:
    return _days(R.calendar(x.archive(), None, "America/New_York", 1998))


@query("A4_calendar_deduplicated", _cal("UTC", 1996, "(SELECT * FROM live WHERE id NOT IN (SELECT id FROM archive))"), "archive live")
def _(x: Fixtures) -> DataFrame:
    return _days(R.calendar(x.archive(), x.live(), "UTC", 1996, deduplicated=True))


@query("X16_day_level", f"SELECT workflow_id, day, CASE WHEN failed > 0 THEN 'failed' WHEN scheduled > 0 THEN 'scheduled' WHEN in_progress > 0 THEN 'in_progress' WHEN completed > 0 THEN 'completed' ELSE 'none' END AS level FROM ({_cal('UTC', 1999)})", "archive live")
def _(x: Fixtures) -> DataFrame:
    return _days(R.calendar(x.archive(), x.live(), "UTC", 1999)).select("workflow_id", "day", R.day_level().alias("level"))


@query("S1_archive_by_key", f"SELECT id, workflow_id, state, {T.format('archived_at')} AS archived_at FROM archive WHERE id = 7", "archive")
def _(x: Fixtures) -> DataFrame:
    return x.archive().where("id = 7").select("id", "workflow_id", "state", text_time("archived_at").alias("archived_at"))


@query("S2_definition_by_version", "SELECT id, version, status, name FROM definitions WHERE id = 7 AND version = 3", "definitions")
def _(x: Fixtures) -> DataFrame:
    return x.definitions().where("id = 7 and version = 3").select("id", "version", "status", "name")


@query("S9_archive_first_then_live", "SELECT id, workflow_id, state, task_count FROM archive UNION ALL SELECT id, workflow_id, state, task_count FROM live WHERE id NOT IN (SELECT id FROM archive)", "archive live")
def _(x: Fixtures) -> DataFrame:
    return R.merge_archive_wins(x.archive(), x.live()).select("id", "workflow_id", "state", "task_count")


@query("W3_merge_archive_wins", "SELECT id, state FROM (SELECT id, state, 0 AS p FROM archive UNION ALL SELECT id, state, 1 FROM live) QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1", "archive live")
def _(x: Fixtures) -> DataFrame:
    return R.merge_archive_wins(x.archive(), x.live()).select("id", "state")


@query("P1_run_list_row", f"SELECT id, workflow_id, state, {T.format('scheduled_at')} AS scheduled_at, task_count, task_count AS completed_tasks FROM archive", "archive")
def _(x: Fixtures) -> DataFrame:
    return x.archive().select("id", "workflow_id", "state", text_time("scheduled_at").alias("scheduled_at"), "task_count", F.col("task_count").alias("completed_tasks"))


@query("P2_task_list_row", f"SELECT run_id, task_id, attempt, state, {T.format('started_at')} AS started_at, {T.format('completed_at')} AS completed_at FROM attempts", "attempts")
def _(x: Fixtures) -> DataFrame:
    return x.attempts().select("run_id", "task_id", "attempt", "state", text_time("started_at").alias("started_at"), text_time("completed_at").alias("completed_at"))


@query("P13_run_handle", f"SELECT id, {T.format('coalesce(scheduled_at, archived_at)')} || ' +00:00' AS handle FROM runs", "runs")
def _(x: Fixtures) -> DataFrame:
    return x.runs().select("id", F.concat(text_time(F.coalesce("scheduled_at", "archived_at")), F.lit(" +00:00")).alias("handle"))


@query("P14_attempt_label", "SELECT run_id, task_id, attempt, CASE WHEN attempt > 0 THEN 't' || task_id || ' (attempt ' || (attempt + 1) || ')' ELSE 't' || task_id END AS label, q FROM attempts", "attempts")
def _(x: Fixtures) -> DataFrame:
    from runweave.operators.timeline import attempt_label

    name = F.concat(F.lit("t"), F.col("task_id").cast("string"))
    return x.attempts().select("run_id", "task_id", "attempt", attempt_label(name, F.col("attempt")).alias("label"), F.col("pos.l_quantity").alias("q"))


@query("P15_replay_summary", "SELECT workflow_id, CASE WHEN count(*) = 1 THEN max(id)::VARCHAR ELSE count(*) || ' roots' END AS summary FROM archive WHERE task_count = 0 GROUP BY workflow_id", "archive")
def _(x: Fixtures) -> DataFrame:
    n = F.count("*")
    return x.archive().where("task_count = 0").groupBy("workflow_id").agg(F.when(n == 1, F.max("id").cast("string")).otherwise(F.concat(n.cast("string"), F.lit(" roots"))).alias("summary"))


@query("F1_terminal_state", "SELECT id, state FROM runs WHERE state IN ('Completed', 'Failed')", "runs")
def _(x: Fixtures) -> DataFrame:
    return x.runs().where(F.col("state").isin(*R.TERMINAL)).select("id", "state")


@query("F2_closed_range", "SELECT id FROM runs WHERE scheduled_at >= '1996-03-01' AND scheduled_at <= '1996-03-31 12:00:00'", "runs")
def _(x: Fixtures) -> DataFrame:
    return R.in_range(x.runs(), "1996-03-01", "1996-03-31 12:00:00").select("id")


@query("F2_open_range", "SELECT id FROM runs", "runs")
def _(x: Fixtures) -> DataFrame:
    return R.in_range(x.runs(), None, None).select("id")


@query("F3_local_year", "SELECT id, day::VARCHAR AS day FROM (SELECT id, timezone('Pacific/Honolulu', timezone('UTC', scheduled_at))::DATE AS day FROM runs) WHERE year(day) = 1997", "runs")
def _(x: Fixtures) -> DataFrame:
    return _days(R.in_local_year(x.runs(), "Pacific/Honolulu", 1997).select("id", "day"))


@query("F8_text_search", "SELECT id, version, name FROM definitions WHERE contains(lower(name), 'a1') OR contains(id::VARCHAR, 'a1')", "definitions")
def _(x: Fixtures) -> DataFrame:
    needle = "  A1 ".strip().lower()
    return x.definitions().where(F.lower("name").contains(needle) | F.col("id").cast("string").contains(needle)).select("id", "version", "name")


@query("F9_clock_slice", "SELECT id FROM runs WHERE state IN ('Completed', 'Failed') AND hour(scheduled_at) < 12 AND (hour(scheduled_at) % 12) * 12 + minute(scheduled_at) // 5 BETWEEN 30 AND 60", "runs")
def _(x: Fixtures) -> DataFrame:
    t = F.col("scheduled_at")
    slot = (F.hour(t) % 12) * 12 + F.floor(F.minute(t) / 5)
    return x.runs().where(F.col("state").isin("Completed", "Failed") & (F.hour(t) < 12) & slot.between(30, 60)).select("id")


@query("F10_live_only", "SELECT id, state FROM runs WHERE state NOT IN ('Completed', 'Failed')", "runs")
def _(x: Fixtures) -> DataFrame:
    return x.runs().where(~F.col("state").isin(*R.TERMINAL)).select("id", "state")


@query("F11_eligible_lease", "SELECT id FROM runs WHERE state = 'InProgress' AND (scheduled_at IS NULL OR scheduled_at <= '1998-01-01')", "runs")
def _(x: Fixtures) -> DataFrame:
    return x.runs().where((F.col("state") == "InProgress") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= F.expr("timestamp'1998-01-01'")))).select("id")


@query("F12_grace_expiry", "SELECT id FROM archive WHERE archived_at IS NOT NULL AND archived_at < '1998-06-01'", "archive")
def _(x: Fixtures) -> DataFrame:
    return x.archive().where(F.col("archived_at").isNotNull() & (F.col("archived_at") < F.expr("timestamp'1998-06-01'"))).select("id")


@query("F16_unexpired_observations", "SELECT run_id, task_id, q FROM attempts WHERE (q * 10)::BIGINT > 250", "attempts")
def _(x: Fixtures) -> DataFrame:
    return x.attempts().where((F.col("pos.l_quantity") * 10).cast("long") > 250).select("run_id", "task_id", F.col("pos.l_quantity").alias("q"))


@query("F17_unsettled_oldest_first", f"SELECT id, {T.format('archived_at')} AS updated_at, row_number() OVER (ORDER BY archived_at, id) AS place FROM runs WHERE state = 'InProgress' AND archived_at <= '1996-01-01' ORDER BY archived_at, id LIMIT 50", "runs")
def _(x: Fixtures) -> DataFrame:
    from pyspark.sql import Window as W

    top = x.runs().where((F.col("state") == "InProgress") & (F.col("archived_at") <= F.expr("timestamp'1996-01-01'"))).orderBy("archived_at", "id").limit(50)
    return top.select("id", text_time("archived_at").alias("updated_at"), F.row_number().over(W.orderBy("archived_at", "id")).alias("place"))


@query("J1_latest_with_live", """SELECT a.id, a.version, b.version AS live_version, b.name AS live_name FROM (SELECT id, max(version) AS version FROM definitions GROUP BY id) a
  LEFT JOIN (SELECT id, max(version) AS version, arg_max(name, version) AS name FROM definitions WHERE status IN ('Ready', 'Submitted') GROUP BY id) b USING (id)""", "definitions")
def _(x: Fixtures) -> DataFrame:
    return R.definitions_with_live(x.definitions()).select("id", "version", "live_version", "live_name")


@query("J2_run_with_info", "SELECT r.id, r.state, i.n FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM attempts WHERE attempt = 0 GROUP BY run_id) i ON i.run_id = r.id", "runs attempts")
def _(x: Fixtures) -> DataFrame:
    info = x.attempts().where("attempt = 0").groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n"))
    return x.runs().join(info, "id", "left").select("id", "state", "n")


@query("J3_builds_with_definitions", "SELECT b.run_id, b.task_id, d.id, d.version, d.status FROM (SELECT run_id, task_id, task_id % 50 AS id, task_id // 50 AS version FROM attempts) b JOIN definitions d USING (id, version)", "attempts definitions")
def _(x: Fixtures) -> DataFrame:
    b = x.attempts().select("run_id", "task_id", (F.col("task_id") % 50).alias("id"), F.floor(F.col("task_id") / 50).alias("version"))
    return b.join(x.definitions(), ["id", "version"]).select("run_id", "task_id", "id", "version", "status")


@query("J4_inner_on_key", "SELECT a.run_id, a.task_id, a.attempt, r.state FROM attempts a JOIN runs r ON r.id = a.run_id", "attempts runs")
def _(x: Fixtures) -> DataFrame:
    return x.attempts().select("run_id", "task_id", "attempt").join(x.runs().select(F.col("id").alias("run_id"), "state"), "run_id")


@query("J5_fences_left_dispatches", "SELECT r.id, r.state, a.task_id FROM archive r LEFT JOIN (SELECT run_id, max(task_id) AS task_id FROM attempts WHERE state = 'Running' GROUP BY run_id) a ON a.run_id = r.id", "archive attempts")
def _(x: Fixtures) -> DataFrame:
    a = x.attempts().where("state = 'Running'").groupBy(F.col("run_id").alias("id")).agg(F.max("task_id").alias("task_id"))
    return x.archive().join(a, "id", "left").select("id", "state", "task_id")


@query("J6_attempt_counts", "SELECT id, (SELECT count(*) FROM attempts WHERE run_id = id) AS n_attempts FROM archive", "archive attempts")
def _(x: Fixtures) -> DataFrame:
    return R.attempt_counts(x.archive(), x.attempts()).select("id", "n_attempts")


@query("J7_latest_name", "SELECT r.id, n.name FROM archive r LEFT JOIN (SELECT id, arg_max(name, version) AS name FROM definitions GROUP BY id) n ON n.id = r.workflow_id", "archive definitions")
def _(x: Fixtures) -> DataFrame:
    return R.latest_names(x.archive(), x.definitions()).select("id", "name")


@query("J8_no_waiting_sibling", "SELECT id, version FROM definitions d WHERE NOT EXISTS (SELECT 1 FROM definitions s WHERE s.version = d.version AND s.id % 10 = d.id % 10 AND s.status NOT IN ('Ready', 'Submitted'))", "definitions")
def _(x: Fixtures) -> DataFrame:
    b = x.definitions().withColumn("g", F.col("id") % 10)
    return R.unsettled_siblings(b, ["version", "g"]).select("id", "version")


@query("J9_no_fence", "SELECT id FROM runs r WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.run_id = r.id AND a.state = 'Failed') AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.task_id = r.id AND a.attempt = 0)", "runs attempts")
def _(x: Fixtures) -> DataFrame:
    a = x.attempts()
    keyed, loose = a.where("state = 'Failed'").select(F.col("run_id").alias("id")), a.where("attempt = 0").select(F.col("task_id").alias("id"))
    return x.runs().select("id").join(keyed, "id", "left_anti").join(loose, "id", "left_anti")


@query("J10_exists", "SELECT id FROM runs r WHERE EXISTS (SELECT 1 FROM attempts a WHERE a.run_id = r.id AND a.state = 'Running')", "runs attempts")
def _(x: Fixtures) -> DataFrame:
    return x.runs().select("id").join(x.attempts().where("state = 'Running'").select(F.col("run_id").alias("id")), "id", "left_semi")


@query("J14_workflow_with_latest", f"""SELECT w.id AS workflow_id, r.id AS run_id, coalesce(c.n, 0) AS completed_runs FROM (SELECT DISTINCT id FROM definitions) w
  LEFT JOIN (SELECT * FROM (SELECT id, workflow_id, state, scheduled_at FROM archive UNION ALL SELECT id, workflow_id, state, scheduled_at FROM live WHERE id NOT IN (SELECT id FROM archive)) WHERE state NOT IN {_FUTURE}
    QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY scheduled_at DESC NULLS LAST, id DESC) = 1) r ON r.workflow_id = w.id
  LEFT JOIN (SELECT workflow_id, count(*) AS n FROM archive GROUP BY workflow_id) c ON c.workflow_id = w.id""", "archive live definitions")
def _(x: Fixtures) -> DataFrame:
    w = x.definitions().select(F.col("id").alias("workflow_id")).distinct()
    r = R.latest_runs(x.archive(), x.live(), w).select("workflow_id", F.col("id").alias("run_id"))
    return r.join(R.completed_counts(x.archive()), "workflow_id", "left").select("workflow_id", "run_id", F.coalesce("completed_runs", F.lit(0)).alias("completed_runs"))


@query("J17_ledger_audit", "SELECT l.id, l.version, CASE WHEN a.id IS NULL THEN 'unapplied' WHEN l.status = 'BuildFailed' THEN 'applied_but_failed' ELSE 'ok' END AS verdict FROM definitions l LEFT JOIN (SELECT DISTINCT workflow_id AS id FROM archive WHERE task_count > 1) a ON a.id = l.id", "definitions archive")
def _(x: Fixtures) -> DataFrame:
    a = x.archive().where("task_count > 1").select(F.col("workflow_id").alias("id"), F.lit(True).alias("a")).distinct()
    return x.definitions().join(a, "id", "left").select("id", "version", F.when(F.col("a").isNull(), "unapplied").when(F.col("status") == "BuildFailed", "applied_but_failed").otherwise("ok").alias("verdict"))


@query("A1_completed_runs", "SELECT workflow_id, count(*) AS completed_runs FROM runs WHERE state IN ('Completed', 'Failed') GROUP BY workflow_id", "runs")
def _(x: Fixtures) -> DataFrame:
    return R.completed_counts(x.runs())


@query("A2_distinct_definitions", "SELECT count(DISTINCT id) AS n FROM definitions", "definitions")
def _(x: Fixtures) -> DataFrame:
    return x.definitions().agg(F.count_distinct("id").alias("n"))


_CLOCK = """SELECT h AS half, s AS slot, f AS family, coalesce(n, 0) AS n FROM (SELECT unnest(['am', 'pm']) AS h), (SELECT unnest(range(144))::INTEGER AS s), (SELECT unnest(['scheduled', 'in_progress', 'completed', 'failed']) AS f)
  LEFT JOIN (SELECT CASE WHEN hour(scheduled_at) < 12 THEN 'am' ELSE 'pm' END AS half, (hour(scheduled_at) % 12 * 12 + minute(scheduled_at) // 5)::INTEGER AS slot,
    CASE WHEN state IN ('Scheduled', 'PendingSchedule', 'Triggered') THEN 'scheduled' WHEN state = 'InProgress' THEN 'in_progress' WHEN state = 'Completed' THEN 'completed' WHEN state = 'Failed' THEN 'failed' END AS family, count(*) AS n
    FROM (SELECT state, scheduled_at FROM archive UNION ALL SELECT state, scheduled_at FROM live WHERE id NOT IN (SELECT id FROM archive)) WHERE scheduled_at IS NOT NULL GROUP BY ALL) ON half = h AND slot = s AND family = f"""


@query("A5_clock_histogram", _CLOCK, "archive live")
def _(x: Fixtures) -> DataFrame:
    return R.clock(R.merge_archive_wins(x.archive(), x.live()))


@query("A6_p90_clamp", f"SELECT greatest(1, coalesce((list_sort(list(n) FILTER (n > 0)))[floor(count(*) FILTER (n > 0) * 0.9)::INTEGER + 1], 1))::BIGINT AS clamp FROM ({_CLOCK})", "archive live")
def _(x: Fixtures) -> DataFrame:
    return R.p90_clamp(R.clock(R.merge_archive_wins(x.archive(), x.live())))


@query("A7_task_progress", "SELECT run_id, count(*) AS task_count, count(*) FILTER (state = 'Completed' AND task_id % 4 <> 0) AS completed FROM (SELECT * FROM attempts WHERE task_id % 9 <> 0) GROUP BY run_id", "attempts")
def _(x: Fixtures) -> DataFrame:
    a = x.attempts().where("task_id % 9 <> 0")
    return a.groupBy("run_id").agg(F.count("*").alias("task_count"), F.count_if((F.col("state") == "Completed") & (F.col("task_id") % 4 != 0)).alias("completed"))


@query("A8_fleet_health", """SELECT count(*) AS observed, coalesce(sum(q::BIGINT), 0)::BIGINT AS slots, coalesce(sum(attempt), 0)::BIGINT AS in_flight, min(a) AS freshest, max(a) AS oldest,
  CASE WHEN min(a) IS NULL THEN 'unhealthy' WHEN min(a) < 20 // 4 THEN 'healthy' ELSE 'degraded' END AS status FROM (SELECT *, task_id % 100 + 3 AS a FROM attempts) WHERE task_id % 40 > 20""", "attempts")
def _(x: Fixtures) -> DataFrame:
    o = x.attempts().select((F.col("task_id") % 40).alias("expires_at"), (F.col("task_id") % 100 + 3).alias("age"), F.col("pos.l_quantity").cast("long").alias("slots"), F.col("attempt").cast("long").alias("in_flight"))
    return R.fleet_health(o, 20, 20)


@query("A10_duplicate_owners", "SELECT name, string_agg(id::VARCHAR, ',' ORDER BY id) AS owners FROM (SELECT DISTINCT cosmetic_hash AS name, id FROM definitions) GROUP BY name HAVING count(*) > 1", "definitions")
def _(x: Fixtures) -> DataFrame:
    g = x.definitions().groupBy(F.col("cosmetic_hash").alias("name")).agg(F.array_sort(F.collect_set("id")).alias("o")).where(F.size("o") > 1)
    return g.select("name", F.array_join(F.transform("o", lambda v: v.cast("string")), ",").alias("owners"))


@query("A12_group_digest", "SELECT id, sha256(string_agg(name, chr(10) ORDER BY name)) AS digest FROM definitions GROUP BY id", "definitions")
def _(x: Fixtures) -> DataFrame:
    from runweave.operators.logs import name_digests

    return name_digests(x.definitions(), "id", "name")


@query("A15_all_ready", "SELECT version, bool_and(status IN ('Ready', 'Submitted')) AS ready, count(*) AS n FROM definitions GROUP BY version", "definitions")
def _(x: Fixtures) -> DataFrame:
    return R.settled_groups(x.definitions(), ["version"])


@query("A16_timeline_extent", f"SELECT {T.format('min(started_at)')} AS lo, {T.format('''greatest(min(started_at), max(coalesce(completed_at, TIMESTAMP '2005-01-01')))''')} AS hi FROM attempts", "attempts")
def _(x: Fixtures) -> DataFrame:
    from runweave.operators.timeline import extent

    e = extent(x.attempts().select(F.col("started_at").alias("start"), F.col("completed_at").alias("end")), F.expr("timestamp'2005-01-01'"))
    return e.select(text_time("lo").alias("lo"), text_time("hi").alias("hi"))


@query("W1_latest_archived", f"SELECT workflow_id, id, {T.format('scheduled_at')} AS scheduled_at FROM archive QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY scheduled_at DESC NULLS LAST, archived_at DESC, id DESC) = 1", "archive")
def _(x: Fixtures) -> DataFrame:
    return R.latest_archived(x.archive()).select("workflow_id", "id", text_time("scheduled_at").alias("scheduled_at"))


@query("W2_latest_run", f"""SELECT q.w AS workflow_id, r.id, r.state FROM (SELECT unnest(range(60)) AS w) q LEFT JOIN (
  SELECT * FROM (SELECT id, workflow_id, state, scheduled_at FROM archive UNION ALL SELECT id, workflow_id, state, scheduled_at FROM live WHERE id NOT IN (SELECT id FROM archive)) WHERE state NOT IN {_FUTURE}
  QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY scheduled_at DESC NULLS LAST, id DESC) = 1) r ON r.workflow_id = q.w""", "archive live")
def _(x: Fixtures) -> DataFrame:
    return R.latest_runs(x.archive(), x.live(), x.spark.range(60).withColumnRenamed("id", "workflow_id")).select("workflow_id", "id", "state")


@query("W4_latest_attempt", "SELECT run_id, task_id, attempt, executor_id, state FROM attempts QUALIFY row_number() OVER (PARTITION BY run_id, task_id ORDER BY attempt DESC, executor_id, started_at, q, price) = 1", "attempts")
def _(x: Fixtures) -> DataFrame:
    return R.latest_attempts(x.attempts()).select("run_id", "task_id", "attempt", "executor_id", "state")


@query("W5_latest_definition", "SELECT id, version, name FROM definitions QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1", "definitions")
def _(x: Fixtures) -> DataFrame:
    return R.latest_definitions(x.definitions()).select("id", "version", "name")


@query("W5_latest_live_definition", "SELECT id, version, name FROM definitions WHERE status IN ('Ready', 'Submitted') QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1", "definitions")
def _(x: Fixtures) -> DataFrame:
    return R.latest_definitions(x.definitions(), True).select("id", "version", "name")


@query("W6_default_version", "SELECT id, version, status FROM definitions QUALIFY row_number() OVER (PARTITION BY id ORDER BY (status IN ('Ready', 'Submitted')) DESC, version DESC) = 1", "definitions")
def _(x: Fixtures) -> DataFrame:
    return R.default_versions(x.definitions()).select("id", "version", "status")


@query("W7_sibling_attempts", "SELECT run_id, task_id, attempt, executor_id, row_number() OVER (PARTITION BY task_id ORDER BY attempt, run_id, executor_id, started_at, q, price) AS place FROM attempts", "attempts")
def _(x: Fixtures) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("task_id").orderBy("attempt", "run_id", "pos")
    return x.attempts().select("run_id", "task_id", "attempt", "executor_id", F.row_number().over(w).alias("place"))


@query("O1_archived_page", "SELECT id FROM archive ORDER BY archived_at DESC, id DESC LIMIT 40 OFFSET 20", "archive")
def _(x: Fixtures) -> DataFrame:
    return x.archive().orderBy(F.desc("archived_at"), F.desc("id")).offset(20).limit(40).select("id")


@query("O2_calendar_candidates", "SELECT id FROM archive WHERE scheduled_at IS NOT NULL ORDER BY scheduled_at DESC, id DESC LIMIT 100", "archive")
def _(x: Fixtures) -> DataFrame:
    return x.archive().where("scheduled_at is not null").orderBy(F.desc("scheduled_at"), F.desc("id")).limit(100).select("id")


@query("O3_dashboard_order", "SELECT id FROM archive ORDER BY scheduled_at DESC NULLS LAST, archived_at DESC, id DESC LIMIT 100", "archive")
def _(x: Fixtures) -> DataFrame:
    return x.archive().orderBy(F.desc_nulls_last("scheduled_at"), F.desc("archived_at"), F.desc("id")).limit(100).select("id")


@query("O4_merged_list_by_text", f"SELECT id, {T.format('scheduled_at')} AS scheduled_at FROM (SELECT id, scheduled_at FROM archive UNION ALL SELECT id, scheduled_at FROM live WHERE id NOT IN (SELECT id FROM archive)) ORDER BY 2 DESC NULLS LAST, id DESC LIMIT 100", "archive live")
def _(x: Fixtures) -> DataFrame:
    m = R.merge_archive_wins(x.archive(), x.live()).select("id", text_time("scheduled_at").alias("scheduled_at"))
    return m.orderBy(F.desc_nulls_last("scheduled_at"), F.desc("id")).limit(100)


@query("O7_upcoming", f"SELECT id, {T.format('scheduled_at')} AS scheduled_at FROM live WHERE state IN ('Scheduled', 'PendingSchedule') ORDER BY live.scheduled_at ASC NULLS LAST, id LIMIT 20", "live")
def _(x: Fixtures) -> DataFrame:
    return x.live().where(F.col("state").isin(*R.FUTURE)).orderBy(F.asc_nulls_last("scheduled_at"), "id").limit(20).select("id", text_time("scheduled_at").alias("scheduled_at"))


@query("O8_definitions_list", "SELECT id, version, inserted_at FROM definitions ORDER BY inserted_at DESC, id, version LIMIT 50", "definitions")
def _(x: Fixtures) -> DataFrame:
    return x.definitions().orderBy(F.desc("inserted_at"), "id", "version").limit(50).select("id", "version", "inserted_at")


@query("O9_replays_of_source", "SELECT id FROM runs WHERE workflow_id = 7 ORDER BY archived_at DESC, id DESC LIMIT 30", "runs")
def _(x: Fixtures) -> DataFrame:
    return x.runs().where("workflow_id = 7").orderBy(F.desc("archived_at"), F.desc("id")).limit(30).select("id")


@query("O10_attempts_of_run", "SELECT run_id, task_id, attempt, row_number() OVER (PARTITION BY run_id ORDER BY started_at, task_id, executor_id, q, price) AS place FROM attempts", "attempts")
def _(x: Fixtures) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("run_id").orderBy("started_at", "task_id", "executor_id", "pos")
    return x.attempts().select("run_id", "task_id", "attempt", F.row_number().over(w).alias("place"))


@query("O14_oldest_eligible", "SELECT id FROM runs WHERE state = 'InProgress' ORDER BY archived_at, id LIMIT 64", "runs")
def _(x: Fixtures) -> DataFrame:
    return x.runs().where("state = 'InProgress'").orderBy("archived_at", "id").limit(64).select("id")


@query("O15_outbox_order", "SELECT run_id, task_id FROM attempts ORDER BY started_at, run_id, CASE state WHEN 'Completed' THEN 0 WHEN 'Failed' THEN 1 ELSE 2 END, task_id LIMIT 100", "attempts")
def _(x: Fixtures) -> DataFrame:
    rank = F.when(F.col("state") == "Completed", 0).when(F.col("state") == "Failed", 1).otherwise(2)
    return x.attempts().orderBy("started_at", "run_id", rank, "task_id").limit(100).select("run_id", "task_id")


@query("O16_timeline_rows", f"SELECT run_id, task_id, attempt, {T.format('started_at')} AS started_at FROM attempts ORDER BY attempts.started_at, run_id, task_id, attempt LIMIT 200", "attempts")
def _(x: Fixtures) -> DataFrame:
    return x.attempts().orderBy("started_at", "run_id", "task_id", "attempt").limit(200).select("run_id", "task_id", "attempt", text_time("started_at").alias("started_at"))


@query("O18_oldest_unfinished", "SELECT id FROM runs WHERE state IN ('InProgress', 'Failed') ORDER BY archived_at, id LIMIT 1", "runs")
def _(x: Fixtures) -> DataFrame:
    return x.runs().where(F.col("state").isin("InProgress", "Failed")).orderBy("archived_at", "id").limit(1).select("id")


@query("X17_attempt_duration", "SELECT run_id, task_id, attempt, executor_id, greatest(0, epoch_ms(coalesce(completed_at, TIMESTAMP '1998-01-01')) - epoch_ms(started_at))::BIGINT AS ms FROM attempts", "attempts")
def _(x: Fixtures) -> DataFrame:
    from runweave.operators.timeline import duration_ms

    return x.attempts().select("run_id", "task_id", "attempt", "executor_id", duration_ms(F.col("started_at"), F.col("completed_at"), F.expr("timestamp'1998-01-01'")).alias("ms"))


@query("G17_registration_decision", """SELECT i.id, CASE WHEN d.version IS NULL THEN 'Insert' WHEN i.c <> d.content_hash THEN 'Insert' WHEN status = 'BuildFailed' THEN 'Requeue' WHEN status = 'Building' THEN 'NoOp' WHEN i.m <> d.cosmetic_hash THEN 'Refresh' ELSE 'NoOp' END AS action,
  CASE WHEN d.version IS NULL THEN 1 WHEN i.c <> d.content_hash THEN d.version + 1 ELSE d.version END::BIGINT AS version
  FROM (SELECT id + 5 AS id, CASE WHEN id % 3 = 0 THEN md5('x') ELSE h END AS c, CASE WHEN id % 2 = 0 THEN md5('y') ELSE g END AS m FROM (SELECT id, arg_max(content_hash, version) AS h, arg_max(cosmetic_hash, version) AS g FROM definitions GROUP BY id)) i
  LEFT JOIN (SELECT * FROM definitions QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) d USING (id)""", "definitions")
def _(x: Fixtures) -> DataFrame:
    last = R.latest_definitions(x.definitions())
    i = last.select((F.col("id") + 5).alias("id"), F.when(F.col("id") % 3 == 0, F.md5(F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("id") % 2 == 0, F.md5(F.lit("y"))).otherwise(F.col("cosmetic_hash")).alias("cosmetic_hash"))
    return R.registration_decision(x.definitions(), i)


@query("G23_retry_budget", "SELECT run_id, task_id, count(*) AS n, count(*) >= 2 AS exhausted FROM attempts GROUP BY ALL", "attempts")
def _(x: Fixtures) -> DataFrame:
    return R.retry_exhausted(x.attempts(), 2)


@query("T9_single_winner", "SELECT run_id, task_id, executor_id, q, row_number() OVER w = 1 AS won, first_value(state) OVER w AS winner FROM attempts WINDOW w AS (PARTITION BY run_id, attempt ORDER BY started_at, task_id, executor_id, q, price)", "attempts")
def _(x: Fixtures) -> DataFrame:
    w = R.single_winner(x.attempts(), ["run_id", "attempt"], [F.asc("started_at"), F.asc("task_id"), F.asc("executor_id"), F.asc("pos")])
    return w.select("run_id", "task_id", "executor_id", F.col("pos.l_quantity").alias("q"), "won", "winner")


@query("Q1_workflows", f"""SELECT a.id AS workflow_id, a.version, l.version AS live_version, r.id AS run_id, r.state AS run_state, coalesce(c.n, 0) AS completed_runs
  FROM (SELECT id, max(version) AS version FROM definitions GROUP BY id) a LEFT JOIN (SELECT id, max(version) AS version FROM definitions WHERE status IN ('Ready', 'Submitted') GROUP BY id) l USING (id)
  LEFT JOIN (SELECT * FROM (SELECT id, workflow_id, state, scheduled_at FROM archive UNION ALL SELECT id, workflow_id, state, scheduled_at FROM live WHERE id NOT IN (SELECT id FROM archive)) WHERE state NOT IN {_FUTURE}
    QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY scheduled_at DESC NULLS LAST, id DESC) = 1) r ON r.workflow_id = a.id
  LEFT JOIN (SELECT workflow_id, count(*) AS n FROM archive GROUP BY workflow_id) c ON c.workflow_id = a.id""", "definitions archive live")
def _(x: Fixtures) -> DataFrame:
    return R.workflow_list(x.definitions(), x.archive(), x.live()).select("workflow_id", "version", "live_version", "run_id", "run_state", "completed_runs")


@query("Q2_workflow_detail", """SELECT d.id, d.version, d.status, count(*) OVER () AS n_versions, d.version = (SELECT version FROM definitions WHERE id = 7 ORDER BY (status IN ('Ready', 'Submitted')) DESC, version DESC LIMIT 1) AS is_default,
  (SELECT count(*) FROM archive WHERE workflow_id = 7) AS completed_runs FROM definitions d WHERE d.id = 7""", "definitions archive")
def _(x: Fixtures) -> DataFrame:
    d = x.definitions().where("id = 7")
    default = R.default_versions(d).select("id", F.col("version").alias("dv"))
    n = d.groupBy("id").agg(F.count("*").alias("n_versions"))
    c = R.completed_counts(x.archive().where("workflow_id = 7")).withColumnRenamed("workflow_id", "id")
    return d.join(default, "id").join(n, "id").join(c, "id", "left").select("id", "version", "status", "n_versions", (F.col("version") == F.col("dv")).alias("is_default"), F.coalesce("completed_runs", F.lit(0)).alias("completed_runs"))


@query("Q4_instances_of_day", "SELECT id, state FROM (SELECT id, workflow_id, state, scheduled_at FROM archive UNION ALL SELECT id, workflow_id, state, scheduled_at FROM live WHERE id NOT IN (SELECT id FROM archive)) WHERE workflow_id = 7 AND timezone('Asia/Tokyo', timezone('UTC', scheduled_at))::DATE = DATE '1995-03-01'", "archive live")
def _(x: Fixtures) -> DataFrame:
    m = R.merge_archive_wins(x.archive().where("workflow_id = 7"), x.live().where("workflow_id = 7"))
    return R.in_local_day(m, "Asia/Tokyo", "1995-03-01").select("id", "state")


@query("Q4_instances_of_year", "SELECT id, state FROM (SELECT id, workflow_id, state, scheduled_at FROM archive UNION ALL SELECT id, workflow_id, state, scheduled_at FROM live WHERE id NOT IN (SELECT id FROM archive)) WHERE workflow_id = 7 AND timezone('Asia/Tokyo', timezone('UTC', scheduled_at))::DATE BETWEEN '1996-01-01' AND '1996-12-31'", "archive live")
def _(x: Fixtures) -> DataFrame:
    m = R.merge_archive_wins(x.archive().where("workflow_id = 7"), x.live().where("workflow_id = 7"))
    return R.in_local_year(m, "Asia/Tokyo", 1996).select("id", "state")


@query("Q5_instance_detail", "SELECT r.id, r.state, count(a.task_id) AS task_count, count(*) FILTER (a.state = 'Completed') AS completed FROM (SELECT id, state FROM archive UNION ALL SELECT id, state FROM live WHERE id NOT IN (SELECT id FROM archive)) r LEFT JOIN attempts a ON a.run_id = r.id GROUP BY r.id, r.state", "archive live attempts")
def _(x: Fixtures) -> DataFrame:
    n = x.attempts().groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("t"), F.count_if(F.col("state") == "Completed").alias("c"))
    m = R.merge_archive_wins(x.archive(), x.live()).select("id", "state")
    return m.join(n, "id", "left").select("id", "state", F.coalesce("t", F.lit(0)).alias("task_count"), F.coalesce("c", F.lit(0)).alias("completed"))


@query("Q6_instance_tasks", "SELECT run_id, task_id, attempt, executor_id, state FROM attempts QUALIFY row_number() OVER (PARTITION BY run_id, task_id ORDER BY attempt DESC, executor_id, started_at, q, price) = 1", "attempts")
def _(x: Fixtures) -> DataFrame:
    return R.latest_attempts(x.attempts()).select("run_id", "task_id", "attempt", "executor_id", "state")


@query("Q11_dashboard_clock", "SELECT m.id, m.state, n.name FROM (SELECT id, workflow_id, state, scheduled_at FROM archive UNION ALL SELECT id, workflow_id, state, scheduled_at FROM live WHERE id NOT IN (SELECT id FROM archive)) m LEFT JOIN (SELECT id, arg_max(name, version) AS name FROM definitions GROUP BY id) n ON n.id = m.workflow_id WHERE m.scheduled_at >= '1996-01-01' AND m.scheduled_at <= '1997-01-01'", "archive live definitions")
def _(x: Fixtures) -> DataFrame:
    m = R.in_range(R.merge_archive_wins(x.archive(), x.live()), "1996-01-01", "1997-01-01")
    return R.latest_names(m, x.definitions()).select("id", "state", "name")


@query("Q12_upcoming", f"SELECT l.id, n.name FROM (SELECT id, workflow_id FROM live WHERE state IN {_FUTURE} ORDER BY live.scheduled_at ASC NULLS LAST, id LIMIT 20) l LEFT JOIN (SELECT id, arg_max(name, version) AS name FROM definitions GROUP BY id) n ON n.id = l.workflow_id", "live definitions")
def _(x: Fixtures) -> DataFrame:
    top = x.live().where(F.col("state").isin(*R.FUTURE)).orderBy(F.asc_nulls_last("scheduled_at"), "id").limit(20)
    return R.latest_names(top, x.definitions()).select("id", "name")
