"""Runs and definitions: latest-of, archive and live merges, rollups and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.functions import scalars as X

TERMINAL = ("Completed", "Failed")
FUTURE = ("PendingSchedule", "Scheduled")
LIVE_STATUS = ("Ready", "Submitted")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the order must be total."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def latest_archived(archive: DataFrame) -> DataFrame:
    return first_by(archive, ["workflow_id"], [F.desc_nulls_last("scheduled_at"), F.desc("archived_at"), F.desc("id")])


def merge_archive_wins(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Archive rows, and live rows of other ids: the anti join keeps it one shuffle of ids."""
    cols = [c for c in archive.columns if c in live.columns]
    return archive.select(cols).unionByName(live.join(archive.select("id"), "id", "left_anti").select(cols))


def latest_runs(archive: DataFrame, live: DataFrame, requested: DataFrame) -> DataFrame:
    """Every requested workflow with its latest run that is not armed for the future, or null."""
    merged = merge_archive_wins(archive, live).where(~F.col("state").isin(*FUTURE))
    top = first_by(merged, ["workflow_id"], [F.desc_nulls_last("scheduled_at"), F.desc("id")])
    return requested.join(top, "workflow_id", "left")


def completed_counts(archive: DataFrame) -> DataFrame:
    """Terminal runs a workflow; failed ones count too."""
    return archive.where(F.col("state").isin(*TERMINAL)).groupBy("workflow_id").agg(F.count("*").alias("completed_runs"))


def attempt_counts(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    n = attempts.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n_attempts"))
    return runs.join(n, "id", "left").withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))


def latest_names(runs: DataFrame, definitions: DataFrame) -> DataFrame:
    n = definitions.groupBy(F.col("id").alias("workflow_id")).agg(F.max_by("name", "version").alias("name"))
    return runs.join(n, "workflow_id", "left")


def in_range(runs: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Closed range on both ends; a null time passes only without bounds."""
    if start is not None:
        runs = runs.where(F.col("scheduled_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        runs = runs.where(F.col("scheduled_at") <= F.lit(end).cast("timestamp"))
    return runs


def in_local_year(runs: DataFrame, zone: str, year: int) -> DataFrame:
    """A UTC range a day wider on both sides, which reaches the scan, then the exact local year."""
    lo, hi = F.expr(f"timestamp'{year - 1}-12-31 00:00:00'"), F.expr(f"timestamp'{year + 1}-01-02 00:00:00'")
    near = runs.where((F.col("scheduled_at") >= lo) & (F.col("scheduled_at") < hi))
    return near.withColumn("day", X.local_date(F.col("scheduled_at"), zone)).where(F.year("day") == year)


def in_local_day(runs: DataFrame, zone: str, day: str) -> DataFrame:
    """Runs of one local day: a UTC range a day wider on both sides, which reaches the scan, then the exact local day."""
    lo, hi = (F.expr(f"cast(date'{day}' as timestamp_ntz) {d}") for d in ("- interval 1 day", "+ interval 2 days"))
    at = F.col("scheduled_at").cast("timestamp_ntz")
    return runs.where((at >= lo) & (at < hi)).withColumn("day", X.local_date(F.col("scheduled_at"), zone)).where(F.col("day") == F.expr(f"date'{day}'"))


def calendar(archive: DataFrame, live: DataFrame | None, zone: str, year: int, deduplicated: bool = False) -> DataFrame:
    """Per workflow and local day: completed, failed, in_progress, scheduled, total; days without runs are absent.

    A run in both halves counts in both unless deduplicated. Without live data the live
    columns are 0.
    """
    halves = in_local_year(archive, zone, year).select("workflow_id", "day", "state")
    if live is not None:
        if deduplicated:
            live = live.join(archive.select("id"), "id", "left_anti")
        halves = halves.unionByName(in_local_year(live, zone, year).select("workflow_id", "day", "state"))
    s = F.col("state")
    out = halves.groupBy("workflow_id", "day").agg(
        F.count_if(s == "Completed").alias("completed"), F.count_if(s == "Failed").alias("failed"), F.count_if(s == "InProgress").alias("in_progress"),
        F.count_if(s.isin("Scheduled", "Triggered", "PendingSchedule")).alias("scheduled"))
    return out.withColumn("total", F.expr("completed + failed + in_progress + scheduled"))


def day_level(row: Column | None = None) -> Column:
    return F.when(F.col("failed") > 0, "failed").when(F.col("scheduled") > 0, "scheduled").when(F.col("in_progress") > 0, "in_progress").when(F.col("completed") > 0, "completed").otherwise("none")


def clock(runs: DataFrame) -> DataFrame:
    """Counts of every five-minute slot of two half-day rings by clock family, zeros kept: half, slot, family, n."""
    spark = runs.sparkSession
    t = F.col("scheduled_at")
    slot = (F.hour(t) % 12) * 12 + F.floor(F.minute(t) / 5)
    found = runs.where(t.isNotNull()).select(F.when(F.hour(t) < 12, "am").otherwise("pm").alias("half"), slot.cast("int").alias("slot"), X.clock_family(F.col("state")).alias("family"))
    found = found.where("family is not null").groupBy("half", "slot", "family").count()
    spine = spark.range(144).select(F.col("id").cast("int").alias("slot"), F.explode(F.array(F.lit("am"), F.lit("pm"))).alias("half"))
    spine = spine.withColumn("family", F.explode(F.array(*[F.lit(f) for f in ("scheduled", "in_progress", "completed", "failed")])))
    return spine.join(found, ["half", "slot", "family"], "left").select("half", "slot", "family", F.coalesce("count", F.lit(0)).alias("n"))


def p90_clamp(counts: DataFrame, n: str = "n") -> DataFrame:
    """The element at floor(count * 0.9) of the sorted positive counts, at least 1; 1 without any.

    The counts of a clock are a fixed number of cells, so one array holds them.
    """
    a = F.array_sort(F.collect_list(F.when(F.col(n) > 0, F.col(n))))
    return counts.agg(a.alias("a")).select(F.greatest(F.lit(1), F.coalesce(F.expr("get(a, cast(floor(size(a) * 0.9) as int))"), F.lit(1))).cast("long").alias("clamp"))


def latest_definitions(definitions: DataFrame, live_only: bool = False) -> DataFrame:
    d = definitions.where(F.col("status").isin(*LIVE_STATUS)) if live_only else definitions
    return first_by(d, ["id"], [F.desc("version")])


def default_versions(definitions: DataFrame) -> DataFrame:
    return first_by(definitions, ["id"], [F.desc(F.col("status").isin(*LIVE_STATUS)), F.desc("version")])


def definitions_with_live(definitions: DataFrame) -> DataFrame:
    """Latest version of each definition beside its latest live one."""
    live = latest_definitions(definitions, True).select("id", F.col("version").alias("live_version"), F.col("name").alias("live_name"))
    return latest_definitions(definitions).join(live, "id", "left")


def workflow_list(definitions: DataFrame, archive: DataFrame, live: DataFrame) -> DataFrame:
    """Each definition with versions, latest run and completed count; null and 0 where there is none."""
    base = definitions_with_live(definitions).withColumnRenamed("id", "workflow_id")
    runs = latest_runs(archive, live, base.select("workflow_id")).select("workflow_id", F.col("id").alias("run_id"), F.col("state").alias("run_state"))
    out = base.join(runs, "workflow_id", "left").join(completed_counts(archive), "workflow_id", "left")
    return out.withColumn("completed_runs", F.coalesce("completed_runs", F.lit(0)))


def registration_decision(definitions: DataFrame, incoming: DataFrame) -> DataFrame:
    """What registering (id, content_hash, cosmetic_hash) does: action and version."""
    last = latest_definitions(definitions).select("id", "version", "status", F.col("content_hash").alias("c"), F.col("cosmetic_hash").alias("m"))
    j = incoming.join(last, "id", "left")
    act = (
        F.when(F.col("version").isNull(), "Insert").when(F.col("content_hash") != F.col("c"), "Insert").when(F.col("status") == "BuildFailed", "Requeue")
        .when(F.col("status") == "Building", "NoOp").when(F.col("cosmetic_hash") != F.col("m"), "Refresh").otherwise("NoOp"))
    v = F.when(F.col("version").isNull(), 1).when(act == "Insert", F.col("version") + 1).otherwise(F.col("version"))
    return j.select("id", act.alias("action"), v.cast("long").alias("version"))


def settled_groups(builds: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of which every build is ready: no sibling that is not."""
    return builds.groupBy(*keys).agg(F.bool_and(F.col("status").isin(*LIVE_STATUS)).alias("ready"), F.count("*").alias("n"))


def unsettled_siblings(builds: DataFrame, keys: list[str]) -> DataFrame:
    """Builds none of whose siblings is waiting, by anti join."""
    waiting = builds.where(~F.col("status").isin(*LIVE_STATUS)).select(*keys).distinct()
    return builds.join(waiting, keys, "left_anti")


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """Highest attempt of each (run, task); of equal ones the first by position."""
    return first_by(attempts, ["run_id", "task_id"], [F.desc("attempt"), F.asc("pos")])


def retry_exhausted(attempts: DataFrame, most: int) -> DataFrame:
    return attempts.groupBy("run_id", "task_id").agg(F.count("*").alias("n"), (F.count("*") >= most).alias("exhausted"))


def single_winner(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows, marked with whether they won their key (first by arrival) and with the winner's state."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("won", F.row_number().over(w) == 1).withColumn("winner", F.first("state").over(w))


def fleet_health(observations: DataFrame, now: int, ttl: int) -> DataFrame:
    """Counts and ages over observations not yet expired (expires_at, age, slots, in_flight), and the fleet's status."""
    o = observations.where((F.lit(ttl) > 0) & (F.col("expires_at") > now))
    a = o.agg(F.count("*").alias("observed"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.coalesce(F.sum("in_flight"), F.lit(0)).alias("in_flight"), F.min("age").alias("freshest"), F.max("age").alias("oldest"))
    return a.withColumn("status", F.when(F.col("freshest").isNull(), "unhealthy").when(F.col("freshest") < ttl // 4, "healthy").otherwise("degraded"))
