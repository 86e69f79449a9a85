"""Transitions to timeline segments, first-transition pivots, durations, debounced status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.functions import scalars as X

# fixed values: colour token by canonical state
STATE_TOKEN = {
    "scheduled": "neutral", "pending": "neutral", "queued": "neutral", "in_progress": "info", "parked": "warning", "completed": "success", "failed": "destructive", "cancelled": "destructive",
    "killed": "destructive", "timed_out": "destructive", "skipped": "neutral", "unknown": "neutral",
}
REDISPATCH = ("Queued", "Delivered", "Assigned")


def first_at(states: list[str], transitions: str = "transitions") -> Column:
    """Time of the first transition, in array order, to one of the states."""
    return F.get(F.filter(transitions, lambda t: t["to"].isin(states)), F.lit(0))["at"]


def pivot_first(df: DataFrame) -> DataFrame:
    return df.withColumns({"triggered_at": first_at(["Triggered"]), "first_started_at": first_at(["InProgress"]), "first_completed_at": first_at(["Completed", "Failed", "Cancelled"])})


def is_terminal(raw: Column) -> Column:
    return X.normalize_state(raw).isin(*X.TERMINAL)


def token(raw: Column) -> Column:
    return X.lookup(STATE_TOKEN, X.normalize_state(raw))


def segments(df: DataFrame) -> DataFrame:
    """id, i, state, start, end, token, outcome: one row a drawn window of each instance's transitions (array of to, at).

    A terminal transition opens none; a running window takes the colour of the terminal
    that closes it; re-dispatch draws only after a park; an instance that is terminal
    without a recorded terminal, or with at most one drawn window, has none. The walk
    needs only the row, so nothing is shuffled.
    """
    t = F.col("transitions")
    recorded = F.exists(t, lambda x: is_terminal(x["to"]))
    legacy = (is_terminal(F.col("state")) | F.col("completed_at").isNotNull()) & ~recorded
    item = lambda x, i: F.struct(
        i.alias("i"), x["to"].alias("state"), x["at"].alias("start"), F.get(t, i + 1)["at"].alias("end"), F.get(t, i + 1)["to"].alias("next"),
        F.exists(F.slice(t, F.lit(1), i), lambda y: y["to"] == "Parked").alias("parked"))
    drawn = F.filter(F.transform(t, item), lambda s: s["start"].isNotNull() & ~is_terminal(s["state"]) & (~s["state"].isin(*REDISPATCH) | s["parked"]))
    d = df.where(~F.coalesce(legacy, F.lit(False))).withColumn("__s", drawn).where(F.size("__s") > 1).select("id", F.explode("__s").alias("s"))
    running = X.normalize_state(F.col("s.state")) == "in_progress"
    closed = running & F.coalesce(is_terminal(F.col("s.next")) & F.col("s.next").isNotNull(), F.lit(False))
    color = F.when(closed, token(F.col("s.next"))).when(F.col("s.state").isin(*REDISPATCH), "warning").otherwise(token(F.col("s.state")))
    return d.select("id", "s.i", "s.state", "s.start", "s.end", color.alias("token"), F.when(closed, F.col("s.next")).otherwise(F.col("s.state")).alias("outcome"))


def terminal_markers(df: DataFrame, segs: DataFrame) -> DataFrame:
    """(id, at, token) where an instance is terminal and its last window ends otherwise."""
    last = segs.groupBy("id").agg(F.max(F.struct("i", "end", "outcome")).alias("l"))
    j = df.where(is_terminal(F.col("state"))).join(last, "id").where(X.normalize_state(F.col("l.outcome")) != X.normalize_state(F.col("state")))
    return j.select("id", F.coalesce("l.end", "completed_at").alias("at"), token(F.col("state")).alias("token")).where("at is not null")


def duration_ms(started: Column, completed: Column, now: Column) -> Column:
    """Null if not started; never negative; open attempts run to now."""
    return F.when(started.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_millis(F.coalesce(completed, now)) - F.unix_millis(started)))


def attempt_label(name: Column, attempt: Column) -> Column:
    return F.when(attempt > 0, F.concat(name, F.lit(" (attempt "), (attempt + 1).cast("string"), F.lit(")"))).otherwise(name)


def extent(rows: DataFrame, now: Column) -> DataFrame:
    lo = F.coalesce(F.min("start"), now)
    return rows.agg(lo.alias("lo"), F.greatest(lo, F.coalesce(F.max(F.coalesce("end", now)), now)).alias("hi"))


def park_turns(transitions: str = "transitions") -> Column:
    return F.size(F.filter(transitions, lambda t: t["to"] == "Parked"))


def debounced(readings: DataFrame, key: str) -> DataFrame:
    """(key, seq, shown): a status is shown after two readings of it in a row; the first is taken at once.

    readings: key, seq, status. What is shown is the latest status that agrees with the
    reading before it; a missing status is never shown.
    """
    upto = W.partitionBy(key).orderBy("seq")
    before = F.count("status").over(upto.rowsBetween(W.unboundedPreceding, -1))
    sure = F.when((before == 0) | (F.col("status") == F.lag("status").over(upto)), F.col("status"))
    r = readings.withColumn("sure", sure)
    shown = F.last("sure", True).over(upto.rowsBetween(W.unboundedPreceding, W.currentRow))
    return r.select(key, F.col("seq").cast("long").alias("seq"), shown.alias("shown"))


def abnormal_end(marker_known: Column, has_marker: Column, state: Column) -> Column:
    return marker_known & ~has_marker & X.normalize_state(state).isin("completed", "failed")
