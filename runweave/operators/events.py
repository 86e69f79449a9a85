"""Event log: payload filters, pages, idempotent append, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: the types of each filter family
FAMILIES = {
    "Workflow": ["CreateWorkflowInstance", "CancelWorkflowInstance", "TickReceived", "WorkflowSubmitted", "WorkflowInstanceCreated", "WorkflowTriggered", "WorkflowCompleted", "WorkflowFailed"],
    "Task": ["TaskInstanceCreated", "TaskQueued", "TaskDelivered", "TaskAssigned", "TaskStarted", "TaskCompleted", "TaskFailed", "TaskCancelled", "TaskParked"],
    "Gate": ["GateDispatched", "GateOutcome", "GateTimeoutFired"],
}
_MEMBER = "map<string,struct<workflow_instance_id:string,task_instance_id:string,reason:string>>"


def members(payload: str = "payload") -> Column:
    return F.map_values(F.from_json(payload, _MEMBER))


def mentions(field: str, value: str, payload: str = "payload") -> Column:
    """The payload is an object with a member whose `field` is the value, whatever the member's name."""
    return F.coalesce(F.exists(members(payload), lambda m: m[field] == value), F.lit(False))


def in_family(family: str) -> Column:
    return F.lit(True) if family == "All" else F.col("event_type").isin(FAMILIES[family])


def newest_page(events: DataFrame, after: int, size: int = 200) -> DataFrame:
    """The newest rows above the cursor; more than a page's rows between polls leave a hole."""
    return events.where(F.col("seq") > after).orderBy(F.desc("seq")).limit(size)


def next_page(events: DataFrame, after: int, size: int = 200) -> DataFrame:
    """The oldest rows above the cursor: a pager without holes."""
    return events.where(F.col("seq") > after).orderBy("seq").limit(size)


def cursor(events: DataFrame) -> DataFrame:
    return events.agg(F.max(F.struct("archived_at", "id")).alias("c")).select("c.archived_at", "c.id")


def append_new(log: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Rows of the batch whose id the log lacks, each id once, with the next sequence numbers.

    Numbers are given by ranges of the order: rows are counted by range first, so no
    single task numbers the batch.
    """
    fresh = batch.join(log.select("id"), "id", "left_anti")
    w = W.partitionBy("id").orderBy(*order)
    fresh = fresh.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__top"))
    return numbered(fresh.drop("seq"), order, "seq").crossJoin(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("__top")).drop("__top")


def numbered(df: DataFrame, order: list[str], name: str, width: int = 4096) -> DataFrame:
    """Numbers from 1 in the given order, whose first column is whole-numbered: ranges of it, then places inside."""
    part = F.floor(F.col(order[0]) / width).alias("__part")
    d = df.withColumn("__part", part)
    sizes = d.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return d.withColumn("__in", inside).join(sizes, "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def display_order() -> list[Column]:
    return [F.desc("ts"), F.desc("seq")]


_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def chips(payload: str = "payload", event_type: str = "event_type") -> Column:
    """label=value of the payload's own member: ids (uuids cut to 8 characters), reason and triggered_by."""
    inner = F.from_json(F.get_json_object(payload, "$") , "map<string,string>")
    body = F.try_element_at(inner, F.col(event_type))
    fields = F.map_entries(F.from_json(body, "map<string,string>"))
    keep = F.filter(fields, lambda e: e["value"].isNotNull() & (e["key"].endswith("_id") | F.rlike(e["value"], F.lit(_UUID)) | e["key"].isin("reason", "triggered_by")))
    return F.transform(keep, lambda e: F.concat(F.regexp_replace(e["key"], "_id$", ""), F.lit("="), F.when(F.rlike(e["value"], F.lit(_UUID)), F.substring(e["value"], 1, 8)).otherwise(e["value"])))
