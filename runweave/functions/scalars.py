"""Scalar functions of the data model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: alphabet of identity codes, and raw states by canonical name
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
STATES = {
    "Scheduled": "scheduled", "PendingSchedule": "pending", "Triggered": "scheduled", "Pending": "pending", "Queued": "queued", "InProgress": "in_progress", "Running": "in_progress", "Parked": "parked",
    "Completed": "completed", "Failed": "failed", "Cancelled": "cancelled", "Killed": "killed", "TimedOut": "timed_out", "Skipped": "skipped",
    "scheduled": "scheduled", "pending": "pending", "queued": "queued", "in-progress": "in_progress", "parked": "parked", "completed": "completed", "failed": "failed", "cancelled": "cancelled", "killed": "killed",
    "timed-out": "timed_out", "skipped": "skipped", "unknown": "unknown",
}
CLOCK = {"scheduled": "scheduled", "pending": "scheduled", "in_progress": "in_progress", "completed": "completed", "failed": "failed", "cancelled": "failed", "killed": "failed", "timed_out": "failed"}
# fixed values: category of each event type, and colour token of each category
CATEGORY = {
    "CreateWorkflowInstance": "workflow", "CancelWorkflowInstance": "cancel", "TickReceived": "workflow", "WorkflowSubmitted": "workflow", "WorkflowInstanceCreated": "workflow", "WorkflowTriggered": "workflow",
    "WorkflowCompleted": "success", "WorkflowFailed": "failure", "TaskInstanceCreated": "task", "TaskQueued": "task", "TaskDelivered": "task", "TaskAssigned": "task", "TaskStarted": "task",
    "TaskCompleted": "success", "TaskFailed": "failure", "TaskParked": "waiting", "TaskCancelled": "cancel", "GateDispatched": "waiting", "GateOutcome": "gate", "GateTimeoutFired": "cancel",
}
TOKEN = {"workflow": "workflow-lifecycle", "task": "task-lifecycle", "gate": "info", "success": "success", "failure": "destructive", "cancel": "destructive", "waiting": "warning"}
SYMBOLS = {"Eq": "==", "Ne": "!=", "Lt": "<", "Le": "<=", "Gt": ">", "Ge": ">="}
TASK_TYPES = ("RegularTask", "SensorTask", "ShadowTask")
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"
TERMINAL = ("completed", "failed", "cancelled", "killed", "timed_out", "skipped")


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """Value of a small fixed table; the default where the key is missing or null."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def normalize_state(raw: Column) -> Column:
    return lookup(STATES, raw, "unknown")


def clock_family(raw: Column) -> Column:
    return lookup(CLOCK, normalize_state(raw))


def parse_duration(text: Column) -> tuple[Column, Column]:
    """(seconds, error): digits with s, m, h or nothing; values beyond a long overflow."""
    t = F.trim(text)
    digits = F.regexp_extract(t, "^[0-9]*", 0)
    unit = F.substr(t, F.length(digits) + 1)
    value = digits.cast("decimal(38,0)")
    scale = F.when(unit.isin("", "s"), 1).when(unit == "m", 60).when(unit == "h", 3600)
    most = F.lit("18446744073709551615").cast("decimal(38,0)")
    error = (
        F.when(F.coalesce(t, F.lit("")) == "", "Empty").when(digits == "", "NotANumber").when((F.length(digits) > 20) | (value > most), "NotANumber").when(value == 0, "NonPositive")
        .when(scale.isNull(), "UnknownUnit").when(value * scale > most, "Overflow"))
    return F.when(error.isNull(), (value * scale).cast("long")), error


def hex_of(uuid: Column) -> Column:
    return F.replace(F.lower(uuid), F.lit("-"), F.lit(""))


def identity_code(uuid: Column) -> Column:
    """Four symbols for the top 20 bits."""
    top = F.conv(F.substring(hex_of(uuid), 1, 5), 16, 10).cast("int")
    return F.concat(*[F.substr(F.lit(ALPHABET), F.shiftright(top, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])


def dashed(h: Column) -> Column:
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _stamped(h: Column, version: str) -> Column:
    """Version and variant bits set in 32 hex digits."""
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 12), F.lit(version), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def uuid5(namespace_hex: Column, name: Column) -> Column:
    """UUIDv5 of a name, binary or text, in a namespace given as 32 hex digits."""
    return dashed(_stamped(F.substring(F.sha1(F.concat(F.unhex(namespace_hex), name.cast("binary"))), 1, 32), "5"))


def workflow_id(tenant: Column, namespace: Column, slug: Column) -> Column:
    return uuid5(F.lit(NAMESPACE_OID), F.concat_ws(".", tenant, namespace, slug))


def scheduled_run_id(workflow: Column, rfc3339: Column) -> Column:
    """First eight bytes of the workflow's id, then of the timestamp text's SHA-256, with version 4 bits."""
    return dashed(_stamped(F.concat(F.substring(hex_of(workflow), 1, 16), F.substring(F.sha2(rfc3339, 256), 1, 16)), "4"))


def namespace_or_default(x: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("default"))


def sanitize_segment(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9_=.\-]", "_")


def is_slug(x: Column) -> Column:
    return F.coalesce(F.rlike(x, F.lit(r"\A[a-z0-9-]{1,64}\z")), F.lit(False))


def is_identifier(x: Column) -> Column:
    return F.coalesce(F.rlike(x, F.lit(r"\A[A-Za-z0-9_-]{1,64}\z")), F.lit(False))


def key_name(key: Column) -> Column:
    """What follows the first slash; all of it without one."""
    return F.regexp_replace(key, r"^[^/]*+/", "")


def relative_time(seconds: Column) -> Column:
    """Age in whole units from rounded seconds."""
    s = F.greatest(F.lit(0), F.floor(seconds + F.lit(0.5))).cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    text = lambda n, u: F.concat(n.cast("string"), F.lit(u))
    return F.when(s < 60, text(s, "s ago")).when(m < 60, text(m, "m ago")).when(h < 24, text(h, "h ago")).otherwise(text(F.floor(h / 24), "d ago"))


def variant_kind(v: Column) -> Column:
    """string, bool, int, float or json of a VARIANT; null and composite values are json."""
    s = F.schema_of_variant(v)
    return F.when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(s == "BIGINT", "int").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float").otherwise("json")


def routing_kind(v: Column) -> tuple[Column, Column]:
    """(kind, error) of casting a JSON value to a routing value: no float, null or composite."""
    k = variant_kind(v)
    ok = k.isin("string", "bool", "int")
    return F.when(ok, k), F.when(~ok, F.concat(F.lit("unsupported "), F.when(k == "json", F.when(F.is_variant_null(v), "null").otherwise("composite")).otherwise(k)))


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def comparison_symbol(op: Column) -> Column:
    return lookup(SYMBOLS, op)


def task_type(raw: Column) -> Column:
    return F.when(raw.isin(*TASK_TYPES), raw).otherwise("RegularTask")


def event_token(event_type: Column) -> Column:
    return lookup({k: TOKEN[v] for k, v in CATEGORY.items()}, event_type, "neutral")


def render_envelope(kind: Column, value: Column) -> Column:
    """Text of an envelope's JSON value: strings bare, everything else as its JSON text."""
    return F.when(kind == "string", F.variant_get(value, "$", "string")).otherwise(F.to_json(value))
