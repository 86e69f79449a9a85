"""Signals: fan-out to subscribers, one-shot gates, idempotency, captures, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.functions import jsonpath
from runweave.functions.scalars import variant_kind

from .asof import first_after


def compiled(text: str | None, payload: str = "payload") -> Column:
    return F.lit(True) if text is None else jsonpath.predicate(text, F.try_parse_json(payload))


def fan_out(signals: DataFrame, subscriptions: list[tuple[int, int, str, str | None]]) -> DataFrame:
    """signals x matching subscriptions (sub_id, workflow_id, name, predicate): equal name and predicate true or absent.

    Predicates are compiled into one array expression per signal, so a signal row is read once
    and nothing is shuffled.
    """
    hits = [F.when((F.col("name") == name) & compiled(text), F.struct(F.lit(s).alias("sub_id"), F.lit(w).alias("workflow_id"))) for s, w, name, text in subscriptions]
    matched = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return signals.withColumn("__m", F.explode(matched)).select("*", "__m.sub_id", "__m.workflow_id").drop("__m")


def fan_out_tallies(signals: DataFrame, matches: DataFrame, gates: DataFrame) -> DataFrame:
    """Per signal: workflows triggered and gates met; signals that met nothing are absent."""
    a = matches.groupBy("signal_id").agg(F.count("*").alias("matched_workflows"))
    b = gates.where("hit_signal_id is not null").groupBy(F.col("hit_signal_id").alias("signal_id")).agg(F.count("*").alias("gates_matched"))
    out = a.join(b, "signal_id", "full")
    return out.select("signal_id", F.coalesce("matched_workflows", F.lit(0)).alias("matched_workflows"), F.coalesce("gates_matched", F.lit(0)).alias("gates_matched"))


def consume_gates(gates: DataFrame, signals: DataFrame, width: int = 500) -> DataFrame:
    """Each gate (name, seq it was registered at) with the first signal of its name from then on, which consumes it."""
    s = signals.select("name", F.col("signal_id").alias("seq"), "signal_id")
    return first_after(gates, s, "name", "seq", width, ["seq", "signal_id"])


def idempotency(requests: DataFrame, ttl: int) -> DataFrame:
    """Fresh, Dedup or Conflict of each request (key, seq, at in seconds, hash), with the original's seq and hash.

    A key is remembered for ttl seconds from the request that took it; after that the next
    request takes it anew. Runs of one key are walked in order of arrival.
    """
    item = F.array_sort(F.collect_list(F.struct("seq", "at", "hash")))
    walk = f"""aggregate(r, named_struct('held', cast(null as struct<seq:bigint,at:bigint,hash:string>), 'out', cast(array() as array<struct<seq:bigint,outcome:string,original:bigint>>)),
        (a, x) -> named_struct(
            'held', if(a.held is null or x.at >= a.held.at + {ttl}, named_struct('seq', x.seq, 'at', x.at, 'hash', x.hash), a.held),
            'out', concat(a.out, array(named_struct('seq', x.seq,
                'outcome', case when a.held is null or x.at >= a.held.at + {ttl} then 'Fresh' when x.hash = a.held.hash then 'Dedup' else 'Conflict' end,
                'original', if(a.held is null or x.at >= a.held.at + {ttl}, x.seq, a.held.seq))))),
        a -> a.out)"""
    typed = requests.select("key", F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"), F.col("hash").cast("string").alias("hash"))
    return typed.groupBy("key").agg(item.alias("r")).select("key", F.explode(F.expr(walk)).alias("o")).select("key", "o.seq", "o.outcome", "o.original")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by min over a struct: map-side aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("f")).select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest])


def digest_conflicts(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys given with more than one digest."""
    return rows.groupBy(key).agg(F.count_distinct(digest).alias("n_digests")).where("n_digests > 1")


def signal_status(ids: DataFrame, wakeups: DataFrame, captures: DataFrame, cancels: DataFrame) -> DataFrame:
    """What a signal turned out to be: wakeup before captures before cancel, else unknown.

    captures may carry the linked run's state: terminal, then materialized, then pending.
    """
    w = wakeups.select("signal_id").distinct().withColumn("w", F.lit(True))
    c = captures.groupBy("signal_id").agg(F.max(F.when(F.col("run_state").isin("Completed", "Failed"), 2).when(F.col("run_state").isNotNull(), 1).otherwise(0)).alias("c"))
    x = cancels.select("signal_id").distinct().withColumn("x", F.lit(True))
    j = ids.join(w, "signal_id", "left").join(c, "signal_id", "left").join(x, "signal_id", "left")
    kind = F.when(F.col("w"), "wakeup").when(F.col("c") == 2, "terminal").when(F.col("c") == 1, "materialized").when(F.col("c") == 0, "pending").when(F.col("x"), "cancel").otherwise("unknown")
    return j.select("signal_id", kind.alias("status"))


def extract_captures(signals: DataFrame, declared: dict[str, str], payload: str = "payload") -> DataFrame:
    """(signal_id, name, present, kind, value) for each declared path: null that is there differs from nothing there."""
    v = F.try_parse_json(payload)
    one = [F.struct(F.lit(n).alias("name"), jsonpath.capture(p, v).alias("c")) for n, p in declared.items()]
    d = signals.select("signal_id", F.explode(F.array(*one)).alias("x")).select("signal_id", "x.name", "x.c.present", F.col("x.c.value").alias("v"))
    kind = F.when(F.col("present"), variant_kind(F.col("v"))).otherwise("json")
    return d.select("signal_id", "name", "present", kind.alias("kind"), F.when(F.col("present"), F.to_json("v")).otherwise("null").alias("value"))


def merge_captures(workflow: DataFrame, trigger: DataFrame) -> DataFrame:
    """(owner, name, path): the trigger's path wins; a name stands where it was first seen."""
    both = workflow.withColumn("__t", F.lit(0)).unionByName(trigger.withColumn("__t", F.lit(1)))
    g = both.groupBy("owner", "name").agg(F.max_by("path", F.struct("__t", -F.col("pos"))).alias("path"), F.min(F.struct("__t", "pos")).alias("seen"))
    w = W.partitionBy("owner").orderBy("seen")
    return g.select("owner", "name", "path", F.row_number().over(w).alias("position"))


def validate_captures(captures: DataFrame, outputs: DataFrame) -> DataFrame:
    """(owner, name, error): duplicate, shadowed by a task output, or bad path; null if fine."""
    n = captures.groupBy("owner", "name").agg(F.count("*").alias("n"), F.first("path").alias("path"))
    j = n.join(outputs.select("owner", "name").distinct().withColumn("o", F.lit(True)), ["owner", "name"], "left")
    bad = ~F.rlike("path", F.lit(r"^\$(\.[A-Za-z_]\w*|\[(\d+|\*|'[^']*')\])*$"))
    return j.select("owner", "name", F.when(F.col("n") > 1, "duplicate").when(F.col("o"), "task_output").when(bad, "bad_path").alias("error"))


def tags_contain(wanted: dict[str, str], tags: str = "tags") -> Column:
    """Every wanted tag is among the run's."""
    return F.coalesce(F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in wanted.items()]), lambda e: F.coalesce(F.try_element_at(F.col(tags), e["k"]) == e["v"], F.lit(False))), F.lit(False))


def compare_routing(op: Column, kind: Column, left: Column, right_kind: Column, right: Column) -> Column:
    """Six comparisons of values of one kind, numbers as longs; other kinds never hold."""
    num, txt = (left.cast("long"), right.cast("long")), (left, right)
    pick = lambda f: F.when(kind == "int", f(*num)).otherwise(f(*txt))
    t = F.when(op == "Eq", pick(lambda a, b: a == b)).when(op == "Ne", pick(lambda a, b: a != b)).when(op == "Lt", pick(lambda a, b: a < b)).when(op == "Le", pick(lambda a, b: a <= b)).when(op == "Gt", pick(lambda a, b: a > b)).when(op == "Ge", pick(lambda a, b: a >= b))
    return F.coalesce((kind == right_kind) & t, F.lit(False))
