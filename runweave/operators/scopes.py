"""Captured context: scopes, ambient names, routing values, masking, replay inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions import scalars as X


def visible(df: DataFrame) -> DataFrame:
    """Rows of keys that are not reserved."""
    return df.where((F.col("key") != "graph") & ~F.col("key").startswith("replay/"))


def masked(value: Column, secret: Column, present: Column) -> Column:
    return F.when(~secret & present, value)


def producer_text(kind: Column, name: Column, ident: Column, source: Column) -> Column:
    return (
        F.when(kind == "task", F.concat(F.lit("task "), F.coalesce(name, ident))).when(kind == "signal", F.concat(F.lit("signal "), ident, F.lit(" ("), source, F.lit(")")))
        .otherwise(F.concat(F.lit("system "), name)))


def classify(entries: DataFrame, scopes: DataFrame) -> DataFrame:
    """entries (key, value) of each scope (prefix, scope, position): names in order; a scope without entries keeps one null row."""
    e = visible(entries).withColumn("prefix", F.substring_index("key", "/", 1)).withColumn("name", X.key_name(F.col("key")))
    return scopes.join(e, "prefix", "left").select("scope", "position", "name", "value")


def gate_scopes(gates: DataFrame) -> DataFrame:
    """Distinct sorted signal ids of a run's satisfied gates."""
    ok = (F.col("state") == "Satisfied") & F.col("signal_id").isNotNull() & (F.col("signal_id") != 0)
    return gates.groupBy("run_id").agg(F.array_sort(F.collect_set(F.when(ok, F.col("signal_id")))).alias("scopes"))


def ambient(entries: DataFrame) -> DataFrame:
    """(run_id, name, outcome, value): one scope gives the value, several collide; names asked for and not there are NotFound."""
    g = entries.groupBy("run_id", "name").agg(F.count("value").alias("n"), F.min("value").alias("v"))
    return g.select("run_id", "name", F.when(F.col("n") == 0, "NotFound").when(F.col("n") == 1, "Value").otherwise("Collision").alias("outcome"), F.when(F.col("n") == 1, F.col("v")).alias("value"))


def first_scope(entries: DataFrame) -> DataFrame:
    """(run_id, name, value): run before trigger before gates, by position; unlike ambient, collisions take the first."""
    return entries.where("value is not null").groupBy("run_id", "name").agg(F.min_by("value", "position").alias("value"))


def split_routing(emitted: DataFrame, declared: DataFrame) -> DataFrame:
    """Per emission (id, name, json): routed if declared and castable, else rest; one bad value fails the whole emission."""
    v = F.try_parse_json("json")
    kind, error = X.routing_kind(v)
    j = emitted.join(declared.select("name").distinct().withColumn("d", F.lit(True)), "name", "left")
    j = j.withColumn("kind", F.when(F.col("d"), kind)).withColumn("error", F.when(F.col("d"), error))
    return j.groupBy("id").agg(
        F.bool_or(F.col("error").isNotNull()).alias("failed"),
        F.array_sort(F.collect_list(F.when(F.col("d") & F.col("error").isNull(), F.concat_ws(":", "name", "kind")))).alias("routed"),
        F.array_sort(F.collect_list(F.when(F.col("d").isNull(), F.col("name")))).alias("rest")).select(
        "id", "failed", F.when(~F.col("failed"), F.array_join("routed", ",")).alias("routed"), F.when(~F.col("failed"), F.array_join("rest", ",")).alias("rest"))


def dropped(declared: Column, emitted: Column, failed: Column) -> Column:
    """Declared names that were emitted but lost because the emission failed; an absent name is no loss."""
    return F.when(failed, F.array_sort(F.array_intersect(declared, emitted))).otherwise(F.array())


def write_claims(writes: DataFrame) -> DataFrame:
    """Applied, Idempotent or ClaimConflict of each write (claim, seq, scope, digest): the first write of a claim holds it."""
    first = writes.groupBy("claim").agg(F.min(F.struct("seq", "scope", "digest")).alias("f"))
    j = writes.join(first, "claim")
    same = (F.col("scope") == F.col("f.scope")) & (F.col("digest") == F.col("f.digest"))
    return j.select("claim", "seq", F.when(F.col("seq") == F.col("f.seq"), "Applied").when(same, "Idempotent").otherwise("ClaimConflict").alias("outcome"))


def replay_inputs(inputs: DataFrame, captures: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each input key against the pinned version: carried with its kind if a capture declares it, else a typed error."""
    j = inputs.join(captures.select("name").distinct().withColumn("c", F.lit(True)), "name", "left").join(outputs.select("name").distinct().withColumn("o", F.lit(True)), "name", "left")
    error = F.when(F.col("c"), None).when(F.col("o"), "task_produced").otherwise("undeclared")
    return j.select("id", "name", F.when(F.col("c"), X.variant_kind(F.try_parse_json("json"))).alias("kind"), error.alias("error"))


def emitted_signals(emits: DataFrame, values: DataFrame) -> DataFrame:
    """(run_id, name, payload, error): payload is the variable's value; a missing one is an error; failures carry their lineage."""
    j = emits.join(values, ["run_id", "var"], "left")
    ok = F.col("on") == "success"
    return j.select("run_id", "name", F.when(ok, F.col("value")).otherwise(F.concat_ws("/", F.col("run_id").cast("string"), F.lit("task"))).alias("payload"), F.when(ok & F.col("value").isNull(), "missing").alias("error"))
