"""Patch documents as rows: primitive operations, handle checks, arms of an expansion, step checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def primitive_ops(ops: DataFrame, minted: DataFrame) -> DataFrame:
    """(patch, position, op, node): placeholders are rewritten to the ids minted for them in their patch, codes pass through.

    ops: patch, items (array of op, node) in order; minted: patch, placeholder, id.
    """
    o = ops.select("patch", F.posexplode("items").alias("position", "i")).select("patch", "position", "i.op", "i.node")
    m = minted.select("patch", F.col("placeholder").alias("node"), F.col("id").alias("__id"))
    return o.join(m, ["patch", "node"], "left").select("patch", "position", "op", F.coalesce("__id", "node").alias("node"))


def duplicate_handles(steps: DataFrame) -> DataFrame:
    """(patch, scope, handle, n) of handles given more than once in one scope."""
    return steps.groupBy("patch", "scope", "handle").agg(F.count("*").alias("n")).where("n > 1")


def expansion_arms(expansions: DataFrame) -> DataFrame:
    """(patch, arm, key, path): arms of a map in order of their keys, numbered from 0; an empty map has none."""
    e = F.array_sort(F.map_entries("arms"))
    return expansions.select("patch", F.posexplode(e).alias("arm", "e")).select("patch", "arm", "e.key", F.col("e.value").alias("path"))


def step_error(leaf: Column, nested: Column) -> Column:
    """A step is a leaf or nested, not both or neither; nested ones are not empty; a leaf path names a #fragment."""
    return (
        F.when(leaf.isNotNull() & nested.isNotNull(), "both").when(leaf.isNull() & nested.isNull(), "neither").when(nested.isNotNull() & (F.size(nested) == 0), "empty")
        .when(leaf.isNotNull() & ~leaf.contains("#"), "no_fragment"))


def branch_arms(branches: DataFrame) -> DataFrame:
    """(patch, arm, gate, path): gated arms in the order given."""
    return branches.select("patch", F.posexplode(F.arrays_zip("gates", "paths")).alias("arm", "z")).select("patch", "arm", F.col("z.gates").alias("gate"), F.col("z.paths").alias("path"))


def version_intents(patches: DataFrame) -> DataFrame:
    """Patches of each definition in order, with the version each makes."""
    w = W.partitionBy("definition").orderBy("applied_at", "patch")
    return patches.withColumn("version", F.row_number().over(w))
