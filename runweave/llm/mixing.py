"""Mixing sources to target weights by hash-threshold histograms.

Nothing is sorted: sizes are summed by source and hash bucket, the bucket in which
a source's budget ends is split again on the next hash bits, and so on until one
hash value is left; the threshold then is a plain filter. Thresholds are nested: a
larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, unused

BITS, LEVELS = 10, 6


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(col: str) -> Column:
    """60 bits of the key's md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): all sizes shared by weight, each source at most `most` times its own.

    Filling level: sources sorted by cap per weight, the first whose cap holds the
    level of what the ones before it leave over sets the level. Windows over one row a
    source run in one task, which bounds sources at some ten million.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = by.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    asc = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(asc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("left", F.sum("w").over(asc.rowsBetween(W.currentRow, W.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.col("before")) / F.col("left"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("before"), F.col("level")))
    t = t.withColumn("fit", F.min(fits).over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    level = F.col("fit.level")
    target = F.when(F.col("cap") / F.col("w") < level, F.col("cap").cast("double")).otherwise(level * F.col("w"))
    return t.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.col(source).alias("source"), word_count(text).alias("size"), hash60(key).alias("h"))


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(s, source_size, target, times, cut): how often a source's texts are taken, and below which hash once more."""
    targets = source_targets(sized, weights, most)
    times = F.least(F.lit(most), F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("long")
    goal = targets.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    goal = materialize(goal.withColumnRenamed("source", "s"), "goal")
    state = goal.select("s", "rest", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        inside = F.shiftright("h", shift + BITS) == F.col("at") if level else F.lit(True)
        hist = (
            sized.join(state, F.col("source").eqNullSafe(F.col("s")) & inside)
            .groupBy("s", "rest", "below", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("n"))
        )
        run = W.partitionBy("s").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("below") + F.sum("n").over(run.rowsBetween(W.unboundedPreceding, W.currentRow)))
        last = F.max("bucket").over(W.partitionBy("s"))
        edge = hist.withColumn("last", last).where((F.col("upto") > F.col("rest")) | (F.col("bucket") == F.col("last")))
        state = edge.groupBy("s").agg(F.min(F.struct("bucket", "upto", "n", "rest")).alias("e")).select(
            "s", F.col("e.rest").alias("rest"), F.col("e.bucket").alias("at"), (F.col("e.upto") - F.col("e.n")).alias("below"), F.col("e.n").alias("n"))
        if level < LEVELS - 1:
            state = state.drop("n")
    # the boundary value itself counts when more than half of it fits
    cut = state.select(F.col("s").alias("c"), F.when(F.col("below") + F.col("n") / 2 <= F.col("rest"), F.col("at") + 1).otherwise(F.col("at")).alias("cut"))
    return materialize(goal.join(cut, F.col("s").eqNullSafe(F.col("c")), "left").drop("c", "rest"), "mix")


def threshold_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    return _plan(materialize(_sized(docs, key, text, source), "sized"), weights, most)


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of docs, each as often as mix_sources takes it (not at all, up to `most` times).

    All columns are kept, whatever their names; an empty table gives no rows.
    """
    plan = threshold_plan(docs, key, text, source, weights, most)
    s, n, cut, h, z, t, i = unused(docs, "s", "n", "cut", "h", "z", "t", "i")
    plan = plan.select(F.col("s").alias(s), F.col("times").alias(n), F.col("cut").alias(cut))
    own = docs.withColumns({h: hash60(key), z: word_count(text)})
    times = F.col(n) + (F.col(h) < F.col(cut)).cast("long")
    own = own.join(plan, F.col(source).eqNullSafe(F.col(s))).withColumn(t, F.least(times, F.lit(most).cast("long")))
    own = own.where((F.col(z) > 0) & (F.col(t) > 0))
    return own.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(t)))).select(docs.columns)


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Every row's (key, source, size, source_size, target, taken): words a mix takes from it.

    A source whose target is r times its size takes each text floor(r) times and, of the
    rest, those below a hash threshold once more; the text at the threshold counts if that
    comes closer to the target. So whole texts are taken, at most `most` times each, and
    reruns agree. Null texts have size 0 and take 0; a null source is a source of its
    own; rows with one key stand or fall together; an empty table gives no rows.
    """
    sized = materialize(_sized(docs, key, text, source), "sized")
    goal = _plan(sized, weights, most)
    taken = F.col("size") * (F.col("times") + (F.col("h") < F.col("cut")).cast("long"))
    out = sized.join(goal, F.col("source").eqNullSafe(F.col("s")), "left")
    taken = F.least(F.coalesce(taken, F.lit(0)), F.col("size") * most)
    return out.select(F.col("k").alias(key), "source", "size", "source_size", "target", taken.alias("taken"))
