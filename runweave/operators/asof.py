"""As-of matches that keep hot keys apart: time is cut into spans, each span hands one row on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_after(left: DataFrame, right: DataFrame, key: str, at: str, width: int, payload: list[str]) -> DataFrame:
    """left with the first row of right of the same key whose `at` is not before left's: its payload, null if none.

    `at` is a whole number. A span's earliest right row serves the spans before it, so a
    window never holds more than one span of one key.
    """
    r = right.select(key, F.struct(at, *[c for c in payload if c != at]).alias("hit"), F.floor(F.col(at) / width).alias("span"), F.col(at).alias("__at"))
    opens = r.groupBy(key, "span").agg(F.min("hit").alias("first"))
    spans = left.select(key, F.floor(F.col(at) / width).alias("span")).distinct()
    after = W.partitionBy(key).orderBy("span").rowsBetween(1, W.unboundedFollowing)
    later = opens.join(spans, [key, "span"], "full").select(key, "span", F.min("first").over(after).alias("later"))
    marked = left.withColumn("span", F.floor(F.col(at) / width)).withColumn("__left", F.lit(True)).withColumn("__at", F.col(at))
    both = marked.unionByName(r.select(key, "span", "__at", "hit"), allowMissingColumns=True)
    here = both.withColumn("here", F.min("hit").over(W.partitionBy(key, "span").orderBy(F.desc("__at")).rangeBetween(W.unboundedPreceding, W.currentRow)))
    out = here.where("__left").join(later, [key, "span"], "left").withColumn("m", F.coalesce("here", "later"))
    return out.select(*left.columns, *[F.col(f"m.{c}").alias(f"hit_{c}") for c in payload])
