"""Task log streams: contiguous frontier, gaps, tails, fallbacks, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def covered(records: DataFrame, gaps: DataFrame) -> DataFrame:
    """Spans (stream, lo, hi) that are accepted or declared missing, each record once."""
    r = records.select("stream", F.col("sequence").alias("lo"), F.col("sequence").alias("hi")).distinct()
    return r.unionByName(gaps.select("stream", F.col("first").alias("lo"), F.col("last").alias("hi")).distinct())


def frontiers(records: DataFrame, gaps: DataFrame) -> DataFrame:
    """(stream, frontier): the last sequence such that 0 up to it are all accepted or declared missing; null if 0 is not."""
    w = W.partitionBy("stream").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    s = covered(records, gaps).withColumn("reach", F.coalesce(F.max("hi").over(w), F.lit(-1)))
    s = s.withColumn("hole", F.col("lo") > F.col("reach") + 1)
    s = s.withColumn("holes", F.sum(F.col("hole").cast("int")).over(W.partitionBy("stream").orderBy("lo", "hi")))
    return s.groupBy("stream").agg(F.max(F.when(F.col("holes") == 0, F.col("hi"))).alias("frontier"))


def replay(records: DataFrame, gaps: DataFrame) -> DataFrame:
    """What a replay returns: records and gaps up to the frontier."""
    f = frontiers(records, gaps)
    both = records.select("stream", F.col("sequence").alias("first"), F.col("sequence").alias("last"), F.lit("record").alias("kind"), "bytes").unionByName(
        gaps.select("stream", "first", "last", F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("bytes")))
    return both.join(f, "stream").where(F.col("last") <= F.col("frontier")).drop("frontier")


def islands(records: DataFrame) -> DataFrame:
    """(stream, lo, hi): maximal runs of consecutive sequences."""
    d = records.select("stream", "sequence").distinct()
    d = d.withColumn("i", F.col("sequence") - F.row_number().over(W.partitionBy("stream").orderBy("sequence")))
    return d.groupBy("stream", "i").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi")).drop("i")


def violations(submissions: DataFrame, gaps: DataFrame) -> DataFrame:
    """(stream, sequence, arrival, outcome): what accepting each submission gives, and how each later one offends.

    submissions: stream, sequence, arrival, bytes, digest, terminal_at (arrival at which the
    stream was closed, or null).
    """
    first = submissions.groupBy("stream", "sequence").agg(F.min(F.struct("arrival", "digest")).alias("f"))
    g = gaps.select(F.col("stream").alias("gs"), "first", "last")
    j = submissions.join(first, ["stream", "sequence"]).join(g, (F.col("stream") == F.col("gs")) & F.col("sequence").between(F.col("first"), F.col("last")), "left")
    outcome = (
        F.when(F.col("arrival") > F.col("terminal_at"), "AppendAfterTerminal").when(F.sha2("bytes", 256) != F.col("digest"), "InvalidContentDigest")
        .when((F.col("arrival") > F.col("f.arrival")) & (F.col("digest") == F.col("f.digest")), "AlreadyAccepted").when(F.col("arrival") > F.col("f.arrival"), "IdentityContentConflict")
        .when(F.col("gs").isNotNull(), "AcceptedIdentityCoveredByGap").otherwise("Accepted"))
    return j.select("stream", "sequence", "arrival", outcome.alias("outcome"))


def tails(records: DataFrame, k: int, before: int | None = None) -> DataFrame:
    """Last k records of each stream (below a sequence), and whether there are earlier ones."""
    r = records if before is None else records.where(F.col("sequence") < before)
    w = W.partitionBy("stream").orderBy(F.desc("sequence"))
    r = r.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    return r.withColumn("has_earlier", F.max("rn").over(W.partitionBy("stream")) > k).where(F.col("rn") <= k).drop("rn")


def after(records: DataFrame, cursor: int) -> DataFrame:
    return records.where(F.col("sequence") > cursor)


def with_fallback(stores: list[DataFrame]) -> DataFrame:
    """Streams from the first store that has them: each later one only adds streams not seen."""
    out = stores[0].withColumn("store", F.lit(0))
    for i, s in enumerate(stores[1:], 1):
        out = out.unionByName(s.join(out.select("stream").distinct(), "stream", "left_anti").withColumn("store", F.lit(i)))
    return out


def exit_marker(kind: Column, status: Column, reason: Column) -> Column:
    code = F.when(kind == "Status", status).otherwise(-1).cast("long")
    why = F.when(kind == "NoStatus", "terminated without exit status").when(kind == "Error", reason).when(kind == "Abnormal", "Executor closed without controlled End-of-stream")
    return F.struct(code.alias("exit_status"), why.alias("reason"))


def record_digests(records: DataFrame) -> DataFrame:
    """SHA-256 of a stream's records as JSON in order; a stream is one document's worth of text."""
    items = F.array_sort(F.collect_list(F.struct("sequence", F.sha2("bytes", 256).alias("digest"))))
    return records.groupBy("stream").agg(items.alias("i")).select("stream", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("i", lambda x: F.concat(F.lit('{"sequence":'), x["sequence"].cast("string"), F.lit(',"digest":"'), x["digest"], F.lit('"}'))), ","), F.lit("]")), 256).alias("digest"))


def name_digests(rows: DataFrame, key: str, name: str) -> DataFrame:
    """SHA-256 of a group's sorted names, a line each."""
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(name)), "\n"), 256).alias("digest"))


def silent_spells(beats: DataFrame, key: str, at: str, ttl: int) -> DataFrame:
    """Spells after which a beat was due and none came within ttl seconds: (key, since, until); until is null if none came at all."""
    nxt = F.lead(at).over(W.partitionBy(key).orderBy(at))
    d = beats.select(key, F.col(at).alias("since"), nxt.alias("until"))
    return d.where(F.col("until").isNull() | (F.unix_seconds("until") - F.unix_seconds("since") > ttl))
