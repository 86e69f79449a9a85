"""Not-modified revisits: an as-of join by canonical url to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sweep

# fixed values: header fields a not-modified answer may renew
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Scheme and host lowered, default port and fragment dropped, an empty path made /; null stays null."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*+://[^/?]*+", 0))
    rest = F.substr(bare, F.length(head) + 1)
    host = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.when(head == "", bare).otherwise(F.concat(host, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, outcome, resolved_id, headers, digest.

    records: record_id, kind (response or revisit), url, ts (seconds), status, etag,
    last_modified, digest, headers (map with lower-case names). The latest response of
    status 200 before the revisit answers for it if a validator that both have agrees: the
    etag, or without one on either side the last_modified. Outcomes: resolved, mismatch (that
    response has other validators, or neither has any), missing (no response before, or a
    null url or ts). Resolved headers are the response's with RENEWED ones of the
    revisit over them; null headers count as none.

    Latest is by ts, then record_id (null first); of responses equal in both, that of the
    largest digest, then etag, then last_modified. A response at the revisit's own ts counts
    if its record_id is not larger. Repeated responses change nothing; a repeated revisit
    gives as many rows as it has; a null record_id is a value like others. Other columns are
    not read; an empty table gives no rows.

    All captures are swept once in order of url and time, in ranges, so a hot url, or
    any number of captures of one url in one second, is shared out.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull()
    r = records.where((F.col("kind") == "revisit") | full)
    r = r.select(canonical_url(F.col("url")).alias("url_key"), "ts", "record_id", "kind", "digest", "etag", "last_modified", "headers")
    answer = F.when(F.col("kind") == "response", F.struct("url_key", "record_id", "etag", "last_modified", "digest", "headers"))
    swept = sweep(r.where("url_key is not null"), ["url_key", "ts", "record_id", "kind", "digest", "etag", "last_modified"], last={"latest": answer}).where("kind = 'revisit'")
    known = (F.col("latest.url_key") == F.col("url_key")) & F.col("ts").isNotNull()
    swept = swept.withColumn("was", F.when(known, F.col("latest")))
    e, m = F.col("was.etag"), F.col("was.last_modified")
    agree = F.when(F.col("etag").isNotNull() & e.isNotNull(), F.col("etag") == e).otherwise(F.coalesce(F.col("last_modified") == m, F.lit(False)))
    outcome = F.when(F.col("was").isNull(), "missing").when(agree, "resolved").otherwise("mismatch")
    ok = outcome == "resolved"
    none = F.expr("cast(map() as map<string,string>)")
    fresh = F.map_filter(F.coalesce("headers", none), lambda k, v: k.isin(RENEWED))
    kept = F.map_filter(F.coalesce("was.headers", none), lambda k, v: ~F.map_contains_key(fresh, k))
    out = swept.select(
        "record_id", "url_key", outcome.alias("outcome"), F.when(ok, F.col("was.record_id")).alias("resolved_id"),
        F.when(ok, F.map_concat(kept, fresh)).alias("headers"), F.when(ok, F.col("was.digest")).alias("digest"))
    lost = r.where("url_key is null and kind = 'revisit'").select(
        "record_id", "url_key", F.lit("missing").alias("outcome"), F.lit(None).cast(out.schema["resolved_id"].dataType).alias("resolved_id"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast(out.schema["digest"].dataType).alias("digest"))
    return out.unionByName(lost)
