"""URL rules by a sorted range sweep over reversed-host keys, DataFrame operations only.

A rule (host, path) is the interval of all keys that begin with its own: reversed host,
a separator, path, in bytes. A url stands at one point for each of its host's suffixes, for
a rule on a host holds for the subdomains too. Intervals are nested or apart, so the
starts and ends of the rules, swept in key order, keep a stack: its height is the running
sum of starts less ends, and the rule at each height the last one opened there. Rules are
swept first, to know what lies below each; then rules and points together, where a point
takes the top of the stack, the longest rule for its suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sweep

# bytes that no UTF-8 text has: between host and path, and after everything a key begins
PART, LAST = b"\xfe", b"\xff"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lowered, path); both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*+", 0)
    return F.translate(host, _UP, _LOW), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.encode(reversed_host(host), "utf-8"), F.lit(PART), F.encode(path, "utf-8"))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, kind, top): where each rule's interval starts (kind 0) and ends (2), and the top of the stack from there on.

    top has null fields where no rule is open. Equal rules count once, block before allow.
    """
    r = rules.groupBy(F.translate("host", _UP, _LOW).alias("rh"), F.col("path").alias("rp")).agg(F.max("verdict").alias("rv"))
    rule = F.struct((F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("h"), F.concat("rh", "rp").alias("rule"), F.col("rv").alias("verdict"))
    r = r.where("rh is not null and rp is not null").select(_key(F.col("rh"), F.col("rp")).alias("start"), rule.alias("own"))
    ends = r.select(F.concat("start", F.lit(LAST)).alias("key"), F.lit(2).alias("kind"), "own")
    events = r.select(F.col("start").alias("key"), F.lit(0).alias("kind"), "own").unionByName(ends)
    step = F.when(F.col("kind") == 0, 1).otherwise(-1)
    events = sweep(events, ["key", "kind"], total={"height": step})
    # a rule's own height at both its ends; the rules below it are at 1 to its height less 1
    events = events.withColumn("level", F.when(F.col("kind") == 0, F.col("height")).otherwise(F.col("height") + 1))
    most = events.agg(F.max("level")).first()[0] or 0
    opened = {f"at{i}": F.when((F.col("kind") == 0) & (F.col("level") == i), F.col("own")) for i in range(1, most)}
    events = sweep(events, ["key", "kind"], last=opened) if opened else events
    below = F.lit(None).cast(events.schema["own"].dataType)
    for i in range(1, most):
        below = F.when(F.col("level") == i + 1, F.col(f"at{i}")).otherwise(below)
    top = F.when(F.col("kind") == 0, F.col("own")).otherwise(below)
    return events.select("key", "kind", F.struct(top.alias("rule")).alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """All rows of pages as (key, url, host, path, rule, verdict).

    rules: host, path, verdict; those with a null host or path count for nothing. The longest
    fitting rule (host and path together; then the longer host) wins; without one, rule is
    null and verdict the default. Null urls, and those without ://, have empty host and path
    and no rule; repeated rows are each judged; other columns are not read; an empty table
    gives no rows. Points are dealt by key, then by hash, so a hot host, and even one key of
    many hosts, is shared out.
    """
    host, path = split_url(F.col(url))
    p = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = p.where("path <> '' or host <> ''").select("host", "path").distinct()
    points = urls.withColumn("suffix", F.explode(F.array_distinct(suffixes))).select(_key(F.col("suffix"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "host", "path")
    events = rule_events(rules)
    both = points.unionByName(events, allowMissingColumns=True)
    at = sweep(both.withColumn("deal", F.xxhash64("host", "path")), ["key", "kind", "deal"], last={"here": F.col("top")}).where("kind = 1 and here.rule is not null")
    best = at.groupBy("host", "path").agg(F.max("here.rule").alias("b"))
    out = p.join(best, ["host", "path"], "left")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
