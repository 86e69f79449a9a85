"""Patch documents and loop lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators import graph as G
from runweave.operators import patches as P
from runweave.sources.fixtures import Fixtures

from .catalogue import query


def _key(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("patch"), "p_name", "p_size")


@query("G19_primitive_ops", "SELECT p_partkey AS patch, i AS position, CASE WHEN i % 2 = 0 THEN 'AddNode' ELSE 'RemoveEdge' END AS op, CASE WHEN i = 0 THEN 'id' || p_partkey WHEN i = 1 THEN 'code1' ELSE 'new2' END AS node FROM part, (SELECT unnest(range(3))::INTEGER AS i)")
def _(x: Fixtures) -> DataFrame:
    items = F.array(*[F.struct(F.lit("RemoveEdge" if i % 2 else "AddNode").alias("op"), F.lit(n).alias("node")) for i, n in enumerate(["new0", "code1", "new2"])])
    k = _key(x)
    return P.primitive_ops(k.select("patch", items.alias("items")), k.select("patch", F.lit("new0").alias("placeholder"), F.concat(F.lit("id"), F.col("patch").cast("string")).alias("id")))


@query("G19_duplicate_handles", "SELECT p_size AS patch, p_brand AS scope, p_name AS handle, count(*) AS n FROM (SELECT p_size % 5 AS p_size, p_brand, substr(p_name, 1, 6) AS p_name FROM part) GROUP BY ALL HAVING count(*) > 1")
def _(x: Fixtures) -> DataFrame:
    return P.duplicate_handles(x.raw("part").select((F.col("p_size") % 5).alias("patch"), F.col("p_brand").alias("scope"), F.substring("p_name", 1, 6).alias("handle")))


@query("G19_expansion_arms", "SELECT p_partkey AS patch, i AS arm, CASE i WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS key, CASE i WHEN 0 THEN 'p' || p_size WHEN 1 THEN p_name ELSE 'z' END AS path FROM part, (SELECT unnest(range(3))::INTEGER AS i)")
def _(x: Fixtures) -> DataFrame:
    arms = F.create_map(F.lit("b"), F.col("p_name"), F.lit("c"), F.lit("z"), F.lit("a"), F.concat(F.lit("p"), F.col("p_size").cast("string")))
    return P.expansion_arms(_key(x).select("patch", arms.alias("arms")))


@query("G19_branch_arms", "SELECT p_partkey AS patch, i AS arm, 'g' || i AS gate, 'f#' || i AS path FROM part, (SELECT unnest(range(2))::INTEGER AS i)")
def _(x: Fixtures) -> DataFrame:
    a = lambda p: F.array(F.lit(p + "0"), F.lit(p + "1"))
    return P.branch_arms(_key(x).select("patch", a("g").alias("gates"), a("f#").alias("paths")))


@query("G19_step_errors", "SELECT p_partkey AS patch, CASE p_partkey % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'neither' WHEN 2 THEN 'empty' WHEN 3 THEN 'no_fragment' END AS error FROM part")
def _(x: Fixtures) -> DataFrame:
    m = F.col("patch") % 5
    leaf = F.when(m.isin(0, 4), "build#t").when(m == 3, "build")
    nested = F.when(m == 0, F.array(F.lit("s"))).when(m == 2, F.expr("cast(array() as array<string>)"))
    return _key(x).select("patch", P.step_error(leaf, nested).alias("error"))


@query("G19_patch_versions", "SELECT p_partkey AS patch, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) AS version FROM part")
def _(x: Fixtures) -> DataFrame:
    return P.version_intents(x.raw("part").select(F.col("p_partkey").alias("patch"), F.col("p_size").alias("definition"), F.col("p_retailprice").alias("applied_at"))).select("patch", "version")


_R = "l AS (SELECT DISTINCT s, t FROM adj WHERE kind = 'loop'), r(a, b) AS (SELECT s, s FROM l UNION SELECT a, t FROM r JOIN l ON s = b), lane(id, c, d) AS (SELECT DISTINCT c, c, 0 FROM (SELECT a, min(b) AS c FROM r GROUP BY a) UNION SELECT t, c, d + 1 FROM lane JOIN l ON s = id WHERE d < 40)"


@query("G13_ring_lanes", "SELECT id, c AS entry, min(d) AS position FROM lane GROUP BY id, c", "adj", _R)
def _(x: Fixtures) -> DataFrame:
    return G.ring_lanes(x.edges(), G.loop_components(x.edges()))
