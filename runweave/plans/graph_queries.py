"""Run hypergraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators import graph as G
from runweave.sources.fixtures import Fixtures

from .catalogue import query

_CLOSED = "closed(id) AS (SELECT id FROM nodes WHERE ground = 'failed' UNION SELECT t FROM closed JOIN adj ON s = id)"


@query("G1_adjacency", "SELECT edge, kind, s, t FROM adj", "adj")
def _(x: Fixtures) -> DataFrame:
    return G.adjacency(x.edges())


@query("G2_forward_closure", "SELECT id FROM r", "nodes adj", "r(id) AS (SELECT 3::BIGINT UNION SELECT t FROM r JOIN adj ON s = id)")
def _(x: Fixtures) -> DataFrame:
    return G.reach(G.adjacency(x.edges()), x.spark.createDataFrame([(3,)], "id long")).select("id")


@query("G3_default_resume_set", "SELECT id FROM nodes WHERE ground = 'failed'", "nodes")
def _(x: Fixtures) -> DataFrame:
    return x.nodes().where("ground = 'failed'").select("id")


@query("G2_closure_of_failed", "SELECT id FROM closed", "nodes adj", _CLOSED)
def _(x: Fixtures) -> DataFrame:
    return G.reach(G.adjacency(x.edges()), x.nodes().where("ground = 'failed'").select("id")).select("id")


@query("G4_fireable")
def _(x: Fixtures) -> DataFrame:
    n, e = x.nodes(), x.edges()
    return G.fireable(n, e, G.reach(G.adjacency(e), n.where("ground = 'failed'").select("id")))


@query("G5_seed_reset", "SELECT n.id, CASE WHEN c.id IS NOT NULL THEN 'pending' ELSE ground END AS ground, c.id IS NULL AND kind = 'task' AND ground = 'success' AS pre_grounded FROM nodes n LEFT JOIN closed c USING (id)", "nodes adj", _CLOSED)
def _(x: Fixtures) -> DataFrame:
    return G.replay_seed(x.nodes(), x.edges()).select("id", "ground", "pre_grounded")


_GUARDED = "[(2, 8), (5, 40), (7, 28), (10, 20), (12, 24), (99999999, 3)]"


@query("G6_edge_dominance", f"""SELECT g AS edge, node, NOT EXISTS (SELECT 1 FROM edges WHERE edge = g) OR EXISTS (SELECT 1 FROM r WHERE r.g = guarded.g AND r.id = node) AS violated FROM guarded""", "edges adj",
       f"guarded(g, node) AS (VALUES {_GUARDED[1:-1]}), r(g, id) AS (SELECT g, 1::BIGINT FROM guarded UNION SELECT g, t FROM r JOIN adj ON s = id AND edge <> g)")
def _(x: Fixtures) -> DataFrame:
    g = x.spark.createDataFrame([(2, 8), (5, 40), (7, 28), (10, 20), (12, 24), (99999999, 3)], "edge long, node long")
    return G.edge_violations(x.edges(), x.spark.createDataFrame([(1,)], "id long"), g).select("edge", "node", "violated")


@query("G7_task_dominance", "SELECT ancestor, node, ancestor = node OR NOT EXISTS (SELECT 1 FROM r WHERE g = ancestor AND id = node) AS dominates FROM pairs", "adj",
       "pairs(ancestor, node) AS (VALUES (2, 8), (3, 12), (5, 20), (7, 7), (4, 9), (10, 41)), r(g, id) AS (SELECT DISTINCT ancestor, 1::BIGINT FROM pairs UNION SELECT g, t FROM r JOIN adj ON s = id AND id <> g)")
def _(x: Fixtures) -> DataFrame:
    p = x.spark.createDataFrame([(2, 8), (3, 12), (5, 20), (7, 7), (4, 9), (10, 41)], "ancestor long, node long")
    return G.task_dominates(x.edges(), x.spark.createDataFrame([(1,)], "id long"), p)


_LOOPS = "l AS (SELECT DISTINCT s, t FROM adj WHERE kind = 'loop'), r(a, b) AS (SELECT s, s FROM l UNION SELECT a, t FROM r JOIN l ON s = b)"


@query("G8_loop_components", "SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1", "adj", _LOOPS)
def _(x: Fixtures) -> DataFrame:
    return G.loop_components(x.edges())


@query("G10_loop_exits", "SELECT c.component, count(DISTINCT CASE WHEN d.component IS NULL OR d.component <> c.component THEN edge END) AS exits FROM comp c LEFT JOIN adj ON s = c.id LEFT JOIN comp d ON d.id = t GROUP BY c.component", "adj",
       _LOOPS + ", comp AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1)")
def _(x: Fixtures) -> DataFrame:
    return G.loop_exits(x.edges(), G.loop_components(x.edges()))


@query("G10_loop_terminable", """SELECT component, count(edge) AS exits, count(edge) FILTER (edge % 3 <> 0) AS ungated, count(edge) > 0 AND count(edge) FILTER (edge % 3 <> 0) = 0 AS terminable
  FROM (SELECT DISTINCT c.component, CASE WHEN d.component IS NULL OR d.component <> c.component THEN edge END AS edge FROM comp c LEFT JOIN adj ON s = c.id LEFT JOIN comp d ON d.id = t) GROUP BY component""", "adj",
       _LOOPS + ", comp AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1)")
def _(x: Fixtures) -> DataFrame:
    e = x.edges()
    gates = e.select("edge", F.when(F.col("edge") % 3 == 0, "loop_control").otherwise("a").alias("variable"))
    return G.loop_terminable(e, G.loop_components(e), gates)


@query("G9_seal", "SELECT 0 AS s, id AS t FROM nodes WHERE id NOT IN (SELECT t FROM adj WHERE kind <> 'loop') UNION ALL SELECT id, -1 FROM nodes WHERE id NOT IN (SELECT s FROM adj WHERE kind <> 'loop')", "nodes adj")
def _(x: Fixtures) -> DataFrame:
    return G.seal(x.nodes().select("id", F.col("id").alias("position")), x.edges())


@query("G11_implicit_chain", "SELECT grp, s, t FROM (SELECT id // 1000 AS grp, id AS s, lead(id) OVER (PARTITION BY id // 1000 ORDER BY id) AS t FROM nodes) WHERE t IS NOT NULL", "nodes")
def _(x: Fixtures) -> DataFrame:
    return G.implicit_chain(x.nodes().select(F.expr("id div 1000").alias("grp"), F.col("id").alias("position"), "id"))


@query("G12_maximal_chains", "SELECT id - id % 10 AS head, count(*) AS length FROM nodes WHERE id % 10 <> 9 AND id <> 0 AND id % 10 <> 0 GROUP BY id - id % 10 HAVING count(*) >= 5", "nodes")
def _(x: Fixtures) -> DataFrame:
    # paths of ten: inner nodes are 1..8 of each ten, joined to 9, whose successors branch
    n = x.nodes().select("id")
    path = n.where("id % 10 <> 9").select(F.col("id").alias("s"), (F.col("id") + 1).alias("t")).join(n.select(F.col("id").alias("t")), "t").select("s", "t")
    fork = n.where("id % 10 = 9").select(F.col("id").alias("s"), F.explode(F.array(-F.col("id"), -F.col("id") - 100000000)).alias("t"))
    c = G.chains(path.unionByName(fork))
    return c.select((F.col("head") - F.col("head") % 10).alias("head"), "length")


@query("G14_version_delta", "SELECT edge, 'added' AS change FROM edges WHERE edge % 7 = 0 UNION ALL SELECT edge, 'ghost' FROM edges WHERE edge % 11 = 0 AND edge % 7 <> 0", "edges")
def _(x: Fixtures) -> DataFrame:
    e = x.edges()
    old = e.where("edge % 7 <> 0")
    new = e.where("edge % 11 <> 0 or edge % 7 = 0").withColumn("sources", F.reverse("sources"))
    return G.version_delta(old, new)


@query("G15_version_history", "SELECT id, version, row_number() OVER (PARTITION BY id ORDER BY version) - 1 AS place FROM definitions", "definitions")
def _(x: Fixtures) -> DataFrame:
    from pyspark.sql import Window as W

    return x.definitions().select("id", "version", (F.row_number().over(W.partitionBy("id").orderBy("version")) - 1).alias("place"))


_NAMED = "named AS (SELECT edge, string_agg(coalesce(p_name, 'unknown'), ',' ORDER BY coalesce(p_name, 'unknown')) AS sources FROM (SELECT edge, unnest(sources) AS id FROM edges) LEFT JOIN nodes USING (id) GROUP BY edge), tn AS (SELECT edge, string_agg(coalesce(p_name, 'unknown'), ',' ORDER BY coalesce(p_name, 'unknown')) AS targets FROM (SELECT edge, unnest(targets) AS id FROM edges) LEFT JOIN nodes USING (id) GROUP BY edge)"


@query("P10_named_edges", "SELECT edge, sources, targets FROM named JOIN tn USING (edge)", "edges nodes", _NAMED)
def _(x: Fixtures) -> DataFrame:
    return G.with_names(x.edges(), x.nodes().select("id", F.col("p_name").alias("name")))


@query("G16_content_hash", "SELECT (edge - (edge % 1000 + 1000) % 1000) // 1000 AS grp, sha256(string_agg(sources || '->' || targets, chr(10) ORDER BY sources || '->' || targets)) AS hash FROM named JOIN tn USING (edge) GROUP BY 1", "edges nodes", _NAMED)
def _(x: Fixtures) -> DataFrame:
    return G.content_hash(x.edges(), x.nodes().select("id", F.col("p_name").alias("name")), F.expr("(edge - pmod(edge, 1000)) div 1000"))


@query("P6_sorted_graph_view", "SELECT edge, list_sort(sources)::VARCHAR AS sources, list_sort(targets)::VARCHAR AS targets FROM edges", "edges")
def _(x: Fixtures) -> DataFrame:
    show = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(c), lambda v: v.cast("string")), ", "), F.lit("]")).alias(c)
    return x.edges().select("edge", show("sources"), show("targets"))


@query("P7_ghosts_and_pre_grounded", "SELECT id, kind = 'task' AND ground <> 'pending' AND NOT minted AS ghost, ground = 'success' AS pre_grounded FROM nodes", "nodes")
def _(x: Fixtures) -> DataFrame:
    n = x.nodes()
    minted = n.where("minted").select("id", F.lit(True).alias("m"))
    return n.join(minted, "id", "left").select("id", ((F.col("kind") == "task") & (F.col("ground") != "pending") & F.col("m").isNull()).alias("ghost"), (F.col("ground") == "success").alias("pre_grounded"))


@query("F18_frontier_edges", "SELECT edge, s, t FROM adj JOIN nodes a ON a.id = s JOIN nodes b ON b.id = t WHERE a.ground = 'success' AND b.kind = 'task' AND NOT b.minted", "nodes adj")
def _(x: Fixtures) -> DataFrame:
    return G.frontier_edges(x.edges(), x.nodes())


@query("G22_edge_firing", "SELECT edge, bool_and(coalesce(ground = 'success', FALSE)) AS fires FROM (SELECT edge, unnest(sources) AS id FROM edges) LEFT JOIN nodes USING (id) GROUP BY edge", "edges nodes")
def _(x: Fixtures) -> DataFrame:
    return G.firing(x.edges(), x.nodes())


@query("G22_gated_edge_firing", """SELECT edge, bool_and(coalesce(ground = 'success', FALSE)) AND edge % 4 NOT IN (1, 2) AS fires FROM (SELECT edge, unnest(sources) AS id FROM edges WHERE kind = 'plain') LEFT JOIN nodes USING (id) GROUP BY edge""", "edges nodes")
def _(x: Fixtures) -> DataFrame:
    # of each four edges one has no gate, one a closed and an open one, one a gate not judged yet, one an open gate
    e = x.edges().where("kind = 'plain'")
    m = F.col("edge") % 4
    has = F.when(m == 1, F.array(F.lit(True), F.lit(False))).when(m == 2, F.array(F.lit(None).cast("boolean"))).when(m == 3, F.array(F.lit(True)))
    return G.firing(e, x.nodes(), e.select("edge", F.explode(has).alias("satisfied")))


@query("J15_edge_end_names", "SELECT edge, s, t, a.p_name AS source, b.p_name AS target FROM adj LEFT JOIN nodes a ON a.id = s LEFT JOIN nodes b ON b.id = t", "nodes adj")
def _(x: Fixtures) -> DataFrame:
    n = x.nodes()
    a = G.adjacency(x.edges()).select("edge", "s", "t")
    return a.join(n.select(F.col("id").alias("s"), F.col("p_name").alias("source")), "s", "left").join(n.select(F.col("id").alias("t"), F.col("p_name").alias("target")), "t", "left")


def _parents(x: Fixtures) -> DataFrame:
    return x.nodes().select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("parent"))


_UP = "up(id, a, d) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT id, a // 2, d + 1 FROM up WHERE a > 1)"


@query("J16_nearest_producer", "SELECT id, arg_min(a, d) AS ancestor, min(d) AS depth FROM up JOIN (SELECT id AS a FROM nodes) USING (a) WHERE a % 5 = 1 GROUP BY id", "nodes", _UP)
def _(x: Fixtures) -> DataFrame:
    return G.nearest_ancestor(_parents(x), x.nodes().where("id % 5 = 1"))


@query("G20_parent_hydration", "SELECT up.id, arg_min(a, d) AS ancestor, min(d) AS depth FROM up JOIN nodes n ON n.id = a WHERE n.ground = 'success' GROUP BY up.id", "nodes", _UP)
def _(x: Fixtures) -> DataFrame:
    return G.nearest_ancestor(_parents(x), x.nodes().where("ground = 'success'"))


@query("J18_gate_signal_resolution", "SELECT edge, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(signal) END AS signal FROM (SELECT e.edge, s.id AS signal FROM (SELECT edge, abs(edge) % 13 AS n FROM edges) e JOIN (SELECT id, id % 13 AS n FROM nodes WHERE id % 40 = 7) s USING (n)) GROUP BY edge", "edges nodes")
def _(x: Fixtures) -> DataFrame:
    e = x.edges().select("edge", (F.abs("edge") % 13).alias("n"))
    s = x.nodes().where("id % 40 = 7").groupBy((F.col("id") % 13).alias("n")).agg(F.count("*").alias("candidates"), F.min("id").alias("signal"))
    return e.join(s, "n").select("edge", "candidates", F.when(F.col("candidates") == 1, F.col("signal")).alias("signal"))


_SIGNAL_GATES = [(1, "s0"), (2, "s0"), (5, "s1"), (10, "s1"), (3, "s2"), (4, "s2")]


@query("J18_gate_signal_dominance", "SELECT task, signal, count(g) AS candidates, CASE WHEN count(g) = 1 THEN min(g) END AS edge FROM (SELECT id AS task, 's' || (id % 3) AS signal FROM nodes) LEFT JOIN (SELECT g, signal, id AS task FROM gates, nodes WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.g = gates.g AND r.id = nodes.id)) USING (task, signal) GROUP BY task, signal", "nodes adj",
       f"gates(g, signal) AS (VALUES {str(_SIGNAL_GATES)[1:-1]}), r(g, id) AS (SELECT g, 1::BIGINT FROM gates UNION SELECT g, t FROM r JOIN adj ON s = id AND edge <> g)")
def _(x: Fixtures) -> DataFrame:
    slots = x.nodes().select(F.col("id").alias("task"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("signal"))
    return G.resolve_signals(x.edges(), x.spark.createDataFrame([(1,)], "id long"), x.spark.createDataFrame(_SIGNAL_GATES, "edge long, signal string"), slots)


_PRODUCERS = [("loop_control", 20), ("a", 2), ("b", 3), ("c", 5)]


@query("G18_producer_dominance", """SELECT edge, variable, bool_and(coalesce(producer = node OR (variable = 'loop_control' AND p.component = n.component) OR (producer IS NOT NULL AND v.id IS NULL), FALSE)) AS ok
  FROM (SELECT edge, unnest(sources) AS node, CASE abs(edge) % 5 WHEN 0 THEN 'loop_control' WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE 'undeclared' END AS variable FROM edges)
  LEFT JOIN producers USING (variable) LEFT JOIN comp p ON p.id = producer LEFT JOIN comp n ON n.id = node LEFT JOIN v ON v.g = producer AND v.id = node GROUP BY edge, variable""", "edges adj",
       _LOOPS + f""", comp AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1),
  producers(variable, producer) AS (VALUES {str(_PRODUCERS)[1:-1]}), v(g, id) AS (SELECT producer, 1::BIGINT FROM producers UNION SELECT g, t FROM v JOIN adj ON s = id AND id <> g)""")
def _(x: Fixtures) -> DataFrame:
    e, m = x.edges(), F.abs("edge") % 5
    variable = F.when(m == 0, "loop_control").when(m == 1, "a").when(m == 2, "b").when(m == 3, "c").otherwise("undeclared")
    producers = x.spark.createDataFrame(_PRODUCERS, "variable string, producer long")
    return G.producer_check(e, x.spark.createDataFrame([(1,)], "id long"), e.select("edge", variable.alias("variable")), producers, G.loop_components(e))


@query("G18_producer_check", "SELECT edge, bool_and(id % 2 = 0) AS ok FROM (SELECT edge, unnest(sources) AS id FROM edges WHERE kind <> 'loop') GROUP BY edge", "edges")
def _(x: Fixtures) -> DataFrame:
    # parity of the sources only; the check itself is G18_producer_dominance
    s = x.edges().where("kind <> 'loop'").select("edge", F.explode("sources").alias("id"))
    return s.groupBy("edge").agg(F.bool_and(F.col("id") % 2 == 0).alias("ok"))


@query("G21_rehydration_plan", """SELECT id AS key, CASE WHEN id % 10 = 1 THEN 'dropped' WHEN id % 10 = 2 THEN 'flagged' WHEN id % 10 = 3 THEN 'flagged' WHEN c.id IS NULL AND kind = 'task' AND ground = 'success' THEN 'carried' ELSE 'absent' END AS disposition
  FROM nodes n LEFT JOIN (SELECT id, TRUE AS c FROM closed) c USING (id)""".replace("c.id IS NULL", "c.c IS NULL"), "nodes adj", _CLOSED)
def _(x: Fixtures) -> DataFrame:
    m = F.col("id") % 10
    v = x.nodes().select(F.col("id").alias("key"), F.when(m == 1, "signal").when(m == 2, "system").otherwise("task").alias("producer_kind"), F.when(m == 3, -F.col("id") - 5).otherwise(F.col("id")).alias("producer"))
    return G.rehydration(v, G.replay_seed(x.nodes(), x.edges()))


@query("Q8_replays", "SELECT id, parent, (SELECT count(*) FROM nodes b WHERE b.id // 2 = a.id AND b.id > 1) AS children FROM (SELECT id, CASE WHEN id > 1 THEN id // 2 END AS parent FROM nodes) a", "nodes")
def _(x: Fixtures) -> DataFrame:
    p = _parents(x)
    n = p.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return p.join(n, "id", "left").select("id", "parent", F.coalesce("children", F.lit(0)).alias("children"))
