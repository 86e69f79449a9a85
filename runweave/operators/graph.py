"""Run hypergraphs: closures, fixpoints, dominance, loops, deltas.

edges: edge, kind, sources (array), targets (array); nodes: id, ground, kind, minted.
Iterations keep a frontier, so each round joins only what the last one added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.plans.loops import cut


def apart(df: DataFrame) -> DataFrame:
    """df, to be joined by merging: a table that grows with the graph is never sent through the driver to be broadcast."""
    return df.hint("merge")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select("edge", "kind", F.explode("sources").alias("s"), "targets").select("edge", "kind", "s", F.explode("targets").alias("t"))


def closure(adj: DataFrame, seeds: DataFrame) -> DataFrame:
    """(origin, id, depth): what each origin (seeds: origin, id) reaches over s -> t, itself at depth 0; cycles are fine."""
    adj = cut(adj.select("s", "t").distinct())
    seen = cut(seeds.select("origin", "id").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while True:
        depth += 1
        step = front.join(apart(adj), F.col("id") == F.col("s")).select("origin", F.col("t").alias("id")).distinct()
        front = cut(step.join(apart(seen.select("origin", "id")), ["origin", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)


def reach(adj: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, depth) reachable from any of the seeds (id)."""
    return closure(adj, seeds.select(F.lit(0).alias("origin"), "id")).select("id", "depth")


def fireable(nodes: DataFrame, edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Nodes of the closure that can fire: roots, and targets of an edge all of whose sources are fireable or succeeded already.

    Sources outside the closure count if they succeeded. Each round tests the edges not yet
    open against what is known; it ends when a round adds nothing.
    """
    ends = cut(edges.select("edge", F.explode("sources").alias("s")).distinct())
    targets = cut(edges.select("edge", F.explode("targets").alias("t")))
    closed = closed.select("id")
    roots = closed.join(apart(targets.select(F.col("t").alias("id"))), "id", "left_anti")
    done = nodes.where("ground = 'success'").select("id").join(apart(closed), "id", "left_anti")
    ok, front = cut(roots), cut(roots.unionByName(done))
    wait = cut(ends.groupBy("edge").agg(F.count("*").alias("n")))
    rounds = 0
    while True:
        hit = ends.join(apart(front), F.col("s") == F.col("id")).groupBy("edge").agg(F.count("*").alias("k"))
        wait = cut(wait.where("n > 0").join(apart(hit), "edge", "left").select("edge", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")))
        new = targets.join(apart(wait.where("n = 0")), "edge", "left_semi").select(F.col("t").alias("id")).distinct().join(apart(closed), "id", "left_semi")
        front = cut(new.join(apart(ok), "id", "left_anti"))
        if front.isEmpty():
            return ok
        rounds += 1
        ok = cut(ok.unionByName(front)) if rounds % 8 == 0 else ok.unionByName(front)


def replay_seed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ground, pre_grounded, doomed) after resuming from the failed nodes."""
    adj = adjacency(edges)
    closed = reach(adj, nodes.where("ground = 'failed'").select("id"))
    fire = fireable(nodes, edges, closed).withColumn("f", F.lit(True))
    j = nodes.join(apart(closed.select("id", F.lit(True).alias("c"))), "id", "left").join(apart(fire), "id", "left")
    inside = F.coalesce("c", F.lit(False))
    ground = F.when(inside, "pending").otherwise(F.col("ground"))
    return j.select("id", ground.alias("ground"), (~inside & (F.col("kind") == "task") & (F.col("ground") == "success")).alias("pre_grounded"), (inside & F.col("f").isNull() & (F.col("kind") == "task")).alias("doomed"))


def edge_violations(edges: DataFrame, start: DataFrame, guarded: DataFrame) -> DataFrame:
    """(edge, node, violated, length): whether node is reached from start without the edge, and over how many steps.

    guarded: edge, node. Each guarded edge is its own origin; its own arcs are left out.
    """
    adj = cut(adjacency(edges).select("edge", "s", "t"))
    seen = cut(guarded.select(F.col("edge").alias("g")).distinct().crossJoin(F.broadcast(start.limit(1))).select("g", "id", F.lit(0).alias("depth")))
    front, depth = seen, 0
    while True:
        depth += 1
        step = front.join(apart(adj), (F.col("id") == F.col("s")) & (F.col("g") != F.col("edge"))).select("g", F.col("t").alias("id")).distinct()
        front = cut(step.join(apart(seen.select("g", "id")), ["g", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    hit = seen.select(F.col("g").alias("edge"), F.col("id").alias("node"), F.col("depth").alias("length"))
    known = edges.select("edge", F.lit(True).alias("known"))
    j = guarded.join(apart(hit), ["edge", "node"], "left").join(apart(known), "edge", "left")
    return j.select("edge", "node", (F.col("known").isNull() | F.col("length").isNotNull()).alias("violated"), F.when(F.col("known").isNotNull(), F.col("length")).alias("length"))


def task_dominates(edges: DataFrame, start: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ancestor, node, dominates): node is not reached from start once the ancestor's own arcs are refused; a node dominates itself."""
    adj = cut(adjacency(edges).select("s", "t").distinct())
    seen = cut(pairs.select(F.col("ancestor").alias("g")).distinct().crossJoin(F.broadcast(start.limit(1))).select("g", "id"))
    front = seen
    while True:
        step = front.where("id <> g").join(apart(adj), F.col("id") == F.col("s")).select("g", F.col("t").alias("id")).distinct()
        front = cut(step.join(apart(seen), ["g", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    hit = seen.select(F.col("g").alias("ancestor"), F.col("id").alias("node"), F.lit(True).alias("hit"))
    j = pairs.join(apart(hit), ["ancestor", "node"], "left")
    return j.select("ancestor", "node", ((F.col("ancestor") == F.col("node")) | F.col("hit").isNull()).alias("dominates"))


def producer_check(edges: DataFrame, start: DataFrame, gates: DataFrame, producers: DataFrame, components: DataFrame) -> DataFrame:
    """(edge, variable, ok): whether a gate's variable has a producer that dominates every source of the edge.

    gates: edge, variable; producers: variable, producer; components: id, component.
    Sources in the loop of loop_control's producer need no dominance for that variable. A
    variable without a producer is not ok; of several producers each must dominate.
    """
    g = gates.select("edge", "variable").distinct().join(producers.select("variable", "producer").distinct(), "variable", "left")
    s = g.join(apart(edges.select("edge", F.explode("sources").alias("node"))), "edge")
    pairs = s.where("producer is not null").select(F.col("producer").alias("ancestor"), "node").distinct()
    dom = task_dominates(edges, start, pairs).withColumnRenamed("ancestor", "producer")
    j = s.join(apart(dom), ["producer", "node"], "left")
    j = j.join(apart(components.select(F.col("id").alias("producer"), F.col("component").alias("body"))), "producer", "left")
    j = j.join(apart(components.select(F.col("id").alias("node"), F.col("component").alias("own"))), "node", "left")
    exempt = F.coalesce((F.col("variable") == "loop_control") & (F.col("body") == F.col("own")), F.lit(False))
    return j.groupBy("edge", "variable").agg(F.bool_and(exempt | F.coalesce("dominates", F.lit(False))).alias("ok"))


def resolve_signals(edges: DataFrame, start: DataFrame, gates: DataFrame, slots: DataFrame) -> DataFrame:
    """(task, signal, candidates, edge): how many edges gated on the slot's signal dominate its task, and which if it is one.

    gates: edge, signal; slots: task, signal. A slot without candidates is kept.
    """
    g = gates.select("edge", "signal").distinct()
    pairs = slots.select("task", "signal").distinct().join(g, "signal")
    dom = edge_violations(edges, start, pairs.select("edge", F.col("task").alias("node")).distinct()).where("not violated").select("edge", F.col("node").alias("task"))
    n = pairs.join(apart(dom), ["edge", "task"]).groupBy("task", "signal").agg(F.count("*").alias("n"), F.min("edge").alias("edge"))
    j = slots.select("task", "signal").distinct().join(apart(n), ["task", "signal"], "left")
    return j.select("task", "signal", F.coalesce("n", F.lit(0)).alias("candidates"), F.when(F.col("n") == 1, F.col("edge")).alias("edge"))


def loop_components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of the loop arcs, named by their smallest node.

    From forward and backward closures of each loop arc's target; a component of one
    node counts only with an arc to itself.
    """
    adj = adjacency(edges).where("kind = 'loop'").select("s", "t").distinct()
    heads = edges.where("kind = 'loop'").select(F.explode("targets").alias("origin")).distinct().withColumn("id", F.col("origin"))
    fwd = closure(adj, heads).select("origin", "id")
    back = closure(adj.select(F.col("t").alias("s"), F.col("s").alias("t")), heads).select("origin", "id")
    both = cut(fwd.join(apart(back), ["origin", "id"]))
    size = both.groupBy("origin").agg(F.count("*").alias("n"))
    selfish = adj.where("s = t").select(F.col("s").alias("origin")).distinct().withColumn("own", F.lit(True))
    ok = size.join(apart(selfish), "origin", "left").where("n > 1 or own").select("origin")
    return both.join(apart(ok), "origin").groupBy("id").agg(F.min("origin").alias("component"))


def ring_lanes(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(id, entry, position): each loop's nodes by their steps along loop arcs from its entry, the smallest node."""
    adj = adjacency(edges).where("kind = 'loop'").select("s", "t")
    entries = components.select(F.col("component").alias("origin"), F.col("component").alias("id")).distinct()
    return closure(adj, entries).select("id", F.col("origin").alias("entry"), F.col("depth").alias("position"))


def loop_exits(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, exits): edges that leave each loop; a loop with none cannot end. Their gates are tested by `loop_terminable`."""
    adj = adjacency(edges).select("edge", "s", "t")
    a = components.select(F.col("id").alias("s"), "component")
    b = components.select(F.col("id").alias("t"), F.col("component").alias("other"))
    out = adj.join(apart(a), "s").join(apart(b), "t", "left").where("other is null or other <> component")
    return components.select("component").distinct().join(apart(out.groupBy("component").agg(F.count_distinct("edge").alias("n"))), "component", "left").select("component", F.coalesce("n", F.lit(0)).alias("exits"))


def loop_terminable(edges: DataFrame, components: DataFrame, gates: DataFrame) -> DataFrame:
    """(component, exits, ungated, terminable): a loop can end if an edge leaves it and each one that does is gated on loop_control.

    gates: edge, variable.
    """
    adj = adjacency(edges).select("edge", "s", "t")
    a = components.select(F.col("id").alias("s"), "component")
    b = components.select(F.col("id").alias("t"), F.col("component").alias("other"))
    out = adj.join(apart(a), "s").join(apart(b), "t", "left").where("other is null or other <> component").select("component", "edge").distinct()
    gated = gates.where("variable = 'loop_control'").select("edge", F.lit(True).alias("gated")).distinct()
    n = out.join(apart(gated), "edge", "left").groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("gated").isNull()).alias("u"))
    j = components.select("component").distinct().join(apart(n), "component", "left").select("component", F.coalesce("n", F.lit(0)).alias("exits"), F.coalesce("u", F.lit(0)).alias("ungated"))
    return j.withColumn("terminable", (F.col("exits") > 0) & (F.col("ungated") == 0))


def seal(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Arcs that close a body: from start (id 0) to tasks nothing enters, from tasks nothing leaves to end (id -1).

    Loop edges do not count as entries or exits. Without any entry, the first task in declaration order gets one.
    """
    adj = adjacency(edges).where("kind <> 'loop'")
    entry = tasks.join(adj.select(F.col("t").alias("id")), "id", "left_anti").select(F.lit(0).cast("long").alias("s"), F.col("id").alias("t"))
    exit_ = tasks.join(adj.select(F.col("s").alias("id")), "id", "left_anti").select(F.col("id").alias("s"), F.lit(-1).cast("long").alias("t"))
    first = tasks.agg(F.min_by("id", "position").alias("t"), F.count("*").alias("n")).where("n > 0")
    none = first.join(entry.limit(1).select(F.lit(True).alias("e")), F.lit(True), "left").where("e is null").select(F.lit(0).cast("long").alias("s"), "t")
    return entry.unionByName(none).unionByName(exit_)


def implicit_chain(groups: DataFrame) -> DataFrame:
    """Consecutive pairs of each group's tasks in order (grp, position, id)."""
    w = W.partitionBy("grp").orderBy("position")
    return groups.withColumn("t", F.lead("id").over(w)).where("t is not null").select("grp", F.col("id").alias("s"), "t")


def degrees(edges: DataFrame) -> DataFrame:
    a = adjacency(edges).where("kind <> 'loop'").select("s", "t").distinct()
    out = a.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("outs"))
    ins = a.groupBy(F.col("t").alias("id")).agg(F.count("*").alias("ins"))
    return out.join(ins, "id", "full").select("id", F.coalesce("ins", F.lit(0)).alias("ins"), F.coalesce("outs", F.lit(0)).alias("outs"))


def chains(arcs: DataFrame, least: int = 5) -> DataFrame:
    """(head, length): maximal paths of at least `least` nodes with one arc in and one out.

    Pointer doubling: each round, a node's pointer jumps to its pointer's pointer, so a chain
    of n nodes takes log2(n) rounds.
    """
    a = arcs.select("s", "t").distinct()
    one_out = a.groupBy("s").agg(F.count("*").alias("n"), F.min("t").alias("t")).where("n = 1").select("s", "t")
    one_in = a.groupBy("t").agg(F.count("*").alias("n")).where("n = 1").select("t")
    inner = one_out.select(F.col("s").alias("id")).join(one_in.select(F.col("t").alias("id")), "id")
    link = one_out.join(inner.select(F.col("id").alias("s")), "s").join(inner.select(F.col("id").alias("t")), "t")
    up = cut(inner.join(link.select(F.col("t").alias("id"), F.col("s").alias("p")), "id", "left").select("id", F.coalesce("p", "id").alias("p")))
    while True:
        nxt = cut(up.alias("a").join(up.alias("b"), F.col("a.p") == F.col("b.id")).select("a.id", F.col("b.p").alias("p"), (F.col("a.p") != F.col("b.p")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.groupBy(F.col("p").alias("head")).agg(F.count("*").alias("length")).where(F.col("length") >= least)
        up = nxt.select("id", "p")


def version_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(edge, change): edges of the new graph matched to the old by their sets of ends; ghost edges are only in the old."""
    ends = lambda d: d.select("edge", F.array_sort("sources").alias("a"), F.array_sort("targets").alias("b"))
    o, n = ends(old), ends(new)
    added = n.join(o.select("a", "b"), ["a", "b"], "left_anti").select("edge", F.lit("added").alias("change"))
    return added.unionByName(o.join(n.select("a", "b"), ["a", "b"], "left_anti").select("edge", F.lit("ghost").alias("change")))


def with_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Ends as sorted name lists; nodes without a name read unknown."""
    n = names.select("id", "name")

    def side(col: str) -> DataFrame:
        e = edges.select("edge", F.explode(col).alias("id")).join(n, "id", "left")
        return e.groupBy("edge").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("name", F.lit("unknown")))), ",").alias(col))

    return side("sources").join(side("targets"), "edge")


def content_hash(edges: DataFrame, names: DataFrame, group: Column) -> DataFrame:
    """(grp, hash) over a group's edges written with names and sorted: the same graph hashes the same whatever its ids."""
    t = with_names(edges, names).join(edges.select("edge", group.alias("grp")), "edge")
    return t.groupBy("grp").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("->", "sources", "targets"))), "\n"), 256).alias("hash"))


def frontier_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs from a succeeded node to a task never minted."""
    a = adjacency(edges).select("edge", "s", "t")
    ok = nodes.where("ground = 'success'").select(F.col("id").alias("s"))
    never = nodes.where("kind = 'task' and not minted").select(F.col("id").alias("t"))
    return a.join(ok, "s", "left_semi").join(never, "t", "left_semi").select("edge", "s", "t")


def firing(edges: DataFrame, nodes: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """(edge, fires): every source succeeded and every gate is satisfied.

    gates: edge, satisfied (null: not yet); an edge without gates needs its sources only, and
    without the table no edge has gates.
    """
    s = edges.select("edge", F.explode("sources").alias("id")).join(nodes.select("id", "ground"), "id", "left")
    ok = s.groupBy("edge").agg(F.bool_and(F.coalesce(F.col("ground") == "success", F.lit(False))).alias("fires"))
    if gates is None:
        return ok
    g = gates.groupBy("edge").agg(F.bool_and(F.coalesce("satisfied", F.lit(False))).alias("open"))
    return ok.join(g, "edge", "left").select("edge", (F.col("fires") & F.coalesce("open", F.lit(True))).alias("fires"))


def nearest_ancestor(parents: DataFrame, complete: DataFrame) -> DataFrame:
    """(id, ancestor, depth): the nearest complete ancestor of each row of parents (id, parent), itself included at 0.

    Complete rows hand themselves down; a row takes the smallest that reaches it first and
    hands on only that, so no round holds more than a row for each id.
    """
    done = complete.select("id").distinct()
    front = cut(done.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    seen = front.join(apart(parents.select("id")), "id", "left_semi")
    rest = cut(parents.select("id", "parent").where("parent is not null").distinct().join(apart(done), "id", "left_anti"))
    depth = 0
    while True:
        depth += 1
        step = rest.join(apart(front.select(F.col("id").alias("parent"), "ancestor")), "parent")
        front = cut(step.groupBy("id").agg(F.min("ancestor").alias("ancestor")).withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        rest = cut(rest.join(apart(front.select("id")), "id", "left_anti"))
        seen = cut(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)


def rehydration(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, disposition) of each context value (key, producer_kind, producer): carried, absent, flagged or dropped."""
    pre = nodes.where("pre_grounded").select(F.col("id").alias("producer"), F.lit(True).alias("p"))
    known = nodes.select(F.col("id").alias("producer"), F.lit(True).alias("k"))
    j = values.join(apart(pre), "producer", "left").join(apart(known), "producer", "left")
    d = F.when(F.col("producer_kind") == "signal", "dropped").when(F.col("producer_kind") != "task", "flagged").when(F.col("p"), "carried").when(F.col("k"), "absent").otherwise("flagged")
    return j.select("key", d.alias("disposition"))
