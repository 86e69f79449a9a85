"""Cases the fixtures do not hold, and operators without SQL."""

import pytest
from pyspark.sql import functions as F

from runweave.functions import jsonpath
from runweave.functions import scalars as X
from runweave.functions.canonical import canonical_json
from runweave.operators import graph as G
from runweave.operators import logs as L
from runweave.operators import runs as R
from runweave.operators import signals as S
from runweave.operators import timeline as T
from runweave.plans import catalogue
from runweave.sources.fixtures import Fixtures


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_identity_codes(spark):
    assert one(spark, a=X.identity_code(F.lit("00443fff-ffff-ffff-ffff-ffffffffffff")), b=X.identity_code(F.lit("FFFFF000-0000-0000-0000-000000000000")))[:] == ("0123", "ZZZZ")


def test_uuid5_vector(spark):
    r = one(spark, a=X.workflow_id(F.lit("8f51db61-785a-5bad-b6c9-e92abfcf5ad7"), F.lit("reporting"), F.lit("daily-sync")))
    assert r.a == "62e7d2fa-5996-5458-868d-77eb2e46fb1f"


def test_local_dates_follow_historical_zones(spark):
    day = lambda t, z: X.local_date(F.lit(t).cast("timestamp"), z).cast("string")
    r = one(spark, a=day("2011-12-30 09:59:59", "Pacific/Apia"), b=day("2011-12-30 10:00:00", "Pacific/Apia"), c=day("1985-12-31 18:15:00", "Asia/Kathmandu"), d=day("2024-03-10 04:30:00", "America/New_York"), e=day("2024-07-01 03:00:00", "America/St_Johns"))
    assert r[:] == ("2011-12-29", "2011-12-31", "1985-12-31", "2024-03-09", "2024-07-01")


def test_canonical_json(spark):
    texts = ['{"b":1,"a":{"d":[1.50,1e3,null],"c":"é\\n"}}', None, "nope", "[ ]", '"x"', "-0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.j for r in df.select("i", canonical_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == ['{"a":{"c":"é\\n","d":[1.50,1e3,null]},"b":1}', "{}", None, "[]", '"x"', "-0"]


@pytest.mark.parametrize("text,payload,want", [
    ("$", "null", True), ("$[?@.a]", '{"a":null}', True), ("$[?@.a]", "{}", False), ("$[?@.a == null]", '{"a":null}', True), ("$[?@.a == 1]", '{"a":"1"}', False), ("$[?@.a != 1]", "{}", True),
    ("$[?@.a.b[1] >= 2.5 && !(@.c == 'x')]", '{"a":{"b":[0,2.5]},"c":"y"}', True), ("$[?@['a b'] == true]", '{"a b":true}', True), ("$[?@.a < @.b]", '{"a":1,"b":2}', True), ("$[?@.a == 'x' || @.b == 'y']", '{"b":"y"}', True), ("$[?@.a > 1]", "not json", False)])
def test_predicates(spark, text, payload, want):
    r = spark.createDataFrame([(payload,)], "p string").select(jsonpath.predicate(text, F.try_parse_json("p")).alias("x")).first()
    assert r.x is want


@pytest.mark.parametrize("text", ["$.a", "$[?@.a ==]", "$[?(@.a]", "$[?@.a && ]", "$[?1 == 2]", "$[?@.a ~ 1]"])
def test_unsupported_predicates_are_refused(spark, text):
    with pytest.raises(jsonpath.Unsupported):
        jsonpath.predicate(text, F.lit(None))


def test_idempotency_forgets_after_its_time(spark):
    rows = [("k", 1, 0, "a"), ("k", 2, 5, "a"), ("k", 3, 9, "b"), ("k", 4, 10, "b"), ("k", 5, 12, "a"), ("j", 6, 0, "a")]
    got = S.idempotency(spark.createDataFrame(rows, "key string, seq long, at long, hash string"), 10).orderBy("seq").collect()
    assert [(r.outcome, r.original) for r in got] == [("Fresh", 1), ("Dedup", 1), ("Conflict", 1), ("Fresh", 4), ("Conflict", 4), ("Fresh", 6)]


def test_debounce(spark):
    seq = ["h", "d", "h", "d", "d", "u", "d", "u", "u"]
    got = T.debounced(spark.createDataFrame([("x", i, s) for i, s in enumerate(seq)], "key string, seq long, status string"), "key").orderBy("seq").collect()
    assert [r.shown for r in got] == ["h", "h", "h", "h", "d", "d", "d", "d", "u"]


def test_debounced_query_matches_a_fold(spark, sf):
    from runweave.plans import catalogue

    got = {(r.key, r.seq): r.shown for r in catalogue.queries()["W11_debounced_status"](spark, sf).collect()}
    shown, nxt = {}, {}
    for r in Fixtures(spark, sf).signals().orderBy("signal_id").collect():
        s, k = "healthy" if r.v > 50 else "degraded", r.user_id
        if k not in shown or s == nxt.get(k) and s != shown[k]:
            shown[k], nxt[k] = s, None
        else:
            nxt[k] = None if s == shown[k] else s
        assert got[k, r.signal_id] == shown[k]


def edges(spark, rows):
    return spark.createDataFrame(rows, "edge long, kind string, sources array<long>, targets array<long>")


def brute_fireable(nodes, rows, seeds):
    closed = set(seeds)
    while True:
        more = {t for _, _, s, ts in rows if closed & set(s) for t in ts} - closed
        if not more:
            break
        closed |= more
    done = {i for i, g in nodes.items() if g == "success" and i not in closed}
    ok = {i for i in closed if not any(i in ts for _, _, _, ts in rows)}
    while True:
        more = {t for _, _, s, ts in rows if set(s) <= ok | done for t in ts if t in closed} - ok
        if not more:
            return closed, ok
        ok |= more


def test_fireable_needs_all_sources_and_survives_cycles(spark):
    ground = {1: "failed", 2: "success", 3: "pending", 4: "pending", 5: "pending", 6: "success", 7: "pending", 8: "pending"}
    rows = [(1, "p", [1, 2], [3]), (2, "p", [3, 7], [4]), (3, "p", [3], [5]), (4, "loop", [5], [3]), (5, "p", [8], [7]), (6, "p", [1], [8]), (7, "p", [6, 9], [5])]
    nodes = spark.createDataFrame([(i, g, "task", True) for i, g in ground.items()], "id long, ground string, kind string, minted boolean")
    e = edges(spark, rows)
    closed = G.reach(G.adjacency(e), nodes.where("ground = 'failed'").select("id"))
    want_closed, want = brute_fireable(ground, rows, [1])
    assert {r.id for r in closed.collect()} == want_closed
    assert {r.id for r in G.fireable(nodes, e, closed).collect()} == want


def test_fireable_query_matches_brute_force(spark, sf):
    from runweave.plans import catalogue

    x = Fixtures(spark, sf)
    ground = {r.id: r.ground for r in x.nodes().collect()}
    rows = [(r.edge, r.kind, r.sources, r.targets) for r in x.edges().collect()]
    _, want = brute_fireable(ground, rows, [i for i, g in ground.items() if g == "failed"])
    assert {r.id for r in catalogue.queries()["G4_fireable"](spark, sf).collect()} == want


def test_edge_violation_gives_the_shortest_length(spark):
    e = edges(spark, [(1, "p", [0], [1]), (2, "p", [1], [2]), (3, "p", [0], [3]), (4, "p", [3], [2]), (5, "p", [2], [0])])
    g = spark.createDataFrame([(2, 2), (1, 1), (9, 2)], "edge long, node long")
    got = {r.edge: (r.violated, r.length) for r in G.edge_violations(e, spark.createDataFrame([(0,)], "id long"), g).collect()}
    assert got == {2: (True, 2), 1: (False, None), 9: (True, None)}


def test_seal_of_a_ring_enters_at_the_first_task(spark):
    tasks = spark.createDataFrame([(5, 0), (4, 1)], "id long, position int")
    ring = edges(spark, [(1, "p", [5], [4]), (2, "p", [4], [5])])
    assert {tuple(r) for r in G.seal(tasks, ring).collect()} == {(0, 5)}
    loop = edges(spark, [(1, "p", [5], [4]), (2, "loop", [4], [5])])
    assert {tuple(r) for r in G.seal(tasks, loop).collect()} == {(0, 5), (4, -1)}


def test_frontier_with_gaps_and_duplicates(spark):
    r = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 1, "b"), (1, 4, "c"), (2, 1, "x"), (3, 0, "y")], "stream long, sequence long, bytes string")
    g = spark.createDataFrame([(1, 2, 3), (2, 0, 0), (3, 2, 5)], "stream long, first long, last long")
    assert {tuple(x) for x in L.frontiers(r, g).collect()} == {(1, 4), (2, 1), (3, 0)}
    assert L.frontiers(r.limit(0), g.limit(0)).count() == 0


def test_optional_ranges_and_missing_live_half(spark, sf):
    x = Fixtures(spark, sf)
    assert R.in_range(x.runs(), None, None).count() == x.runs().count()
    assert R.in_range(x.runs(), "1990-01-01", None).where("scheduled_at is null").count() == 0
    assert R.calendar(x.archive(), None, "UTC", 1996).where("in_progress + scheduled > 0").count() == 0


def test_calendar_filter_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderdate", "t").withColumn("scheduled_at", F.col("t").cast("timestamp"))
    plan = R.in_local_year(df, "Asia/Kathmandu", 1997)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "ReadSchema" in plan


def test_producer_must_dominate_each_gate_source_but_in_its_own_loop(spark):
    e = edges(spark, [(1, "p", [1], [2, 3]), (2, "p", [2], [4]), (3, "p", [3], [5]), (4, "p", [4, 5], [6]), (5, "loop", [4], [2]), (6, "loop", [2], [4]), (7, "loop", [3], [5]), (8, "loop", [5], [3])])
    start = spark.createDataFrame([(1,)], "id long")
    gates = spark.createDataFrame([(4, "a"), (4, "b"), (4, "none"), (2, "loop_control"), (5, "loop_control"), (3, "loop_control"), (2, "d"), (3, "b"), (3, "b")], "edge long, variable string")
    producers = spark.createDataFrame([("a", 1), ("b", 2), ("loop_control", 4), ("d", 4)], "variable string, producer long")
    got = {(r.edge, r.variable): r.ok for r in G.producer_check(e, start, gates, producers, G.loop_components(e)).collect()}
    # 2 is not dominated by 4, but is in the loop of 4; 3 is on another loop; 2 does not dominate 5
    assert got == {(4, "a"): True, (4, "b"): False, (4, "none"): False, (2, "loop_control"): True, (5, "loop_control"): True, (3, "loop_control"): False, (2, "d"): False, (3, "b"): False}


def test_signal_is_resolved_by_the_one_gate_that_dominates(spark):
    e = edges(spark, [(1, "p", [1], [2, 3]), (2, "p", [2], [4]), (3, "p", [3], [5])])
    gates = spark.createDataFrame([(2, "x"), (3, "x"), (1, "y"), (2, "y")], "edge long, signal string")
    slots = spark.createDataFrame([(4, "x"), (4, "y"), (5, "y"), (2, "x"), (5, "none")], "task long, signal string")
    got = {tuple(r) for r in G.resolve_signals(e, spark.createDataFrame([(1,)], "id long"), gates, slots).collect()}
    assert got == {(4, "x", 1, 2), (4, "y", 2, None), (5, "y", 1, 1), (2, "x", 0, None), (5, "none", 0, None)}


def test_unsatisfied_gate_stops_an_edge_and_ungated_exit_stops_a_loop(spark):
    e = edges(spark, [(1, "p", [1], [2]), (2, "p", [2], [3]), (3, "p", [2], [4]), (4, "loop", [2], [5]), (5, "loop", [5], [2]), (6, "p", [5], [3]), (7, "loop", [8], [8]), (8, "loop", [9], [9]), (9, "p", [9], [3])])
    nodes = spark.createDataFrame([(1, "success"), (2, "success"), (5, "failed")], "id long, ground string")
    gates = spark.createDataFrame([(1, True), (2, True), (2, False), (3, None), (6, True)], "edge long, satisfied boolean")
    assert {r.edge for r in G.firing(e, nodes, gates).collect() if r.fires} == {1, 4}
    control = spark.createDataFrame([(2, "loop_control"), (3, "loop_control"), (6, "a"), (9, "loop_control"), (9, "a")], "edge long, variable string")
    got = {tuple(r) for r in G.loop_terminable(e, G.loop_components(e), control).collect()}
    assert got == {(2, 3, 1, False), (8, 0, 0, False), (9, 1, 0, True)}


def test_nearest_ancestor_holds_a_row_for_each_id(spark, monkeypatch):
    cut, rows = G.cut, []

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", counted)
    n = 127
    tree = spark.createDataFrame([(i, i // 2 if i > 1 else None) for i in range(1, n + 1)], "id long, parent long")
    got = {r.id: (r.ancestor, r.depth) for r in G.nearest_ancestor(tree, tree.where("id = 1 or id % 2 = 0")).collect()}
    want = {i: (i, 0) if i == 1 or i % 2 == 0 else next((i >> d, d) for d in range(1, 8) if i >> d == 1 or (i >> d) % 2 == 0) for i in range(1, n + 1)}
    assert got == want
    assert sum(rows) <= 3 * n
    # a cycle with nothing complete, two parents at one distance, a complete ancestor that has no row, a repeated row
    odd = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (3, 8), (4, 3), (4, 7), (5, 4), (5, 1), (5, 1), (6, None)], "id long, parent long")
    ok = spark.createDataFrame([(9,), (8,), (6,), (6,)], "id long")
    assert sorted(map(tuple, G.nearest_ancestor(odd, ok).collect())) == [(3, 8, 1), (4, 8, 2), (5, 8, 3), (6, 6, 0)]


@pytest.mark.parametrize("name", ["G21_rehydration_plan", "G10_loop_terminable", "G7_task_dominance"])
def test_graph_tables_do_not_pass_through_the_driver(spark, sf, monkeypatch, name):
    cut, plans = G.cut, []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(G, "cut", noted)
    df = catalogue.queries()[name](spark, sf)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "BroadcastHashJoin" in p]
