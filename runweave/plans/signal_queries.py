"""Signals, gates, captures and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions import jsonpath
from runweave.functions import scalars as X
from runweave.operators import scopes as C
from runweave.operators import signals as S
from runweave.sources import envelopes
from runweave.sources.fixtures import Fixtures

from .catalogue import query

#: predicate texts and what they mean over the signal columns
PREDICATES = {
    "and": ("$[?(@.v > 50 && @.k < 30)]", "v > 50 AND k < 30"),
    "or_not": ("$[?!(@.k == 5) && (@.v <= 10 || @.v >= 90.5)]", "k <> 5 AND (v <= 10 OR v >= 90.5)"),
    "nested": ("$[?@.user.id == 7 && @.user.tags[1] == 't1']", "user_id = 7 AND k % 4 = 1"),
    "exists_null": ("$[?@.none && @.none == null && !@.missing]", "TRUE"),
    "missing": ("$[?@.missing > 1]", "FALSE"),
    "root": ("$", "TRUE"),
    "kinds_differ": ("$[?@.v != '5' && 3 < @.k]", "k > 3"),
}

for _name, (_text, _where) in PREDICATES.items():

    @query(f"F5_predicate_{_name}", f"SELECT signal_id FROM signals WHERE {_where}", "signals")
    def _(x: Fixtures, text: str = _text) -> DataFrame:
        return x.signals().where(jsonpath.predicate(text, F.try_parse_json("payload"))).select("signal_id")


def subscriptions(names: list[str]) -> list[tuple[int, int, str, str | None]]:
    out: list[tuple[int, int, str, str | None]] = []
    for i, n in enumerate(names):
        out += [(3 * i, i, n, None), (3 * i + 1, i + 10, n, PREDICATES["and"][0]), (3 * i + 2, i + 20, n, PREDICATES["nested"][0])]
    return out


_NAMES = ["click", "view", "purchase", "signup", "error"]
_SUBS = "subs(sub_id, workflow_id, name, p) AS (VALUES " + ", ".join(f"({s}, {w}, '{n}', {0 if t is None else (1 if t == PREDICATES['and'][0] else 2)})" for s, w, n, t in subscriptions(_NAMES)) + ")"
_MATCH = f"p = 0 OR p = 1 AND {PREDICATES['and'][1]} OR p = 2 AND {PREDICATES['nested'][1]}"


@query("J12_fan_out", f"SELECT signal_id, sub_id, workflow_id FROM signals JOIN subs USING (name) WHERE {_MATCH}", "signals", _SUBS)
def _(x: Fixtures) -> DataFrame:
    return S.fan_out(x.signals(), subscriptions(_NAMES)).select("signal_id", "sub_id", "workflow_id")


@query("F6_subscription_match", f"SELECT sub_id, count(*) AS n FROM signals JOIN subs USING (name) WHERE {_MATCH} GROUP BY sub_id", "signals", _SUBS)
def _(x: Fixtures) -> DataFrame:
    return S.fan_out(x.signals(), subscriptions(_NAMES)).groupBy("sub_id").agg(F.count("*").alias("n"))


def _gates(x: Fixtures) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _NAMES])
    return x.runs().select(F.col("id").alias("gate_id"), F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("name"), (F.col("id") * 31 % 12000).alias("seq"))


_GATES = "gates AS (SELECT id AS gate_id, (['" + "', '".join(_NAMES) + "'])[id % 5 + 1] AS name, id * 31 % 12000 AS seq FROM runs)"


@query("J13_consume_gates", "SELECT gate_id, (SELECT min(signal_id) FROM signals s WHERE s.name = gates.name AND s.signal_id >= gates.seq) AS signal_id FROM gates", "runs signals", _GATES)
def _(x: Fixtures) -> DataFrame:
    return S.consume_gates(_gates(x), x.signals()).select("gate_id", F.col("hit_signal_id").alias("signal_id"))


@query("A9_fan_out_tallies", f"""SELECT signal_id, coalesce(a, 0) AS matched_workflows, coalesce(b, 0) AS gates_matched FROM (SELECT signal_id, count(*) AS a FROM signals JOIN subs USING (name) WHERE {_MATCH} GROUP BY signal_id)
  FULL JOIN (SELECT signal_id, count(*) AS b FROM (SELECT (SELECT min(signal_id) FROM signals s WHERE s.name = gates.name AND s.signal_id >= gates.seq) AS signal_id FROM gates) WHERE signal_id IS NOT NULL GROUP BY signal_id) USING (signal_id)""", "runs signals", _GATES + ", " + _SUBS)
def _(x: Fixtures) -> DataFrame:
    return S.fan_out_tallies(x.signals(), S.fan_out(x.signals(), subscriptions(_NAMES)), S.consume_gates(_gates(x), x.signals()))


@query("C1_captures", """SELECT signal_id, name, present, kind, value FROM (
  SELECT signal_id, unnest([{'name': 'v', 'present': true, 'kind': 'int', 'value': v::VARCHAR}, {'name': 'tag', 'present': true, 'kind': 'string', 'value': '"t' || (k % 4) || '"'}, {'name': 'tags', 'present': true, 'kind': 'json', 'value': '["a","t' || (k % 4) || '"]'},
    {'name': 'null', 'present': true, 'kind': 'json', 'value': 'null'}, {'name': 'gone', 'present': false, 'kind': 'json', 'value': 'null'}, {'name': 'first', 'present': true, 'kind': 'string', 'value': '"a"'}], recursive := true) FROM signals)""", "signals")
def _(x: Fixtures) -> DataFrame:
    return S.extract_captures(x.signals(), {"v": "$.v", "tag": "$.user.tags[1]", "tags": "$.user.tags", "null": "$.none", "gone": "$.user.gone", "first": "$.user['tags'][*]"})


@query("T1_idempotency", """SELECT key, seq, CASE WHEN seq = first_value(seq) OVER w THEN 'Fresh' WHEN hash = first_value(hash) OVER w THEN 'Dedup' ELSE 'Conflict' END AS outcome, first_value(seq) OVER w AS original
  FROM (SELECT user_id * 100 + k AS key, signal_id AS seq, (v // 40)::VARCHAR AS hash FROM signals) WINDOW w AS (PARTITION BY key ORDER BY seq)""", "signals")
def _(x: Fixtures) -> DataFrame:
    r = x.signals().select((F.col("user_id") * 100 + F.col("k")).alias("key"), F.col("signal_id").alias("seq"), F.lit(0).alias("at"), F.floor(F.col("v") / 40).cast("string").alias("hash"))
    return S.idempotency(r, 600)


@query("T12_digest_conflicts", "SELECT k AS key, count(DISTINCT v // 10) AS n_digests FROM signals GROUP BY k HAVING count(DISTINCT v // 10) > 1", "signals")
def _(x: Fixtures) -> DataFrame:
    return S.digest_conflicts(x.signals().select(F.col("k").alias("key"), F.floor(F.col("v") / 10).alias("d")), "key", "d")


@query("T14_first_linkage", "SELECT user_id, k, min(signal_id) AS signal_id FROM signals GROUP BY ALL", "signals")
def _(x: Fixtures) -> DataFrame:
    return S.first_wins(x.signals().select("user_id", "k", "signal_id"), ["user_id", "k"], ["signal_id"])


@query("T18_replay_idempotency", "SELECT user_id, name, min(signal_id) AS signal_id, arg_min(v, signal_id) AS v FROM signals GROUP BY user_id, name", "signals")
def _(x: Fixtures) -> DataFrame:
    return S.first_wins(x.signals().select("user_id", "name", "signal_id", "v"), ["user_id", "name"], ["signal_id"])


@query("T15_signal_status", """SELECT s.signal_id, CASE WHEN s.signal_id % 7 = 0 THEN 'wakeup' WHEN s.signal_id % 5 = 0 THEN CASE WHEN r.state IN ('Completed', 'Failed') THEN 'terminal' WHEN r.state IS NOT NULL THEN 'materialized' ELSE 'pending' END WHEN s.signal_id % 3 = 0 THEN 'cancel' ELSE 'unknown' END AS status
  FROM signals s LEFT JOIN runs r ON r.id = s.signal_id""", "signals runs")
def _(x: Fixtures) -> DataFrame:
    s = x.signals().select("signal_id")
    captures = s.where("signal_id % 5 = 0").join(x.runs().select(F.col("id").alias("signal_id"), F.col("state").alias("run_state")), "signal_id", "left")
    return S.signal_status(s, s.where("signal_id % 7 = 0"), captures, s.where("signal_id % 3 = 0"))


@query("Q13_signal", "SELECT s.signal_id, s.name, CASE WHEN s.signal_id % 7 = 0 THEN 'wakeup' ELSE 'pending' END AS status FROM signals s WHERE s.signal_id IN (35, 40)", "signals")
def _(x: Fixtures) -> DataFrame:
    s = x.signals().where("signal_id in (35, 40)")
    ids = s.select("signal_id")
    st = S.signal_status(ids, ids.where("signal_id % 7 = 0"), ids.withColumn("run_state", F.lit(None).cast("string")), ids.limit(0))
    return s.join(st, "signal_id").select("signal_id", "name", "status")


@query("C3_captures_merge", """SELECT owner, name, path, row_number() OVER (PARTITION BY owner ORDER BY t, pos) AS position FROM (
  SELECT owner, name, arg_max(path, t * 1000000000 - pos) AS path, min(t) AS t, arg_min(pos, t * 1000000000 + pos) AS pos FROM (
    SELECT user_id AS owner, 'n' || (k % 10) AS name, '$.w' || k AS path, signal_id AS pos, 0 AS t FROM signals WHERE k < 60 UNION ALL SELECT user_id, 'n' || (k % 10), '$.t' || k, signal_id, 1 FROM signals WHERE k >= 90) GROUP BY owner, name)""", "signals")
def _(x: Fixtures) -> DataFrame:
    s = x.signals()
    pick = lambda d, p: d.select(F.col("user_id").alias("owner"), F.concat(F.lit("n"), (F.col("k") % 10).cast("string")).alias("name"), F.concat(F.lit(p), F.col("k").cast("string")).alias("path"), F.col("signal_id").alias("pos"))
    return S.merge_captures(pick(s.where("k < 60"), "$.w"), pick(s.where("k >= 90"), "$.t"))


@query("C10_capture_validation", "SELECT owner, name, CASE WHEN count(*) > 1 THEN 'duplicate' WHEN bool_or(name = 'c3') THEN 'task_output' WHEN min(path) LIKE '%!%' THEN 'bad_path' END AS error FROM (SELECT user_id AS owner, 'c' || k AS name, CASE WHEN k % 9 = 0 THEN '$.!' ELSE '$.a' END AS path FROM signals) GROUP BY owner, name", "signals")
def _(x: Fixtures) -> DataFrame:
    c = x.signals().select(F.col("user_id").alias("owner"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("name"), F.when(F.col("k") % 9 == 0, "$.!").otherwise("$.a").alias("path"))
    return S.validate_captures(c, c.where("name = 'c3'"))


@query("C2_inputs_without_captures", "SELECT signal_id, CASE WHEN v > 20 AND k % 2 = 1 THEN 'inputs_without_captures' END AS error FROM signals", "signals")
def _(x: Fixtures) -> DataFrame:
    has_inputs, has_captures = F.col("v") > 20, F.col("k") % 2 == 0
    return x.signals().select("signal_id", F.when(has_inputs & ~has_captures, "inputs_without_captures").alias("error"))


@query("F14_tag_containment", "SELECT signal_id FROM signals WHERE k % 4 = 2 AND name = 'click'", "signals")
def _(x: Fixtures) -> DataFrame:
    tagged = x.signals().withColumn("tags", F.create_map(F.lit("team"), F.concat(F.lit("t"), (F.col("k") % 4).cast("string")), F.lit("kind"), F.col("name")))
    return tagged.where(S.tags_contain({"team": "t2", "kind": "click"})).select("signal_id")


@query("F15_predicate_holds", "SELECT signal_id, CASE k % 6 WHEN 0 THEN v = 50 WHEN 1 THEN v <> 50 WHEN 2 THEN v < 50 WHEN 3 THEN v <= 50 WHEN 4 THEN v > 50 ELSE v >= 50 END AND k % 5 <> 0 AS holds FROM signals", "signals")
def _(x: Fixtures) -> DataFrame:
    op = F.element_at(F.array(*[F.lit(o) for o in X.SYMBOLS]), F.col("k") % 6 + 1)
    kind = F.when(F.col("k") % 5 == 0, "string").otherwise("int")
    return x.signals().select("signal_id", S.compare_routing(op, kind, F.col("v").cast("string"), F.lit("int"), F.lit("50")).alias("holds"))


@query("S5_envelopes", """SELECT event_id AS id, CASE event_id % 10 WHEN 0 THEN 'MalformedJson' WHEN 1 THEN 'MissingVersion' WHEN 2 THEN 'UnknownVersion' WHEN 3 THEN 'MissingIdempotencyKey' WHEN 4 THEN 'MissingVariant' WHEN 5 THEN 'UnknownVariant' WHEN 6 THEN 'VariantDeserialize' END AS reject,
  CASE event_id % 10 WHEN 7 THEN 'Trigger' WHEN 8 THEN 'Cancel' WHEN 9 THEN 'Wakeup' END AS variant FROM events""")
def _(x: Fixtures) -> DataFrame:
    return envelopes.parse_envelopes(_envelopes(x)).select("id", "reject", "variant")


def _envelopes(x: Fixtures) -> DataFrame:
    e = F.col("event_id")
    bodies = [
        '{"version":1', '{"idempotency_key":"a","variant":"Wakeup"}', '{"version":2,"idempotency_key":"a","variant":"Wakeup"}', '{"version":1,"variant":"Wakeup"}', '{"version":1,"idempotency_key":"a"}',
        '{"version":1,"idempotency_key":"a","variant":"Jump"}', '{"version":1,"idempotency_key":"a","variant":"Trigger","workflow_id":"no"}', '{"version":1,"idempotency_key":"a","variant":"Trigger","workflow_id":"62e7d2fa-5996-5458-868d-77eb2e46fb1f"}',
        '{"version":1,"idempotency_key":"a","variant":"Cancel","target":{"x":1}}', '{"version":1,"idempotency_key":"a","variant":"Wakeup","name":"n","target":{}}']
    return x.raw("events").select(e.alias("id"), F.element_at(F.array(*[F.lit(b) for b in bodies]), (e % 10 + 1).cast("int")).alias("body"))


@query("S5_reject_counts", "SELECT CASE WHEN m = 0 THEN 'MalformedJson' WHEN m >= 7 THEN 'accepted' ELSE (['MissingVersion', 'UnknownVersion', 'MissingIdempotencyKey', 'MissingVariant', 'UnknownVariant', 'VariantDeserialize'])[m] END AS outcome, count(*) AS n FROM (SELECT event_id % 10 AS m FROM events) GROUP BY 1")
def _(x: Fixtures) -> DataFrame:
    return envelopes.reject_counts(envelopes.parse_envelopes(_envelopes(x)))


@query("C4_routing_split", """SELECT user_id AS id, bool_or(d AND bad) AS failed, CASE WHEN NOT bool_or(d AND bad) THEN coalesce(string_agg(n || ':int', ',' ORDER BY n || ':int') FILTER (d), '') END AS routed, CASE WHEN NOT bool_or(d AND bad) THEN coalesce(string_agg(n, ',' ORDER BY n) FILTER (NOT d), '') END AS rest
  FROM (SELECT user_id, 'n' || k AS n, k % 3 = 0 AS d, v > 97 AS bad FROM signals) GROUP BY user_id""", "signals")
def _(x: Fixtures) -> DataFrame:
    s = x.signals().select(F.col("user_id").alias("id"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"), F.when(F.col("v") > 97, "1.5").otherwise("7").alias("json"))
    declared = x.signals().where("k % 3 = 0").select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"))
    return C.split_routing(s, declared)


@query("C5_dropped_variables", "SELECT signal_id, CASE WHEN v > 50 THEN CASE WHEN k % 2 = 0 THEN 'a,b' ELSE 'a' END ELSE '' END AS dropped FROM signals", "signals")
def _(x: Fixtures) -> DataFrame:
    declared = F.array(F.lit("b"), F.lit("a"), F.lit("c"))
    emitted = F.when(F.col("k") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("a")))
    return x.signals().select("signal_id", F.array_join(C.dropped(declared, emitted, F.col("v") > 50), ",").alias("dropped"))


@query("C6_scope_classification", """SELECT s.scope, s.position, e.name, e.value FROM (VALUES ('run', 0, '1'), ('trigger', 1, '2'), ('gate', 2, '3'), ('gate', 3, 'none')) s(scope, position, prefix) LEFT JOIN (SELECT user_id::VARCHAR AS prefix, name || '/' || k AS name, v::VARCHAR AS value FROM signals) e USING (prefix)""", "signals")
def _(x: Fixtures) -> DataFrame:
    e = x.signals().select(F.concat_ws("/", F.col("user_id").cast("string"), "name", F.col("k").cast("string")).alias("key"), F.col("v").cast("string").alias("value"))
    scopes = x.spark.createDataFrame([("run", 0, "1"), ("trigger", 1, "2"), ("gate", 2, "3"), ("gate", 3, "none")], "scope string, position int, prefix string")
    return C.classify(e, scopes)


@query("F13_reserved_keys", "SELECT signal_id FROM signals WHERE k % 3 = 0", "signals")
def _(x: Fixtures) -> DataFrame:
    key = F.when(F.col("k") % 3 == 0, F.concat(F.lit("a/"), F.col("k").cast("string"))).when(F.col("k") % 3 == 1, "graph").otherwise("replay/x")
    return C.visible(x.signals().withColumn("key", key)).select("signal_id")


def _ambient(x: Fixtures) -> DataFrame:
    return x.signals().select(F.col("user_id").alias("run_id"), F.col("k").alias("name"), F.when(F.col("v") > 50, F.col("v").cast("string")).alias("value"), F.col("signal_id").alias("position"))


@query("C7_ambient", "SELECT user_id AS run_id, k AS name, CASE WHEN count(*) FILTER (v > 50) = 0 THEN 'NotFound' WHEN count(*) FILTER (v > 50) = 1 THEN 'Value' ELSE 'Collision' END AS outcome, CASE WHEN count(*) FILTER (v > 50) = 1 THEN max(v) FILTER (v > 50)::VARCHAR END AS value FROM signals GROUP BY user_id, k", "signals")
def _(x: Fixtures) -> DataFrame:
    return C.ambient(_ambient(x))


@query("C8_first_scope", "SELECT user_id AS run_id, k AS name, arg_min(v::VARCHAR, signal_id) AS value FROM signals WHERE v > 50 GROUP BY user_id, k", "signals")
def _(x: Fixtures) -> DataFrame:
    return C.first_scope(_ambient(x))


@query("A14_gate_scope_ids", "SELECT user_id AS run_id, coalesce(string_agg(DISTINCT k::VARCHAR, ',' ORDER BY k::VARCHAR) FILTER (v > 50 AND k <> 0), '') AS scopes FROM signals GROUP BY user_id", "signals")
def _(x: Fixtures) -> DataFrame:
    g = x.signals().select(F.col("user_id").alias("run_id"), F.when(F.col("v") > 50, "Satisfied").otherwise("Idle").alias("state"), F.col("k").alias("signal_id"))
    return C.gate_scopes(g).select("run_id", F.array_join(F.array_sort(F.transform("scopes", lambda v: v.cast("string"))), ",").alias("scopes"))


@query("P8_secret_mask", "SELECT signal_id, CASE WHEN k % 2 = 0 AND v > 10 THEN v END AS value FROM signals", "signals")
def _(x: Fixtures) -> DataFrame:
    return x.signals().select("signal_id", C.masked(F.col("v"), F.col("k") % 2 == 1, F.col("v") > 10).alias("value"))


@query("P9_producer_text", "SELECT signal_id, CASE k % 3 WHEN 0 THEN 'task ' || coalesce(CASE WHEN k % 2 = 0 THEN name END, user_id::VARCHAR) WHEN 1 THEN 'signal ' || user_id || ' (External)' ELSE 'system clock' END AS producer FROM signals", "signals")
def _(x: Fixtures) -> DataFrame:
    kind = F.element_at(F.array(F.lit("task"), F.lit("signal"), F.lit("system")), F.col("k") % 3 + 1)
    name = F.when(F.col("k") % 3 == 2, "clock").when(F.col("k") % 2 == 0, F.col("name"))
    return x.signals().select("signal_id", C.producer_text(kind, name, F.col("user_id").cast("string"), F.lit("External")).alias("producer"))


@query("Q7_run_context", "SELECT user_id AS run_id, k AS name, CASE WHEN k % 2 = 0 THEN arg_min(v, signal_id) END AS value FROM signals WHERE v > 50 GROUP BY user_id, k", "signals")
def _(x: Fixtures) -> DataFrame:
    first = C.first_scope(_ambient(x))
    return first.select("run_id", "name", C.masked(F.col("value").cast("long"), F.col("name") % 2 == 1, F.lit(True)).alias("value"))


@query("T21_write_claims", """SELECT k AS claim, signal_id AS seq, CASE WHEN signal_id = first_value(signal_id) OVER w THEN 'Applied' WHEN user_id = first_value(user_id) OVER w AND v // 50 = first_value(v // 50) OVER w THEN 'Idempotent' ELSE 'ClaimConflict' END AS outcome
  FROM signals WINDOW w AS (PARTITION BY k ORDER BY signal_id)""", "signals")
def _(x: Fixtures) -> DataFrame:
    return C.write_claims(x.signals().select(F.col("k").alias("claim"), F.col("signal_id").alias("seq"), F.col("user_id").alias("scope"), F.floor(F.col("v") / 50).alias("digest")))


@query("C11_replay_inputs", "SELECT signal_id AS id, 'n' || k AS name, CASE WHEN k % 3 = 0 THEN CASE WHEN v > 50 THEN 'int' ELSE 'string' END END AS kind, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'task_produced' ELSE 'undeclared' END AS error FROM signals", "signals")
def _(x: Fixtures) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("k").cast("string")).alias("name")
    i = x.signals().select(F.col("signal_id").alias("id"), name, F.when(F.col("v") > 50, F.col("v").cast("string")).otherwise('"s"').alias("json"))
    return C.replay_inputs(i, x.signals().where("k % 3 = 0").select(name), x.signals().where("k % 3 = 1").select(name))


@query("C9_signal_emits", "SELECT s.signal_id AS run_id, s.name, CASE WHEN k % 2 = 0 THEN CASE WHEN v > 50 THEN v::VARCHAR END ELSE signal_id || '/task' END AS payload, CASE WHEN k % 2 = 0 AND v <= 50 THEN 'missing' END AS error FROM signals s", "signals")
def _(x: Fixtures) -> DataFrame:
    s = x.signals()
    emits = s.select(F.col("signal_id").alias("run_id"), "name", F.lit("x").alias("var"), F.when(F.col("k") % 2 == 0, "success").otherwise("failure").alias("on"))
    values = s.where("v > 50").select(F.col("signal_id").alias("run_id"), F.lit("x").alias("var"), F.col("v").cast("string").alias("value"))
    return C.emitted_signals(emits, values)
