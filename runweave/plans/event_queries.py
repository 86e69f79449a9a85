"""Event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions import scalars as X
from runweave.operators import events as E
from runweave.sources.fixtures import Fixtures

from .catalogue import query, text_time

T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_ANY = "payload <> '{}'"


@query("P3_event_row", f"SELECT seq, event_type, {T.format('ts')} AS ts, payload FROM evs", "evs")
def _(x: Fixtures) -> DataFrame:
    return x.events().select("seq", "event_type", text_time("ts").alias("ts"), "payload")


@query("P12_event_chips", f"SELECT seq, event_type, CASE WHEN {_ANY} THEN 'workflow_instance=' || user_id || ',task_instance=' || (id % 37) || ',reason=r' || (id % 3) ELSE '' END AS chips FROM evs", "evs")
def _(x: Fixtures) -> DataFrame:
    return x.events().select("seq", "event_type", F.coalesce(F.array_join(E.chips(), ","), F.lit("")).alias("chips"))


@query("F4_mentions_run", f"SELECT seq FROM evs WHERE {_ANY} AND user_id = 7", "evs")
def _(x: Fixtures) -> DataFrame:
    return x.events().where(E.mentions("workflow_instance_id", "7")).select("seq")


@query("F4_mentions_task", f"SELECT seq FROM evs WHERE {_ANY} AND id % 37 = 5", "evs")
def _(x: Fixtures) -> DataFrame:
    return x.events().where(E.mentions("task_instance_id", "5")).select("seq")


for _family, _types in E.FAMILIES.items():

    @query(f"F7_family_{_family.lower()}", f"SELECT seq, event_type FROM evs WHERE event_type IN ({', '.join(repr(t) for t in _types)})", "evs")
    def _(x: Fixtures, family: str = _family) -> DataFrame:
        return x.events().where(E.in_family(family)).select("seq", "event_type")


@query("F7_family_all", "SELECT seq, event_type FROM evs", "evs")
def _(x: Fixtures) -> DataFrame:
    return x.events().where(E.in_family("All")).select("seq", "event_type")


@query("A3_event_count", f"SELECT count(*) AS n FROM evs WHERE {_ANY} AND user_id = 11", "evs")
def _(x: Fixtures) -> DataFrame:
    return x.events().where(E.mentions("workflow_instance_id", "11")).agg(F.count("*").alias("n"))


@query("O5_event_page", "SELECT seq, event_type FROM evs WHERE seq > 100 ORDER BY seq DESC LIMIT 200", "evs")
def _(x: Fixtures) -> DataFrame:
    return E.newest_page(x.events(), 100).select("seq", "event_type")


@query("O5_ascending_pager", "SELECT seq, event_type FROM evs WHERE seq > 100 ORDER BY seq LIMIT 200", "evs")
def _(x: Fixtures) -> DataFrame:
    return E.next_page(x.events(), 100).select("seq", "event_type")


@query("T16_live_tail", "SELECT seq, (SELECT max(seq) FROM evs) AS next_cursor FROM evs ORDER BY seq DESC LIMIT 200", "evs")
def _(x: Fixtures) -> DataFrame:
    page = E.newest_page(x.events(), 0).select("seq")
    return page.crossJoin(F.broadcast(page.agg(F.max("seq").alias("next_cursor"))))


@query("O6_upstream_cursor", f"SELECT {T.format('archived_at')} AS archived_at, id FROM evs ORDER BY evs.archived_at DESC, id DESC LIMIT 1", "evs")
def _(x: Fixtures) -> DataFrame:
    return E.cursor(x.events()).select(text_time("archived_at").alias("archived_at"), "id")


@query("O11_display_order", "SELECT seq FROM evs ORDER BY ts DESC, seq DESC LIMIT 200", "evs")
def _(x: Fixtures) -> DataFrame:
    return x.events().orderBy(*E.display_order()).limit(200).select("seq")


@query("S4_append_new_events", "SELECT id, 1000 + row_number() OVER (ORDER BY id) AS seq FROM evs WHERE id >= 900 AND id NOT IN (SELECT id FROM evs WHERE seq <= 1000)", "evs")
def _(x: Fixtures) -> DataFrame:
    e = x.events()
    batch = e.where("id >= 900")
    return E.append_new(e.where("seq <= 1000"), batch.unionByName(batch.where("id % 3 = 0")), ["id", "ts"]).select("id", "seq")


@query("W10_contiguous_numbers", "SELECT id, row_number() OVER (ORDER BY id) AS n FROM evs WHERE event_type <> 'TaskQueued'", "evs")
def _(x: Fixtures) -> DataFrame:
    return E.numbered(x.events().where("event_type <> 'TaskQueued'"), ["id"], "n").select("id", "n")


@query("J11_insert_dedup", "SELECT id FROM evs WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM evs WHERE id % 3 = 0)", "evs")
def _(x: Fixtures) -> DataFrame:
    e = x.events().select("id")
    return e.where("id % 2 = 0").join(e.where("id % 3 = 0"), "id", "left_anti")


@query("X23_event_token", "SELECT seq, event_type, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{X.TOKEN[v]}'" for k, v in X.CATEGORY.items()) + " ELSE 'neutral' END AS token FROM evs", "evs")
def _(x: Fixtures) -> DataFrame:
    return x.events().select("seq", "event_type", X.event_token(F.col("event_type")).alias("token"))


@query("X15_relative_time", """SELECT seq, CASE WHEN s < 60 THEN s || 's ago' WHEN s // 60 < 60 THEN (s // 60) || 'm ago' WHEN s // 3600 < 24 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age
  FROM (SELECT seq, greatest(0, floor((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(date_trunc('second', ts)))::DOUBLE / 1000000 + 0.5)::BIGINT) AS s FROM evs)""", "evs")
def _(x: Fixtures) -> DataFrame:
    now = F.unix_seconds(F.expr("timestamp'2024-01-20'"))
    return x.events().select("seq", X.relative_time((now - F.unix_seconds("ts")).cast("double")).alias("age"))


@query("T8_liveness_gaps", "SELECT user_id, since, until FROM (SELECT user_id, epoch_us(date_trunc('second', ts)) // 1000000 AS since, lead(epoch_us(date_trunc('second', ts)) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM evs) WHERE until IS NULL OR until - since > 7200", "evs")
def _(x: Fixtures) -> DataFrame:
    from runweave.operators.logs import silent_spells

    beats = x.raw("events").select("user_id", F.date_trunc("second", "ts").alias("ts"))
    return silent_spells(beats, "user_id", "ts", 7200).select("user_id", F.unix_seconds("since").alias("since"), F.unix_seconds("until").alias("until"))


@query("Q9_events_of_run", f"SELECT seq, event_type FROM evs WHERE {_ANY} AND user_id = 7 AND seq > 50 ORDER BY seq DESC LIMIT 200", "evs")
def _(x: Fixtures) -> DataFrame:
    return E.newest_page(x.events().where(E.mentions("workflow_instance_id", "7")), 50).select("seq", "event_type")


@query("T4_late_rows_kept", "SELECT seq, ts < max(ts) OVER (ORDER BY archived_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM evs WHERE user_id = 7", "evs")
def _(x: Fixtures) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("archived_at", "seq").rowsBetween(W.unboundedPreceding, -1)
    e = x.events().join(x.raw("events").select(F.col("event_id").alias("id"), "user_id"), "id").where("user_id = 7")
    return e.select("seq", (F.col("ts") < F.max("ts").over(w)).alias("late"))


@query("T20_drain_good_events", f"SELECT seq FROM evs WHERE {_ANY}", "evs")
def _(x: Fixtures) -> DataFrame:
    return x.events().where(F.exists(E.members(), lambda m: F.rlike(m["workflow_instance_id"], F.lit("^[0-9]+$")))).select("seq")
