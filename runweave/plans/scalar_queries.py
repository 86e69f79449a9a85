"""Scalar functions over columns of the fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions import scalars as X
from runweave.sources.fixtures import Fixtures

from .catalogue import query

_DUR = ["30s", "5m", "1h", "42", "", "s", "0m", "7d", "99999999999999999999999", "18446744073709551615h", " 9m "]
_DUR_OUT = [(30, None), (300, None), (3600, None), (42, None), (None, "Empty"), (None, "NotANumber"), (None, "NonPositive"), (None, "UnknownUnit"), (None, "NotANumber"), (None, "Overflow"), (540, None)]


def _pick(values: list, key: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _lit(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _case(key: str, values: list) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(values)) + " END"


@query("X1_parse_duration", f"SELECT p_partkey AS id, {_case('p_partkey', [a for a, _ in _DUR_OUT])}::BIGINT AS seconds, {_case('p_partkey', [b for _, b in _DUR_OUT])} AS error FROM part")
def _(x: Fixtures) -> DataFrame:
    seconds, error = X.parse_duration(_pick(_DUR, "p_partkey"))
    return x.raw("part").select(F.col("p_partkey").alias("id"), seconds.alias("seconds"), error.alias("error"))


_ALPHA = X.ALPHABET
_TOP = "('0x' || substr(md5(p_partkey::VARCHAR), 1, 5))::BIGINT"


@query("X2_identity_code", "SELECT p_partkey AS id, " + " || ".join(f"substr('{_ALPHA}', (({_TOP}) >> {s}) % 32 + 1, 1)" for s in (15, 10, 5, 0)) + " AS code FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.identity_code(X.dashed(F.md5(F.col("p_partkey").cast("string")))).alias("code"))


_V5 = "(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', ('0x' || substr({h}, 17, 1))::INTEGER % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def _sha1(name: str) -> str:
    return f"sha1(unhex('{X.NAMESPACE_OID}') || encode({name}))"


@query("X12_workflow_id", f"SELECT p_partkey AS id, {_V5.format(h=_sha1('''('8f51db61-785a-5bad-b6c9-e92abfcf5ad7.reporting.s' || p_partkey)'''))} AS workflow_id FROM part")
def _(x: Fixtures) -> DataFrame:
    slug = F.concat(F.lit("s"), F.col("p_partkey").cast("string"))
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.workflow_id(F.lit("8f51db61-785a-5bad-b6c9-e92abfcf5ad7"), F.lit("reporting"), slug).alias("workflow_id"))


@query("X10_replay_id", f"SELECT p_partkey AS id, {_V5.format(h='''sha1(unhex(md5('source')) || unhex(md5(p_partkey::VARCHAR)))''')} AS replay_id FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.uuid5(F.md5(F.lit("source")), F.unhex(F.md5(F.col("p_partkey").cast("string")))).alias("replay_id"))


@query("X11_patch_key", f"SELECT p_partkey AS id, {_V5.format(h='''sha1(unhex(md5(p_partkey::VARCHAR)) || encode('patch-key'))''')} AS patch_key FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.uuid5(F.md5(F.col("p_partkey").cast("string")), F.lit("patch-key")).alias("patch_key"))


@query("X27_release_signal_id", f"SELECT p_partkey AS id, {_V5.format(h='''sha1(unhex(md5(p_partkey::VARCHAR)) || encode('release'))''')} AS signal_id FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.uuid5(F.md5(F.col("p_partkey").cast("string")), F.lit("release")).alias("signal_id"))


_H = "(substr(md5(o_orderkey::VARCHAR), 1, 16) || substr(sha256(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00')), 1, 16))"


@query("X25_scheduled_run_id", f"SELECT o_orderkey AS id, {_V5.format(h=_H).replace('-5', '-4')} AS run_id FROM orders")
def _(x: Fixtures) -> DataFrame:
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return x.raw("orders").select(F.col("o_orderkey").alias("id"), X.scheduled_run_id(F.md5(F.col("o_orderkey").cast("string")), at).alias("run_id"))


@query("X4_canonical_hash", "SELECT p_partkey AS id, sha256('{\"a\":' || p_size || ',\"b\":{\"c\":\"' || p_name || '\",\"d\":[1,null]}}') AS hash FROM part")
def _(x: Fixtures) -> DataFrame:
    from runweave.functions.canonical import canonical_json

    body = F.concat(F.lit('{ "b": {"d": [1, null], "c": "'), F.col("p_name"), F.lit('"}, "a": '), F.col("p_size").cast("string"), F.lit("}"))
    return x.raw("part").select(F.col("p_partkey").alias("id"), F.sha2(canonical_json(body), 256).alias("hash"))


@query("X3_canonical_json", "SELECT p_partkey AS id, '{\"a\":1.50,\"z\":\"' || p_name || '\"}' AS json FROM part")
def _(x: Fixtures) -> DataFrame:
    from runweave.functions.canonical import canonical_json

    return x.raw("part").select(F.col("p_partkey").alias("id"), canonical_json(F.concat(F.lit('{"z":"'), F.col("p_name"), F.lit('", "a" : 1.50}'))).alias("json"))


_JSON = ['"s"', "true", "5", "1.5", "null", "[1]", '{"a":1}', "-7"]
_KINDS = ["string", "bool", "int", "float", "json", "json", "json", "int"]


@query("X5_json_kind", f"SELECT p_partkey AS id, {_case('p_partkey', _KINDS)} AS kind FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.variant_kind(F.try_parse_json(_pick(_JSON, "p_partkey"))).alias("kind"))


@query("X13_routing_cast", f"SELECT p_partkey AS id, {_case('p_partkey', [k if k in ('string', 'bool', 'int') else None for k in _KINDS])} AS kind, {_case('p_partkey', [None, None, None, 'unsupported float', 'unsupported null', 'unsupported composite', 'unsupported composite', None])} AS error FROM part")
def _(x: Fixtures) -> DataFrame:
    kind, error = X.routing_kind(F.try_parse_json(_pick(_JSON, "p_partkey")))
    return x.raw("part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), error.alias("error"))


@query("X29_render_envelope", f"SELECT p_partkey AS id, {_case('p_partkey', ['s', 'true', '5', '1.5', 'null', '[1]', '{\"a\":1}', '-7'])} AS text FROM part")
def _(x: Fixtures) -> DataFrame:
    v = F.try_parse_json(_pick(_JSON, "p_partkey"))
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.render_envelope(X.variant_kind(v), v).alias("text"))


@query("X7_local_date", "SELECT o_orderkey AS id, timezone('Asia/Kathmandu', timezone('UTC', o_orderdate + to_seconds(o_orderkey * 7919 % 86400)))::DATE::VARCHAR AS day FROM orders")
def _(x: Fixtures) -> DataFrame:
    at = F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("o_orderkey") * 7919 % 86400)
    return x.raw("orders").select(F.col("o_orderkey").alias("id"), X.local_date(at, "Asia/Kathmandu").cast("string").alias("day"))


@query("X8_year_envelope", "SELECT DISTINCT year(o_orderdate) AS y, (make_date(year(o_orderdate), 1, 1) - INTERVAL 1 DAY)::DATE::VARCHAR AS lo, (make_date(year(o_orderdate) + 1, 1, 1) + INTERVAL 1 DAY)::DATE::VARCHAR AS hi FROM orders")
def _(x: Fixtures) -> DataFrame:
    y = F.year("o_orderdate")
    day = lambda d, n: F.date_add(d, n).cast("string")
    return x.raw("orders").select(y.cast("long").alias("y"), day(F.make_date(y, F.lit(1), F.lit(1)), -1).alias("lo"), day(F.make_date(y + 1, F.lit(1), F.lit(1)), 1).alias("hi")).distinct()


_NAMES = ["daily-sync", "Daily", "", "a_b", "x" * 65, "ok9"]


@query("X9_slug_and_identifier", f"SELECT p_partkey AS id, regexp_full_match({_case('p_partkey', _NAMES)}, '[a-z0-9-]{{1,64}}') AS slug, regexp_full_match({_case('p_partkey', _NAMES)}, '[A-Za-z0-9_-]{{1,64}}') AS identifier FROM part")
def _(x: Fixtures) -> DataFrame:
    n = _pick(_NAMES, "p_partkey")
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.is_slug(n).alias("slug"), X.is_identifier(n).alias("identifier"))


_RAW = [*X.STATES, "Nonsense", None]


@query("X14_normalized_state", f"SELECT p_partkey AS id, {_case('p_partkey', [X.STATES.get(s, 'unknown') for s in _RAW])} AS state, {_case('p_partkey', [X.CLOCK.get(X.STATES.get(s, 'unknown')) for s in _RAW])} AS family FROM part")
def _(x: Fixtures) -> DataFrame:
    s = _pick(_RAW, "p_partkey")
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.normalize_state(s).alias("state"), X.clock_family(s).alias("family"))


@query("X19_key_name", "SELECT p_partkey AS id, regexp_replace(p_size || '/' || p_name || '/x', '^[^/]*/', '') AS name FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.key_name(F.concat_ws("/", F.col("p_size").cast("string"), "p_name", F.lit("x"))).alias("name"))


@query("X21_tag_guard", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'system/a,system/b' WHEN p_size % 3 = 1 THEN 'system/b' ELSE '' END AS rejected FROM part")
def _(x: Fixtures) -> DataFrame:
    s = F.col("p_size") % 3
    tags = F.map_from_arrays(F.array(F.lit("system/b"), F.lit("team"), F.when(s == 0, "system/a").otherwise("own/x")), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    bad = F.array_sort(F.filter(F.map_keys(tags), lambda k: k.startswith("system/")))
    return x.raw("part").select(F.col("p_partkey").alias("id"), F.when(s == 2, "").otherwise(F.array_join(bad, ",")).alias("rejected"))


@query("X22_comparison_symbol", f"SELECT p_partkey AS id, {_case('p_partkey', ['==', '!=', '<', '<=', '>', '>=', None])} AS symbol FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.comparison_symbol(_pick([*X.SYMBOLS, "Like"], "p_partkey")).alias("symbol"))


@query("X26_sanitized_segment", "SELECT p_partkey AS id, regexp_replace(p_name || ' é/' || p_type, '[^A-Za-z0-9_=.\\-]', '_', 'g') AS segment FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.sanitize_segment(F.concat("p_name", F.lit(" é/"), "p_type")).alias("segment"))


@query("X28_namespace_default", f"SELECT p_partkey AS id, {_case('p_partkey', ['default', 'default', 'ns', 'ns'])} AS namespace FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.namespace_or_default(_pick([None, "  ", "ns", " ns "], "p_partkey")).alias("namespace"))


@query("X30_task_type", f"SELECT p_partkey AS id, {_case('p_partkey', ['SensorTask', 'ShadowTask', 'RegularTask', 'RegularTask', 'RegularTask'])} AS task_type FROM part")
def _(x: Fixtures) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), X.task_type(_pick(["SensorTask", "ShadowTask", "RegularTask", "sensortask", None], "p_partkey")).alias("task_type"))


@query("P5_trigger", f"SELECT p_partkey AS id, {_case('p_partkey', ['cron 0 * * * *', 'fire now', 'waits on go'])} AS trigger FROM part")
def _(x: Fixtures) -> DataFrame:
    t = _pick(["cron", "now", "signal"], "p_partkey")
    return x.raw("part").select(F.col("p_partkey").alias("id"), F.when(t == "cron", "cron 0 * * * *").when(t == "now", "fire now").otherwise("waits on go").alias("trigger"))


@query("P16_patch_label", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'insert \"' || p_name || '\"' ELSE (p_size % 5 + 1) || ' op(s)' END AS label FROM part")
def _(x: Fixtures) -> DataFrame:
    s = F.col("p_size")
    fill = F.transform(F.sequence(F.lit(1), s % 5 + 1), lambda i: F.struct(F.lit("RemoveEdge").alias("op"), F.lit("").alias("task")))
    ops = F.when(s % 2 == 0, F.concat(fill, F.array(F.struct(F.lit("AddNode").alias("op"), F.col("p_name").alias("task"))))).otherwise(fill)
    first = F.get(F.filter(ops, lambda o: o["op"] == "AddNode"), F.lit(0))
    return x.raw("part").select(F.col("p_partkey").alias("id"), F.when(first.isNotNull(), F.concat(F.lit('insert "'), first["task"], F.lit('"'))).otherwise(F.concat(F.size(ops).cast("string"), F.lit(" op(s)"))).alias("label"))
