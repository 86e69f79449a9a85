"""Keyed state over streams: idempotency, one-shot gates, log frontiers, liveness.

Each function takes a streaming (or batch) DataFrame and keeps per-key state in the state
store, so a restart continues from the checkpoint. Rows of one key in a micro-batch are
taken in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _rows(parts: Iterable[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(order, kind="stable")


def idempotency(requests: DataFrame, ttl: int, buckets: int = 1024) -> DataFrame:
    """(key, seq, outcome, original): Fresh, Dedup or Conflict; a key is held ttl seconds from the request that took it.

    Keys are dealt over buckets and a bucket has one state for all of its keys: a call and a
    state for each key cost far more than its rows.
    """
    known = F.col("key").isNotNull()
    dealt = requests.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), F.when(known, F.col("key")).otherwise(0).alias("key"), known.alias("known"), "seq", "at", "hash")

    def step(_: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {}
        if state.exists:
            keys, *rest = state.get
            held = dict(zip(keys, zip(*rest)))
        out = []
        r = _rows(parts, ["seq"])
        for key, known, seq, at, digest in zip(*(r[c].tolist() for c in ["key", "known", "seq", "at", "hash"])):
            key, digest = key if known else None, str(digest)
            first = held.get(key)
            if first is None or at >= first[1] + ttl:
                held[key] = (seq, at, digest)
                out.append((key, seq, "Fresh", seq))
            else:
                out.append((key, seq, "Dedup" if digest == first[2] else "Conflict", first[0]))
        state.update((list(held), *map(list, zip(*held.values()))))
        yield pd.DataFrame(out, columns=["key", "seq", "outcome", "original"], dtype=object)

    return dealt.groupBy("bucket").applyInPandasWithState(step, "key long, seq long, outcome string, original long", "keys array<long>, seqs array<long>, ats array<long>, hashes array<string>", "append", GroupStateTimeout.NoTimeout)


def one_shot_gates(events: DataFrame, shards: int = 8) -> DataFrame:
    """(gate_id, signal_id): each gate with the first signal of its name after it was registered.

    events: name, seq, gate_id (a registration) or signal_id (a wakeup). Gates of one name are
    dealt over shards and signals go to all of them, so a frequent name is shared out. A task
    keeps 17 bytes a row of a name's micro-batch. A wakeup that meets no waiting gate is
    dropped; registering again replaces.
    """
    gate = F.col("gate_id").isNotNull()
    shard = F.when(gate, F.array(F.pmod(F.xxhash64("gate_id"), F.lit(shards)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))
    dealt = events.select("name", F.explode(shard).alias("shard"), "seq", F.coalesce("gate_id", "signal_id").alias("id"), gate.alias("gate"))

    def step(_: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [(p["seq"].to_numpy(np.int64, copy=True), p["id"].to_numpy(np.int64, copy=True), p["gate"].to_numpy(bool, copy=True)) for p in parts]
        seq, ids, gate = (np.concatenate(c) for c in zip(*columns))
        del columns
        times, signals = seq[~gate], ids[~gate]
        order = np.argsort(times, kind="stable")
        times, signals = times[order], signals[order]
        held = np.array(state.get[0] if state.exists else [], np.int64)
        # the place of the first signal not before the registration; gates that waited already take the first of all
        gates = np.concatenate([held, ids[gate]])
        at = np.concatenate([np.zeros(len(held), np.int64), np.searchsorted(times, seq[gate])])
        fired = at < len(times)
        hits = np.unique(np.stack([at[fired], gates[fired]]), axis=1)
        state.update((np.unique(gates[~fired]).tolist(),))
        yield pd.DataFrame({"gate_id": hits[1], "signal_id": signals[hits[0]]})

    return dealt.groupBy("name", "shard").applyInPandasWithState(step, "gate_id long, signal_id long", "waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def log_frontiers(records: DataFrame) -> DataFrame:
    """(stream, frontier) after each micro-batch that moved it; records: stream, first, last (a record, or a declared gap)."""

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        front, los, his = state.get if state.exists else (-1, [], [])
        was = front
        spans = sorted({*zip(los, his), *((int(r.first), int(r.last)) for p in parts for r in p.itertuples())})
        rest = []
        for lo, hi in spans:
            if lo <= front + 1:
                front = max(front, hi)
            else:
                rest.append((lo, hi))
        state.update((front, [a for a, _ in rest], [b for _, b in rest]))
        yield pd.DataFrame([(key[0], front)] if front > was else [], columns=["stream", "frontier"])

    return records.groupBy("stream").applyInPandasWithState(step, "stream long, frontier long", "front long, los array<long>, his array<long>", "append", GroupStateTimeout.NoTimeout)


def liveness(beats: DataFrame, ttl: int, lateness: str = "0 seconds") -> DataFrame:
    """(key, status, at): Healthy on a key's first beat and after a silence, Unhealthy when event time passes ttl seconds without one.

    beats: key, ts. Event-time timers: late beats do not revive a key that has moved on.
    """

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last, _) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "Unhealthy", last + ttl)], columns=["key", "status", "at"])
            return
        times = sorted(int(t.timestamp()) for p in parts for t in p.ts)
        last, known = state.get if state.exists else (times[0], False)
        out = [] if known else [(key[0], "Healthy", times[0])]
        for t in times:
            if t - last > ttl:
                out += [(key[0], "Unhealthy", last + ttl), (key[0], "Healthy", t)]
            last = max(last, t)
        state.update((last, True))
        state.setTimeoutTimestamp(max((last + ttl) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "status", "at"])

    return beats.withWatermark("ts", lateness).groupBy("key").applyInPandasWithState(step, f"key {dict(beats.dtypes)['key']}, status string, at long", "last long, known boolean", "append", GroupStateTimeout.EventTimeTimeout)
