"""Toxicity by a factorization machine over hashed terms.

Terms are letters-and-digits tokens, lowered, and their first 4 to 6 bytes, so that
inflected forms share terms; they are hashed into 2^20 buckets. Training takes a bounded
sample of labelled rows and keeps the buckets that go with the label, and those that go with
or against it among the texts that hold one of the first: so a term that means nothing by
itself, but makes another worse or harmless, takes part. Weights are fitted first, then
pairwise factors with them, for as long as that helps on training rows set aside. Scoring
is one pass over all texts, whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import materialize, tidy

BITS = 20
PREFIXES = (4, 5, 6)
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def _terms(t: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every term occurrence."""
    s, e, d = t.spans(_TERM[t.buf])
    parts = [t.hashes(s, e, fold=True)]
    docs = [d]
    for n in PREFIXES:
        at = np.flatnonzero(e - s >= n)
        parts.append(textops.mix(t.hashes(s[at], s[at] + n, fold=True) + np.uint64(n)))
        docs.append(d[at])
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def _bags(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in textops.slices(batch, text):
                t = textops.Texts(part.column(2))
                bucket, doc = _terms(t)
                pair = np.unique((doc << BITS) + bucket)
                cut = np.searchsorted(pair >> BITS, np.arange(t.n + 1))
                low = (pair & ((1 << BITS) - 1)).astype("<i4")
                blobs = [low[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary())], [key, "y", "terms"])

    return docs.select(F.col(key).cast("long").alias(key), F.col("y").cast("int").alias("y"), F.col(text).alias(text)).mapInArrow(tidy(run), f"`{key}` long, y int, terms binary")


@dataclass
class Machine:
    """Kept buckets (sorted), bias, weights and factors."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, bucket: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Of n texts, from occurrences (bucket, text); a bucket counts once a text."""
        at = np.searchsorted(self.buckets, bucket)
        at[at == len(self.buckets)] = 0
        hit = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), bool)
        pair = np.unique(doc[hit] * max(1, len(self.buckets)) + at[hit])
        d, f = pair // max(1, len(self.buckets)), pair % max(1, len(self.buckets))
        return self.bias + _second_order(self.weights, self.factors, d, f, n)[0]


def _second_order(w: np.ndarray, v: np.ndarray, d: np.ndarray, f: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    sums = np.stack([np.bincount(d, weights=v[f, k], minlength=n) for k in range(v.shape[1])], 1) if v[f].size else np.zeros((n, v.shape[1]))
    squares = np.bincount(d, weights=(v[f] ** 2).sum(1), minlength=n)
    return np.bincount(d, weights=w[f], minlength=n) + 0.5 * ((sums**2).sum(1) - squares), sums


def choose_buckets(bags: DataFrame, keep: int, least: int, z: float, beside: int) -> np.ndarray:
    """Sorted: buckets in at least `least` texts whose log odds differ from 0 by `z` deviations.

    Up to `keep` are those that go most with the label, up to `beside` more those that go
    most with or against it among the texts that hold one of them.
    """

    def tally(within: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = [np.frombuffer(x, "<i4") for x in b.column(2).to_pylist()]
                y = b.column(1).to_numpy(zero_copy_only=False) > 0
                if within is not None:
                    use = [bool(np.isin(within, x, assume_unique=True).any()) for x in parts]
                    parts, y = [x for x, u in zip(parts, use) if u], y[use]
                at = np.repeat(y, [len(x) for x in parts])
                # a row for all texts, below the buckets
                term = np.concatenate([np.full(len(y), -1), *parts])
                at = np.concatenate([y, at])
                name, place = np.unique(term, return_inverse=True)
                pos = np.bincount(place[at], minlength=len(name))
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(pos, pa.int64()), pa.array(np.bincount(place, minlength=len(name)) - pos, pa.int64())], ["bucket", "a", "b"])

        return run

    def best(within: np.ndarray | None, most: int) -> list[int]:
        counts = bags.mapInArrow(tally(within), "bucket int, a long, b long").groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        whole = counts.where("bucket = -1").select(F.col("a").alias("pos"), F.col("b").alias("neg"))
        a, b = F.col("a") + 0.5, F.col("b") + 0.5
        odds = F.log(a / (F.col("pos") + 1.0 - a)) - F.log(b / (F.col("neg") + 1.0 - b))
        found = counts.where((F.col("bucket") >= 0) & (F.col("a") + F.col("b") >= least)).join(F.broadcast(whole))  # one row
        found = found.withColumn("score", odds / F.sqrt(1 / a + 1 / b))
        if within is not None:
            found = found.withColumn("score", F.abs("score")).where(~F.col("bucket").isin(within.tolist()))
        return [r[0] for r in found.where(F.col("score") >= z).orderBy(F.desc("score"), "bucket").limit(most).select("bucket").collect()]

    first = best(None, keep)
    second = best(np.sort(np.array(first, "<i4")), beside) if first else []
    return np.sort(np.array(first + second, np.int64))


def fit_machine(buckets: np.ndarray, bags: list[np.ndarray], y: np.ndarray, factors: int = 4, rounds: int = 200, pairs: int = 200, each_round: Callable[[int, Machine], None] | None = None) -> Machine:
    """Full-batch Adam on the log loss with small weight decay: `rounds` of weights, then `pairs` more with factors.

    bags: places in `buckets` of each text's terms. each_round is called with the number of
    rounds with factors done and the machine, every 50 of them.
    """
    n, pos = len(y), y > 0
    bias = float(np.log((pos.sum() + 0.5) / (n - pos.sum() + 0.5)))
    d, f = np.repeat(np.arange(n), [len(b) for b in bags]), np.concatenate([np.zeros(0, np.int64), *bags]).astype(np.int64)
    if not len(f) or not pos.any() or pos.all():
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    # sums by text and by bucket are runs of the entries and of the entries sorted by bucket
    texts, by_bucket = textops.runs(d), np.argsort(f, kind="stable")
    d2, f2 = d[by_bucket], f[by_bucket]
    terms = textops.runs(f2)
    rows, cols = d[texts], f2[terms]
    rng = np.random.RandomState(0)
    w, v = np.zeros(len(buckets)), rng.normal(0, 0.01, (factors, len(buckets)))
    state = [np.zeros_like(x) for x in (w, v, w, v)] + [0.0, 0.0]
    sums = np.zeros((factors, n))
    for i in range(1, rounds + pairs + 1):
        done = i - rounds - 1
        if each_round and done >= 0 and done % 50 == 0:
            each_round(done, Machine(buckets, float(bias), w, v.T))
        raw = np.full(n, bias)
        if done >= 0:
            for k in range(factors):
                sums[k, rows] = np.add.reduceat(v[k][f], texts)
            raw += 0.5 * (sums**2).sum(0)
        raw[rows] += np.add.reduceat((w - 0.5 * (v**2).sum(0) if done >= 0 else w)[f], texts)
        err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - pos) / n
        each = err[d2]
        whole = np.add.reduceat(each, terms)
        gw, gv = 1e-5 * w, 1e-5 * v
        gw[cols] += whole
        if done >= 0:
            for k in range(factors):
                gv[k, cols] += np.add.reduceat(each * sums[k][d2], terms) - v[k, cols] * whole
        gb = err.sum()
        for j, g, at, rate in ((0, gw, i, 0.1), (1, gv, done + 1, 0.02)):
            if at > 0:
                state[j] = 0.9 * state[j] + 0.1 * g
                state[j + 2] = 0.999 * state[j + 2] + 0.001 * g * g
                change = rate * np.sqrt(1 - 0.999**at) / (1 - 0.9**at) * state[j] / (np.sqrt(state[j + 2]) + 1e-8)
                w, v = (w - change, v) if j == 0 else (w, v - change)
        state[4], state[5] = 0.9 * state[4] + 0.1 * gb, 0.999 * state[5] + 0.001 * gb * gb
        bias -= 0.1 * np.sqrt(1 - 0.999**i) / (1 - 0.9**i) * state[4] / (np.sqrt(state[5]) + 1e-8)
    if each_round:
        each_round(pairs, Machine(buckets, float(bias), w, v.T))
    return Machine(buckets, float(bias), w, np.ascontiguousarray(v.T))


def _loss(m: Machine, bags: list[np.ndarray], y: np.ndarray) -> float:
    d, f = np.repeat(np.arange(len(y)), [len(b) for b in bags]), np.concatenate([np.zeros(0, np.int64), *bags]).astype(np.int64)
    raw = m.bias + (_second_order(m.weights, m.factors, d, f, len(y))[0] if len(m.weights) else 0)
    return float(np.logaddexp(0, np.where(y > 0, -1, 1) * np.clip(raw, -30, 30) * np.ones(len(y))).mean())


def fit_validated(buckets: np.ndarray, bags: list[np.ndarray], y: np.ndarray, aside: np.ndarray, factors: int = 4) -> Machine:
    """The machine fitted to all rows with as many rounds with factors as do best on the rows `aside`, fitted to the others."""
    losses: dict[int, float] = {0: 0.0}
    if aside.any() and not aside.all():
        rest = [b for b, u in zip(bags, aside) if u]
        watch = lambda done, m: losses.__setitem__(done, _loss(m, rest, y[aside]))
        fit_machine(buckets, [b for b, u in zip(bags, aside) if not u], y[~aside], factors, each_round=watch)
    return fit_machine(buckets, bags, y, factors, pairs=min(losses, key=losses.get))


def train_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 20_000, held_out: int | None = 2, keep: int = 2048, least: int = 3, z: float = 3.0, beside: int = 256) -> Machine:
    """Fit on at most `most` labelled rows, those of least hash of their key, and at most `keep` + `beside` buckets.

    Rows whose crc32(key as text) mod 4 is `held_out` take no part (None: all may); those
    of the next remainder are set aside to choose by, then used like the others.
    Null keys, labels and texts take no part. The driver sees the kept buckets of those
    rows only; the list of drawn keys, bounded by `most`, is broadcast, so that texts stay put.
    """
    crc = F.crc32(F.col(key).cast("string"))
    use = labels.select(F.col(key), F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col(key).isNotNull())
    if held_out is not None:
        use = use.where(crc % 4 != held_out)
    use = use.groupBy(key).agg(F.max("y").alias("y")).orderBy(F.xxhash64(key), key).limit(most)
    bags = materialize(_bags(docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(use), key), key, text), "bags")
    buckets = choose_buckets(bags, keep, least, z, beside)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [np.flatnonzero(np.isin(buckets, np.frombuffer(x, "<i4"), assume_unique=True)).astype("<i4").tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], [key, "y", "terms"])

    rows = sorted((tuple(r) for r in bags.mapInArrow(tidy(kept), bags.schema).collect()), key=lambda r: (r[0], r[1], r[2]))
    aside = np.array([zlib.crc32(str(r[0]).encode()) % 4 == ((held_out or 0) + 1) % 4 for r in rows], bool)
    return fit_validated(buckets, [np.frombuffer(r[2], "<i4") for r in rows], np.array([r[1] for r in rows], np.int64), aside)


def score_toxicity(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the probability of the label; every row, null and empty texts get the bias alone."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != name) + f", {name} double"
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in textops.slices(batch, text):
                t = textops.Texts(part.column(part.schema.get_field_index(text)))
                raw = machine.logits(*_terms(t), t.n)
                p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, name])

    return docs.select(*kept).mapInArrow(tidy(run), schema)
