"""Near-duplicate vectors by product quantisation.

Coarse inverted lists, subspace codes of the residuals, asymmetric table-lookup
distances over the lists nearest to each vector, exact cosine for what passes. A
stored code's own error widens the lookup test, so within a probed list no pair at
the threshold is passed over. Lists are in proportion to the vectors: beyond what one
set of centroids can name, a list is a sum of centroids, one of each of several levels,
each level fitted to what the ones before leave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_spread, materialize, release, tidy

BLOCK = 4096
PER_LIST = 64  # classes of vectors to a list, on average
PER_LEVEL = 1024  # centroids of one level at most, as many as a sample of 16 times that can place


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.RandomState(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * part @ c.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c**2).sum(1) - 2 * p @ c.T).argmin(1) for p in np.array_split(x, max(1, len(x) // 4096))])


@dataclass
class Quantizer:
    """Centroids of each level, and for each subspace the code words of residuals. A list's number has its centroids as digits."""

    levels: list[np.ndarray]
    words: list[np.ndarray]
    cuts: list[tuple[int, int]]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int = 16, codes: int = 256, most: int = PER_LEVEL) -> Quantizer:
        depth = 1
        while most**depth < lists:
            depth += 1
        rest, levels = x, []
        for i in range(depth):
            levels.append(_kmeans(rest, max(1, min(round(lists ** (1 / depth)), len(x))), 8, 1 + 100 * i))
            rest = rest - levels[-1][_nearest(rest, levels[-1])]
        edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return cls(levels, [_kmeans(rest[:, a:b], min(codes, len(x)), 5, 2 + i) for i, (a, b) in enumerate(cuts)], cuts)

    def center(self, lists: np.ndarray) -> np.ndarray:
        out = 0
        for c in reversed(self.levels):
            out = out + c[lists % len(c)]
            lists = lists // len(c)
        return out

    def probe(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first; from level to level the n nearest sums are kept."""
        out = []
        for part in np.array_split(x, max(1, len(x) // 256)) if len(self.levels) > 1 else [x]:
            name, left = np.zeros((len(part), 1), np.int64), part[:, None, :]
            for c in self.levels:
                d = (left**2).sum(2)[:, :, None] + (c**2).sum(1) - 2 * left @ c.T
                k = min(n, d.shape[1] * d.shape[2])
                d = d.reshape(len(part), -1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
                left = np.take_along_axis(left, (near // len(c))[:, :, None], 1) - c[near % len(c)]
                name = np.take_along_axis(name, near // len(c), 1) * len(c) + near % len(c)
            out.append(name)
        return np.concatenate(out)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what the codes miss)."""
        codes, miss = np.zeros((len(rest), len(self.cuts)), np.uint8), np.zeros(len(rest))
        for i, ((a, b), w) in enumerate(zip(self.cuts, self.words)):
            d = (w**2).sum(1) - 2 * rest[:, a:b] @ w.T
            codes[:, i] = d.argmin(1)
            miss += ((rest[:, a:b] - w[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(miss)

    def lookup(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of uncoded residuals to coded ones, by table."""
        out = np.zeros((len(rest), len(codes)), np.float32)
        for i, ((a, b), w) in enumerate(zip(self.cuts, self.words)):
            part = rest[:, a:b]
            table = ((part**2).sum(1)[:, None] + (w**2).sum(1) - 2 * part @ w.T).astype(np.float32)
            out += table[:, codes[:, i]]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(col: pa.Array, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(usable, matrix of the usable ones)."""
    n = len(col)
    if not n:
        return np.zeros(0, bool), np.zeros((0, dim), kind)
    lens = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    fit = lens == dim
    flat = col.filter(pa.array(fit)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim) if dim else np.zeros((int(fit.sum()), 0), kind)
    good = np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0) > 0)
    ok = fit.copy()
    ok[fit] = good
    return ok, x[good] + kind(0)


def _labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index connected to each of n, over pairs of indexes."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            low = np.minimum(ra, rb)
            if (ra == rb).all():
                break
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while not (root[root] == root).all():
                root = root[root]
    return root


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, probes: int = 16, sample: int = 16_384, lists: int | None = None, per_level: int = PER_LEVEL) -> DataFrame:
    """(key, n_links, component_id, kept), one row an input row.

    Links: other vectors found with cosine >= threshold in double precision.
    component_id: the smallest key reachable over links; kept: key = component_id.
    Null, zero and non-finite vectors, vectors not of the usual dimension (the
    commonest, then the smallest) and rows without a key link with nothing.

    Elements are read as they are if they are floats, else as doubles. Repeated rows count
    as vectors of their own; other columns are not read; an empty table gives no rows.

    Equal vectors become one class with a count. Centroids and code words are fitted on
    `sample` classes of least hash; every class is coded into its nearest list and sought
    in the `probes` nearest. There is a list to about PER_LIST classes, named by levels of
    at most `per_level` centroids, so what a vector is compared with does not grow with the
    table, but for vectors that really are close. A list of many vectors is cut into
    blocks, and a task compares one block of seekers with one of stored vectors: it returns
    counts and a spanning forest of its links, never the pairs. A pair found from either
    side counts on both sides once.
    """
    spark = vectors.sparkSession
    dims = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 0
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = _rows(b.column(1), dim, kind)
            keys = b.column(0)
            ok &= keys.is_valid().to_numpy(zero_copy_only=False)
            _, x = (ok, x) if ok.sum() == len(x) else _rows(b.column(1).filter(pa.array(ok)), dim, kind)
            blobs: list = [None] * len(ok)
            for i, v in zip(np.flatnonzero(ok).tolist(), x):
                blobs[i] = v.tobytes()
            sig = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in blobs]
            yield pa.RecordBatch.from_arrays([keys, pa.array(sig, pa.binary()), pa.array(blobs, pa.binary())], ["id", "sig", "vec"])

    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    base = materialize(base.mapInArrow(tidy(read), "id long, sig binary, vec binary"), "vectors")
    classes = base.where("sig is not null").groupBy("sig").agg(F.min("id").alias("cid"), F.count("*").alias("m"), F.min("vec").alias("vec"))
    n = classes.count()
    drawn = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("vec").collect()
    if not drawn:
        return base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    raw = lambda blobs: np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), dim).astype(np.float64)
    x = _unit(raw([r[0] for r in drawn])).astype(np.float32)
    quant = Quantizer.fit(x, lists or max(1, round(n / PER_LIST)), most=per_level)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                b = batch.slice(start, 4096)
                u = _unit(raw(b.column(2).to_pylist())).astype(np.float32)
                near = quant.probe(u, probes)
                codes, miss = quant.encode(u - quant.center(near[:, 0]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(near[:, 0]), pa.array([r.tobytes() for r in near], pa.binary()), pa.array(near.tolist(), pa.list_(pa.int64())), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(miss)],
                    ["cid", "m", "vec", "own", "near", "lists", "codes", "miss"])

    schema = "cid long, m long, vec binary, own long, near binary, lists array<long>, codes binary, miss double"
    coded = materialize(classes.select("cid", "m", "vec").mapInArrow(tidy(code), schema), "codes")
    stored = coded.groupBy("own").agg(F.count("*").alias("s")).withColumnRenamed("own", "list")
    sought = coded.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("q"))
    blocks = stored.join(sought, "list").select("list", "s", "q", F.ceil(F.col("s") / BLOCK).cast("int").alias("nd"), F.ceil(F.col("q") / BLOCK).cast("int").alias("nq"))
    blocks = materialize(blocks, "blocks")
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    cols = ["cid", "m", "vec", "own", "near", "codes", "miss"]
    d = join_spread(coded.withColumn("list", F.col("own")), blocks, "list", "s", n, "cid").select("list", F.explode(F.expr("sequence(0, nq - 1)")).alias("qb"), deal("nd").alias("db"), F.lit(True).alias("is_stored"), *cols)
    q = join_spread(coded.withColumn("list", F.explode("lists")), blocks, "list", "q", n * probes, "cid").select("list", deal("nq").alias("qb"), F.explode(F.expr("sequence(0, nd - 1)")).alias("db"), F.lit(False).alias("is_stored"), *[c if c not in ("codes", "miss") else F.lit(None).cast("binary" if c == "codes" else "double").alias(c) for c in cols])
    reach = np.sqrt(2 - 2 * threshold)

    def match(g: pd.DataFrame) -> pd.DataFrame:
        ds, qs = g[g.is_stored], g[~g.is_stored]
        none = pd.DataFrame({"kind": np.zeros(0, np.int32), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(ds) or not len(qs):
            return none
        c = quant.center(np.int64(g.list.iloc[0]))
        du, qu = _unit(raw(ds.vec.tolist())), _unit(raw(qs.vec.tolist()))
        codes = np.frombuffer(b"".join(ds.codes), np.uint8).reshape(len(ds), -1)
        limit = ((reach + ds.miss.to_numpy() + 1e-4) ** 2).astype(np.float32)
        dnear = np.frombuffer(b"".join(ds.near), np.int64).reshape(len(ds), -1)
        did, qid, dm, qm, qown = ds.cid.to_numpy(), qs.cid.to_numpy(), ds.m.to_numpy(), qs.m.to_numpy(), qs.own.to_numpy()
        ids, where = np.unique(np.concatenate([did, qid]), return_inverse=True)
        dat, qat = where[: len(did)], where[len(did) :]
        links = np.zeros(len(ids), np.int64)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for lo in range(0, len(qid), 256):
                qpart = qu[lo : lo + 256]
                near = quant.lookup((qpart - c).astype(np.float32), codes) <= limit
                near &= qid[lo : lo + 256, None] != did
                i, j = np.nonzero(near)
                if len(i) > near.size // 16:
                    i, j = np.nonzero(near & (qpart @ du.T >= threshold))
                else:
                    keep = np.concatenate([np.einsum("ij,ij->i", qpart[i[k : k + 65536]], du[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= threshold
                    i, j = i[keep], j[keep]
                if len(i):
                    i = i + lo
                    np.add.at(links, qat[i], dm[j])
                    alone = ~(dnear[j] == qown[i][:, None]).any(1)
                    np.add.at(links, dat[j[alone]], qm[i[alone]])
                    yield qat[i], dat[j]

        root = _labels(len(ids), found())
        if len(g) > BLOCK:
            release()
        has, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({
            "kind": np.repeat(np.array([0, 1], np.int32), [len(has), len(joined)]),
            "a": np.concatenate([ids[has], ids[joined]]), "b": np.concatenate([links[has], ids[root[joined]]])})

    out = materialize(d.unionByName(q).groupBy("list", "qb", "db").applyInPandas(match, "kind int, a long, b long"), "matches")
    counts = out.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("n"))
    comps = components(out.where("kind = 1").select("a", "b")).withColumnRenamed("id", "cid")
    known = classes.select("sig", "cid", "m").join(counts, "cid", "left").join(comps, "cid", "left")
    known = known.select("sig", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "cid").alias("component_id"))
    known = materialize(known, "known")
    res = join_spread(base.where("sig is not null").select("id", "sig"), known, "sig", "m", base.count(), "id").select("id", "n_links", "component_id")
    res = res.unionByName(base.where("sig is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return res.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
