"""Exact Jaccard join on word shingles by token-combination prefixes.

Shingles are ordered rare first by their exact document counts. Two sets as similar as
asked share at least two shingles among the first |s| - ceil(t|s|) + 2 of each (sets of
one shingle match only their equals). Either one of those is rare, and is indexed alone, or all
are frequent, and pairs of their classes are indexed. Frequent shingles with the same
smallest document form one class, as those of one passage mostly do; a class pairs with
itself where a document has two of its shingles. Rare shingles with the same documents
are indexed once.

Only connection is asked for, so candidates are first tried against one earlier document
each. What is not connected then is compared in blocks: a task takes two blocks of
documents with an index key in common and sizes that may match, drops by bitmaps the pairs
that cannot reach the similarity, tests the rest as far as they are not connected yet and
returns the links that connect them, so pairs are never rows of a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import components, join_spread, materialize, release, tidy

RARE = 512  # in up to so many texts a shingle is indexed alone; the result is the same at any value
BLOCK = 256
BITS = 4096
SIG = 16
HALF = np.uint64(1 << 63)
SLICE = 2_000_000


def _sigs(h: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """Fingerprint of each set; None for an empty one."""
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=SIG).digest() if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def shingle_info(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, sig): size and fingerprint of each text's shingle set; sig is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in textops.slices(batch, text):
                h, off = textops.shingle_sets(textops.Texts(part.column(1)), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(_sigs(h, off), pa.binary())], ["id", "n", "sig"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias(text)).mapInArrow(tidy(run), "id long, n long, sig binary")


def shingle_blobs(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, sig, set): fingerprint and sorted distinct 64-bit shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in textops.slices(batch, text):
                h, off = textops.shingle_sets(textops.Texts(part.column(1)), width)
                blobs = [h[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sigs(h, off), pa.binary()), pa.array(blobs, pa.binary())], ["id", "sig", "set"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias(text)).mapInArrow(tidy(run), "id long, sig binary, set binary")


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n + (-percent * n // 100) + 2)


def _short(count: np.ndarray) -> np.ndarray:
    """Counts in 16 bits, in the same order: exact up to 2^15, beyond that in steps of a thousandth of a doubling."""
    return np.where(count < 32768, count, 32768 + 1000 * (np.log2(np.maximum(count, 32768)) - 15)).astype("<u2")


_NONE = b""
_POST = "bucket int, batch long, parts int, toks binary, at binary, hot binary, n binary, ids binary, sigs binary, sizes binary"


def prefix_postings(docs: DataFrame, key: str, text: str, width: int, percent: int, buckets: int) -> DataFrame:
    """(id, sig, n, toks): the prefix shingles of every text that occur in two texts or more; texts without any are left out.

    The order is: hashes below 2^63 by document count, then the others by hash; of the
    latter only as many as the prefix still needs are looked at. A task deals its
    shingles out by hash, as arrays; each bucket counts documents and answers with the
    counts over one; each batch of texts then cuts its prefixes. Shingles in many texts
    of a batch are sent once with their number, so a very frequent one is summed
    before the shuffle. A batch sends one row to each bucket it has shingles for, so rows
    are never more than shingles, however many buckets there are.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in textops.slices(batch, text, SLICE):
                h, off = textops.shingle_sets(textops.Texts(part.column(1)), width)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                n, sigs = np.diff(off), b"".join(x or bytes(SIG) for x in _sigs(h, off))
                doc = np.repeat(np.arange(len(n)), n)
                low = np.bincount(doc[h < HALF], minlength=len(n))
                used = np.where(n > 1, np.maximum(low, _prefix(n, percent)), 0)
                keep = np.arange(len(h)) - off[doc] < used[doc]
                h, doc = h[keep], doc[keep]
                bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                tok = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
                code = (bucket << 32) + tok
                order = np.argsort(code, kind="stable")
                code, doc = code[order], doc[order]
                first = textops.runs(code)
                count = np.diff(np.concatenate([first, [len(code)]]))
                many = np.repeat(count > 8, count)
                name = int.from_bytes(hashlib.blake2b(ids.tobytes() + sigs + n.tobytes() + h.tobytes(), digest_size=8).digest(), "little", signed=True)
                hot, hot_n = code[first[count > 8]], count[count > 8].astype("<u4")
                one, one_doc = code[~many], doc[~many].astype("<u2")
                used_buckets = np.unique(code[first] >> 32)
                bounds = lambda x: zip(*(np.searchsorted(x >> 32, used_buckets, side).tolist() for side in ("left", "right")))
                edges, hot_edges = list(bounds(one)), list(bounds(hot))
                one, hot = one.astype("<u4"), hot.astype("<u4")
                rows = [
                    (b, name, 0, one[lo:hi].tobytes(), one_doc[lo:hi].tobytes(), hot[x:y].tobytes(), hot_n[x:y].tobytes(), _NONE, _NONE, _NONE)
                    for b, (lo, hi), (x, y) in zip(used_buckets.tolist(), edges, hot_edges)
                ]
                sizes = np.stack([n, low, used], 1).astype("<i8").tobytes()
                rows.append((-1 - name % buckets, name, len(rows), code[many].astype("<i8").tobytes(), doc[many].astype("<u2").tobytes(), _NONE, _NONE, ids.tobytes(), sigs, sizes))
                types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
                names = [f.split()[0] for f in _POST.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def count(g: pd.DataFrame) -> pd.DataFrame:
        if g.bucket.iloc[0] < 0:
            return g
        toks = [np.frombuffer(x, "<u4") for x in g.toks]
        hots, nums = [np.frombuffer(x, "<u4") for x in g.hot], [np.frombuffer(x, "<u4").astype(np.int64) for x in g.n]
        every = np.concatenate([*toks, *hots])
        weight = np.concatenate([np.ones(sum(map(len, toks)), np.int64), *nums])
        order = np.argsort(every, kind="stable")
        s = every[order]
        first = textops.runs(s)
        total = np.add.reduceat(weight[order], first) if len(s) else weight
        df = np.zeros(len(every), np.int64)
        df[order] = np.repeat(total, np.diff(np.concatenate([first, [len(s)]])))
        df = _short(df)
        cut = np.split(df, np.cumsum([len(x) for x in (*toks, *hots)])[:-1])
        k = len(toks)
        two = [cut[i] > 1 for i in range(k)]
        out = g[["bucket", "batch", "parts"]].copy()
        out["toks"] = [toks[i][two[i]].tobytes() for i in range(k)]
        out["at"] = [np.frombuffer(x, "<u2")[two[i]].tobytes() for i, x in enumerate(g["at"])]
        out["hot"] = g.hot
        # counts of the single entries, then of the summed ones
        out["n"] = [cut[i][two[i]].tobytes() + cut[k + i].tobytes() for i in range(k)]
        release()
        return out.assign(ids=_NONE, sigs=_NONE, sizes=_NONE)

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        answers, own = g[g.bucket >= 0].drop_duplicates("bucket"), g[g.bucket < 0]
        if not len(own) or len(answers) < own.parts.max():
            raise RuntimeError("a batch of texts was dealt out anew while it was counted; run the join on a table")
        # batches of equal content share a name and have equal answers
        m = own.iloc[0]
        sizes, ids = np.frombuffer(m.sizes, "<i8").reshape(-1, 3), np.frombuffer(m.ids, "<i8")
        n, low, used = sizes.T
        tok, doc, df, hot, hot_df = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in answers.itertuples():
            base, one, counts = np.int64(r.bucket) << 32, np.frombuffer(r.toks, "<u4").astype(np.int64), np.frombuffer(r.n, "<u2").astype(np.int64)
            tok.append(one + base), doc.append(np.frombuffer(r.at, "<u2").astype(np.int64)), df.append(counts[: len(one)])
            hot.append(np.frombuffer(r.hot, "<u4").astype(np.int64) + base), hot_df.append(counts[len(one) :])
        hot, hot_df, mine = np.concatenate(hot), np.concatenate(hot_df), np.frombuffer(m.toks, "<i8")
        if len(mine):
            o = np.argsort(hot, kind="stable")
            tok.append(mine), doc.append(np.frombuffer(m["at"], "<u2").astype(np.int64)), df.append(hot_df[o][np.searchsorted(hot[o], mine)])
        rows = []
        if tok:
            tok, doc, df = np.concatenate(tok), np.concatenate(doc), np.concatenate(df)
            order = np.lexsort((tok, df, doc))
            tok, doc = tok[order], doc[order]
            have = np.bincount(doc, minlength=len(n))
            place = np.arange(len(doc)) - (np.cumsum(have) - have)[doc]
            # texts whose prefix goes beyond the lower half use all that was sent
            room = np.where(used > low, have, _prefix(n, percent) - (low - have))
            keep = place < room[doc]
            tok, doc = tok[keep], doc[keep]
            first = textops.runs(doc)
            rows = [(ids[d], m.sigs[SIG * d : SIG * (d + 1)], n[d], t) for d, t in zip(doc[first].tolist(), np.split(tok, first[1:]))]
        release()
        return pd.DataFrame(rows, columns=["id", "sig", "n", "toks"])

    sent = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias(text)).where("id is not null").mapInArrow(tidy(send), _POST)
    return sent.groupBy("bucket").applyInPandas(count, _POST).groupBy("batch").applyInPandas(cut, "id long, sig binary, n long, toks array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity.

    Merge joins whatever the sizes: neither side has a bound, and a hot b is split.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                good.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    p = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")).hint("merge"), "a")
    p = p.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")).hint("merge"), "b").select("a", "b", "sa", "sb")
    return p.mapInArrow(tidy(test), "a long, b long")


def connecting_links(keyed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of documents that share a key; keyed: k, id, n, comp.

    Keys of the same documents count once. A key belongs to its smallest document, the lead.
    A lead's documents are parted by size into bands so wide that similar sizes are in the
    same or in neighbouring ones, and a band is dealt into blocks of about BLOCK. Blocks
    of neighbouring bands are compared, but not those of the lead's largest component
    with each other. So a lead of m documents in one band makes at most (m / BLOCK)^2 / 2
    tasks; only those that are mostly of one passage come together in so large a one.
    """
    keyed = materialize(keyed, "keyed")
    keys = keyed.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("lead")).where("lo < hi")
    keys = keys.groupBy("c", "x", "lead").agg(F.min("k").alias("k")).select("k", "lead", "c")
    wide = float(np.log(100 / percent)) * 1.000001 if percent < 100 else 1.0
    members = join_spread(keyed, keys, "k", "c", keyed.count(), "id").groupBy("lead", "id").agg(F.min("n").alias("n"), F.min("comp").alias("comp"), F.collect_set(F.xxhash64("k")).alias("ks"))
    members = materialize(members.withColumn("band", F.floor(F.log("n") / wide).cast("int")), "members")
    total = members.count()
    parts = members.groupBy("lead", "comp", "band").agg(F.count("*").alias("m"))
    main = parts.groupBy("lead", "comp").agg(F.sum("m").alias("m"), F.count("*").alias("c")).groupBy("lead").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"), F.sum("c").alias("c"))
    bands = join_spread(parts, main, "lead", "c", total, "comp").groupBy("lead", "main", (F.col("comp") == F.col("main")).cast("int").alias("big"), "band").agg(F.sum("m").alias("m"))
    # of a lead one row with its bands, as many as sizes have doublings times three
    leads = bands.groupBy("lead", "main").agg(F.sum("m").alias("m"), F.collect_list(F.struct("big", "band", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))).alias("bands"))
    d = join_spread(members, leads, "lead", "m", total, "id").join(sets.hint("merge"), "id")
    d = d.withColumn("big", (F.col("comp") == F.col("main")).cast("int"))
    code = "((x.big * 1000L + x.band) << 32)"
    own = f"transform(filter(bands, x -> x.big = big and x.band = band), x -> {code} + pmod(xxhash64(id), x.nb))[0]"
    others = f"flatten(transform(filter(bands, x -> abs(x.band - band) <= 1 and x.big + big < 2), x -> transform(sequence(0, x.nb - 1), i -> {code} + i)))"
    d = d.withColumns({"own": F.expr(own), "other": F.expr(others)}).withColumn("other", F.explode("other"))
    d = d.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "comp", "ks", "set")

    def connect(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        left, right = g.own.to_numpy() == g.i.iloc[0], g.own.to_numpy() == g.j.iloc[0]
        ids, n, comp = g.id.to_numpy(), g.n.to_numpy(), g.comp.to_numpy()
        blobs = [np.frombuffer(x, np.uint64) for x in g.set]
        ks = [np.asarray(x, np.int64) for x in g.ks]
        _, code = np.unique(np.concatenate(ks), return_inverse=True)
        row = np.repeat(np.arange(len(g)), [len(x) for x in ks])
        share = np.zeros((len(g), len(g)), bool)
        for lo in range(0, int(code.max()) + 1, 2048):
            use = (code >= lo) & (code < lo + 2048)
            inc = np.zeros((len(g), 2048), np.float32)
            inc[row[use], code[use] - lo] = 1
            share |= inc @ inc.T > 0
        share &= left[:, None] & right[None, :] & (comp[:, None] != comp[None, :])
        share &= (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None])
        if share.any():
            share &= may_link(blobs, percent)
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for a, b in np.argwhere(share).tolist():
            ra, rb = find(int(comp[a])), find(int(comp[b]))
            if ra != rb and _similar(blobs[a], blobs[b], percent):
                root[max(ra, rb)] = min(ra, rb)
                links.append((ids[a], ids[b]))
        if sum(x.nbytes for x in blobs) > 16_000_000:
            release()
        return pd.DataFrame(links, columns=["a", "b"])

    return d.groupBy("lead", "i", "j").applyInPandas(connect, "a long, b long")


def may_link(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of the pairs of sets that bitmaps do not rule out; no pair of the similarity is ruled out.

    Bits of one set's bitmap that the other's lacks are no more than the shingles it
    lacks, which bounds the intersection from above at any size of the sets.
    """
    bits = np.zeros((len(sets), BITS), np.float32)
    for row, x in enumerate(sets):
        bits[row, (x >> np.uint64(20)).astype(np.int64) % BITS] = 1
    own = np.array([len(x) for x in sets], np.int64) - bits.sum(1).astype(np.int64)
    most = own[:, None] + (bits @ bits.T).astype(np.int64)
    most = np.minimum(most, most.T)
    size = own + bits.sum(1).astype(np.int64)
    return 100 * most >= percent * (size[:, None] + size[None, :] - most)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def key_links(info: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of a key that stands on different texts, as a star around one of them."""
    texts = info.where("sig is not null and id is not null").select("id", "sig")
    several = texts.groupBy("id").agg(F.min("sig").alias("first"), F.max("sig").alias("last"), F.count("*").alias("c")).where("first < last").drop("last")
    several = materialize(several, "several")
    total = several.agg(F.sum("c")).first()[0] or 0
    star = join_spread(texts, several, "id", "c", total, "sig").where("sig <> first").select("sig", "first").distinct()
    ends = nodes.select("sig", "node")
    star = star.join(ends.withColumnRenamed("node", "a"), "sig").select("first", "a")
    return star.join(ends.select(F.col("sig").alias("first"), F.col("node").alias("b")), "first").select("a", "b")


def near_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, stored: bool = False) -> DataFrame:
    """(key, n_shingles, component_id), one row an input row.

    Sets: distinct runs of `width` words, A-Z lowered; of fewer words, the whole as one.
    Two texts link if 100 * intersection >= percent * union; component_id is the smallest
    key reachable over links. Null texts and texts without words have no shingles and
    link with nothing. Equal sets are one node, so copies cost one row each. A key on
    rows with different texts stands for all of them: what one of them links with is
    linked with the key; its rows without shingles stay alone. A null key links with
    nothing.
    Other columns of docs are not read. stored: docs is read from files as it stands;
    otherwise key and text are written first, as batches of texts must not change between passes.
    """
    docs = docs.select(key, text) if stored else materialize(docs.select(key, text), "docs")
    info = materialize(shingle_info(docs, key, text, width), "info")
    nodes = info.where("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = info.agg(F.sum("n")).first()[0] or 0
    post = prefix_postings(docs, key, text, width, percent, max(64, total >> 19)).withColumnRenamed("id", "rep")
    post = post.join(nodes.select("rep", "sig", "node"), ["rep", "sig"]).dropDuplicates(["rep", "sig"])
    post = materialize(post.select(F.col("node").alias("id"), "n", F.explode("toks").alias("tok")), "postings")
    size = post.count()
    by_tok = post.groupBy("tok").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("lead")).where("c > 1")
    classes = by_tok.groupBy("c", "x", "lead").agg(F.min("tok").alias("tok"), F.count("*").alias("mult"))
    post = materialize(join_spread(post, classes, "tok", "c", size, "id").select("tok", "id", "n", "c", "mult", "lead"), "classes")
    used = nodes.join(post.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select(F.col("rep").alias("id"), "sig", "node")
    sets = docs.join(used.select(F.col("id").alias(key)).distinct().hint("merge"), key, "left_semi").select(key, text).dropDuplicates([key, text])
    sets = shingle_blobs(sets, key, text, width).dropDuplicates(["id", "sig"]).join(used.hint("merge"), ["id", "sig"])
    sets = materialize(sets.select(F.col("node").alias("id"), "set"), "sets")

    tries = post.where("id <> lead").groupBy("id", "lead").agg(F.sum("mult").alias("w"))
    tries = tries.groupBy("id").agg(F.max(F.struct(F.col("w"), -F.col("lead"))).alias("t")).select(F.col("id").alias("a"), (-F.col("t")["col2"]).alias("b"))
    links = materialize(linked(tries, sets, percent), "links")
    comp = materialize(components(links), "components")

    post = post.join(comp, "id", "left").withColumn("comp", F.coalesce("component_id", "id"))
    apart = post.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).where("lo < hi").select("tok", "many")
    post = materialize(join_spread(post, apart, "tok", "many", size, "id").select("tok", "id", "n", "c", "mult", "lead", "comp"), "apart")
    rare = post.where(F.col("c") <= RARE).select(F.struct(F.col("tok").alias("x"), F.col("tok").alias("y")).alias("k"), "id", "n", "comp")
    often = post.where(F.col("c") > RARE).groupBy("id", "lead").agg(F.sum("mult").alias("mult"), F.min("n").alias("n"), F.min("comp").alias("comp"))
    often = materialize(often, "often")
    twice = often.where("mult > 1").select(F.struct(F.col("lead").alias("x"), F.col("lead").alias("y")).alias("k"), "id", "n", "comp")
    other = often.select(F.col("lead").alias("lead2"), F.col("id").alias("id2"))
    combos = often.join(other, (F.col("id") == F.col("id2")) & (F.col("lead") < F.col("lead2"))).select(F.struct(F.col("lead").alias("x"), F.col("lead2").alias("y")).alias("k"), "id", "n", "comp")
    keyed = rare.unionByName(twice).unionByName(combos)
    more = materialize(connecting_links(keyed, sets, percent), "links")
    final = materialize(components(links.union(more).union(key_links(info, nodes))).withColumnRenamed("id", "node"), "components")
    joined = final.join(nodes.select("node", "rep"), "node")
    least = joined.groupBy(F.col("component_id").alias("comp")).agg(F.min("rep").alias("least"), F.count("*").alias("c"))
    joined = join_spread(final.withColumnRenamed("component_id", "comp"), least, "comp", "c", final.count(), "node").select("node", "least")
    known = nodes.join(joined, "node", "left").select("sig", "copies", F.coalesce("least", "rep").alias("component_id"))
    known = materialize(known, "known")
    alone = F.col("sig").isNull() | F.col("id").isNull()
    out = join_spread(info.where(~alone), known, "sig", "copies", info.count(), "id").select("id", "n", "component_id")
    out = out.unionByName(info.where(alone).select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
