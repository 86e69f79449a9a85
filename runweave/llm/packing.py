"""Packing token pieces into fixed-length sequences by patterns of few documents.

Only the histogram of piece lengths, at most one row a length, reaches the driver:
patterns of two or three lengths that fill a sequence are fitted to it by
non-negative least squares, rounded down, and what remains is packed best-fit
decreasing, still on counts. Spark ranks the pieces of each length and looks up
each rank's place in the plan.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textops
from .common import materialize, tidy, unused

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[list(b".,;:!?#$%&*")] = True
SPECIALS = ("<|endoftext|>", "<|startoftext|>")


class WordTokens:
    """ids of texts from a tokenizer that never joins what white space parts.

    Each distinct word of a slice, A-Z lowered, is encoded once, many to a call with a
    special token between them, and kept for later slices; over `keep` words, those met in one
    slice only are forgotten, and all if that leaves over half. A word is also cut between a
    letter and the punctuation mark after it, where the tokenizer always cuts.
    """

    def __init__(self, path: str, keep: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.keep = Tokenizer.from_file(path), keep
        self.sep = self.tok.token_to_id(SPECIALS[0])
        self.clear()

    def clear(self) -> None:
        self.seen: dict[int, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = self.lens = self.met = np.zeros(0, np.int64)

    def forget(self) -> None:
        stay = np.flatnonzero(self.met > 1)
        if 2 * len(stay) > self.keep:
            return self.clear()
        keys = np.fromiter(self.seen, np.uint64, len(self.seen))[stay]
        starts, lens = self.starts[stay], self.lens[stay]
        self.starts, self.lens, self.met = np.cumsum(lens) - lens, lens, np.ones(len(stay), np.int64)
        self.flat = self.flat[np.repeat(starts - self.starts, lens) + np.arange(lens.sum())]
        self.seen = dict(zip(keys.tolist(), range(len(stay))))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words end to end, how many each has); none holds a special token."""
        groups = [SPECIALS[0].join(words[i : i + 512]) for i in range(0, len(words), 512)]
        close = np.array([self.sep], np.uint32)
        ids = np.concatenate([x for e in self.tok.encode_batch(groups, add_special_tokens=False) for x in (np.array(e.ids, np.uint32), close)])
        ends = np.flatnonzero(ids == self.sep)
        return ids[ids != self.sep], np.diff(np.concatenate([[-1], ends])) - 1

    def learn(self, keys: list[int], words: list[str]) -> None:
        odd = [i for i, w in enumerate(words) if "<|" in w]
        if odd:
            apart = set(odd)
            self.learn([k for i, k in enumerate(keys) if i not in apart], [w for i, w in enumerate(words) if i not in apart])
            keys, each = [keys[i] for i in odd], [self.tok.encode(words[i], add_special_tokens=False).ids for i in odd]
            ids, lens = np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64)
        elif words:
            ids, lens = self.encode(words)
        else:
            return
        n = len(self.starts)
        self.seen.update(zip(keys, range(n, n + len(keys))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.met = np.concatenate([self.met, np.zeros(len(lens), np.int64)])
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, t: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each text's followed by 0; offsets)."""
        b = t.buf
        prev, prev2 = np.roll(b, 1), np.roll(b, 2)
        letter = _LETTER[prev] | (prev2 == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7)
        s, e, d = t.spans(~textops._SPACE[b], _MARK[b] & letter)
        if len(self.seen) > self.keep:
            self.forget()
        uniq, first, inv = np.unique(t.hashes(s, e, fold=True), return_index=True, return_inverse=True)
        keys = uniq.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.seen]
        raw = t.buf.tobytes()
        lo, hi = s[first].tolist(), e[first].tolist()
        self.learn([keys[i] for i in new], [raw[lo[i] : hi[i]].decode() for i in new])
        at = np.fromiter(map(self.seen.__getitem__, keys), np.int64, len(keys))
        self.met[at] += 1
        starts, lens = self.starts[at], self.lens[at]
        n = lens[inv]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        src = np.repeat(starts[inv] - (ends - n), n) + np.arange(total)
        doc = np.repeat(d, n)
        out = np.zeros(total + t.n, np.uint32)
        out[np.arange(total) + doc] = self.flat[src] if total else 0
        return out, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=t.n) + 1)]).astype(np.int64)


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every text, longer ones cut every `limit` ids.

    A null text counts as empty: one piece, the closing id 0. ids are little-endian
    unsigned 32-bit values in a binary.
    """
    kind = "ids binary" if keep_ids else ""
    schema = f"{key} long, piece int, start long, length int, ids_crc32 long" + (", " + kind if kind else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        words = WordTokens(tokenizer)
        for batch in batches:
            for part in textops.slices(batch, text):
                t = textops.Texts(part.column(1))
                ids, off = words.ids(t)
                n = -(-(off[1:] - off[:-1]) // limit)
                row = np.repeat(np.arange(t.n), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * limit
                length = np.minimum(limit, (off[1:] - off[:-1])[row] - start)
                lo = off[row] + start
                blobs = [ids[a : a + m].astype("<u4").tobytes() for a, m in zip(lo.tolist(), length.tolist())]
                cols = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(blobs, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(tidy(cut), schema)


def fill_patterns(counts: np.ndarray, limit: int) -> np.ndarray:
    """All rows of two or three lengths (0: none) that fill a sequence exactly and occur in the histogram.

    At most about limit^2 / 12 rows, whatever the number of texts.
    """
    have = np.flatnonzero(counts[:limit])
    have = have[have > 0]
    there = counts > 0
    two = have[(have <= limit - have) & there[limit - have]]
    rows = [np.stack([limit - two, two, np.zeros_like(two)], 1)]
    a = have[have >= limit // 3]
    for x in a.tolist():
        rest = limit - x
        y = have[(have <= x) & (have * 2 >= rest) & (have < rest)]
        y = y[there[rest - y]]
        if len(y):
            rows.append(np.stack([np.full_like(y, x), y, rest - y], 1))
    return np.concatenate(rows).astype(np.int64)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with the least sum of (counts - lengths used)^2.

    Accelerated projected gradient; the columns have at most three ones, so each
    round is one gather and one histogram.
    """
    if not len(patterns):
        return np.zeros(0)
    n, used = len(counts), patterns > 0

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns[used], weights=np.repeat(x, used.sum(1)), minlength=n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[patterns] * used).sum(1)

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / np.linalg.norm(back(forward(v)))
    h = counts.astype(float).copy()
    h[0] = 0
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y + step * back(h - forward(y)))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / s * (nxt - x)
        x, t = nxt, s
    return x


def best_fit(counts: np.ndarray, limit: int) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) groups of best-fit decreasing, worked out on counts."""
    open_: list[list[tuple[int, list[int]]]] = [[] for _ in range(limit + 1)]
    top = 0
    done: list[tuple[int, list[int]]] = []
    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        if n == 0:
            break
        room = n
        while left and room <= top:
            if not open_[room]:
                room += 1
                continue
            k, items = open_[room].pop()
            m = min(max(1, room // n), left)
            q = min(k, left // m)
            if q < k:
                open_[room].append((k - q, items))
            left -= q * m
            rest = room - n * m
            (open_[rest] if rest else done).append((q, items + [n] * m))
        if left:
            m = limit // n
            whole, rest = divmod(left, m)
            for q, size in ((whole, m), (1 if rest else 0, rest)):
                if q:
                    r = limit - size * n
                    (open_[r] if r else done).append((q, [n] * size))
                    top = max(top, r)
    return done + [g for groups in open_ for g in groups]


def plan_sequences(counts: np.ndarray, limit: int) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) groups that use every length exactly as often as counted."""
    left = counts.astype(np.int64).copy()
    groups: list[tuple[int, list[int]]] = []
    if left[limit]:
        groups.append((int(left[limit]), [limit]))
        left[limit] = 0
    patterns = fill_patterns(left, limit)
    x = fit_counts(patterns, left)
    for j in np.argsort(-x, kind="stable").tolist():
        items = [v for v in patterns[j].tolist() if v]
        q = int(x[j])
        for v in set(items):
            q = min(q, int(left[v]) // items.count(v))
        if q <= 0:
            if x[j] < 1:
                break
            continue
        groups.append((q, items))
        for v in items:
            left[v] -= q
    return groups + best_fit(left, limit)


def place_pieces(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, ...).

    Pieces of one length are interchangeable, so a rank within the length is enough.
    Ranks are made without gathering a length: pieces are written with a number each, dealt
    by it over about sqrt(rows) groups a length, the groups counted, and a row's rank is its
    place in its group plus the counts of the groups before. Repeated rows are dealt like
    others.
    """
    names = pieces.columns
    row, g, rank, own = unused(pieces, "row", "g", "rank", "own")
    pieces = materialize(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(limit + 1, np.int64)
    for r in lengths:
        counts[r["length"]] = r["n"]
    deal = max(1, int(np.sqrt(counts.sum())))
    runs: list[tuple[int, int, int, int]] = []
    used = np.zeros(limit + 1, np.int64)
    seq = 0
    for q, items in plan_sequences(counts, limit):
        offset = 0
        for n in items:
            runs.append((n, int(used[n]), seq, offset))
            used[n] += q
            offset += n
        seq += q
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    code = (table[:, 0] << np.int64(48)) + table[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            at_rank = b.column(len(names)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(code, (n << np.int64(48)) + at_rank, "right") - 1
            cols = [*b.columns[: len(names)], pa.array(table[at, 2] + at_rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    dealt = pieces.withColumn(g, F.pmod(F.xxhash64(row), F.lit(deal)).cast("int"))
    sizes = dealt.groupBy("length", g).agg(F.count("*").alias(rank))
    before = W.partitionBy("length").orderBy(g).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", g, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(rank))
    ranked = dealt.withColumn(own, F.row_number().over(W.partitionBy("length", g).orderBy(row))).join(sizes, ["length", g])
    ranked = ranked.select(*names, (F.col(rank) + F.col(own) - 1).alias(rank))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c != row) + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(look_up), schema)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of all texts with their place: key, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    Null and empty texts give one piece of length 1. Repeated rows are packed as often
    as they occur. An empty table gives no rows.
    """
    return place_pieces(token_pieces(docs, tokenizer, limit, key, text, keep_ids), limit)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces): the packed ids, at most one sequence length each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.size("p").alias("n_pieces"))
