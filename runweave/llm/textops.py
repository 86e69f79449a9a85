"""Vectorised word, shingle and line work on Arrow string batches.

A column slice of a few MB is seen as one byte buffer; spans, 64-bit hashes and
counts come from array operations over it, never from a loop over words. Texts are
always processed whole; a slice holds at least one text however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RND = np.random.RandomState(7).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_FOLD = _RND.copy()
_FOLD[65:91] = _RND[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        got = _powers[name] = np.cumprod(out, dtype=np.uint64)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """One slice: bytes, and the byte range of each text (null counts as empty)."""

    def __init__(self, col: pa.Array):
        col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
        if col.null_count:
            col = col.fill_null("")
        self.n = len(col)
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        data = col.buffers()[2]
        lo, hi = int(off[0]), int(off[-1])
        self.buf = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
        self.off = off - lo
        self._h: dict[bool, np.ndarray] = {}

    def _prefix(self, fold: bool) -> np.ndarray:
        if fold not in self._h:
            h = np.empty(len(self.buf) + 1, np.uint64)
            h[0] = 0
            np.take(_FOLD if fold else _RND, self.buf, out=h[1:])
            h[1:] *= _power("p", _P, len(self.buf))
            np.cumsum(h, out=h)
            self._h[fold] = h
        return self._h[fold]

    def hashes(self, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
        h = self._prefix(fold)
        raw = (h[end] - h[start]) * _power("q", _PINV, len(self.buf) + 1)[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def spans(self, inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text index) of maximal runs of the marked bytes within each text, also cut before `cuts`."""
        n = len(inside)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        if cuts is not None:
            first[:n] |= cuts
        start_at = inside & np.concatenate([[True], ~inside[:-1]]) | inside & first[:n]
        end_at = inside & (np.concatenate([~inside[1:], [True]]) | first[1:])
        start, end = np.flatnonzero(start_at), np.flatnonzero(end_at) + 1
        return start, end, np.searchsorted(self.off, start, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~_SPACE[self.buf])

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return c[self.off[1:]] - c[self.off[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text index) of the pieces between newlines, empty ones left out."""
        return self.spans(self.buf != 10)


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `size` bytes of text, at least one row each."""
    col = batch.column(batch.schema.get_field_index(text))
    if not len(col):
        return
    lens = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lens) // size + np.arange(len(col)) // 60_000 * (int(lens.sum()) + 1)
    cut = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cut.tolist(), len(col)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal keys."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


_C = np.array([0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)


def windows(wh: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive word hashes (order matters)."""
    m = len(wh) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for i in range(width):
        acc += mix(wh[i : i + m] + _C[i % 8]) * _C[(i + 3) % 8]
    return mix(acc)


def shingle_sets(t: Texts, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts end to end, offsets per text).

    A-Z is lowered; a text of fewer than `width` words has one shingle, its whole
    word sequence; a text without words has none.
    """
    s, e, d = t.words()
    wh = t.hashes(s, e, fold=True)
    count = np.bincount(d, minlength=t.n)
    first = np.concatenate([[0], np.cumsum(count)])
    g = windows(wh, width)
    ok = d[: len(g)] == d[width - 1 :] if len(g) else np.zeros(0, bool)
    keys, docs = [g[ok]], [d[: len(g)][ok]]
    short = np.flatnonzero((count > 0) & (count < width))
    for n in range(1, width):
        at = short[count[short] == n]
        if len(at):
            rows = wh[first[at][:, None] + np.arange(n)]
            acc = np.zeros(len(at), np.uint64)
            for i in range(n):
                acc += mix(rows[:, i] + _C[i]) * _C[(i + 3) % 8]
            keys.append(mix(acc + np.uint64(n)))
            docs.append(at)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    if len(key):
        keep = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[keep], doc[keep]
    return key, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=t.n))]).astype(np.int64)
