import numpy as np
import pytest
from helpers import docs_frame, odd_rows, words

from runweave.llm import jaccard, vectors
from runweave.llm.common import components, table


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components_of_chain_star_and_ring(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    ids = {x for e in edges for x in e} - {7} | {7}
    assert got == closure(ids, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows():
    rng = np.random.RandomState(3)
    base = rng.normal(size=(300, 16)).astype(np.float32)
    near = [base[0] + rng.normal(scale=s, size=16).astype(np.float32) for s in (0.05, 0.1, 0.2, 0.3, 0.4) for _ in range(30)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near, base[1], base[1], base[1] * 3])]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0] * 3]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, base[2].tolist())]


def test_vectors_match_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, sig string, n int")
    got = {r[0]: tuple(r[1:]) for r in vectors.near_vectors(df, lists=4, probes=4).collect()}
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and i < 1000}
    ids = sorted(ok)
    u = np.stack([ok[i].astype(np.float32).astype(np.float64) for i in ids])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(u @ u.T >= 0.9)) if a != b]
    comp = closure(ids, links)
    for i in ids:
        assert got[i] == (sum(a == i for a, _ in links), comp[i], comp[i] == i)
    assert all(got[i][0] == 0 and got[i][1] == i and got[i][2] for i in range(1000, 1007))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_bitmaps_rule_out_no_similar_pair():
    rng = np.random.RandomState(5)
    base = [rng.randint(0, 1 << 62, n).astype(np.uint64) for n in (1, 2, 5, 40, 300, 300, 9000)]
    sets = []
    for x in base:
        for part in (0, 0.05, 0.11, 0.2, 0.25, 0.6):
            new = rng.randint(0, 1 << 62, int(part * len(x))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([x[: len(x) - len(new)], new])))
    may = jaccard.may_link(sets, 80)
    both = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    size = np.array([len(x) for x in sets])
    similar = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    assert (may | ~similar).all() and similar.sum() > len(sets)
    texts = np.flatnonzero(size == 300)
    assert (may == similar)[np.ix_(texts, texts)].mean() > 0.95


def test_few_probes_keep_recall(spark, sf):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    full = {r[0]: r[1] for r in vectors.near_vectors(df, lists=1).collect()}
    some = {r[0]: r[1] for r in vectors.near_vectors(df, lists=16, probes=6).collect()}
    assert sum(some.values()) >= 0.9 * sum(full.values())
    assert all(some[k] <= full[k] for k in full)


def test_every_vector_is_indexed(spark):
    rng = np.random.RandomState(8)
    base = rng.normal(size=(4500, 8)).astype(np.float32)
    x = np.concatenate([base, base[:600] + rng.normal(scale=0.1, size=(600, 8)).astype(np.float32)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    full = {r[0]: r[1] for r in vectors.near_vectors(df, lists=6, probes=6).collect()}
    assert [full[i] for i in range(len(x))] == want.tolist()
    for per_level in (1024, 8):
        some = {r[0]: r[1] for r in vectors.near_vectors(df, per_level=per_level).collect()}
        assert sum(some.values()) >= 0.95 * want.sum() and all(some[i] <= want[i] for i in range(len(x)))


def test_lists_of_several_levels_keep_each_vector_near():
    x = np.random.RandomState(1).normal(size=(3000, 8)).astype(np.float32)
    q = vectors.Quantizer.fit(x, 500, most=16)
    assert len(q.levels) == 3
    near = q.probe(x, 4)
    d = np.stack([((x - q.center(near[:, i])) ** 2).sum(1) for i in range(4)], 1)
    assert (np.diff(d, axis=1) >= -1e-3).all() and d[:, 0].mean() < (x**2).sum(1).mean() / 3


def test_doubles_stay_doubles(spark):
    # cosine a little under 0.9 as doubles, which floats round to more
    c = 0.9 - 1e-9
    rows = [(1, [1.0, 0.0]), (2, [c, (1 - c * c) ** 0.5]), (3, [0.9, (1 - 0.81) ** 0.5 * 0.999])]
    got = {r[0]: (r[1], r[2]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1) and got[3] == (2, 1)


def brute_texts(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, closure(ids, links)


def check_texts(spark, rows):
    got = jaccard.near_texts(docs_frame(spark, [(i, t, "s") for i, t in rows])).collect()
    n, comp = brute_texts(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r[1] == n[r[0]] and r[2] == comp.get(r[0]), r


def test_texts_match_brute_force_on_odd_rows(spark):
    check_texts(spark, [(i, t) for i, t, _ in odd_rows()])


@pytest.mark.parametrize("block", [256, 5])
def test_frequent_shingles_go_by_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "RARE", 2)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.RandomState(5)
    shared = [f"p{i}" for i in range(60)]
    rows, k = [], 0
    for g in range(6):
        body = [f"g{g}w{rng.randint(30)}" for _ in range(80)]
        for _ in range(14):
            w = list(body)
            for at in rng.randint(0, 80, rng.randint(0, 5)):
                w[at] = f"e{rng.randint(50)}"
            rows.append((k, " ".join(w + shared if g % 2 else w)))
            k += 1
    check_texts(spark, rows)


def test_texts_match_brute_force_on_documents(spark, sf):
    check_texts(spark, [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()])


def test_a_key_on_different_texts_stands_for_all_of_them(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"}
    near = {c: t + " more" for c, t in texts.items()}
    rows = [(1, texts["a"]), (2, near["a"]), (2, texts["b"]), (2, None), (3, near["b"]), (3, near["b"]), (4, texts["c"]), (5, near["c"]), (6, texts["d"]), (6, texts["e"]), (6, texts["f"]), (7, near["f"]), (8, texts["d"]), (None, texts["a"]), (9, "alone")]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 9, None: None}
    for order in (rows, rows[::-1]):
        got = jaccard.near_texts(docs_frame(spark, [(i, t, "s") for i, t in order])).collect()
        sizes = sorted((i or 0, max(1, len(words(t)) - 4) if t else 0) for i, t in rows)
        assert sorted((r[0] or 0, r[1]) for r in got) == sizes
        assert all(r[2] == (want[r[0]] if r[1] else r[0]) for r in got)


def test_no_texts(spark):
    assert jaccard.near_texts(docs_frame(spark, [])).count() == 0
