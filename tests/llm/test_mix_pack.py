import zlib

import numpy as np
import pytest
from helpers import docs_frame, frame, odd_rows, words
from pyspark.sql import functions as F

from runweave.llm import mixing, packing
from runweave.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def fill(sizes):
    """Targets by sharing the excess again and again; sizes: (source, size) in order."""
    w = {s: 1 + i % 3 for i, (s, _) in enumerate(sizes)}
    size = dict(sizes)
    total, target, open_ = float(sum(size.values())), {}, set(size)
    left = total
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > 3 * size[s]}
        if not over:
            return target | {s: share * w[s] for s in open_}
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(pdf):
    by = pdf.groupby(pdf.source.fillna("\uffff"))["size"].sum()
    goal = fill(list(by.items()))
    for s, g in pdf.groupby(pdf.source.fillna("\uffff")):
        assert np.allclose(g.target, goal[s]) and (g.source_size == by[s]).all()
        assert (g.taken <= 3 * g["size"]).all()
        assert abs(g.taken.sum() - goal[s]) <= g["size"].max() * len(g[g.doc_id.duplicated(keep=False)] if len(g) else g) + g["size"].max() / 2 + 1


def test_mix_of_odd_rows(spark):
    df = docs_frame(spark, odd_rows())
    pdf = frame(mixing.mix_sources(df))
    assert len(pdf) == len(odd_rows())
    sizes = {i: len(words(t)) for i, t, _ in odd_rows()}
    assert all(sizes[None if i != i else i] == z for i, z in zip(pdf.doc_id, pdf["size"]))
    check_mix(pdf)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mix_is_near_target_and_reruns_agree(spark, sf):
    docs = table(spark, sf, "documents")
    pdf = frame(mixing.mix_sources(docs))
    check_mix(pdf)
    again = frame(mixing.mix_sources(docs.repartition(7)))
    assert dict(zip(pdf.doc_id, pdf.taken)) == dict(zip(again.doc_id, again.taken))


def test_mixed_rows_repeat_as_often_as_taken(spark):
    df = docs_frame(spark, odd_rows()).where("doc_id is not null").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix_sources(df).collect()}
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns
    count = {}
    for r in got.select("doc_id").collect():
        count[r[0]] = count.get(r[0], 0) + 1
    assert count == {k: v for k, v in taken.items() if v}


def test_mixed_rows_keep_columns_of_any_name(spark):
    df = docs_frame(spark, [(i, " ".join(["w"] * (i + 1)), "ab"[i % 2]) for i in range(20)])
    plain = sorted(r.doc_id for r in mixing.mixed_rows(df).collect())
    names = ["h", "z", "t", "i", "cut", "s", "n", "H_"]
    odd = df.drop(*names).withColumns({n: F.lit(-7) for n in names})
    got = mixing.mixed_rows(odd).collect()
    assert sorted(r.doc_id for r in got) == plain and all(r[n] == -7 for r in got for n in names)


def check_pack(spark, df, limit=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    pdf = frame(packing.pack_documents(df, PATH, limit))
    total = 0
    left = {}
    for i, t in [tuple(r) for r in df.select("doc_id", "text").collect()]:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for p, a in enumerate(range(0, len(ids), limit)):
            k = (i, p, a, min(limit, len(ids) - a), zlib.crc32(ids[a : a + limit].tobytes()))
            left[k] = left.get(k, 0) + 1
    for r in pdf.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32
        left[(None if r.doc_id != r.doc_id else r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] -= 1
    assert not any(left.values())
    for _, g in pdf.sort_values("offset").groupby("sequence_id"):
        ends = np.cumsum(g.length)
        assert g.offset.tolist() == [0, *ends[:-1]] and ends.iloc[-1] <= limit
    return pdf.sequence_id.nunique(), -(-total // limit)


def test_packing_of_odd_rows_round_trips(spark):
    df = docs_frame(spark, odd_rows())
    check_pack(spark, df, 64)
    used, least = check_pack(spark, df)
    assert used <= least + 1
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    seq = packing.sequences(packing.pack_documents(df, PATH))
    assert all(len(r.ids) <= 4 * 2048 for r in seq.collect())


def test_packing_of_documents_is_tight(spark, sf):
    used, least = check_pack(spark, table(spark, sf, "documents"))
    assert used <= least * 1.02 + 1


def test_plan_uses_each_length_as_often_as_counted():
    rng = np.random.RandomState(0)
    for shape in (rng.randint(1, 129, 900), np.full(500, 65), np.full(300, 1), np.array([128] * 9 + [100] * 50 + [28] * 20), rng.randint(1, 20, 3000)):
        counts = np.bincount(shape, minlength=129)
        used = np.zeros(129, int)
        groups = packing.plan_sequences(counts, 128)
        for q, items in groups:
            assert sum(items) <= 128
            np.add.at(used, items, q)
        assert (used == counts).all()
        n = sum(q for q, _ in groups)
        least = max(-(-shape.sum() // 128), (shape > 64).sum())
        assert n <= least * 1.03 + 1


def test_every_pattern_of_three_lengths_is_enumerated():
    limit = 2048
    rows = packing.fill_patterns(np.ones(limit + 1, np.int64), limit)
    assert (rows.sum(1) == limit).all()
    found = {tuple(sorted(r)) for r in rows.tolist()}
    assert len(found) == len(rows)
    assert found == {(a, b, limit - a - b) for a in range(limit // 3 + 1) for b in range(max(a, 1), (limit - a) // 2 + 1)}
