import dataclasses
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import docs_frame, frame, odd_rows, words

from runweave.llm import queries, quality, toxicity
from runweave.llm.common import table


def measures(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_measures_match_brute_force(spark, sf):
    odd = odd_rows() + [(20, "x y\n\nx y\nx y ", "a"), (21, " ".join("a b c d e f g h a b c d e f g h".split() * 2), "a"), (22, "é€😀 #*|<>\n#*", "b")]
    for df in (docs_frame(spark, odd), table(spark, sf, "documents")):
        want = Counter((r.doc_id, *measures(r.text)) for r in df.collect())
        got = quality.measure_texts(df)
        assert Counter(tuple(r) for r in got.select("doc_id", *quality.MEASURES[:5]).collect()) == want


def other_measures(text):
    w, t = words(text), text or ""
    letter = lambda c: c.isascii() and c.isalpha() or ord(c) > 127
    runs = re.findall(r"([!-/:-@\[-`{-~])\1+", t)
    return sum(map(letter, t)), sum(any(map(letter, x)) for x in w), len(runs), len(set(w))


def test_other_measures_match_brute_force(spark, sf):
    odd = odd_rows() + [(20, "!! a!! ##", "a"), (21, "#", "a"), (22, "#b é€😀 -- ..\n...", "b"), (23, "aa aa ab", "b")]
    for df in (docs_frame(spark, odd), table(spark, sf, "documents")):
        want = Counter((r.doc_id, *other_measures(r.text)) for r in df.collect())
        got = quality.measure_texts(df).select("doc_id", "n_alpha", "n_lettered", "n_runs", "n_distinct")
        assert Counter(tuple(r) for r in got.collect()) == want


def planted_votes(n, junk, seed):
    """Votes of 8 rules with known chances of a bad vote: on good texts, and on two kinds of bad ones."""
    rng = np.random.RandomState(seed)
    kind = np.where(rng.rand(n) < junk, 1 + (rng.rand(n) < 0.4), 0)
    chance = np.array([[0.02, 0.01, 0.03, 0.15, 0.01, 0.02, 0.01, 0.02], [0.9, 0.8, 0.7, 0.2, 0.05, 0.05, 0.02, 0.02], [0.05, 0.03, 0.05, 0.2, 0.9, 0.85, 0.8, 0.6]])
    votes = np.where(rng.rand(n, 8) < 0.1, 0, np.where(rng.rand(n, 8) < chance[kind], -1, 1))
    return kind == 0, votes, chance


def grouped(votes):
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    return patterns, back.ravel(), counts


@pytest.mark.parametrize("junk", [0.05, 0.16, 0.5])
def test_em_finds_the_planted_accuracies(junk):
    good, votes, chance = planted_votes(40_000, junk, 2)
    patterns, back, counts = grouped(votes)
    post, rates, share = quality.fit_votes(patterns, counts)
    assert abs(share - good.mean()) < 0.03
    assert np.abs(rates[:, 0] - chance[0]).max() < 0.02
    assert np.abs(rates[:, 1] - (0.6 * chance[1] + 0.4 * chance[2])).max() < 0.08
    verdict = post[back] >= 0.5
    # as good as judging by the planted chances themselves
    logs = (votes == -1) @ np.log(chance.T) + (votes == 1) @ np.log(1 - chance.T) + np.log([1 - junk, junk * 0.6, junk * 0.4])
    best = np.exp(logs[:, 0]) >= np.exp(logs[:, 1:]).sum(1)
    assert (verdict == good).mean() > (best == good).mean() - 0.005
    # rule 3 errs on 15 % of good texts: alone it condemns nothing, all-must-pass would
    assert (verdict == good).mean() > ((votes != -1).all(1) == good).mean() + 0.03
    only = np.where(np.arange(8) == 3, -1, 1)
    assert post[(patterns == only).all(1)][0] > 0.9
    assert quality.fit_votes(np.zeros((0, 3)), np.zeros(0))[0].shape == (0,)


def plain_em(votes, belief, rounds):
    """The same model, one text at a time."""
    k, n = len(votes[0]), len(votes)
    member = []
    for v in votes:
        bad = [x == -1 for x in v]
        if sum(bad) >= 2:
            member.append([0.05] + [0.95 * b / sum(bad) for b in bad])
        else:
            member.append([0.95] + [0.05 / k] * k)
    for _ in range(rounds):
        rate = []
        for c in range(k + 1):
            b, g = belief[0] if c == 0 else belief[1]
            no = [b + sum(m[c] for m, v in zip(member, votes) if v[j] == -1) for j in range(k)]
            yes = [g + sum(m[c] for m, v in zip(member, votes) if v[j] == 1) for j in range(k)]
            rate.append([x / (x + y) for x, y in zip(no, yes)])
        share = [(sum(m[c] for m in member) + 1) / (n + k + 1) for c in range(k + 1)]
        member = []
        for v in votes:
            p = [share[c] * np.prod([1.0 if x == 0 else r if x < 0 else 1 - r for x, r in zip(v, rate[c])]) for c in range(k + 1)]
            member.append([x / sum(p) for x in p])
    return [m[0] for m in member]


def test_em_equals_a_plain_one():
    _, votes, _ = planted_votes(300, 0.3, 4)
    patterns, back, counts = grouped(votes)
    post = quality.fit_votes(patterns, counts, rounds=25)[0]
    assert np.allclose(post[back], plain_em(votes.tolist(), quality.BELIEF, 25), atol=1e-6)


def test_verdict_is_not_all_must_pass(spark):
    df = quality.judge_quality(table(spark, "/root/testdata/sf0.01", "documents"))
    pdf = frame(df.select("quality", *[v.alias(k) for k, v in quality.rule_votes().items()]))
    passed = (pdf[list(quality.rule_votes())] != -1).all(axis=1)
    assert ((pdf.quality >= 0.5) & ~passed).sum() > 0 and (pdf.quality >= 0.5)[passed].all()


def test_quality_query_keeps_good_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    pdf = frame(queries.op5_quality_votes(spark, sf)).merge(frame(table(spark, sf, "labels")), on="doc_id")
    assert pdf[pdf.quality_y == 1].kept.mean() > 0.95
    assert pdf[(pdf.quality_y == 1) & ~pdf.base_failed].kept.mean() > 0.99
    assert pdf[pdf.quality_y == 0].kept.mean() < 0.05
    assert not pdf[pdf.base_failed].kept.any()


def test_quality_of_odd_rows(spark):
    df = docs_frame(spark, odd_rows())
    assert quality.judge_quality(df).count() == len(odd_rows())
    assert quality.judge_quality(df.limit(0)).count() == 0


def bags_of_pairs(n, seed):
    rng = np.random.RandomState(seed)
    insult, group = rng.rand(n) < 0.5, rng.rand(n) < 0.5
    bags = [np.unique(([1] if a else []) + ([2] if b else []) + (3 + rng.randint(0, 40, 3)).tolist()) for a, b in zip(insult, group)]
    return bags, (insult & group).astype(int)


def test_machine_learns_a_pair_of_terms():
    bags, y = bags_of_pairs(3000, 0)
    m = toxicity.fit_machine(np.arange(43), bags, y, rounds=100, pairs=800)
    bags, y = bags_of_pairs(500, 1)
    raw = m.logits(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))
    assert ((raw > 0) == y).mean() > 0.97
    both, one = m.logits(np.array([1, 2]), np.zeros(2, int), 1), m.logits(np.array([1]), np.zeros(1, int), 1)
    assert both[0] > 0 > one[0]


def test_training_learns_a_pair_that_neither_term_shows(spark):
    rng = np.random.RandomState(5)
    n = 6000
    insult, group = rng.rand(n) < 0.4, rng.rand(n) < 0.5
    # with the insult the group makes it toxic, a mild word without the group does as often: group alone says nothing
    mild = rng.rand(n) < 0.4
    y = np.where(group, insult, mild & ~insult | insult & (rng.rand(n) < 0.15)).astype(int)
    text = [" ".join((["insultword"] if a else []) + (["groupname"] if b else []) + (["mildword"] if c else []) + [f"x{rng.randint(60)}q" for _ in range(4)]) for a, b, c in zip(insult, group, mild)]
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(n), "text": text}))
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": range(n), "toxic": y}))
    m = toxicity.train_toxicity(df, labels)
    held = df.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2")
    pdf = frame(toxicity.score_toxicity(held, m))
    linear = dataclasses.replace(m, factors=np.zeros_like(m.factors))
    plain = frame(toxicity.score_toxicity(held, linear))
    loss = lambda p: -np.log(np.where(p.toxic == 1, p.score, 1 - p.score).clip(1e-9)).mean()
    probe = frame(toxicity.score_toxicity(spark.createDataFrame([(1, "insultword groupname x1q x2q"), (2, "groupname x1q x2q"), (3, "groupname mildword x1q")], "doc_id long, text string"), m)).set_index("doc_id").score
    assert probe[1] > 0.8 and probe[2] < 0.2 and probe[3] < 0.3
    assert loss(pdf) < 0.8 * loss(plain) and ((pdf.score >= 0.5) == (pdf.toxic == 1)).mean() > 0.88


def test_factors_are_no_worse_than_weights_alone(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2")

    def quality_of(m):
        p = frame(toxicity.score_toxicity(held.select("toxic", "text"), m))
        return p[p.toxic == 1].score.ge(0.3).mean(), -np.log(np.where(p.toxic == 1, p.score, 1 - p.score).clip(1e-9)).mean()

    recall, loss = quality_of(toxicity.train_toxicity(docs, labels))
    whole = toxicity.fit_machine
    monkeypatch.setattr(toxicity, "fit_machine", lambda *a, **k: whole(*a, **{**k, "pairs": 0}))
    alone, alone_loss = quality_of(toxicity.train_toxicity(docs, labels))
    assert recall >= alone - 0.005 and loss <= alone_loss * 1.02


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    pdf = frame(queries.op7_toxicity(spark, sf)).merge(frame(table(spark, sf, "labels")), on="doc_id")
    held = pdf[pdf.held_out]
    assert ((pdf.score >= 0) & (pdf.score <= 1)).all()
    assert held[held.toxic == 1].predicted.mean() > 0.8
    assert held[held.toxic == 0].predicted.mean() < 0.02


def test_toxicity_of_odd_rows_and_without_labels(spark):
    df = docs_frame(spark, odd_rows())
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        m = toxicity.train_toxicity(df, l)
        out = toxicity.score_toxicity(df, m)
        assert out.columns == [*df.columns, "score"] and out.count() == len(odd_rows())
        assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(df.limit(0), m).count() == 0
    assert toxicity.train_toxicity(df.limit(0), labels).bias == pytest.approx(0.0, abs=2)
