"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies.

The votes of all texts are reduced to counts of vote patterns (at most 3^rules, a fixed
bound); expectation-maximisation on those counts estimates how often each rule is right
on good and on bad texts and each pattern's probability of good quality, which decides.
Rules overlap on purpose: a text is called bad when rules that the data shows to agree
call it bad together, not because one of them does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import materialize

_SYMBOL, _UPPER, _LETTER, _ALPHA, _STOP, _PUNCT = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
# of a code point outside ASCII the first byte counts, as a letter
_ALPHA[:] = _LETTER
_ALPHA[192:] = True
_STOP[list(b".!?")] = True
_PUNCT[33:127] = True
_PUNCT[48:58] = _PUNCT[65:91] = _PUNCT[97:123] = False

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_alpha", "n_ends", "n_same", "n_lines", "n_lettered", "n_runs", "n_distinct"]


def _repeated(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of entries equal to an earlier one of their group, and of all that occur twice."""
    mixed = textops.mix(key ^ textops.mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    same = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else np.zeros(0, bool)
    later, twice = np.zeros(len(s), bool), np.zeros(len(s), bool)
    later[order] = same
    twice[order] = same | np.concatenate([same[1:], [False]]) if len(s) else same
    return later, twice


def _measure(t: textops.Texts) -> list[np.ndarray]:
    b = t.buf
    s, e, d = t.words()
    space = textops._SPACE[b]
    wh = t.hashes(s, e)
    g = textops.windows(wh, 8)
    at = np.flatnonzero(d[: len(g)] == d[7:]) if len(g) else np.zeros(0, np.int64)
    _, twice = _repeated(d[at], g[at])
    cover = np.zeros(len(d) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 8, -1)
    repeat = np.bincount(d[np.cumsum(cover[:-1]) > 0], minlength=t.n)
    ls, le, ld = t.lines()
    filled = np.concatenate([[0], np.cumsum(~space)])
    worded = filled[le] > filled[ls]
    ls, le, ld = ls[worded], le[worded], ld[worded]
    later, _ = _repeated(ld, t.hashes(ls, le))
    same = (wh[1:] == wh[:-1]) & (d[1:] == d[:-1]) if len(wh) else np.zeros(0, bool)
    last = np.zeros(len(b), bool)
    last[e - 1] = True
    alpha = _ALPHA[b]
    upto = np.concatenate([[0], np.cumsum(alpha)])
    again = np.zeros(len(b), bool)
    again[1:] = (b[1:] == b[:-1]) & _PUNCT[b[1:]]
    again[t.off[:-1][t.off[:-1] < len(b)]] = False
    runs = again.copy()
    runs[1:] &= ~again[:-1]
    known, _ = _repeated(d, wh)
    return [
        np.bincount(d, minlength=t.n),
        t.per_text(~space & ((b & 0xC0) != 0x80)),
        t.per_text(_SYMBOL[b]),
        np.bincount(ld[later], minlength=t.n),
        repeat,
        t.per_text(_UPPER[b]),
        t.per_text(_LETTER[b]),
        t.per_text(alpha),
        t.per_text(last & _STOP[b]),
        np.bincount(d[1:][same], minlength=t.n) if len(wh) else np.zeros(t.n, np.int64),
        np.bincount(ld, minlength=t.n),
        np.bincount(d[upto[e] > upto[s]], minlength=t.n),
        t.per_text(runs),
        np.bincount(d[~known], minlength=t.n),
    ]


def measure_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, MEASURES...) of every whole text; a null text measures 0 everywhere."""
    schema = f"`{key}` long, " + ", ".join(f"{m} long" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in textops.slices(batch, text):
                cols = _measure(textops.Texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols)], [key, *MEASURES])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(run, schema)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """Votes by name: 1 good, -1 bad, 0 abstains.

    Each rule calls a text good where its measure is usual for prose, bad where it is far
    from that, and abstains between. The bounds are round numbers of the kind published
    filters for web text use; n_ is per text, mean and shares are of its own words,
    characters or lines. Every rule abstains on texts without words, but length.
    """
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    lines, chars = F.greatest(c("n_lines"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    mean = c("word_chars") / n
    some = c("n_words") > 0
    votes = {
        "word_length": _vote((mean < 3) | (mean > 10), (mean >= 3.5) & (mean <= 8)),
        "symbols": _vote(c("n_symbols") * 10 > n, c("n_symbols") * 50 <= n),
        "windows": _vote(c("n_repeat_words") * 100 > n * 20, c("n_repeat_words") * 100 <= n * 5),
        "lines": _vote(c("n_dup_lines") * 10 > lines * 3, c("n_dup_lines") * 10 <= lines),
        "capitals": _vote(c("n_upper") * 10 > c("n_letters") * 3, c("n_upper") * 10 <= c("n_letters")),
        "sentences": _vote((c("n_ends") * 80 < n) | (c("n_ends") * 2 > n), (c("n_ends") * 40 >= n) & (c("n_ends") * 3 <= n)),
        "stutter": _vote(c("n_same") * 10 > n, c("n_same") * 50 <= n),
        "lettered": _vote(c("n_lettered") * 10 < n * 8, c("n_lettered") * 20 >= n * 19),
        "letters": _vote(c("n_alpha") * 10 < chars * 8, c("n_alpha") * 10 >= chars * 9),
        "runs": _vote(c("n_runs") * 10 > n, c("n_runs") * 50 <= n),
        "variety": _vote(c("n_distinct") * 5 < F.least(n, F.lit(500)), c("n_distinct") * 3 >= F.least(n, F.lit(500))),
    }
    return {"length": _vote(c("n_words") < 20, c("n_words") >= 50)} | {k: F.when(some, v).otherwise(0) for k, v in votes.items()}


#: what is believed of every rule before any text is seen, as numbers of (bad, good) votes on good texts and on bad ones of each kind
BELIEF = ((1.0, 9.0), (1.0, 1.0))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, belief: tuple = BELIEF, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of good for each vote pattern, chance of each rule's vote being bad on (good, bad) texts, share of good).

    Good texts are one class; bad ones are of several kinds, as many as there are rules, of
    which those the data does not ask for die out. Within a class the rules vote
    independently, each with its own chance of a bad vote; whether a rule abstains says
    nothing. The belief counts as that many single votes, so any corpus outweighs it. EM
    starts from the agreement of rules: patterns with two bad votes or more are spread over
    the kinds of their rules, the others are good. One bad vote alone is then bad only if
    the texts of a kind are seen to draw it, and a rule that errs on good texts is found out.
    """
    k = patterns.shape[1]
    if not len(patterns):
        return np.zeros(0), np.full((k, 2), 0.5), 0.5
    bad, good = (patterns == -1).astype(float), (patterns == 1).astype(float)
    weight = counts.astype(float)
    agree = bad.sum(1) >= 2
    member = np.concatenate([np.where(agree, 0.05, 0.95)[:, None], np.where(agree[:, None], bad / np.maximum(bad.sum(1), 1)[:, None] * 0.95, 0.05 / k)], 1)
    prior = np.array([belief[0]] + [belief[1]] * k)
    for _ in range(rounds):
        w = member * weight[:, None]
        no, yes = w.T @ bad + prior[:, :1], w.T @ good + prior[:, 1:]
        rate, share = no / (no + yes), (w.sum(0) + 1) / (weight.sum() + k + 1)
        logs = bad @ np.log(rate.T) + good @ np.log(1 - rate.T) + np.log(share)
        new = np.exp(logs - logs.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - member).max() < 1e-9
        member = new
        if done:
            break
    kinds = share[1:] / share[1:].sum()
    return member[:, 0], np.stack([rate[0], kinds @ rate[1:]], 1), float(share[0])


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_at: float = 0.5) -> DataFrame:
    """(key, MEASURES..., quality) with quality the posterior probability of being good; one row an input row.

    Null and empty texts measure 0 and are judged by the votes that gives. Repeated rows
    count as often as they occur. An empty table gives no rows.
    """
    rules = rule_votes()
    code = sum((v + 1) * 3**i for i, v in enumerate(rules.values()))
    m = materialize(measure_texts(docs, key, text).withColumn("pattern", code), "measures")
    found = sorted(tuple(r) for r in m.groupBy("pattern").count().collect())
    codes, counts = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(rules))], 1) if found else np.zeros((0, len(rules)))
    post = fit_votes(patterns, counts)[0]
    if not found:
        return m.drop("pattern").withColumn("quality", F.lit(0.0))
    table = docs.sparkSession.createDataFrame(list(zip(codes.tolist(), post.tolist())), "pattern int, quality double")
    return m.join(F.broadcast(table), "pattern", "left").drop("pattern")
