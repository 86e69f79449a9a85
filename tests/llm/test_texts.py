import numpy as np
import pyarrow as pa
import pytest
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from runweave.llm import packing, textops


@pytest.fixture(autouse=True)
def _quiet():
    with np.errstate(over="ignore"):
        yield


def brute_shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.x", max_size=40)), max_size=12))
def test_shingles_match_sets_of_tuples(texts):
    _, off = textops.shingle_sets(textops.Texts(pa.array(texts, pa.string())))
    assert np.diff(off).tolist() == [len(brute_shingles(t)) for t in texts]


def test_slices_cover_all_rows_and_keep_long_texts_whole():
    texts = ["a" * 50, None, "b" * 900, "", "c"]
    got = [t for b in textops.slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text", 100) for t in b.column(0).to_pylist()]
    assert got == texts


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aZé.,'s1<|> \n\u0301ß…", max_size=30), max_size=6))
def test_word_tokens_equal_the_tokenizer(texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [*texts, "I'LL go<|endoftext|>x. <|startoftext|>,", ""]
    ids, off = packing.WordTokens(path).ids(textops.Texts(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0]


def test_words_met_again_stay_when_others_are_forgotten():
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    words = packing.WordTokens(path, keep=60)
    alone, learned = Tokenizer.from_file(path), []
    learn = words.learn
    words.learn = lambda keys, new: (learned.extend(new), learn(keys, new))[1]
    for i in range(8):
        texts = ["often seen été# straße$ a%b&c*d x*́", *(f"only{'abcdefgh'[i]}{'klmnopqrst'[k % 10]}{'uvw'[k // 10]}" for k in range(30))]
        ids, off = words.ids(textops.Texts(pa.array(texts)))
        assert [ids[a : b - 1].tolist() for a, b in zip(off, off[1:])] == [alone.encode(t, add_special_tokens=False).ids for t in texts]
    assert learned.count("often") == 1 and "été" in learned and "straße" in learned
