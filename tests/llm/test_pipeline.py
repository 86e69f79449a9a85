import corpus_pipeline
from helpers import docs_frame, odd_rows, words
from test_native import brute
from test_neardup import brute_texts

from runweave.llm import mixing, queries
from runweave.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_do_what_they_say(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.count()
    toxic = {r.doc_id for r in queries.op7_toxicity(spark, sf).where("predicted = 1").collect()}
    (_, a), (_, b), (_, c), (_, d), (_, e) = corpus_pipeline.STAGES
    one = a(spark, docs, sf).cache()
    assert one.columns == COLUMNS and {r.doc_id for r in one.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - toxic
    two = b(spark, one, sf).cache()
    _, comp = brute_texts([(r.doc_id, r.text) for r in one.collect()])
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(comp.values()))
    three = c(spark, two, sf).cache()
    assert three.columns == COLUMNS and three.count() == two.count() <= n
    assert not any(brute(r.text) for r in three.collect())
    four = d(spark, three, sf).cache()
    assert four.columns == COLUMNS
    assert sum(len(words(r.text)) for r in four.collect()) == mixing.mix_sources(three).agg({"taken": "sum"}).first()[0]
    five = e(spark, four, sf)
    assert five.where("piece = 0").count() == four.count()


def test_one_text_of_a_repeated_id_stays(spark, sf):
    body = " ".join(f"w{i}" for i in range(50))
    rows = [(1, body, "a"), (2, body + " end", "a"), (2, "another text", "a"), (2, None, "a"), (3, "x", "a"), (3, "y", "a"), (3, "y", "a"), (None, "z", "a")]
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    got = [sorted((r.doc_id or 0, r.text) for r in stage(spark, docs_frame(spark, order), sf).collect()) for order in (rows, rows[::-1])]
    assert got[0] == got[1] and [i for i, _ in got[0]] == [0, 1, 3]


def test_run_equals_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_odd_rows_pass_every_stage(spark, sf):
    docs = docs_frame(spark, odd_rows())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert out.count() >= 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
