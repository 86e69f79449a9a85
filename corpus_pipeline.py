"""Documents to packed training sequences: STAGES in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.llm import jaccard, mixing, packing, pii, queries, toxicity
from runweave.llm.common import materialize, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts below the toxicity threshold; the model is fitted on labelled rows of the raw documents."""
    machine = toxicity.train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, machine, name="__score").where(F.col("__score") < queries.TOXIC_AT).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by five-word Jaccard links of 0.8 or more, the one of smallest doc_id, once.

    Rows of one doc_id count as connected; of those of the smallest one that comes first by content stays.
    """
    kept = jaccard.near_texts(docs, stored=bool(docs.inputFiles())).groupBy("doc_id").agg(F.min("component_id").alias("component_id")).where("doc_id = component_id").select("doc_id")
    (place,) = unused(docs, "place")
    order = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), *[F.col(c) for c, t in docs.dtypes if "map<" not in t and t != "variant"])
    one = docs.join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return docs.where("doc_id is null").unionByName(one.select(docs.columns))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text, its personal data replaced by the kind's name, n_chars to match."""
    done = pii.redact(pii.find_pii(docs))
    return done.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as often as its source's target takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their sequence and place."""
    return packing.pack_documents(docs, queries.tokenizer_path(), keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("pii", redact_personal),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
