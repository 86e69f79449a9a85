"""The registered query of each operator, over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, mixing, packing, pii, quality, toxicity, urlrules, vectors, warc
from .common import table

#: what the url query judges by
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
TOXIC_AT = 0.3


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return placed.withColumn("length", F.col("length").cast("long"))


def capture_log(pages: DataFrame) -> DataFrame:
    """Each page as a response a minute after the last, and asked for again half an hour later.

    Every eleventh response is no success; every third page has no etag and goes by its
    last_modified; every seventh is asked for again with validators of its own.
    """
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    p = pages.select(
        "page_id", "url", F.when(i % 3 != 0, tag).alias("etag"), F.concat(F.lit("m"), (i % 5).cast("string")).alias("modified"), F.sha1(F.coalesce("html", F.lit(""))).alias("sha"),
        (i * 60).alias("at"), (i % 7 == 0).alias("other"))
    etag = lambda c: F.when(c.isNotNull(), F.create_map(F.lit("etag"), c)).otherwise(F.create_map().cast("map<string,string>"))
    first = p.select(
        (i * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("at").alias("ts"), F.when(i % 11 == 0, 503).otherwise(200).alias("status"), "etag", F.col("modified").alias("last_modified"), F.col("sha").alias("digest"),
        F.map_concat(F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("at").cast("string"), F.lit("server"), F.lit("a")), etag(F.col("etag"))).alias("headers"))
    asked = F.when(F.col("other"), F.lit('"other"')).otherwise(F.col("etag"))
    again = p.select(
        (i * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.col("url"), F.lit("#again")).alias("url"), (F.col("at") + 1800).alias("ts"), F.lit(304).alias("status"), asked.alias("etag"),
        F.when(F.col("other"), F.lit("other")).otherwise(F.col("modified")).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.map_concat(F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("at") + 1800).cast("string")), etag(asked)).alias("headers"))
    return first.unionByName(again)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(capture_log(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return out.withColumn("headers", F.array_join(lines, "\n"))


def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.judge_quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), machine)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    r = chat.preference_records(chat.neighbour_pairs(turns), turns)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return r.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_texts(table(spark, sf_dir, "documents"), stored=True)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in pii.BASE], F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_vector_neardup, op2_mix_sources, op3_pattern_packing, op4_warc_revisits, op5_quality_votes, op6_url_rules, op7_toxicity, op8_preference_format, op9_jaccard_join, op10_pii)}
