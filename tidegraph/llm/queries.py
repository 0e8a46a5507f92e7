"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import audio, bloomlm, jaccard, mixing, packing, pfor, ranking, rules, surrogates, triecount
from tidegraph.llm.common import crc_mod


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(body)
    padded = F.greatest(F.lit(64), (F.ceil(n / 64) * 64).cast("int"))
    rows = documents(spark, sf_dir).select("doc_id", n.cast("bigint").alias("n_bytes"), F.rpad(body, padded, F.lit(b"\0")).alias("payload"))
    made = audio.store_and_describe(rows)
    feature = F.concat_ws(":", F.col("n_frames"), F.size("segments"), F.sha2("tensors", 256))
    return made.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
        F.col("n_frames"), F.col("segments").alias("loud_spans"), F.col("tensors").alias("log_mel"),
    )


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod("doc_id", 3) != 1)
    model = ranking.train(docs, labels.select("doc_id", "quality"))
    return ranking.score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.col("__count").alias("n_copies"), F.col("__copy").alias("copy"), F.col("__key").alias("shuffle_key"))


def op5_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return surrogates.pseudonymize(docs, count="n_entities", kinds="entity_types")


def op7_pfor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.write_and_read(documents(spark, sf_dir))


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    return bloomlm.score(docs, ~F.col("held_out"), flag="held_out")


def op9_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op10_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triecount.count_tokens(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_audio_features, op2_pairwise_quality, op3_quality_rules, op4_poisson_mix, op5_shortest_pack_first, op6_surrogates, op7_pfor_blocks, op8_bloom_lm, op9_bayes_jaccard, op10_trie_counts)
}
