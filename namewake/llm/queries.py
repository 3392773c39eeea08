"""Queries of this subpackage, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, htmlmain, langid, licenses, minhash, negatives, packing, secrets, simhash, tokencount, topk, urlfilter
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(*urlfilter.captures_and_entries(table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")))
    return judged.select("capture_id", "url", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"), "verdict", F.coalesce("pattern", F.lit("")).alias("pattern"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", F.length("secret").alias("length"), F.sha2("secret", 256).alias("digest"), "probability", "is_secret")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), model_path=public_tokenizers.path("piece_bpe_32k.model"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_url_filter": op2_url_filter,
        "op3_packing": op3_packing,
        "op4_licenses": op4_licenses,
        "op5_language": op5_language,
        "op6_secrets": op6_secrets,
        "op7_tokens": op7_tokens,
        "op8_decontamination": op8_decontamination,
        "op9_main_text": op9_main_text,
        "op10_top_k": op10_top_k,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_vector_codes": op12_vector_codes,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urlfilter.ORACLE, "op4_licenses": licenses.ORACLE, "op10_top_k": topk.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op12_vector_codes": codes.ORACLE}
