"""The corpus pipeline: documents in, packed training sequences out.

Each stage is one operator of ``namewake.llm``; what a stage returns is written and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from namewake.llm import decontam, langid, packing, secrets, simhash
from namewake.llm.common import shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by a model learned from their labelled rows; the rest go."""
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    By SimHash: three fingerprints of 64 bits in six blocks, of which one must agree, so that all pairs of up to 5 differing bits meet. A pair at 0.8
    differs in 29 of the 192 bits on average (standard deviation 5), which blocks of a useful length miss, so 27 bands of 7 MinHash minima add candidates: one
    agrees for a pair at 0.8 with a chance of 0.998. Of all that meet, pairs of up to 56 differing bits are compared exactly.
    """
    return simhash.one_of_each(docs, words=5, lanes=3, blocks=6, agree=1, more_bands=27, max_bits=56, min_jaccard=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; the other stages' models also lie in the workers, so few words are kept."""
    import public_tokenizers

    return packing.packed(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), keep=40_000)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_values", secret_values),
    ("pack", pack),
]

#: SQL can express none of the learned stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's rows kept as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
