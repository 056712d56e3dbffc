"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import decontamination, embedding_dedup, language_id, merkle, minhash_dedup, oracle, packing, personal_data, quality, secrets, sharding, spelling, suffix_dedup, token_blocks

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = oracle.sql()


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.9 or more, and their components."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in windows of the benchmark."""
    marked = decontamination.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontamination.digest(marked)


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, by kind and place."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token sequences of 1024."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text, by kind and place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.digest(personal_data.find(docs, personal_data.train(docs), keep=["doc_id"]))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by a network trained outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs), keep=["doc_id"])
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("lang__pred").alias("lang_pred"), F.col("lang__score").alias("score")
    )


@query
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by a similarity of 0.85 or more, and their components."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("tag")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document in strings of 50 that an earlier document has."""
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


@query
def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards by doc_id, and in 25."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, by trees trained outside the held-out fold."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and roots of all documents, a third of them checked with a changed text."""
    return merkle.checked(table(spark, sf_dir, "documents"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, a few with a letter dropped, and the forms they lead to."""
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), drop=31))


@query
def op13_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files of packed blocks and read back."""
    return token_blocks.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
