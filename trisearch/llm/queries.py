"""The operators' registered queries, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, embedding_dedup, jaccard_join, lattice, licenses, token_counts, token_store, toxicity, url_filter


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(common.read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(common.read(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    token_store.write(common.read(spark, sf_dir, "documents"), path, _vocabulary("word_bpe_49k.json"), end=1)
    return token_store.digests(spark, path)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(common.read(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(pages))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))
    held_out = F.pmod(common.crc_of_id(F.col("doc_id")), F.lit(4)) == 2
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(common.read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(common.read(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_lattice": op1_lattice,
        "op2_licenses": op2_licenses,
        "op3_token_store": op3_token_store,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_decontaminate": op5_decontaminate,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_toxicity": op8_toxicity,
        "op9_token_counts": op9_token_counts,
        "op10_jaccard_join": op10_jaccard_join,
    }


def oracle_sql():
    return {"op2_licenses": licenses.sql()}
