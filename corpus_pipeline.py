"""A corpus pipeline of training-data operators.

Toxic documents go, one document of each group of near-duplicates stays, what
leaks a benchmark goes, and the rest is encoded. Each stage works on all that the
one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trisearch.llm import bpe, common, decontaminate, jaccard_join, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 for toxicity."""
    return toxicity.keep_ordinary(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")), 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 make."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and of the text they decode to."""
    import public_tokenizers

    return bpe.encode_and_check(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("benchmark_decontamination", drop_leaks), ("bpe", encode)]

#: The trained model and the fingerprints are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stored(docs, name)
    return docs
