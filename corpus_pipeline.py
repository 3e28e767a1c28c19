"""The corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, PII, SentencePiece.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs. All but
the last keep the columns of documents. Rows are judged by their texts: several with one doc_id, or without one, each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orogen.llm import classifier, decontamination, pii, queries, sentencepieces, simhash
from orogen.llm.shared import written

#: SQL cannot express a classifier, fingerprints by XXH64 or a latent index.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. It learns from the labels of the documents that came in."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.accepted(docs, labels)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by pseudonyms."""
    return pii.pseudonymised(docs, queries.PII_KEY)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_digest, round_trip, ids of every document that is left."""
    return sentencepieces.encoded(docs, sentencepieces.load(queries.PIECES), keep_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii_pseudonyms),
    ("sentencepiece", sentencepiece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
