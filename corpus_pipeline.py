"""From raw documents to token ids: quality, near-duplicates, contamination, personal data, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet in the shared checkpoint folder and reads it back for the next one. All stages
but the last return the columns they were given. SQL can express neither the estimated
rules nor the fingerprints nor the merges, so there is no oracle; the tests compare every
stage with a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.llm import byte_bpe, decontaminate, pii, quality, simhash
from plantspark.llm.common import prepare, table, text_or_empty, written
from plantspark.session import checkpoint_root


def _whole(docs: DataFrame) -> DataFrame:
    """The row as one column beside its text, so that no operator's column meets one of the documents'."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps. The rules are weighed on all of them first.

    The texts are measured once: the rows with their counts wait in the shared folder.
    """
    prepare(spark)
    measured = written(quality.measure(_whole(docs)).drop("text"))
    return quality.judge(measured, quality.fit(measured)).where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id."""
    prepare(spark)
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    prepare(spark)
    found = decontaminate.contamination(_whole(docs), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every span becomes its kind in brackets, and n_chars follows."""
    prepare(spark)
    found = pii.spans(_whole(docs))
    clean = found.withColumn("clean", F.when(F.col("text").isNull(), F.col("text")).otherwise(pii.redacted(text_or_empty("text"), F.col("pii"))))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return clean.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    prepare(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = ("n_tokens", "ids", "decoded_sha256")
    return byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN, outputs=out).select("doc_id", "lang", "source", "n_chars", *out)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
