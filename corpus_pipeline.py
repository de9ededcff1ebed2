"""A corpus from raw documents: five stages, each over all that the one before kept.

Language ID drops what it rejects, SimHash near-dedup keeps one document of each group, decontamination drops documents with benchmark passages,
mixing repeats documents by the rates that meet its targets and drops those of domains without one, and what is left is written as token ids and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmend.llm import decontaminate, langid, mixing, simhash, token_files
from seriesmend.llm.queries import TARGETS, domains, table
from seriesmend.runtime import prepare, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(langid.learnable(F.col("doc_id"))))
    prepare(spark)
    return langid.identify(docs, model, keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=True)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, domains(table(spark, sf_dir, "labels")), TARGETS, least=1)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(spark, token_files.write_token_files(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing), ("token_output", token_output)]

#: Hashes, models and tokenizers aren't SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, f"pipeline-{k}-{name}") if k < len(STAGES) - 1 else docs
    return docs
