"""A training corpus out of documents: five stages, each written and read again.

Language ID drops documents of no known language; SimHash keeps one document of
each group of near copies; decontamination drops documents in which a window of
the benchmark occurs; personal data is replaced by its kind; mixing decides how
many copies of each document the mix takes, and returns the documents that it
takes, with their texts and columns and the mix's figures (``copies``).

Defined results: a null or blank text is of no known language and goes; rows
with a null doc_id take part like others; of rows with one doc_id and unlike
texts each is a document of its own, and of equal rows one stays; of near copies
that one stays whose doc_id is smallest, by ties the one whose text's hash is;
documents of size 0 take nothing; an empty table gives an empty one. Columns
beside those of documents are kept, but for the names of the mix's figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import decontam, langid, mixing, pii, simhash
from rowloom.llm.common import table
from rowloom.sources import files
from rowloom.sources.scratch import scratch_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.applied(docs).where("copies > 0")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]

#: Profiles, fingerprints and pivotal rounding aren't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The mix. It stays in folder, a new one in the shared folder if none is given; what earlier stages wrote is removed."""
    folder = folder or scratch_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            files.remove(spark, before)
        before = out
    return docs
