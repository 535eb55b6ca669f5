"""Corpus pipeline: quality filter, near duplicates, benchmark leakage, secrets, packing.

Each stage reads what the one before has written; all but the last return the
columns of ``documents``, further ones included, whatever their names. Texts are
read whole. An empty table passes every stage and gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import decontaminate, neardup, packing, quality, secretscan
from strandmill.llm.common import shared_folder, table
from strandmill.llm.queries import word_tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer, fitted on this stage's input, keeps.

    A null or empty text is scored as an empty one; equal texts go or stay together; ties (a score of 0.5) stay.
    """
    return quality.keep_good(docs, quality.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least id.

    Texts without words, null ones among them, all stay; of repeated rows one stays; a null id comes after all others.
    """
    return neardup.keep_one(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; rows that share an id go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced. Null and empty texts, and those without secrets, stay as they are."""
    return secretscan.redact(docs, secretscan.train(secretscan.sample_findings(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences. A null text is an empty one: the end id alone."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: EM, sketches, a forest and bin packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet and read again.

    A stage's rows are deleted once the next one's are written; those of the last
    but one stay for the frame that is returned, whoever calls.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
