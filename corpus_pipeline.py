"""A corpus in five stages: toxic documents go, one of each group of near copies stays, documents with benchmark
passages go, personal data is masked, and the rest is encoded. Each stage is written as Parquet and read by the next.

Null texts count as empty: such documents stay (null and wordless texts resemble nothing) and get no pieces. Null and repeated
doc_ids are rows like others, told apart by their place; of rows with one text one stays. An empty table gives an empty
one. Further columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import decontaminate, jaccard, pieces, pii, toxicity
from quarrystone.llm.common import delete_path, read, shared_path
from quarrystone.llm.queries import tokenizer_path


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the machine, trained on the labels of docs, calls toxic."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents that share 0.8 of their five-word shingles."""
    return jaccard.drop_similar(docs, width=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless) of all documents."""
    return pieces.encoded_report(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxic_documents),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark_passages),
    ("pii", personal_data),
    ("sentencepiece", encoded),
]

#: A trained machine and sampled segmentations have no SQL; a test holds the documents that run() keeps against brute force, toxicity by its own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
