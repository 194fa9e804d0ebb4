"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents scored 0.5 or more go.
2. near_duplicates: of each class of near copies the document of the smallest doc_id stays.
3. decontamination: documents with a window of ``benchmark`` go.
4. mix: each document as often as its source's target takes it (whole copies; a source over its share loses documents), in order of training
   position.
5. records: the token ids of each row, written as records and read back: doc_id, start, n_tokens, ids_crc32 and where the record is.

Every stage works on all rows its predecessor kept; all but the last return the columns of ``documents``. A null text is kept by the
filtering stages (it is neither toxic nor a copy nor contaminated).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, mix, near_duplicates, queries, records, toxicity
from ledgerloom.session import materialize, read_table


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, docs, read_table(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mix(docs)


def stage_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return records.digest(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("mix", stage_mix),
    ("records", stage_records),
]

#: Trained scores and signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
