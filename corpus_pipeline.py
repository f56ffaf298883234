"""The training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns;
the last returns where each document's ids stand in the token files. A stage works on
all that the one before it kept, written as Parquet and read again.

Defined results: a null, empty or blank text is clean, has fingerprint zero (so one such document
stays), leaks nothing and has size 0, so the mix takes it as often as its source's rate says;
a document with a null id is a document like any other and comes first in the token files;
repeated rows are one group of copies, of which one stays; ties go to the smallest id, then
to a hash of the row; columns of any other name, whatever it is, pass through to the last
stage; an empty table gives an empty result, and so does one that a stage leaves empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weblode.llm import decontamination, mixing, near_dedup, token_output, toxicity
from weblode.llm.spark_io import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.encode_and_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: SQL can express neither the fitted models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
