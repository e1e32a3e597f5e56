"""From documents to token files: the stages of a training corpus, each written as Parquet and read again.

1. toxicity: rows whose score is 0.5 or more go (learned from ``labels`` outside the held-out fold);
2. near_duplicates: of each component of 5-word shingle sets with a similarity of 0.8 or more the row with
   the smallest doc_id stays;
3. decontamination: rows of whose words a twentieth or more lies in 13-word windows of ``benchmark`` go;
4. mixing: rows are repeated or left out so that sources reach their target weights;
5. token_ids: what is left is encoded and written as token files, and read back.

Stages 1 to 4 return the columns of documents. The operators' docstrings define what nulls, empty and
very long texts, ties, repeated rows and empty tables give; extra columns are kept until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symlake.llm import decontam, minhash, mixing, tokens, toxicity
from symlake.llm.common import read, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenize(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: A trained network decides in the first stage, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
