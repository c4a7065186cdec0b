"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. toxicity: documents that the factorization machine rejects go.
2. near_dedup: of each group of near-duplicates the document of the smallest id stays.
3. secrets: every span of a secret is replaced by a mark; documents stay.
4. mixing: documents are repeated, cut or left out so that sources come to their
   target weights; a row is what one epoch reads of a document.
5. packing: token ids in sequences; a row is a piece of a document.

Every stage takes all that its predecessor kept. Null texts pass 1 to 3 as they
are; 4 draws words, so that documents without any go there. Columns beside those
of documents pass through. Empty tables pass as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.llm.common import written
from docustrata.llm.mixing import apply_mix
from docustrata.llm.neardup import drop_near_duplicates
from docustrata.llm.packing import pack
from docustrata.llm.secrets import redact
from docustrata.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return redact(docs).withColumn("n_chars", F.length("text").cast(kind))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The learned, hashed and tokenized stages have no SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
