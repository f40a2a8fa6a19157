"""From raw documents to token records: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Rows with a
null text go in the first stage (they have no words); an empty table gives an empty result;
rows alike in doc_id and text are one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import decontamination, mixing, order_minhash, quality_model, token_records
from riskframe.llm.stage import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trained model both accept."""
    return quality_model.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in doc_id order, written and read back."""
    return token_records.token_output(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate),
          ("mixing", mix), ("token output", tokens)]

#: A trained model and a tokenizer decide; SQL cannot express these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
