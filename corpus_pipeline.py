"""From documents to shards: five stages, each an operator of `runledger.llm`.

A stage takes (spark, docs, sf_dir) and returns what it keeps of `docs`, the last
one the shard and slot of each document. Between stages the rows are written as
Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.llm.decontaminate import drop_leaks
from runledger.llm.mixing import MIX_SHARE, document_margins, mix_documents
from runledger.llm.near_dedup import keep_one_of_each
from runledger.llm.sharding import shard_documents
from runledger.llm.toxicity import Field, drop_toxic, learn_toxic_field
from runledger.plans.lineage import cut

#: A document from this score on is toxic.
TOXIC_FROM = 0.7
SHARDS = 16
#: The margins of the mixture.
margins = document_margins


def toxic_field(spark: SparkSession, sf_dir: str) -> Field | None:
    """The field learnt from the labelled documents of a folder, held-out rows excepted."""
    return learn_toxic_field(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not reject.

    Null and empty texts score 0 and stay, as does all where no label is there
    to learn from. Repeated rows share their fate. Texts of any length are
    scored whole. Of an empty table nothing stays. Columns keep names and values.
    """
    return drop_toxic(docs, toxic_field(spark, sf_dir), TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, rows without id last.

    Rows of null or empty text, or without words, are groups of their own. Rows
    that repeat id and text are one; texts of one id are told apart. Of an empty
    table nothing stays. Columns keep names and values.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts hold none and stay. Repeated rows are judged alike.
    Texts of any length are searched whole. An empty benchmark drops nothing.
    Columns keep names and values.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that their tokens have the target shares.

    Values without a target, nulls too, are drawn as the rest. Texts without
    words weigh nothing and are drawn with the chance of their cell. Repeated
    rows share their fate. Of an empty table nothing stays. Columns keep names
    and values.
    """
    return mix_documents(docs, document_margins(), MIX_SHARE)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, one row each.

    Null texts have no bytes; equal texts are one group and share a shard.
    Repeated rows and rows without id have a slot each. An empty table gives no
    rows. Other columns are not read.
    """
    return shard_documents(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL has no conditional random field, so it has none for the rows of `run`; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
