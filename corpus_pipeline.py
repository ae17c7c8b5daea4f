"""The corpus pipeline: five stages over documents, each one operator of revisor.llm.

A stage takes (spark, docs, sf_dir) and returns what stays of docs; the last returns
the packed pieces with their token ids.  Rows are judged one by one, by a key of their
own: documents without an id, with a repeated id or repeated whole are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisor.llm import decontaminate, exact_dedup, packing, similar, simhash, toxicity
from revisor.llm.common import among, with_row_key, written


def _without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without those whose key is in ``dropped`` (row), and without the key."""
    return among(rows, key, dropped.select("row"), inside=False).select([f"`{c}`" for c in rows.columns if c != key])


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, key = with_row_key(docs)
    toxic = toxicity.toxicity(rows, model, key).where("predicted = 1").select(F.col("doc_id").alias("row"))
    return _without(rows, key, written(toxic, "toxic"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the keeper stays."""
    rows, key = with_row_key(docs)
    return _without(rows, key, written(exact_dedup.exact_dedup(rows, row_col=key).where("not kept").select("row"), "copies"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document that names it stays; of the rest, none that is like an earlier one.

    Near duplicates are those of the SimHash operator; alike are texts whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    rows, key = with_row_key(docs)
    others = written(simhash.near_duplicates(rows, row_col=key).where("not named").select("row"), "near")
    alike = similar.like_smaller(among(rows, key, others, inside=False), key).select(F.col("gone").alias("row"))
    return _without(rows, key, others.unionByName(alike))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    rows, key = with_row_key(docs)
    leaked = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key).select(F.col("doc_id").alias("row"))
    return _without(rows, key, written(leaked, "leaks"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their ids and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", distinct_texts),
    ("simhash", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Kernels, graph components and tokenizers are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
