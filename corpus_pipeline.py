"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixture, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last
return the columns of ``docs``; the last adds each row's shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterwise.llm import decontamination, mixing, sharding, simhash, similarity, toxicity
from meterwise.llm.storage import hand_over

#: No SQL: the stages fit a classifier, hash with XXH64 and refine splitters by counts.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that a model fitted on the labelled ones among them rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near-duplicates.

    Documents are linked by SimHash, or if their sets of five-word shingles are alike to 0.8.
    Null and empty texts form one group; a group without ids keeps one row.
    """
    return simhash.keep_first(docs, similarity=similarity.SIMILARITY)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that cover a benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take whole documents of every source until its target is met, some more than once."""
    return mixing.materialise(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``shard`` and ``slot`` to every row."""
    placed = sharding.assign(docs)
    return placed.withColumnsRenamed({"__shard": "shard", "__slot": "slot"}).drop("__size")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-duplicates", one_of_each_group),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
    ("sharding", place_in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = hand_over(docs, f"stage-{k}")
    return docs
