"""The corpus pipeline: documents without toxic, near-duplicate and contaminated ones, mixed to target weights and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.llm import decontamination, jaccard, mixing, sharding, toxicity
from terrella.llm.common import byte_size, release, written

#: The toxicity stage has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without rows that score as toxic. Null and empty texts stay, equal rows share their fate; labels train the model."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id (null last); rows without words all stay."""
    release(spark)
    return jaccard.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without rows of whose words a twentieth or more stands in benchmark windows; null texts stay."""
    release(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words only in whole repetitions."""
    release(spark)
    return mixing.repeated(mixing.mix(docs), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with curve, shard and slot; nulls have cells of their own."""
    release(spark)
    size = byte_size(F.col("text")) + 1
    cells = sharding.metadata_cells(docs, size, F.col("source"), F.col("lang"))
    return sharding.hilbert_shards(docs, cells, [F.col("doc_id"), F.xxhash64("text")])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("hilbert_sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again as the next one's input.

    Columns beyond those that stages read pass through, whatever their names. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
