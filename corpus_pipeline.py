"""From raw documents to shards: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, mixing, sharding, simhash, toxicity
from plumbline.llm.common import col, hidden, scratch_path, table

WEIGHTS = (5, 2, 1)
SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score, places = hidden(docs, "_score"), hidden(docs, "_places")
    return toxicity.score(docs, model, name=score, places=places).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints that are linked at three bits or fewer: 3-word shingles."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole copies; those it does not take go."""
    # the rows travel as one column, whatever the names of theirs
    row = F.struct(*[col(c) for c in docs.columns]).alias("row")
    rows = docs.select(row, "doc_id", "source", F.xxhash64("text").alias("mark"), mixing.words_in(F.col("text")).alias("words"))
    out = mixing.mix(rows, mixing.cycle(WEIGHTS), F.col("words"), F.array("source"), key=[F.col("doc_id"), F.col("mark"), F.col("source")])
    out = out.select("row", mixing.copies(F.col("taken"), F.col("size")).alias("copies")).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: (doc_id, size, text_crc32, shard, slot)."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Scores, fingerprints and differencing are not SQL; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
