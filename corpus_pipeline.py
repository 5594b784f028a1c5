"""A corpus pipeline of five operators: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import decontam, linededup, minhash, mixing, quality
from tidepool.llm._store import Scratch, attach

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.judge(spark, docs, keep=True).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; a document of which nothing is left goes with them."""
    out = linededup.dedup_lines(spark, docs).where("_removed = 0 or text <> ''")
    return out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows whose id and text are not in ``verdicts``: an id may be null or repeat, and a verdict is on
    one text. They are counted and then broadcast, or both sides are dealt out (no key is hot)."""
    gone = verdicts.select("doc_id", "text_hash").distinct()
    return attach(docs.withColumn("text_hash", F.xxhash64("text")), gone, ["doc_id", "text_hash"], "left_anti", salted=False).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity of 0.8 or more) the one with the smallest id stays."""
    return _without(docs, minhash.near_duplicates(spark, docs, percent=80).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an exact phrase of eight words of any benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontam.contamination(spark, docs, items).where("n_hit > 0"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.pareto_mix(spark, docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]

#: The line stage's rolling hash and the near-dedup's links have no plain SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = store.cut(stage(spark, docs, sf_dir), name)
        if k:
            store.drop(STAGES[k - 1][0])
    return docs
