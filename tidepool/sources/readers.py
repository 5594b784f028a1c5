"""Other corpus layouts, query and truth files, and run outputs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import read_csv
from .storage import exists


def relation_chunks(spark: SparkSession, path: str, max_columns: int = 100) -> DataFrame:
    """Web tables in JSON lines whose ``relation`` lists columns: ``chunk, colid, rowid, value``.
    Tables of more than ``max_columns`` columns are left out, as the layout's definition says."""
    rows = spark.read.schema("relation array<array<string>>").json(path).where(F.size("relation") <= max_columns)
    rows = rows.select(F.monotonically_increasing_id().alias("chunk"), F.posexplode("relation").alias("colid", "cells"))
    return rows.select("chunk", "colid", F.posexplode("cells").alias("rowid", "value"))


def parquet_chunks(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """One table for each Parquet file, by base name."""
    return {p.rstrip("/").rsplit("/", 1)[-1]: spark.read.parquet(p) for p in sorted(paths)}


def union_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, strings=True).select("query_table").distinct()


def join_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, strings=True).select("query_table", "query_column").distinct()


def ground_truth(spark: SparkSession, path: str, lake_names: DataFrame | None = None) -> DataFrame:
    """Truth pairs without self pairs; with ``lake_names(name)`` only pairs of known tables."""
    t = read_csv(spark, path, strings=True).where("query_table <> candidate_table").distinct()
    if lake_names is not None:
        for side in ("query_table", "candidate_table"):
            t = t.join(F.broadcast(lake_names.select(F.col("name").alias(side))), side, "left_semi")
    return t


def write_run(spark: SparkSession, folder: str, manifest: dict, aggregate: DataFrame, per_query: DataFrame) -> None:
    """A run folder: the manifest as one JSON document, aggregate rows as JSON lines and CSV, per-query rows as Parquet."""
    text = json.dumps(manifest, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    aggregate.coalesce(1).write.mode("overwrite").json(f"{folder}/aggregate.json")
    aggregate.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/results.csv")
    per_query.write.mode("overwrite").parquet(f"{folder}/per_query.parquet")


class RunLog:
    """Appended measurements with summaries."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def log(self, *rows: tuple) -> None:
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def averages(self) -> DataFrame:
        numbers = [c for c, t in self.read().dtypes if t in ("int", "bigint", "double", "float")]
        return self.read().agg(*[F.avg(c).alias(c) for c in numbers])


def storage_audit(spark: SparkSession, folder: str) -> DataFrame:
    """``name, files, bytes`` of every table below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for s in fs.listStatus(path):
        c = fs.getContentSummary(s.getPath())
        rows.append((s.getPath().getName(), int(c.getFileCount()), int(c.getLength())))
    return spark.createDataFrame(sorted(rows), "name string, files long, bytes long")


def slug(text: str) -> str:
    """A name that is safe in a path."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip("-") or "run"
