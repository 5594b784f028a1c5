"""Searches judged against a truth: one more result is asked for, the query's own table is dropped, then the cut."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from time import perf_counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.storage import small
from .nodes import Node
from .planner import Engine


def without_self(runs: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """``query, rank, item`` without the pairs of ``own(query, item)``, ranked anew and cut at ``k``."""
    left = runs.join(small(own.select("query", "item").distinct()), ["query", "item"], "left_anti")
    again = F.row_number().over(Window.partitionBy("query").orderBy("rank", "item")) - 1
    return left.withColumn("rank", again).where(F.col("rank") < k).select("query", "rank", "item")


def scores(runs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``query, n_relevant, n_retrieved, hits, precision, recall, ap, reciprocal_rank, hit`` of every query with a truth."""
    j = metrics.judged(runs, truth).groupBy("query").agg(F.first("n_rel").alias("n_relevant"), F.count("rank").alias("n_retrieved"), F.coalesce(F.max("hits"), F.lit(0)).alias("hits"))
    depth = metrics.at_depths(runs, truth, [k]).select("query", "precision", "recall", "reciprocal_rank", "hit")
    return j.join(depth, "query").join(metrics.average_precision(runs, truth), "query")


def evaluate(engine: Engine, plans: Mapping[int, Callable[[int], Node]], truth: DataFrame, k: int = 10) -> tuple[DataFrame, dict]:
    """Runs ``plans`` (a plan for a depth, by the query's table id) at ``k + 1`` and judges them.

    Queries whose table is not in the lake or that have no relevant table in it are skipped. Returns
    the scores of each query with its ``runtime_ms``, and their means. At most ``k + 1`` ids of a query
    come to the driver.
    """
    spark = engine.lake.spark
    there = range(len(engine.lake.names))
    known = truth.where(F.col("query").isin(list(plans)) & F.col("item").between(0, len(there) - 1) & (F.col("query") != F.col("item"))).select(F.col("query").cast("long").alias("query"), F.col("item").cast("long").alias("item")).distinct()
    judged = {r.query for r in known.select("query").distinct().collect()}
    found, times, began = [], [], perf_counter()
    for q in sorted(judged.intersection(there)):
        t = perf_counter()
        ids = engine.ids(plans[q](k + 1))
        times.append((q, (perf_counter() - t) * 1000))
        found += [(q, rank, table) for rank, table in enumerate(ids)]
    wall = perf_counter() - began
    runs = spark.createDataFrame(found, "query long, rank int, item long")
    timed = spark.createDataFrame(times, "query long, runtime_ms double")
    own = timed.select("query", F.col("query").alias("item"))
    rows = scores(without_self(runs, own, k), known.join(own.select("query"), "query", "left_semi"), k).join(timed, "query")
    means = {name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for name, c in (("mean_precision", "precision"), ("mean_recall", "recall"), ("map", "ap"), ("mrr", "reciprocal_rank"))}
    summary = rows.agg(*means.values()).first().asDict()
    return rows, summary | {"evaluated": len(times), "skipped": len(plans) - len(times), "total_queries": len(plans), "wall_s": wall}
