"""Rankings combined: votes, fusion, set operations and repairs. A ranking is ``rank, table_id, ...``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def values(spark: SparkSession, ids: Sequence[int]) -> DataFrame:
    """A ranking given by hand; of a repeated id the first place counts."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(ids))], "rank int, table_id int")


def distinct_tables(r: DataFrame) -> DataFrame:
    """Each table once, at its best rank; places close up."""
    return ranked(r.groupBy("table_id").agg(F.min("rank").alias("r")), "r", "table_id").select("rank", "table_id")


def union(legs: Sequence[DataFrame], k: int | None = None) -> DataFrame:
    """Different tables of all rankings, by best rank, then leg, then id."""
    rows = reduce(DataFrame.unionAll, [leg.select("table_id", F.col("rank").alias("r"), F.lit(i).alias("leg")) for i, leg in enumerate(legs)])
    best = rows.groupBy("table_id").agg(F.min(F.struct("r", "leg")).alias("b"))
    best = best.orderBy("b", "table_id").limit(k) if k is not None else best
    return ranked(best, "b", "table_id").select("rank", "table_id")


def counter(legs: Sequence[DataFrame], k: int | None = None) -> DataFrame:
    """Tables by votes; each row of a ranking is a vote."""
    votes = reduce(DataFrame.unionAll, [leg.select("table_id") for leg in legs]).groupBy("table_id").agg(F.count("*").alias("score"))
    votes = votes.orderBy(F.desc("score"), "table_id").limit(k) if k is not None else votes
    return ranked(votes, F.desc("score"), "table_id")


def pure_intersection(legs: Sequence[DataFrame]) -> DataFrame:
    """Tables of the first ranking that all others have, in its order: no pushdown."""
    out = legs[0]
    for leg in legs[1:]:
        out = out.join(leg.select("table_id").distinct(), "table_id", "left_semi")
    return distinct_tables(out)


def pure_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return distinct_tables(left.join(right.select("table_id").distinct(), "table_id", "left_anti"))


def fusion(legs: Sequence[DataFrame], weights: Sequence[float] | None = None, constant: float = 60.0, k: int | None = None) -> DataFrame:
    """Reciprocal ranks: the sum of ``weight / (constant + rank)``; ties by first leg, then its rank."""
    weights = weights or [1.0] * len(legs)
    rows = reduce(DataFrame.unionAll, [leg.select("table_id", (F.lit(float(w)) / (F.lit(float(constant)) + F.col("rank"))).alias("s"), F.lit(i).alias("leg"), F.col("rank").alias("r")) for i, (leg, w) in enumerate(zip(legs, weights, strict=True))])
    sums = rows.groupBy("table_id").agg(F.sum("s").alias("score"), F.min(F.struct("leg", "r")).alias("first"))
    sums = sums.orderBy(F.desc("score"), "first").limit(k) if k is not None else sums
    return ranked(sums, F.desc("score"), "first").select("rank", "table_id", "score")


def repair(found: DataFrame, truth: DataFrame, extra: DataFrame | None = None, flagged: DataFrame | None = None) -> DataFrame:
    """What an oracle with a keyword search could mend: true tables of ``extra`` that were missed are
    appended, and wrong tables that are ``flagged`` are taken out."""
    out = found.select("table_id", "rank", F.lit(0).alias("leg"))
    if flagged is not None:
        wrong = found.select("table_id").join(truth.select("table_id"), "table_id", "left_anti").join(flagged.select("table_id"), "table_id", "left_semi").distinct()
        out = out.join(wrong, "table_id", "left_anti")
    if extra is not None:
        missed = extra.join(found.select("table_id"), "table_id", "left_anti").join(truth.select("table_id"), "table_id", "left_semi")
        out = out.unionByName(missed.select("table_id", "rank", F.lit(1).alias("leg")))
    return ranked(out.groupBy("table_id").agg(F.min(F.struct("leg", "rank")).alias("b")), "b", "table_id").select("rank", "table_id")


def cut(r: DataFrame, k: int, tables: bool = False) -> DataFrame:
    """The first ``k`` places; with ``tables`` the first ``k`` different tables."""
    r = distinct_tables(r) if tables else r
    return r.where(F.col("rank") < k)
