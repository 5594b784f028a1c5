"""Widening a table by tables that a search found: union by best columns, joins by modes and means.

Columns are matched by the distinct values they share, compared as strings; of equal ones the first
column of the found table counts. Nulls match nothing. What comes to the driver is one number for each
pair of columns. Groups are combined before their shuffles, and a found table has one row for each key
when it is joined, so a hot key multiplies nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import small


def _values(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])
    return df.select(F.explode(pairs).alias("x")).where("x.v is not null").select(F.col("x.i").alias(name), F.col("x.v").alias("v")).distinct()


def best_columns(query: DataFrame, found: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """For each of the query's ``columns`` (all by default) the column of ``found`` that shares most values."""
    columns = list(columns or query.columns)
    shared = _values(query, columns, "q").join(_values(found, found.columns, "f"), "v").groupBy("q", "f").agg(F.count("*").alias("n"))
    n = {(r.q, r.f): r.n for r in shared.collect()}
    return {c: found.columns[max(range(len(found.columns)), key=lambda f: n.get((q, f), 0))] for q, c in enumerate(columns)}


def union_by_overlap(query: DataFrame, found: DataFrame) -> DataFrame:
    """The query's rows and those of ``found``, in the query's columns and types; values that have not the type are null."""
    best, types = best_columns(query, found), dict(query.dtypes)
    return query.unionByName(found.select(*[F.col(f"`{best[c]}`").try_cast(types[c]).alias(c) for c in query.columns]))


def modes(df: DataFrame, key: str) -> DataFrame:
    """One row for each key that is not null: the most frequent value of every other column, the least of equally
    frequent ones, null if it has none. Values are counted before they are compared, so no state grows with a group."""
    rest = [c for c in df.columns if c != key]
    one = lambda i: F.struct(F.lit(i).alias("i"), *[(F.col(f"`{c}`") if i == j else F.lit(None).cast(df.schema[c].dataType)).alias(f"v{j}") for j, c in enumerate(rest)])
    rows = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.explode(F.array(F.struct(F.lit(-1).alias("i"), *[F.lit(None).cast(df.schema[c].dataType).alias(f"v{j}") for j, c in enumerate(rest)]), *map(one, range(len(rest))))).alias("x")).select("key", "x.*")
    counts = rows.groupBy("key", "i", *[f"v{j}" for j in range(len(rest))]).agg(F.count("*").alias("n"))
    best = [F.min_by(f"v{j}", F.when((F.col("i") == j) & F.col(f"v{j}").isNotNull(), F.struct(-F.col("n"), f"v{j}"))).alias(c) for j, c in enumerate(rest)]
    return counts.groupBy(F.col("key").alias(key)).agg(F.max("n").alias("_n"), *best).drop("_n")


def means(df: DataFrame, key: str) -> DataFrame:
    """One row for each key that is not null: the mean of every other column that holds a number; the others go."""
    rest = [c for c in df.columns if c != key]
    numbers = df.select(F.col(f"`{key}`"), *[F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in rest])
    have = numbers.agg(*[F.count(f"`{c}`").alias(c) for c in rest]).first() if rest else {}
    kept = [c for c in rest if have[c]]
    grouped = numbers.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key))
    return grouped.agg(F.count("*").alias("_n"), *[F.avg(f"`{c}`").alias(c) for c in kept]).drop("_n")


def _left(query: DataFrame, key: str, other: DataFrame, at: str, suffix: str) -> DataFrame:
    rest = [c for c in other.columns if c != at]
    side = other.select(F.col(f"`{at}`").cast("string").alias("_key"), *[F.col(f"`{c}`").alias(c + suffix if suffix == "_join" or c in query.columns else c) for c in rest])
    return query.withColumn("_key", F.col(f"`{key}`").cast("string")).join(small(side), "_key", "left").drop("_key")


def join_modes(query: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Every row of the query with the modes of ``found`` for its key, in columns that end in ``_join``."""
    at = best_columns(query, found, [key])[key]
    return _left(query, key, modes(found, at), at, "_join")


def join_means(query: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Every row of the query with the means of ``found`` for its key; a clashing name gets ``_correlation``."""
    at = best_columns(query, found, [key])[key]
    return _left(query, key, means(found, at), at, "_correlation")
