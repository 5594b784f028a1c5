"""Columns' hits to tables: decaying votes, best similarity, assignment.

Hits are ``query, query_col, r, table_id, distance`` with ``r`` from 0 by growing distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAME = 1e-6


def decay_vote(hits: DataFrame, k_vote: int | None = None) -> DataFrame:
    """A column's first hit votes with the number of its hits; the vote falls by one wherever the
    distance changes by more than SAME. Ties go to the table seen first (by column, then rank)."""
    h = hits if k_vote is None else hits.where(F.col("r") < k_vote)
    col = Window.partitionBy("query", "query_col")
    step = F.coalesce((F.abs(F.col("distance") - F.lag("distance").over(col.orderBy("r"))) > SAME).cast("int"), F.lit(0))
    h = h.withColumn("_step", step).withColumn("_n", F.count("*").over(col))
    h = h.withColumn("vote", F.col("_n") - F.sum("_step").over(col.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    return h.groupBy("query", "table_id").agg(F.sum("vote").cast("long").alias("score"), F.min(F.struct("query_col", "r")).alias("first"))


def max_pool(hits: DataFrame) -> DataFrame:
    """A table's best similarity (distance is its negative); ties by table."""
    return hits.groupBy("query", "table_id").agg((-F.min("distance")).alias("score"))


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """A maximum-weight matching of rows to columns by growing shortest augmenting paths."""
    flip = weights.shape[0] > weights.shape[1]
    w = weights.T if flip else weights
    top = w.max(initial=0.0)
    return [(j, i) if flip else (i, j) for i, j in _matched(*w.shape, lambda i: top - w[i])]


def assigned_cosines(a: np.ndarray, b: np.ndarray, threshold: float) -> list[float]:
    """The cosines above the threshold of the best assignment of unit vectors; no matrix of all pairs is held."""
    if len(a) > len(b):
        a, b = b, a
    top = max((float((a[i : i + 64] @ b.T).max(initial=0.0)) for i in range(0, len(a), 64)), default=0.0)
    top = top if top > threshold else 0.0

    def cost(i: int) -> np.ndarray:
        cos = b @ a[i]
        return top - np.where(cos > threshold, cos, 0.0)

    cosines = (float(b[j] @ a[i]) for i, j in _matched(len(a), len(b), cost))
    return [x for x in cosines if x > threshold]


def _matched(rows: int, cols: int, cost: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """A matching of least cost of ``rows`` to at least as many columns; ``cost`` gives a row's costs."""
    u, v = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        dist, via, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        row, reached, last = start, 0.0, -1
        while True:
            slack = reached + cost(row) - u[row] - v
            better = ~done & (slack < dist)
            dist[better], via[better] = slack[better], last
            last = int(np.argmin(np.where(done, np.inf, dist)))
            reached, done[last] = dist[last], True
            if owner[last] < 0:
                break
            row = owner[last]
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                u[owner[j]] += reached - dist[j]
            v[j] -= reached - dist[j]
        u[start] += reached
        while last >= 0:
            back = via[last]
            owner[last] = owner[back] if back >= 0 else start
            last = back
    return [(i, j) for j, i in enumerate(owner.tolist()) if i >= 0]


def munkres(queries: DataFrame, candidates: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``query, table_id, score``: the sum of the assigned cosines above the threshold, over the best
    assignment of the query's columns to the candidate's.

    ``queries(query, embedding)`` and ``vectors(table_id, embedding)`` hold unit vectors;
    ``candidates(query, table_id)`` says what is scored. A group is one pair of tables.
    """
    q = queries.groupBy("query").agg(F.collect_list("embedding").alias("qs"))
    c = vectors.groupBy("table_id").agg(F.collect_list("embedding").alias("cs"))
    pairs = candidates.select("query", "table_id").distinct().join(q, "query").join(c, "table_id")

    def score(batches):
        for pdf in batches:
            out = []
            for query, table, qs, cs in zip(pdf["query"], pdf["table_id"], pdf["qs"], pdf["cs"], strict=True):
                kept = assigned_cosines(np.array([np.asarray(x, float) for x in qs]), np.array([np.asarray(x, float) for x in cs]), threshold)
                if kept:
                    out.append((query, table, sum(kept)))
            yield pd.DataFrame(out, columns=["query", "table_id", "score"]).astype({"query": "int64", "table_id": "int32", "score": "float64"})

    return pairs.select(F.col("query").cast("long"), F.col("table_id").cast("int"), "qs", "cs").mapInPandas(score, "query long, table_id int, score double")


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """``rank`` of each query's tables from 0."""
    ties = ["first"] if "first" in scores.columns else []
    w = Window.partitionBy("query").orderBy(F.desc("score"), *ties, "table_id")
    out = scores.withColumn("rank", F.row_number().over(w) - 1)
    return out if k is None else out.where(F.col("rank") < k)
