"""Frequencies, measured runtimes and cost models of leaf searches."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_dir
from .nodes import Node

FEATURES = ("rows", "frequency", "columns")


def features(columns: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``rows, frequency, columns`` of each query ``(query, qid, col, token)``: different rows, the
    geometric mean over columns of the summed frequencies of their tokens, number of columns."""
    per = columns.select("query", "col", "token").distinct().join(frequencies, "token", "left").groupBy("query", "col").agg(F.coalesce(F.sum(F.when(F.col("token") != "", F.col("n"))), F.lit(0)).alias("f"))
    mean = per.groupBy("query").agg(F.when(F.min("f") > 0, F.exp(F.avg(F.log("f")))).otherwise(0.0).alias("frequency"), F.count("*").alias("columns"))
    rows = columns.groupBy("query", "qid").agg(F.sort_array(F.collect_list(F.struct("col", "token"))).alias("row")).groupBy("query").agg(F.countDistinct("row").alias("rows"))
    return rows.join(mean, "query").select("query", "rows", "frequency", "columns")


# -- measured runtimes -------------------------------------------------------------------------


def measure(run: Callable[[], object], repeats: int = 3, limit: float = math.inf) -> tuple[float, str]:
    """Median seconds after a warm-up, and ``ok``, ``censored`` (over the limit) or ``error``."""
    took = []
    try:
        run()
        for _ in range(repeats):
            start = time.perf_counter()
            run()
            took.append(time.perf_counter() - start)
            if took[-1] > limit:
                return limit, "censored"
    except Exception:
        return math.nan, "error"
    return float(np.median(took)), "ok"


def with_deadline(df: DataFrame, seconds: float, tag: str) -> list:
    """Collect under a job tag that is cancelled after ``seconds``."""
    import threading

    sc = df.sparkSession.sparkContext
    timer = threading.Timer(seconds, lambda: sc.cancelJobsWithTag(tag))
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def censored_quantiles(samples: DataFrame, qs: Sequence[float] = (0.5,), by: Sequence[str] = ("kind",)) -> DataFrame:
    """Quantiles of ``seconds`` where samples with outcome ``censored`` count as larger than all
    others; null where a quantile falls among them. ``error`` samples do not count."""
    s = samples.where("outcome in ('ok', 'censored')")
    w = Window.partitionBy(*by).orderBy((F.col("outcome") == "censored"), "seconds")
    r = s.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    out = []
    for q in qs:
        pos = F.lit(float(q)) * (F.col("n") - 1)
        at = lambda p: F.max(F.when((F.col("i") == p) & (F.col("outcome") == "ok"), F.col("seconds")))
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        share = F.lit(float(q)) * (F.first("n") - 1)
        out.append((lo + (share - F.floor(share)) * (hi - lo)).alias(f"q{q:g}"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), *out)


def cost_integers(medians: DataFrame) -> DataFrame:
    """``kind, cost``: medians as multiples of the least, rounded half to even, 1 at least."""
    low = medians.agg(F.min("median").alias("low"))
    return medians.join(F.broadcast(low), F.lit(True)).select("kind", F.greatest(F.lit(1), F.bround(F.col("median") / F.col("low")).cast("int")).alias("cost"))


def crossover(curve: DataFrame, ann_seconds: float) -> DataFrame:
    """The largest number of columns for which the exact search is no slower, and the mean of the
    better of both over the curve ``(columns, seconds)``."""
    return curve.agg(F.coalesce(F.max(F.when(F.col("seconds") <= ann_seconds, F.col("columns"))), F.lit(0)).alias("crossover"), F.avg(F.least("seconds", F.lit(float(ann_seconds)))).alias("best_mean"))


# -- fitted models -----------------------------------------------------------------------------


def fit_line(points: DataFrame, x: str, y: str, per: str | None = None) -> DataFrame:
    """``beta, alpha`` of ``y / per = beta + alpha * x``."""
    v = F.col(y) / F.greatest(F.col(per), F.lit(1)) if per else F.col(y)
    s = points.select(F.col(x).cast("double").alias("x"), v.cast("double").alias("y")).agg(F.regr_intercept("y", "x").alias("b"), F.regr_slope("y", "x").alias("a"), F.avg("y").alias("m"))
    return s.select(F.coalesce("b", "m").alias("beta"), F.coalesce("a", F.lit(0.0)).alias("alpha"))


def normal_equations(points: DataFrame, design: Sequence, y: str) -> np.ndarray:
    """Least squares from sums only: the products of the design's columns are aggregated in Spark."""
    k = len(design)
    cols = [c.cast("double") for c in design]
    sums = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(cols[i] * F.col(y)).alias(f"b{i}") for i in range(k)]
    r = points.agg(*sums).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(k)], float), rcond=None)[0]


def fit_unfiltered(points: DataFrame, form: str) -> dict[str, float]:
    """``points(n_cols, k_coarse, ms)``: all columns' search is bilinear in columns and depth, one
    column's linear in depth."""
    n, kc = F.col("n_cols"), F.col("k_coarse")
    design, names = {"union": ([F.lit(1.0), n, kc, n * kc], ("a", "b", "c", "d")), "join": ([F.lit(1.0), kc], ("a", "c"))}[form]
    return dict(zip(names, normal_equations(points, design, "ms").tolist(), strict=True))


def predict_unfiltered(coef: dict[str, float], n_cols: float, k_coarse: float) -> float:
    return coef["a"] + coef.get("b", 0.0) * n_cols + coef["c"] * k_coarse + coef.get("d", 0.0) * n_cols * k_coarse


def predict_filtered(n_cols: int, allowed: int, beta: float, alpha: float, flip: int | None, ann: float) -> float:
    """Exact up to ``flip`` allowed columns, then the approximate search's cost for each column."""
    return n_cols * (ann if flip is not None and allowed > flip else beta + alpha * allowed)


def noise_ceiling(points: DataFrame, keys: Sequence[str], y: str = "ms") -> DataFrame:
    """The share of variance that repeated measurements leave to be explained."""
    g = points.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop(y).alias("v"))
    within = g.agg(F.sum(F.when(F.col("n") > 1, F.col("v") * F.col("n"))).alias("ss"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1)).alias("dof"), F.count_if(F.col("n") > 1).alias("replicated"))
    total = points.agg(F.var_pop(y).alias("var"))
    return within.join(F.broadcast(total), F.lit(True)).select(F.round(F.greatest(F.lit(0.0), 1 - F.col("ss") / F.col("dof") / F.col("var")), 6).alias("ceiling_r2"), "replicated")


def train(samples: DataFrame, iterations: int = 20):
    """A gradient-boosted model of ``seconds`` from FEATURES."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(samples).select("x", F.col("seconds").cast("double").alias("y"))
    return GBTRegressor(featuresCol="x", labelCol="y", maxIter=iterations, seed=1).fit(data)


def with_prediction(node: Node, seconds: float) -> Node:
    """The node with a predicted runtime, which decides between inputs of equal cost."""
    return replace(node, predicted=seconds)


# -- profiles ----------------------------------------------------------------------------------


def save_profile(spark, name: str, profile: dict, folder: str | None = None) -> str:
    path = f"{folder or shared_dir(spark)}/profiles/{name}"
    spark.createDataFrame([(json.dumps(profile, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_profile(spark, name: str, folder: str | None = None) -> dict:
    return json.loads(spark.read.text(f"{folder or shared_dir(spark)}/profiles/{name}").first()["value"])


def regret(pairs: DataFrame) -> DataFrame:
    """Of pairs ``(cost_a, cost_b, ms_a, ms_b)``: how often the cheaper by cost was faster, and the mean
    time lost against the better of both and against a coin."""
    pick = F.when(F.col("cost_a") <= F.col("cost_b"), F.col("ms_a")).otherwise(F.col("ms_b"))
    best = F.least("ms_a", "ms_b")
    return pairs.agg(F.count("*").alias("n"), F.avg((pick == best).cast("double")).alias("right"), F.avg(pick - best).alias("regret"), F.avg((F.col("ms_a") + F.col("ms_b")) / 2 - pick).alias("gain_over_coin"))
