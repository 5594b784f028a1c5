"""Studies over many queries: depth grids, approximate-search frontiers, weight sweeps, imputation legs, reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import imputation, metrics, rollup, setops, vectors
from ..operators.filters import IdFilter
from ..sources.lake import Lake
from . import costs
from . import nodes as N
from .planner import Engine


@dataclass
class Matrix:
    """Tasks by methods by repeats; a leg that fails is recorded and the others go on."""

    legs: dict[tuple[str, str], Callable[[], DataFrame]]
    repeats: int = 3
    skipped: list[tuple[str, str, str]] = field(default_factory=list)

    def run(self) -> list[dict]:
        out = []
        for (task, method), leg in self.legs.items():
            try:
                took = []
                for _ in range(self.repeats):
                    start = time.perf_counter()
                    n = leg().count()
                    took.append(time.perf_counter() - start)
            except Exception as e:
                self.skipped.append((task, method, str(e)[:200]))
                continue
            out.append({"task": task, "method": method, "rows": n, "seconds": sorted(took)[len(took) // 2]})
        return out


def depth_grid(hits: DataFrame, truth: DataFrame, fetches: Sequence[int], votes: Sequence[int], k: int) -> DataFrame:
    """Recall of table rankings at each fetch and vote depth, from one deep fetch of
    ``query, query_col, r, table_id, distance``. ``full``: the share of columns with that many hits."""
    spark = hits.sparkSession
    grid = spark.createDataFrame([(f, v) for f in fetches for v in votes if v <= f], "fetch int, vote int")
    h = hits.join(F.broadcast(grid), F.least("fetch", "vote") > F.col("r")).withColumn("query", F.struct("query", "fetch", "vote"))
    ranked = rollup.ranked(rollup.decay_vote(h), k).select(F.col("query.query").alias("query"), F.col("query.fetch").alias("fetch"), F.col("query.vote").alias("vote"), F.col("table_id").alias("item"))
    size = truth.groupBy("query").agg(F.countDistinct("item").alias("n"))
    found = ranked.join(truth.distinct(), ["query", "item"]).groupBy("query", "fetch", "vote").agg(F.count("*").alias("hit"))
    each = size.join(F.broadcast(grid), F.lit(True)).join(found, ["query", "fetch", "vote"], "left")
    filled = hits.groupBy("query", "query_col").agg(F.count("*").alias("c")).join(F.broadcast(grid), F.lit(True)).groupBy("fetch", "vote").agg(F.avg((F.col("c") >= F.col("fetch")).cast("double")).alias("full"))
    return each.groupBy("fetch", "vote").agg(F.avg(F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall")).join(filled, ["fetch", "vote"])


def ann_frontier(queries: DataFrame, stored: DataFrame, k: int, settings: Sequence[tuple[int, int]]) -> DataFrame:
    """``refine, bits, recall, seconds`` of the approximate search against the exact one."""
    exact = vectors.nearest(queries, stored, k)
    rows = []
    for refine, bits in settings:
        start = time.perf_counter()
        r = vectors.recall(vectors.lsh_nearest(queries, stored, k, refine, bits), exact).first()["recall"]
        rows.append((refine, bits, float(r), time.perf_counter() - start))
    return queries.sparkSession.createDataFrame(rows, "refine int, bits int, recall double, seconds double")


def fusion_sweep(first: DataFrame, second: DataFrame, truth: DataFrame, k: int, steps: int = 10) -> DataFrame:
    """``weight, recall`` for reciprocal-rank fusion of two runs ``(query, rank, item)`` at each weight
    from 0 to 1, all at once."""
    spark = first.sparkSession
    w = spark.createDataFrame([(i / steps,) for i in range(steps + 1)], "weight double")
    rows = first.withColumn("second", F.lit(0)).unionByName(second.withColumn("second", F.lit(1))).join(F.broadcast(w), F.lit(True))
    s = F.when(F.col("second") == 1, F.col("weight")).otherwise(1 - F.col("weight")) / (60 + F.col("rank"))
    scored = rows.groupBy("weight", "query", "item").agg(F.sum(s).alias("score"), F.min(F.struct("second", "rank")).alias("f")).where("score > 0")
    order = Window.partitionBy("weight", "query").orderBy(F.desc("score"), "f", "item")
    top = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    t = truth.select("query", "item").distinct()
    size = t.groupBy("query").agg(F.count("*").alias("n"))
    hit = top.join(t, ["query", "item"]).groupBy("weight", "query").agg(F.count("*").alias("h"))
    return size.join(F.broadcast(w), F.lit(True)).join(hit, ["weight", "query"], "left").groupBy("weight").agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))


def difficulty(semantic: DataFrame, exact: DataFrame) -> DataFrame:
    """``query, semantic, exact, bucket`` from two tables ``(query, recall)``: who finds the query's items."""
    j = semantic.withColumnRenamed("recall", "semantic").join(exact.withColumnRenamed("recall", "exact"), "query", "full").na.fill(0.0)
    b = F.when((F.col("semantic") > 0) & (F.col("exact") > 0), "both").when(F.col("semantic") > 0, "semantic").when(F.col("exact") > 0, "exact").otherwise("neither")
    return j.withColumn("bucket", b)


def assisted(engine: Engine, semantic: N.Node, words, k: int) -> dict[str, DataFrame]:
    """A semantic search alone, within, with and without a keyword search's tables."""
    kw = N.Keyword(words, k=k)
    return {
        "alone": engine.run(semantic.cut(k)), "within": engine.run(N.Intersection((kw, semantic), k=k, fixed=True)),
        "with": engine.run(N.Union((semantic, kw), k=k)), "without": engine.run(N.Difference((semantic, kw), k=k)),
    }


def column_variants(engine: Engine, df: DataFrame, k: int) -> dict[str, N.Node]:
    """Union search by column overlap: by rank, by votes, with ten times deeper inputs, and text columns only."""
    legs = lambda cols, n: tuple(N.SingleColumn(df.select(f"`{c}`"), k=n) for c in cols)
    text = [c for c, t in df.dtypes if t == "string"] or df.columns
    return {"plain": N.Union(legs(df.columns, k), k=k), "votes": N.Counter(legs(df.columns, k), k=k), "deep": N.Counter(legs(df.columns, 10 * k), k=k), "text": N.Counter(legs(text, k), k=k)}


def imputation_legs(engine: Engine, examples: DataFrame, keys: DataFrame, truth: DataFrame, ks: Sequence[int], largest_scan: float | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """``leg, k, n_keys, n_covered, n_correct, coverage, accuracy`` of retrieval by rows, by key column,
    and by both. ``examples(k, v)``, ``keys(k)`` and ``truth(k, v)`` are tokens. Queries whose scan by
    rows would be larger than ``largest_scan`` run by key column only."""
    k_max, spark = max(ks), engine.lake.spark
    mc, sc = N.MultiColumn(examples.select("k", "v"), k=k_max), N.SingleColumn(keys.select("k"), k=k_max)
    legs: dict[str, N.Node] = {"rows": mc, "keys": sc, "both": N.Intersection((mc.cut(10 * k_max), sc.cut(30 * k_max)), k=k_max)}
    if largest_scan is not None:
        ex = examples.select(F.lit(0).alias("col"), F.col("k").alias("token")).unionByName(examples.select(F.lit(1).alias("col"), F.col("v").alias("token")))
        if imputation.scan_cost(ex, frequencies).first()["scan_rows"] > largest_scan:
            legs = {"keys": sc}
    # k_max tables at most of each leg; what a table says of a key does not depend on the leg or its rank.
    found = {name: engine.ids(node) for name, node in legs.items()}
    said = imputation.answers(engine.lake.by_token(), engine.lake.by_row(), sorted(set().union(*found.values())), examples, truth.select("k"))
    out = None
    for name, ids in found.items():
        ranking = setops.values(spark, ids)
        for k in ks:
            s = imputation.score(imputation.majority(said, setops.cut(ranking, k)), truth).select(F.lit(name).alias("leg"), F.lit(k).alias("k"), "*")
            out = s if out is None else out.unionByName(s)
    return out if out is not None else spark.createDataFrame([], "leg string, k int")


def leakage(found: DataFrame, allowed: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """``recall, leaked``: of the exact filtered top ``k`` how many were found, and results outside the filter."""
    top = found.where(F.col("rank") < k)
    hit = exact.where(F.col("rank") < k).select("table_id").join(top.select("table_id").distinct().withColumn("h", F.lit(1)), "table_id", "left").agg((F.count("h") / F.count("*")).alias("recall"))
    out = top.join(allowed.select("table_id"), "table_id", "left_anti").agg(F.count("*").alias("leaked"))
    return hit.join(F.broadcast(out), F.lit(True))


def filtered_recall(engine: Engine, node: N.SemanticUnion, allowed: Sequence[int], k: int) -> DataFrame:
    """What filtering after the search loses against filtering before it."""
    keep = IdFilter.of(allow=allowed)
    before, after = (engine.build(replace(node, k=k, prefilter=p), keep) for p in (True, False))
    return leakage(after, engine.lake.spark.createDataFrame([(int(a),) for a in allowed], "table_id int"), before, k)


def cost_report(samples: DataFrame) -> DataFrame:
    """``kind, n, median, cost``: runtimes of leaf searches as whole-number costs."""
    m = costs.censored_quantiles(samples, (0.5,)).select("kind", "n", F.col("`q0.5`").alias("median")).where("median is not null")
    return m.join(costs.cost_integers(m.select("kind", "median")), "kind")


def calibrate(lake: Lake, seekers: dict[str, list[N.Node]], engine: Engine, repeats: int = 1, limit: float = 60.0) -> DataFrame:
    """Measure leaf searches of each kind: ``kind, seconds, outcome``."""
    rows = []
    for kind, nodes in seekers.items():
        for node in nodes:
            seconds, outcome = costs.measure(lambda n=node: engine.scored(n).count(), repeats, limit)
            rows.append((kind, float(seconds), outcome))
    return lake.spark.createDataFrame(rows, "kind string, seconds double, outcome string")


def evaluate(runs: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Means of all metrics at each depth, with the ceilings."""
    means = metrics.mean_at_depths(metrics.at_depths(runs, truth, ks))
    return means.join(metrics.ceilings(truth, ks), "k")
