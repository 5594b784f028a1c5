"""Retrieval metrics over all queries at once.

Runs are ``query, rank, item`` with ranks from 0; truth is ``query, item``. Truth decides which
queries count: one without results scores as if it had found nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import small

# The depths that are reported.
DEPTHS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 24, 25, 36, 48, 50, 60, 75, 100, 130, 150)
STRATA = (0.0, 0.1, 0.3, 0.5, 1.0)


def judged(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """The runs with ``rel``, ``hits`` so far, and each query's ``n_rel``; of a repeated item the
    places count each."""
    t = truth.select("query", "item").distinct()
    sizes = t.groupBy("query").agg(F.count("*").alias("n_rel"))
    j = runs.join(t.withColumn("rel", F.lit(1)), ["query", "item"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("hits", F.sum("rel").over(w)).join(sizes, "query", "right").select("query", "rank", "item", "rel", "hits", "n_rel")


def at_depths(runs: DataFrame, truth: DataFrame, ks: Sequence[int] = DEPTHS) -> DataFrame:
    """``query, k, precision, recall, ndcg, ap, mean_precision, precision_found, reciprocal_rank, hit, f1``.

    ``precision`` divides by k, ``precision_found`` by the number of results; ``ap`` divides by
    min(n_rel, k); ``mean_precision`` is the mean of the precisions at 1 to k.
    """
    j = judged(runs, truth)
    depth = j.sparkSession.createDataFrame([(k,) for k in sorted(set(ks))], "k int")
    last = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumns({
        "gain": F.sum(F.col("rel") / F.log2(F.col("rank") + 2)).over(last),
        "prec": F.sum(F.col("rel") * F.col("hits") / (F.col("rank") + 1)).over(last),
        "mean": F.sum(F.col("hits") / (F.col("rank") + 1)).over(last),
        "firsthit": F.min(F.when(F.col("rel") == 1, F.col("rank") + 1)).over(last),
    })
    # What a query has at depth k stands on its last place below k.
    g = j.join(F.broadcast(depth), F.coalesce("rank", F.lit(0)) < F.col("k")).groupBy("query", "k").agg(
        F.first("n_rel").alias("n_rel"), F.count("rank").alias("found"), F.coalesce(F.max("hits"), F.lit(0)).alias("hits"), F.coalesce(F.max("gain"), F.lit(0.0)).alias("gain"),
        F.coalesce(F.max("prec"), F.lit(0.0)).alias("prec"), F.coalesce(F.max("mean"), F.lit(0.0)).alias("mean"), F.min("firsthit").alias("firsthit"),
    )
    cap = F.least("n_rel", "k")
    ideal = F.aggregate(F.sequence(F.lit(1), cap.cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    # Beyond the last place the precisions go on falling with the hits that there are.
    beyond = F.when(F.col("k") > F.col("found"), F.aggregate(F.sequence(F.col("found").cast("int") + 1, F.col("k")), F.lit(0.0), lambda a, i: a + F.col("hits") / i)).otherwise(0.0)
    p, r = F.col("hits") / F.col("k"), F.col("hits") / F.col("n_rel")
    pf = F.when(F.col("found") > 0, F.col("hits") / F.col("found")).otherwise(0.0)
    return g.select(
        "query", "k", p.alias("precision"), r.alias("recall"), (F.col("gain") / ideal).alias("ndcg"), (F.col("prec") / cap).alias("ap"), ((F.col("mean") + beyond) / F.col("k")).alias("mean_precision"),
        pf.alias("precision_found"), F.coalesce(1 / F.col("firsthit"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("hits") > 0).cast("double").alias("hit"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
    )


def mean_at_depths(per_query: DataFrame) -> DataFrame:
    names = [c for c in per_query.columns if c not in ("query", "k")]
    return per_query.groupBy("k").agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in names])


def average_precision(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """``query, ap`` over whole rankings, divided by the number of relevant items."""
    return judged(runs, truth).groupBy("query").agg((F.coalesce(F.sum(F.col("rel") * F.col("hits") / (F.col("rank") + 1)), F.lit(0.0)) / F.first("n_rel")).alias("ap"))


def truth_density(truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean, nearest-rank median and 90th percentile, least and most relevant items of a query."""
    n = queries.select("query").distinct().join(truth.groupBy("query").agg(F.countDistinct("item").alias("n")), "query", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    # One number a query; sorted as counted groups, then read off at two places.
    hist = n.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(p) * F.col("all")), F.lit(1)), F.col("n"))).cast("double")
    return cum.agg(
        (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.min("n").cast("double").alias("min"), F.max("n").cast("double").alias("max"),
        F.sum("c").alias("n_queries"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("c"))), F.lit(0)).alias("n_queries_with_gt"),
    )


def ceilings(truth: DataFrame, ks: Sequence[int] = DEPTHS) -> DataFrame:
    """The best precision and recall that any ranking could reach at each depth."""
    n = truth.groupBy("query").agg(F.countDistinct("item").alias("n"))
    depth = n.sparkSession.createDataFrame([(k,) for k in sorted(set(ks))], "k int")
    return n.join(F.broadcast(depth), F.lit(True)).groupBy("k").agg(F.avg(F.least("n", "k") / F.col("k")).alias("precision_ceiling"), F.avg(F.least("n", "k") / F.col("n")).alias("recall_ceiling"))


def utilisation(means: DataFrame, best: DataFrame, n_queries: int, n_with_truth: int) -> DataFrame:
    """Achieved precision and recall as a share of the ceilings, corrected for queries without truth."""
    f = n_queries / n_with_truth if n_with_truth else None
    pct = lambda x, c: F.when(F.col(c) > 0, F.col(x) * F.lit(f) / F.col(c) * 100).otherwise(0.0)
    return means.join(best, "k").select("k", pct("precision", "precision_ceiling").alias("precision_pct"), pct("recall", "recall_ceiling").alias("recall_pct"))


def compared(arm: DataFrame, ref: DataFrame, p: float = 0.9) -> DataFrame:
    """Rankings compared query by query: ``retention`` (share of the reference's items kept),
    ``additions``, ``changed``, Jaccard ``distance``, and rank-biased overlap ``rbo``."""
    a, b = (x.groupBy("query", "item").agg(F.min("rank").alias(n)) for x, n in ((arm, "ra"), (ref, "rb")))
    both = a.join(b, ["query", "item"], "full")
    sets = both.groupBy("query").agg(F.count("ra").alias("na"), F.count("rb").alias("nb"), F.count(F.col("ra") + F.col("rb")).alias("n"))
    depth = arm.select("query", "rank").union(ref.select("query", "rank")).groupBy("query").agg((F.max("rank") + 1).alias("depth"))
    met = both.where("ra is not null and rb is not null").select("query", F.greatest("ra", "rb").alias("at")).groupBy("query", "at").agg(F.count("*").alias("c"))
    met = met.groupBy("query").agg(F.collect_list(F.struct("at", "c")).alias("met"))
    overlap = lambda d: F.aggregate(F.coalesce("met", F.array().cast("array<struct<at:int,c:bigint>>")), F.lit(0).cast("long"), lambda s, m: s + F.when(m["at"] <= d, m["c"]).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(0), F.col("depth") - 1), F.lit(0.0), lambda s, d: s + overlap(d) / (d + 1) * F.pow(F.lit(p), d))
    rbo = total * (1 - p) / (1 - F.pow(F.lit(p), F.col("depth")))
    out = sets.join(depth, "query").join(met, "query", "left")
    return out.select(
        "query", F.when(F.col("nb") == 0, 1.0).otherwise(F.col("n") / F.col("nb")).alias("retention"), (F.col("na") - F.col("n")).alias("additions"),
        ((F.col("na") != F.col("n")) | (F.col("nb") != F.col("n"))).alias("changed"), (1 - F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("distance"), rbo.alias("rbo"),
    )


# -- by how much query and candidate overlap ---------------------------------------------------


def name_key(c):
    """Names as they are compared: trimmed, lower case, one space."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def hit_pairs(truth: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each relevant pair with its rank, or -1."""
    best = runs.groupBy("query", "item").agg(F.min("rank").alias("rank"))
    return truth.join(best, ["query", "item"], "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))


def labelled(pairs: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs with the registry's overlap figures; of registry rows with one key the first counts."""
    w = Window.partitionBy(*keys).orderBy("row_idx")
    first = registry.where("status = 'ok'").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return pairs.join(small(first.select(*keys, "n_inter", "cont_q2x", "cont_x2q", "numeric_q")), list(keys), "left")


def labelled_by_table(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """Where candidates are tables: the registry's best column pair of each query column and table."""
    w = Window.partitionBy("query_table", "query_column", "candidate_table").orderBy(F.desc("cont_q2x"), F.desc("n_inter"), "row_idx")
    best = registry.where("status = 'ok'").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    keys = ["query_table", "query_column", "candidate_table"]
    return pairs.join(small(best.select(*keys, "n_inter", "cont_q2x", "cont_x2q", "numeric_q")), keys, "left")


def stratum(containment):
    """Strata of containment: 0, then half-open ranges up to each edge of STRATA."""
    out = F.when(containment <= STRATA[0], "0")
    for lo, hi in zip(STRATA, STRATA[1:], strict=False):
        out = out.when(containment <= hi, f"({lo:g},{hi:g}]")
    return out


def regime_recall(pairs: DataFrame, ks: Sequence[int] = (1, 5, 10), strata: bool = True, union: bool = False, text_only: bool = False) -> DataFrame:
    """``variant, bucket, n`` and ``hit_<k>``: recall of labelled pairs by how much they overlap."""
    m = pairs.where("n_inter is not null")
    if text_only:
        m = m.where("not numeric_q")
    cont = F.greatest("cont_q2x", "cont_x2q") if union else F.col("cont_q2x")
    bucket = stratum(cont) if strata else F.when(F.col("n_inter") == 0, "semantic").otherwise("overlap")
    hits = [F.round(F.avg(F.col("rank").between(0, k - 1).cast("double")), 3).alias(f"hit_{k}") for k in ks]
    return m.withColumn("bucket", bucket).groupBy("variant", "bucket").agg(*hits, F.count("*").alias("n"))


def condensed_recall(pairs: DataFrame, ks: Sequence[int] = (1, 5, 10), group: Sequence[str] = ("query_table",)) -> DataFrame:
    """Recall of pairs without overlap, raw and with the overlapping hits above them taken away."""
    m = pairs.where("n_inter is not null")
    w = Window.partitionBy("variant", *group).orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum(F.when((F.col("n_inter") > 0) & (F.col("rank") >= 0), 1).otherwise(0)).over(w), F.lit(0))
    m = m.withColumn("cond", F.when(F.col("rank") < 0, -1).otherwise(F.col("rank") - above)).where("n_inter = 0")
    rate = lambda c, k: F.round(F.avg(F.col(c).between(0, k - 1).cast("double")), 4)
    return m.groupBy("variant").agg(F.count("*").alias("n_semantic"), *[rate("rank", k).alias(f"raw_{k}") for k in ks], *[rate("cond", k).alias(f"cond_{k}") for k in ks])
