"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document's expected number of copies is its importance times
a factor that makes its source meet the target, at most ``cap``. The whole part is allocated with
certainty; the fractional part ``f`` is sampled: documents are ranked by their random odds
``u / (1 - u)`` divided by their inclusion odds ``f / (1 - f)``, and the smallest ranks are selected
until the source's remaining words are used up (a fixed-size sample with unequal probabilities).

Scale: texts are read once, for their sizes. The cut in rank order needs no sort of a source: ranks
are summed in 4,096 buckets of each source, the bucket that holds the cut is summed in 4,096 again,
and only the documents in that cell are sorted. A source with a third of all rows is spread over all
tasks.

Defined cases: a null source is a source of its own, ordered last. Null and empty texts have size 0
and are not taken. Rows that repeat a ``doc_id`` are documents of their own with the same random
number. Equal ranks are ordered by ``doc_id`` (nulls first), then size. An empty table gives an empty
mix. Only the named columns are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch, attach
from ._text import n_words, unit_hash

BUCKETS = 4096


def water_fill(rows: DataFrame, by: list[str], amount: str, weight: str, room: str, out: str) -> DataFrame:
    """Share the group's ``amount`` by ``weight`` so that no row gets more than its ``room``.

    The excess of full rows is shared again by weight until none is above: rows fill in the order of
    room / weight, and the level of the first row that is not full holds for all that follow.
    Floating-point sums only; groups are small (sources, or importance levels of a source).
    """
    order = Window.partitionBy(*by).orderBy("_ratio", *[F.col(c).asc_nulls_last() for c in rows.columns if c not in by])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return (
        rows.withColumn("_ratio", F.col(room) / F.col(weight))
        .withColumn("_full", F.coalesce(F.sum(room).over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.greatest(F.lit(0.0), F.col(amount) - F.col("_full")) / F.col("_rest"))
        .withColumn("_level", F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(whole))
        .withColumn(out, F.coalesce(F.least(F.col(room), F.col("_level") * F.col(weight)), F.col(room)))
        .drop("_ratio", "_full", "_rest", "_level")
    )


def pareto_mix(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    source_weights: Sequence[float] = (1.0, 2.0, 3.0),
    cap: int = 3,
    length_temper: float = 0.25,
    seed: int = 17,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, inclusion, taken`` for every row of ``docs``.

    ``size``: words by default. Sources in code-point order take ``source_weights`` in turn.
    ``length_temper``: a document's importance is ``2 ** -(temper * floor(log2(size)))``, so long
    documents are repeated somewhat less than short ones of their source; 0 makes all equal.
    ``taken`` is ``size`` times the document's copies in the mix.
    """
    store = Scratch(spark, "mix")
    words = n_words(F.col("text")) if size is None else size.cast("long")
    sized = store.cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size")), "sized")
    sized = sized.withColumn("lvl", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double"))).cast("int")).otherwise(F.lit(0)))

    levels = store.cut(sized.groupBy("source", "lvl").agg(F.sum("size").alias("lvl_size")), "levels")
    sources = levels.groupBy("source").agg(F.sum("lvl_size").alias("source_size"))
    # One row a source from here on. ``all`` is a constant: the sharing is over all sources.
    turn = Window.partitionBy("all").orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("all", F.lit(1)).withColumn("sid", F.row_number().over(turn))
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in source_weights]), (F.pmod(F.col("sid") - 1, F.lit(len(source_weights))) + 1).cast("int")))
    sources = sources.withColumn("amount", F.sum("source_size").over(Window.partitionBy("all")).cast("double")).withColumn("room", (F.lit(cap) * F.col("source_size")).cast("double"))
    sources = water_fill(sources, ["all"], "amount", "w", "room", "target")
    sources = store.cut(sources.select("source", "sid", "source_size", "target"), "sources")

    # Expected copies of each importance level of a source: shares of the target, cap copies at most.
    lv = attach(levels, sources, ["source"]).withColumn("imp", F.pow(F.lit(2.0), -F.lit(length_temper) * F.col("lvl")))
    lv = lv.withColumn("lw", F.col("lvl_size") * F.col("imp")).withColumn("lroom", (F.lit(cap) * F.col("lvl_size")).cast("double")).where("lvl_size > 0")
    lv = water_fill(lv, ["sid"], "target", "lw", "lroom", "share")
    lv = lv.withColumn("expect", F.least(F.lit(float(cap)), F.col("share") / F.col("lvl_size"))).withColumn("whole", F.floor("expect").cast("long"))
    lv = store.cut(lv.select("sid", "lvl", "lvl_size", "target", "expect", "whole"), "expect")
    rest = lv.groupBy("sid").agg((F.first("target") - F.sum(F.col("whole") * F.col("lvl_size"))).alias("rest"))

    keyed = attach(sized, sources, ["source"])
    keyed = attach(keyed, lv.select("sid", "lvl", "expect", "whole"), ["sid", "lvl"], "left")
    f, u = F.col("expect") - F.col("whole"), unit_hash(seed, F.col("doc_id"))
    rank = (u / (1 - u)) / (f / (1 - f))
    keyed = keyed.withColumn("rank", F.when((f > 0) & (F.col("size") > 0), rank)).withColumn("q", F.col("rank") / (1 + F.col("rank")) * BUCKETS)
    keyed = keyed.withColumn("b1", F.least(F.lit(BUCKETS - 1), F.floor("q").cast("int"))).withColumn("b2", F.least(F.lit(BUCKETS - 1), F.floor((F.col("q") - F.col("b1")) * BUCKETS).cast("int")))

    cut1 = _crossing(keyed, rest, "b1", "c1")
    in1 = attach(keyed, cut1.select("sid", "c1", "before"), ["sid"])
    cut2 = _crossing(in1.where("b1 = c1"), cut1.select("sid", (F.col("rest") - F.col("before")).alias("rest")), "b2", "c2")
    cuts = cut1.select("sid", "c1", F.col("rest").alias("left")).join(cut2.select("sid", "c2", "before", "rest"), "sid", "left")
    cuts = store.cut(cuts.select("sid", "c1", "c2", (F.col("rest") - F.col("before")).alias("left")), "cuts")
    ready = attach(keyed, cuts, ["sid"], "left")
    cell = F.coalesce((F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2")), F.lit(False))
    sure = F.coalesce((F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2"))), F.lit(False))
    order = Window.partitionBy("sid").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    chosen = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("left")
    both = ready.where(~cell).withColumn("extra", sure).union(ready.where(cell).withColumn("extra", chosen))
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.col("extra").cast("long")
    return both.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), F.coalesce(f, F.lit(0.0)).alias("inclusion"), (copies * F.col("size")).alias("taken")
    )


def _crossing(keyed: DataFrame, rest: DataFrame, bucket: str, name: str) -> DataFrame:
    """The bucket of each source in which the words reach ``rest``, and the words before it; the last
    bucket and one more if they never do. At most BUCKETS rows a source are ordered."""
    sums = keyed.where(F.col(bucket).isNotNull()).groupBy("sid", bucket).agg(F.sum("size").alias("s"))
    sums = sums.join(rest, "sid").withColumn("upto", F.sum("s").over(Window.partitionBy("sid").orderBy(bucket)))
    hit = F.min(F.when(F.col("upto") >= F.col("rest"), F.struct(F.col(bucket).alias("b"), (F.col("upto") - F.col("s")).alias("x"))))
    return sums.groupBy("sid").agg(F.first("rest").alias("rest"), hit.alias("h"), F.max("upto").alias("top")).select(
        "sid", "rest", F.coalesce(F.col("h.b"), F.lit(BUCKETS)).alias(name), F.coalesce(F.col("h.x"), F.col("top")).alias("before")
    )
