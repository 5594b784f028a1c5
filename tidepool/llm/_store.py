"""Shared-folder tables, size-checked joins and connected components.

Lineage is cut by writing Parquet below the folder named in ``spark.checkpoint.dir`` (which every
executor can read), so a lost executor costs a re-read and never a recomputation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import BROADCAST_ROWS, shared_dir
from ._arrays import shipped

shipped(__name__)

#: A graph of at most so many edges (16 bytes each) is solved by one task; larger ones in rounds.
FEW_EDGES = 500_000
#: Copies of each row of a side that is too large for a broadcast (see ``attach``).
SALTS = 16


class Scratch:
    """Tables of one operator call in the shared folder; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Remove all tables of the call but those its result still reads."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(root):
            if s.getPath().getName() not in names:
                fs.delete(s.getPath(), True)


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def attach(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salted: bool = True, cells: Column | None = None
) -> DataFrame:
    """Join a corpus-sized side with a side that is expected to be small.

    The small side is counted: up to ``rows`` rows it is broadcast (with ``cells``, the number of
    values in a row of it, up to ten times as many values too); beyond that each of its rows is copied
    to SALTS salts and the big side deals its rows over them, so a hot key is split (with ``salted``
    false it is a plain shuffled join, for keys that are not hot). Keys compare null-safe. For
    ``left``, ``left_semi``, ``left_anti`` and ``inner`` joins only.
    """
    on, left, right = list(keys), big, small
    n, values = small.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if cells is None else cells), F.lit(0))).first()
    if n <= rows and values <= 10 * rows:
        right = F.broadcast(small)
    elif salted:
        left = big.withColumn("_salt", F.pmod(F.xxhash64(*[big[c] for c in big.columns[:4]], F.monotonically_increasing_id()), F.lit(SALTS)))
        right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = [*keys, "_salt"]
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in on], "_salt")


def dealt(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Groups of ``df`` that are to be joined back with its rows.

    They are grouped by the keys as one struct, so that the join cannot reuse the groups' partitioning:
    both of its sides get an exchange of their own, and adaptive execution can then split a key that
    very many rows have. (With one exchange for both, a hot key would be one task.)
    """
    groups = df.groupBy(F.struct(*keys).alias("_key")).agg(*aggs)
    return groups.select(*[F.col("_key")[k].alias(k) for k in keys], *[c for c in groups.columns if c != "_key"])


def _least_reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a partition's edges: labels are hung on smaller ones and paths halved until all agree."""
    parts = list(batches)
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x.column(k).to_numpy(zero_copy_only=False) for x in parts)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(store: Scratch, edges: DataFrame, name: str = "cc", max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    The edges are counted. At most ``few`` of them are solved by one task. More are solved in rounds:
    alternating large-star and small-star rounds (each node's neighbours are hung on the smallest
    one). Both are grouped minima, combined before the shuffle, plus an equi-join whose sides are dealt
    out for it (``dealt``), so a star with very many leaves is split over tasks. Every round is cut to
    the shared folder; it ends when a round changes nothing.
    """
    cur = store.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    mark = _mark(cur)
    if mark[0] <= few:
        return store.cut(cur.coalesce(1).mapInArrow(_least_reachable, "node long, component long"), f"{name}-solved")
    for i in range(1, max_rounds + 1):
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = dealt(both, ["a"], F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the larger end of each edge hangs its smaller neighbours on the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = dealt(down, ["a"], F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        nxt = store.cut(small, f"{name}{i}")
        new = _mark(nxt)
        if i > 1:
            store.drop(f"{name}{i - 1}")
        cur = nxt
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("connected components did not converge")
    return cur.select("a", "b").union(cur.select("b", "b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)
