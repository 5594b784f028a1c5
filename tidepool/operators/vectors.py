"""Nearest columns by cosine: exact, filtered, and by locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import code, normalise, once
from ..sources.lake import Lake
from ..sources.storage import exists, small
from .filters import IdFilter

DEFAULT_PLANES, DEFAULT_ROW_CAP = 18, 1000


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", normalise(F.col("embedding")))


def bad_vectors(vectors: DataFrame) -> DataFrame:
    """Rows with a missing, empty, or not finite component."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col("embedding").isNull() | (F.size("embedding") == 0) | odd)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, keep: IdFilter = IdFilter(), exclude_self: bool = True) -> DataFrame:
    """``query_col, r, global_id, table_id, colid, similarity``: the ``k`` nearest stored columns.

    ``queries(query_col, query_table, embedding)`` are the columns of the query tables; each stored
    vector meets each of them (a stated query set against all rows), in matrix products of blocks.
    A task returns the ``k`` best of its block. A query's own table is left out.
    """
    found = _by_blocks(queries, keep.on(vectors), k, exclude_self)
    w = Window.partitionBy("query_col").orderBy(F.desc("similarity"), "global_id")
    return found.withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < k).select("query_col", "r", "global_id", "table_id", "colid", "similarity")


def lsh_nearest(queries: DataFrame, vectors: DataFrame, k: int, refine: int = 20, bits: int = 512, seed: int = 0) -> DataFrame:
    """Approximate ``nearest``: every stored column is compared by the bits of its hyperplane code alone,
    and of each query's ``refine * k`` best the cosines are computed. Of the ten nearest of random
    vectors it finds 0.98 (``lsh_recall``)."""
    found = _by_blocks(queries, vectors, refine * k, True, -(-bits // 64) * 64, seed)
    near = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_col").orderBy(F.desc("_score"), "global_id"))).where(F.col("_r") <= refine * k)
    w = Window.partitionBy("query_col").orderBy(F.desc("similarity"), "global_id")
    return near.select("query_col", "global_id", "table_id", "colid", "similarity").withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < k)


#: Queries and stored vectors of a task at most, those that a task should have, and those of one matrix product.
MOST, LEAST, PRODUCT = (8192, 131_072), (256, 4096), (128, 16_384)
#: A product's error is far smaller. Scores of missing similarities, which come last, and of nan, which is first.
SLACK, MISSING, ODD = 1e-9, -1e6, 1e6


def _by_blocks(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool, bits: int = 0, seed: int = 0) -> DataFrame:
    """``query_col, global_id, table_id, colid, _score, similarity``: the ``k`` best of each pair of a block
    of queries and a part of the vectors; the score is the similarity or, with ``bits``, the agreement of codes."""
    whole = F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding"))
    if exclude_self:
        queries, vectors = queries.where("query_table is not null"), vectors.where("table_id is not null")
    n, m, tasks = max(queries.count(), 1), max(vectors.count(), 1), 4 * queries.sparkSession.sparkContext.defaultParallelism
    blocks, parts = -(-n // MOST[0]), -(-m // MOST[1])
    blocks = max(blocks, min(-(-tasks // parts), -(-n // LEAST[0])))
    parts = max(parts, min(-(-tasks // blocks), -(-m // LEAST[1])))
    dealt = lambda df, key, i, j: df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(i)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(j - 1))))
    q = dealt(normalised(queries).select("query_col", "query_table", whole.alias("embedding")), "query_col", blocks, parts)
    v = dealt(normalised(vectors).select("global_id", "table_id", "colid", whole.alias("embedding")), "global_id", parts, blocks)
    q = q.select((F.col("_own") * parts + F.col("_other")).alias("_task"), "query_col", "query_table", "embedding").repartition(blocks * parts, "_task")
    v = v.select((F.col("_other") * parts + F.col("_own")).alias("_task"), "global_id", "table_id", "colid", "embedding").repartition(blocks * parts, "_task")
    kinds = dict(q.dtypes) | dict(v.dtypes)
    ids = ["query_col", "global_id", "table_id", "colid"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("global_id")
        own = (left["query_table"].to_numpy(), right["table_id"].to_numpy()) if exclude_self else None
        found = [_best(*x, k, own, bits, seed) for x in _by_width(left["embedding"], right["embedding"])]
        i, j, score, similarity = (np.concatenate([x[c] for x in found]) if found else np.zeros(0, int if c < 2 else float) for c in range(4))
        out = {c: (left[c].take(pa.array(i)) if c == "query_col" else right[c].take(pa.array(j))) for c in ids}
        return pa.table(out | {"_score": pa.array(score), "similarity": pa.array(similarity, mask=score == MISSING)})

    schema = ", ".join(f"{c} {kinds[c]}" for c in ids) + ", _score double, similarity double"
    return q.groupBy("_task").cogroup(v.groupBy("_task")).applyInArrow(best, schema)


def _by_width(left: pa.ChunkedArray, right: pa.ChunkedArray):
    """Places and matrix of the queries of each width, the stored vectors' matrix, and which of them have that width."""
    wide = [x.value_lengths().fill_null(-1).to_numpy() for x in (pa.concat_arrays(left.chunks), pa.concat_arrays(right.chunks))] if left.num_chunks and right.num_chunks else [np.zeros(0, int)] * 2
    for d in np.unique(wide[0]) if len(wide[1]) else []:
        def matrix(x, rows, d=int(d)):
            out = np.zeros((len(x), max(d, 0)))
            if d > 0 and rows.any():
                out[rows] = pa.concat_arrays(x.chunks).filter(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            return out

        mine, fit = wide[0] == d, (wide[1] == d) & (d >= 0)
        yield np.flatnonzero(mine), matrix(left, mine)[mine], matrix(right, fit), fit


def _best(at: np.ndarray, q: np.ndarray, v: np.ndarray, fit: np.ndarray, k: int, own: tuple | None, bits: int, seed: int) -> tuple:
    """Places of queries and stored vectors, scores and similarities: each query's ``k`` best, ties by place.

    Products of blocks say which pairs may be among them; their similarities are then summed as ``dot``
    does, so that equal vectors tie, and by them the choice is made.
    """
    nan, out = not (np.isfinite(q).all() and np.isfinite(v).all()), []
    planes = np.random.default_rng(seed).standard_normal((q.shape[1], bits)) if bits else None
    coded = lambda m: (m @ planes > 0).astype(np.int8) * np.int8(2) - np.int8(1)
    codes = np.concatenate([coded(v[x : x + PRODUCT[1]]) for x in range(0, len(v), PRODUCT[1])]) if bits and len(v) else v

    def cosines(a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s = np.zeros(len(i))
        for d in range(v.shape[1]):
            s += a[i, d] * v[j, d]
        return s

    for lo in range(0, len(q), PRODUCT[0]):
        a = q[lo : lo + PRODUCT[0]]
        left = coded(a).astype(np.float32) if bits else a
        ki, kj, ks, least = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.full(len(a), -np.inf)
        for start in range(0, len(v), PRODUCT[1]):
            b = codes[start : start + PRODUCT[1]]
            s = left @ (b.astype(np.float32) if bits else b).T
            if nan and not bits:
                s[np.isnan(s)] = ODD
            s[:, ~fit[start : start + len(b)]] = MISSING
            if own:
                s[own[0][at[lo : lo + len(a)], None] == own[1][None, start : start + len(b)]] = -np.inf
            if not len(ki):
                n = min(k, len(b))
                least = np.partition(s, len(b) - n, axis=1)[:, len(b) - n]
            i, j = np.nonzero((s >= least[:, None] - SLACK) & (s > -np.inf))
            exact = s[i, j].astype(float) if bits else cosines(a, i, j + start)
            exact[np.isnan(exact)] = ODD
            exact[~fit[j + start]] = MISSING
            ki, kj, ks = np.concatenate([ki, i]), np.concatenate([kj, j + start]), np.concatenate([ks, exact])
            order = np.lexsort((kj, -ks, ki))
            ki, kj, ks = ki[order], kj[order], ks[order]
            r = np.arange(len(ki)) - np.searchsorted(ki, ki)
            least = np.full(len(a), -np.inf)
            least[ki[r == k - 1]] = ks[r == k - 1]
            ki, kj, ks = ki[r < k], kj[r < k], ks[r < k]
        out.append((at[ki + lo], kj, ks, cosines(a, ki, kj)))
    return tuple(np.concatenate([x[c] for x in out]) for c in range(4))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``recall``: the share of exact neighbours that were found."""
    hit = exact.select("query_col", "global_id").join(found.select("query_col", "global_id", F.lit(1).alias("hit")), ["query_col", "global_id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))


# -- codes of cells ----------------------------------------------------------------------------


def sample_rows(cells: DataFrame, cap: int = DEFAULT_ROW_CAP, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each table, chosen by hash; small tables whole (the sample is the
    feature: a code index looks at that many rows of a table)."""
    rows = cells.select("table_id", "rowid").distinct()
    w = Window.partitionBy("table_id").orderBy(F.xxhash64(F.lit(seed), "table_id", "rowid"), "rowid")
    keep = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    return cells.join(keep, ["table_id", "rowid"], "left_semi")


def numeric_columns(raw: DataFrame) -> DataFrame:
    """``table_id, colid`` of columns whose ten most frequent values are mostly digits."""
    counts = raw.where("value is not null").groupBy("table_id", "colid", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("table_id", "colid").orderBy(F.desc("n"), "value")
    ten = counts.withColumn("r", F.row_number().over(w)).where("r <= 10")
    share = F.sum(F.length(F.regexp_replace("value", "[^0-9]", ""))) / F.sum(F.length("value"))
    return ten.groupBy("table_id", "colid").agg(share.alias("digits")).where("digits > 0.5").select("table_id", "colid")


def hyperplanes(bits: int, dim: int, seed: int = 0) -> list[list[float]]:
    if not 0 < bits <= 30:
        raise ValueError("codes have 1 to 30 bits")
    return np.random.default_rng(seed).standard_normal((bits, dim)).tolist()


def hashing_encoder(value, dim: int = 32):
    """A unit vector of a string's character trigrams: each adds or subtracts one at a hashed place."""
    padded = F.concat(F.lit("##"), F.lower(value), F.lit("##"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    hashed = F.transform(grams, lambda g: F.xxhash64(g))

    def place(hs):
        at = lambda d: F.aggregate(hs, F.lit(0.0), lambda a, h: F.when(F.pmod(h, F.lit(dim)) == d, a + F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(a))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)

    return normalise(once(hashed, place))


def column_sentence(cells: DataFrame, registry: DataFrame, values: int = 50) -> DataFrame:
    """A sentence about each column for a text encoder: name, number of values, lengths, and the most
    frequent values."""
    n = cells.where("token <> ''").groupBy("table_id", "colid", "token").agg(F.count("*").alias("n"))
    stats = n.groupBy("table_id", "colid").agg(F.count("*").alias("k"), F.max(F.length("token")).alias("mx"), F.min(F.length("token")).alias("mn"), F.avg(F.length("token")).alias("av"))
    w = Window.partitionBy("table_id", "colid").orderBy(F.desc("n"), "token")
    tops = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= values).groupBy("table_id", "colid").agg(F.sort_array(F.collect_list(F.struct("r", "token"))).alias("t"))
    both = registry.join(stats, ["table_id", "colid"]).join(tops, ["table_id", "colid"])
    text = F.concat(F.col("column"), F.lit(" contains "), F.col("k").cast("string"), F.lit(" values ("), F.col("mx").cast("string"), F.lit(", "), F.col("mn").cast("string"), F.lit(", "), F.format_string("%.2f", "av"), F.lit("): "), F.array_join(F.transform("t", lambda x: x["token"]), ", "))
    return both.select("table_id", "colid", text.alias("sentence"))


def missing_values(values: DataFrame, store: DataFrame) -> DataFrame:
    """Values that have no vector yet, for a resumable encoding job."""
    return values.select("value").where("value is not null").distinct().join(store.select("value"), "value", "left_anti")


def encode_missing(values: DataFrame, store: DataFrame, dim: int = 32) -> DataFrame:
    """The store with vectors added for missing values."""
    return store.unionByName(missing_values(values, store).select("value", hashing_encoder(F.col("value"), dim).alias("embedding")))


def codes(cells: DataFrame, embeddings: DataFrame, planes: list[list[float]]) -> DataFrame:
    """``code, table_id, colid, rowid`` of raw cells ``(table_id, colid, rowid, value)``."""
    coded = embeddings.select("value", code(F.col("embedding"), planes).alias("code"))
    return cells.join(coded, "value").select("code", "table_id", "colid", "rowid")


def code_index(raw: DataFrame, dim: int = 32, bits: int = DEFAULT_PLANES, cap: int = DEFAULT_ROW_CAP, seed: int = 0) -> DataFrame:
    """The code index of a lake's raw cells: sampled rows, text columns, hashed distinct values."""
    sampled = sample_rows(raw, cap, seed).where("value is not null")
    text = sampled.join(small(numeric_columns(sampled)), ["table_id", "colid"], "left_anti")
    vectors = text.select("value").distinct().select("value", hashing_encoder(F.col("value"), dim).alias("embedding"))
    return codes(text, vectors, hyperplanes(bits, dim, seed))



def written_codes(lake: Lake, names: Sequence[str], dim: int = 32, bits: int = DEFAULT_PLANES, cap: int = DEFAULT_ROW_CAP, seed: int = 0) -> DataFrame:
    """The code index of some of a lake's tables, clustered by code; written once for each choice."""
    path = f"{lake.root}/codes-{dim}-{bits}-{cap}-{seed}-{'-'.join(names)}"
    if not exists(lake.spark, f"{path}/_SUCCESS"):
        raw = reduce(DataFrame.unionAll, [lake.raw(n) for n in names])
        code_index(raw, dim, bits, cap, seed).sort("code", "table_id", "colid", "rowid").write.mode("overwrite").parquet(path)
    return lake.spark.read.parquet(path)
