"""Leaf searches. Each returns all its scored matches; ``top`` ranks and cuts them.

Rankings have a total order: score, then table id, then column ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import LITERAL_TOKENS, covers, signature, token, tokens_of
from ..sources.lake import CELLS, PLAIN_TABLES, Lake, rowkeys
from ..sources.storage import small
from .filters import IdFilter

#: Rows of a table that correlation looks at.
CORRELATION_ROWS = 256
EVERYTHING = IdFilter()


def top(scored: DataFrame, k: int | None, by: str = "score", ties: Sequence[str] = ("table_id", "colid", "numcol")) -> DataFrame:
    """``rank`` from 0 by falling ``by``. With ``k`` it is a top-k selection, without sorting the rest."""
    order = [F.desc(by), *[F.asc(c) for c in ties if c in scored.columns]]
    if k is not None:
        scored = scored.orderBy(*order).limit(k)
    # A ranking is one sequence; after the limit it has k rows at most.
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def matching(lake: Lake, tokens: DataFrame | Iterable, keep: IdFilter = EVERYTHING) -> DataFrame:
    """Cells whose token is one of ``tokens``: a literal list if short, else a semi-join."""
    wanted = tokens if isinstance(tokens, DataFrame) and tokens.columns == ["token"] else tokens_of(lake.spark, tokens)
    if keep.empty:
        return lake.spark.createDataFrame([], CELLS)
    first = wanted.limit(LITERAL_TOKENS + 1).collect()
    if len(first) <= LITERAL_TOKENS:
        return _kept(lake, lake.searched, keep).where(F.col("token").isin([r["token"] for r in first])) if first else lake.spark.createDataFrame([], CELLS)
    return _kept(lake, lake.cells, keep).join(small(wanted), "token", "left_semi")


def _kept(lake: Lake, read: Callable[..., DataFrame], keep: IdFilter) -> DataFrame:
    """Cells of the tables that pass; of a lake of few tables no other is read."""
    n = len(lake.names)
    return read(keep.passing(n)) if n <= PLAIN_TABLES else keep.on(read())


def keyword(lake: Lake, values, keep: IdFilter = EVERYTHING) -> DataFrame:
    """Tables by the number of different query tokens found anywhere in them."""
    return matching(lake, values, keep).groupBy("table_id").agg(F.countDistinct("token").alias("score"))


def single_column(lake: Lake, values, keep: IdFilter = EVERYTHING) -> DataFrame:
    """Columns by the number of different query tokens found in them."""
    return matching(lake, values, keep).groupBy("table_id", "colid").agg(F.countDistinct("token").alias("score"))


def query_rows(lake: Lake, rows: DataFrame | Sequence[Sequence]) -> DataFrame:
    """``qid, q0, q1, ...``: tokens of the query's rows, repeated rows kept."""
    if isinstance(rows, DataFrame):
        df = rows
    else:
        width = len(rows[0]) if len(rows) else 1
        df = lake.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"c{i} string" for i in range(width)))
    return df.select(F.monotonically_increasing_id().alias("qid"), *[token(F.col(f"`{c}`")).alias(f"q{i}") for i, c in enumerate(df.columns)])


def multi_column(lake: Lake, rows, keep: IdFilter = EVERYTHING, prune: bool = False) -> DataFrame:
    """Tables by how well their rows hold whole query rows, under one mapping of columns.

    A lake row matches a query row if a cell equals its first value and each further value is in some
    cell of the row. The match counts, for the mapping (cell's column, columns of the further values),
    once for each combination of cells of the row that hold any query value of each further column.
    A table's score is its best mapping's count. ``prune``: before the exact test, drop candidate rows
    whose signature lacks a bit of the query row's; the exact test is an equi-join here, so this pays
    only where candidate rows are many and true matches few.
    """
    q = query_rows(lake, rows)
    width = len(q.columns) - 1
    # Each query token with the columns that hold it: one character a column, 1 if it does. The exact test also
    # meets empty further values, which count nowhere else.
    each = q.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"q{i}").alias("token")) for i in range(width)])).alias("x")).select("x.*").where("i > 0 or token <> ''")
    held = each.groupBy("token").agg(F.concat(*[F.max(F.when((F.col("i") == i) & (F.col("token") != ""), "1").otherwise("0")) for i in range(width)]).alias("held"))
    found = matching(lake, held.select("token"), keep).select("table_id", "rowid", "colid", "token").join(small(held), "token")
    # One shuffle brings a row's matched cells together; all that follows is within the row.
    lake_rows = found.groupBy("table_id", "rowid").agg(F.collect_list(F.struct("colid", "token", "held")).alias("cells"))
    of = lambda i: F.filter("cells", lambda c: F.substring(c["held"], i + 1, 1) == "1")
    weight = reduce(lambda a, b: a * b, [F.size(of(i)).cast("long") for i in range(1, width)], F.lit(1).cast("long"))
    hits = lake_rows.withColumn("weight", weight).where("weight > 0").withColumn("hit", F.explode(of(0)))
    pairs = hits.select("table_id", "rowid", F.col("hit.colid").alias("colid"), F.col("hit.token").alias("q0"), "cells", "weight").join(small(q.drop("qid")), "q0")
    if prune and width > 1:
        bits = lambda half: reduce(lambda a, b: a.bitwiseOR(b), [signature(F.col(f"q{i}"))[half] for i in range(width)])
        rows_met = pairs.select("table_id", "rowid").distinct()
        keys_met = rowkeys(_kept(lake, lake.cells, keep).join(rows_met, ["table_id", "rowid"], "left_semi"))
        pairs = pairs.withColumns({"qhi": bits("hi"), "qlo": bits("lo")}).join(keys_met, ["table_id", "rowid"])
        pairs = pairs.where(covers(F.col("hi"), F.col("lo"), F.col("qhi"), F.col("qlo"))).drop("qhi", "qlo", "hi", "lo")
    # A one-column query's mapping has every column of the row that holds the value.
    wanted = range(1, width) if width > 1 else range(0, 1)
    at = lambda i: F.transform(F.filter("cells", lambda c: c["token"] == F.col(f"q{i}")), lambda c: c["colid"])
    mapped = pairs.withColumn("cols", F.array(*[F.sort_array(at(i)) for i in wanted])).where(~F.exists("cols", lambda c: F.size(c) == 0))
    return mapped.groupBy("table_id", "colid", "cols").agg(F.sum("weight").alias("n")).groupBy("table_id").agg(F.max("n").alias("score"))


def correlation_keys(lake: Lake, source, target) -> DataFrame:
    """``token, high`` of each key: whether its mean target reaches the mean of all keys' means."""
    if isinstance(source, DataFrame):
        pairs = source.select(F.col(source.columns[0]).cast("string").alias("s"), F.col(source.columns[1]).cast("double").alias("t"))
    else:
        pairs = lake.spark.createDataFrame([(None if a is None else str(a), None if b is None else float(b)) for a, b in zip(source, target, strict=True)], "s string, t double")
    means = pairs.where("s is not null and t is not null and not isnan(t)").groupBy("s").agg(F.avg("t").alias("t"))
    level = means.agg(F.avg("t").alias("level"))
    keys = means.join(F.broadcast(level), F.lit(True)).select(token(F.col("s")).alias("token"), (F.col("t") >= F.col("level")).alias("high")).where("token <> ''")
    # Keys that differ only in what the normaliser drops: high if any of them is.
    return keys.groupBy("token").agg(F.max("high").alias("high"))


def correlation(lake: Lake, source, target=None, keep: IdFilter = EVERYTHING, rows: int = CORRELATION_ROWS) -> DataFrame:
    """Pairs of a key column and a number column by quadrant agreement with the query.

    ``score`` is agreements minus disagreements over the matched keys; pairs of one key, or whose
    numbers do not vary, are left out. Rank by ``strength``, its absolute value.
    """
    keys = small(correlation_keys(lake, source, target))
    cells = keep.on(lake.first_rows(rows))
    cat = cells.join(keys, "token").select("table_id", "rowid", F.col("colid").alias("catcol"), "token", "high")
    num = cells.where("quadrant is not null").select("table_id", "rowid", F.col("colid").alias("numcol"), F.col("token").alias("number"), "quadrant")
    each = cat.join(num, ["table_id", "rowid"]).groupBy("table_id", "catcol", "numcol", "token", "high").agg(
        (F.avg(F.col("quadrant").cast("int")) > 0.5).alias("upper"), F.countDistinct("number").alias("n"), F.min("number").alias("least")
    )
    pairs = each.groupBy("table_id", F.col("catcol").alias("colid"), "numcol").agg(
        (2 * F.sum((F.col("high") == F.col("upper")).cast("long")) - F.count("*")).alias("score"), F.count("*").alias("k"), F.countDistinct("least").alias("values"), F.sum("n").alias("n")
    )
    pairs = pairs.where("k > 1 and (values > 1 or n > k)")
    return pairs.select("table_id", "colid", "numcol", "score", F.abs("score").alias("strength"))


def code_overlap(codes: DataFrame, query: DataFrame, keep: IdFilter = EVERYTHING) -> DataFrame:
    """Columns by the number of different query codes; ``codes(table_id, colid, rowid, code)``."""
    return keep.on(codes).join(small(query.select("code").distinct()), "code", "left_semi").groupBy("table_id", "colid").agg(F.countDistinct("code").alias("score"))
