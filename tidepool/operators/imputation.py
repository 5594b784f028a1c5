"""Values for masked keys, voted by candidate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import small
from .filters import IdFilter


def align(cells: DataFrame, examples: DataFrame, candidates: DataFrame) -> DataFrame:
    """``table_id, kc, vc, score``: the column pair of each candidate that holds most example pairs
    ``(k, v)`` in its rows; the first pair in column order on ties."""
    ex = small(examples.where("k <> '' and v <> ''").select("k", "v"))
    c = cells.join(small(candidates.select("table_id").distinct()), "table_id", "left_semi")
    # The cells of an example's key name the value that its row must have: few rows ask for few cells.
    k = c.select("table_id", "rowid", F.col("colid").alias("kc"), F.col("token").alias("k")).join(ex, "k")
    pairs = c.select("table_id", "rowid", F.col("colid").alias("vc"), F.col("token").alias("v")).join(ex.select("v").distinct(), "v", "left_semi")
    found = pairs.join(k, ["table_id", "rowid", "v"]).where("kc <> vc").select("table_id", "kc", "vc", "k", "v").distinct()
    w = Window.partitionBy("table_id").orderBy(F.desc("score"), "kc", "vc")
    return found.groupBy("table_id", "kc", "vc").agg(F.count("*").alias("score")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mapping(cells: DataFrame, aligned: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``table_id, k, v``: of rows with one key the first gives the value. ``keys(k)``: only these."""
    a = cells.join(small(aligned.select("table_id", F.col("kc").alias("colid"))), ["table_id", "colid"]).select("table_id", "rowid", F.col("token").alias("k")).where("k <> ''")
    a = a if keys is None else a.join(small(keys.select("k").distinct()), "k", "left_semi")
    b = cells.join(small(aligned.select("table_id", F.col("vc").alias("colid"))), ["table_id", "colid"]).select("table_id", "rowid", F.col("token").alias("v")).where("v <> ''")
    return a.join(b, ["table_id", "rowid"]).groupBy("table_id", "k").agg(F.min_by("v", "rowid").alias("v"))


def vote(cells: DataFrame, ranked: DataFrame, examples: DataFrame, masked: DataFrame) -> DataFrame:
    """``k, v, votes`` for each masked key: the value of most candidates, the best ranked on ties."""
    return majority(mapping(cells, align(cells, examples, ranked), masked), ranked)


def majority(mapped: DataFrame, ranked: DataFrame) -> DataFrame:
    """``vote`` over what each table says, ``(table_id, k, v)``."""
    m = mapped.join(small(ranked.select("table_id", "rank")), "table_id")
    votes = m.groupBy("k", "v").agg(F.count("*").alias("votes"), F.min("rank").alias("best"))
    w = Window.partitionBy("k").orderBy(F.desc("votes"), "best", "v")
    return votes.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("k", "v", "votes")


def answers(by_token: DataFrame, by_row: DataFrame, tables: list[int], examples: DataFrame, masked: DataFrame) -> DataFrame:
    """``table_id, k, v`` of some tables for the masked keys, at once for all; found again only after a lost
    executor. The tables and the aligned ones are literal filters, so the scans skip the others."""
    spark = by_row.sparkSession
    inside = lambda cells, ids: IdFilter.of(allow=ids).on(cells)
    aligned = align(inside(by_token, tables), examples, spark.createDataFrame([(t,) for t in tables], "table_id int"))
    rows = aligned.collect()  # one for each table
    aligned = spark.createDataFrame([tuple(r) for r in rows], aligned.schema)
    return mapping(inside(by_row, [r["table_id"] for r in rows]), aligned, masked).persist()


def score(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``n_keys, n_covered, n_correct, coverage, accuracy``."""
    j = truth.select("k", F.col("v").alias("t")).distinct().join(predicted.select("k", "v"), "k", "left")
    s = j.agg(F.count("*").alias("n_keys"), F.count("v").alias("n_covered"), F.count_if(F.col("v") == F.col("t")).alias("n_correct"))
    return s.withColumn("coverage", F.when(F.col("n_keys") > 0, F.col("n_covered") / F.col("n_keys"))).withColumn("accuracy", F.when(F.col("n_covered") > 0, F.col("n_correct") / F.col("n_covered")))


def split_query(rows: DataFrame, examples: int = 5) -> tuple[DataFrame, DataFrame]:
    """The first rows ``(rowid, k, v)`` as examples, the others as masked keys with their truth."""
    w = Window.orderBy("rowid")
    n = rows.withColumn("_n", F.row_number().over(w))
    return n.where(F.col("_n") <= examples).drop("_n"), n.where(F.col("_n") > examples).drop("_n")


def scan_cost(examples: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``scan_rows, est_rows, worst_case`` of a multi-column search: sum, least and product over the
    query's columns of the frequencies of their tokens. ``examples(col, token)``."""
    per = examples.where("token <> ''").distinct().join(frequencies, "token", "left").groupBy("col").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("f"))
    return per.agg(F.sum("f").alias("scan_rows"), F.min("f").alias("est_rows"), F.product("f").alias("worst_case"))
