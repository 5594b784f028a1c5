"""Column types, dependencies, overlap registries, keywords and samples, over cells of many tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import remove, shared_dir, small

# Limits of the key and dependency search, and of the cardinality strata.
SAMPLE_ROWS, MIN_DISTINCT, MIN_UNIQUE, MIN_CONFIDENCE = 5000, 10, 0.9, 0.95
STRATA = (10, 100, 1000, 10000)


def token_frequencies(cells: DataFrame) -> DataFrame:
    return cells.groupBy("token").agg(F.count("*").alias("n"))


def column_types(cells: DataFrame) -> DataFrame:
    """``numeric_fraction, cardinality_ratio, avg_char_len, col_type`` of each column, by its non-empty cells."""
    full = cells.where("token <> ''")
    s = full.groupBy("table_id", "colid").agg(
        F.count("*").alias("n"), F.avg(F.col("token").try_cast("double").isNotNull().cast("double")).alias("numeric_fraction"),
        F.countDistinct("token").alias("d"), F.avg(F.length("token")).alias("avg_char_len"),
    )
    s = cells.select("table_id", "colid").distinct().join(s, ["table_id", "colid"], "left")
    ratio = F.col("d") / F.col("n")
    kind = (
        F.when(F.col("n").isNull(), "empty").when((F.col("numeric_fraction") >= 0.8) & (ratio >= 0.5), "id").when(F.col("numeric_fraction") >= 0.8, "numeric")
        .when((ratio < 0.2) & (F.col("avg_char_len") < 30), "categorical").otherwise("text")
    )
    zero = F.lit(0.0)
    return s.select("table_id", "colid", F.coalesce("numeric_fraction", zero).alias("numeric_fraction"), F.coalesce(ratio, zero).alias("cardinality_ratio"), F.coalesce("avg_char_len", zero).alias("avg_char_len"), kind.alias("col_type"))


def key_columns(cells: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns that nearly identify the rows among a table's first ``rows`` (the search's definition)."""
    c = cells.where(F.col("rowid") < rows)
    s = c.groupBy("table_id", "colid").agg(F.count("*").alias("n"), F.countDistinct("token").alias("d"), F.avg(F.when(F.col("rowid") < 200, F.col("token").rlike(r"\D").cast("double"))).alias("text"))
    return s.where((F.col("d") >= MIN_DISTINCT) & (F.col("d") / F.col("n") >= MIN_UNIQUE)).select("table_id", "colid", (F.col("d") / F.col("n")).alias("uniqueness"), (F.col("text") >= 0.5).alias("stringy"))


def dependencies(cells: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``table_id, key, value, confidence``: for each key column and other column of its table, the
    share of rows that agree with their key's most frequent value."""
    c = cells.where(F.col("rowid") < rows).select("table_id", "colid", "rowid", "token")
    k = c.join(small(key_columns(cells, rows).select("table_id", "colid")), ["table_id", "colid"], "left_semi").select("table_id", "rowid", F.col("colid").alias("key"), F.col("token").alias("k"))
    pairs = k.join(c.select("table_id", "rowid", F.col("colid").alias("value"), F.col("token").alias("v")), ["table_id", "rowid"]).where("key <> value")
    counts = pairs.groupBy("table_id", "key", "value", "k", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("table_id", "key", "value", "k").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return best.groupBy("table_id", "key", "value").agg((F.sum("top") / F.sum("n")).alias("confidence"))


def key_value_pairs(cells: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each table's best key with its best dependent column: text keys, then the most unique; then the
    surest, text, most varied value."""
    c = cells.where(F.col("rowid") < rows)
    stats = c.groupBy("table_id", "colid").agg(F.countDistinct("token").alias("d"), (F.avg(F.when(F.col("rowid") < 200, F.col("token").rlike(r"\D").cast("double"))) >= 0.5).alias("text"))
    keys = key_columns(cells, rows).select("table_id", F.col("colid").alias("key"), "uniqueness", "stringy")
    values = stats.select("table_id", F.col("colid").alias("value"), F.col("d").alias("vd"), F.col("text").alias("vtext"))
    found = dependencies(cells, rows).where(F.col("confidence") >= MIN_CONFIDENCE).join(keys, ["table_id", "key"]).join(values, ["table_id", "value"]).where("vd >= 2")
    w = Window.partitionBy("table_id").orderBy(F.desc("stringy"), F.desc("uniqueness"), "key", F.desc(F.round("confidence", 3)), F.desc("vtext"), F.desc("vd"), "value")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("table_id", "key", "value", "confidence")


def value_sets(cells: DataFrame) -> DataFrame:
    return cells.where("token <> ''").select("table_id", "colid", "token").distinct()


def overlap_pairs(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Registry rows of column pairs ``(query_table, query_col, candidate_table, candidate_col)``: set
    sizes, intersection, containments, Jaccard similarity and status."""
    sets = value_sets(cells)
    n = sets.groupBy("table_id", "colid").agg(F.count("*").alias("n"))
    known = cells.select("table_id", "colid").distinct()
    tables = known.select("table_id").distinct()
    side = lambda df, p, *more: df.select(F.col("table_id").alias(f"{p}_table"), *([F.col("colid").alias(f"{p}_col")] if "colid" in df.columns else []), *more)
    q = sets.join(small(pairs.select(F.col("query_table").alias("table_id"), F.col("query_col").alias("colid")).distinct()), ["table_id", "colid"], "left_semi")
    c = sets.join(small(pairs.select(F.col("candidate_table").alias("table_id"), F.col("candidate_col").alias("colid")).distinct()), ["table_id", "colid"], "left_semi")
    wanted = small(pairs.select("query_table", "query_col", "candidate_table", "candidate_col").distinct())
    met = side(q, "query", F.col("token")).join(wanted, ["query_table", "query_col"]).join(side(c, "candidate", F.col("token")), ["candidate_table", "candidate_col", "token"])
    inter = met.groupBy("query_table", "query_col", "candidate_table", "candidate_col").agg(F.count("*").alias("n_inter"))
    out = pairs.join(inter, ["query_table", "query_col", "candidate_table", "candidate_col"], "left")
    for p, a in (("query", "n_query"), ("candidate", "n_cand")):
        out = out.join(small(side(n, p, F.col("n").alias(a))), [f"{p}_table", f"{p}_col"], "left")
        out = out.join(small(side(tables, p, F.lit(True).alias(f"_t{p}"))), f"{p}_table", "left").join(small(side(known, p, F.lit(True).alias(f"_c{p}"))), [f"{p}_table", f"{p}_col"], "left")
    zero = F.lit(0).cast("long")
    i, nq, nc = F.coalesce("n_inter", zero), F.coalesce("n_query", zero), F.coalesce("n_cand", zero)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    status = F.when(F.col("_tquery").isNull() | F.col("_tcandidate").isNull(), "missing_table").when(F.col("_cquery").isNull() | F.col("_ccandidate").isNull(), "missing_column").otherwise("ok")
    return out.select(
        "query_table", "query_col", "candidate_table", "candidate_col", nq.alias("n_query"), nc.alias("n_cand"), i.alias("n_inter"),
        share(i, nq).alias("cont_q2x"), share(i, nc).alias("cont_x2q"), share(i, nq + nc - i).alias("jaccard"), status.alias("status"),
    )


def best_union_pair(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """For table pairs ``(query_table, candidate_table)`` the column pair with the largest containment
    either way; only pairs that share a value are met."""
    sets = value_sets(cells)
    q = sets.select(F.col("table_id").alias("query_table"), F.col("colid").alias("query_col"), "token").join(small(tables), "query_table")
    met = q.join(sets.select(F.col("table_id").alias("candidate_table"), F.col("colid").alias("candidate_col"), "token"), ["candidate_table", "token"])
    inter = met.groupBy("query_table", "candidate_table", "query_col", "candidate_col").agg(F.count("*").alias("n_inter"))
    n = sets.groupBy("table_id", "colid").agg(F.count("*").alias("n"))
    inter = inter.join(small(n.select(F.col("table_id").alias("query_table"), F.col("colid").alias("query_col"), F.col("n").alias("nq"))), ["query_table", "query_col"])
    inter = inter.join(small(n.select(F.col("table_id").alias("candidate_table"), F.col("colid").alias("candidate_col"), F.col("n").alias("nc"))), ["candidate_table", "candidate_col"])
    inter = inter.withColumn("containment", F.greatest(F.col("n_inter") / F.col("nq"), F.col("n_inter") / F.col("nc")))
    w = Window.partitionBy("query_table", "candidate_table").orderBy(F.desc("containment"), F.desc("n_inter"), "query_col", "candidate_col")
    return inter.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_table", "candidate_table", "query_col", "candidate_col", "n_inter", "containment")


def digit_columns(cells: DataFrame) -> DataFrame:
    """Share of digits in each column's ten most frequent values, and whether it is over a half."""
    n = cells.where("token <> ''").groupBy("table_id", "colid", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("table_id", "colid").orderBy(F.desc("n"), "token")
    ten = n.withColumn("r", F.row_number().over(w)).where("r <= 10")
    share = F.sum(F.length(F.regexp_replace("token", "[^0-9]", ""))) / F.sum(F.length("token"))
    return ten.groupBy("table_id", "colid").agg(share.alias("digits")).withColumn("numeric", F.col("digits") > 0.5)


def document_frequencies(cells: DataFrame, min_length: int = 2) -> DataFrame:
    """In how many tables a token occurs; short ones and plain numbers are not keywords."""
    words = cells.where((F.length("token") >= min_length) & ~F.col("token").rlike("^[0-9]+$"))
    return words.groupBy("token").agg(F.countDistinct("table_id").alias("df"))


def keywords(cells: DataFrame, n: int = 10) -> DataFrame:
    return document_frequencies(cells).orderBy(F.desc("df"), "token").limit(n)


def discriminative(cells: DataFrame, wrong: DataFrame, relevant: DataFrame, n: int = 10) -> DataFrame:
    """Tokens of wrongly found tables that no relevant table has, by the number of such tables."""
    return discriminative_cells(*(cells.join(F.broadcast(t.select("table_id")), "table_id", "left_semi") for t in (wrong, relevant)), n)


def discriminative_cells(bad: DataFrame, good: DataFrame, n: int = 10) -> DataFrame:
    """``discriminative`` of the cells of the wrongly found and of the relevant tables."""
    return document_frequencies(bad).join(good.select("token").distinct(), "token", "left_anti").orderBy(F.desc("df"), "token").limit(n)


def cardinalities(cells: DataFrame) -> DataFrame:
    n = cells.groupBy("table_id", "colid").agg(F.countDistinct("token").alias("cardinality"))
    place = F.lit(len(STRATA))
    for i, edge in reversed(list(enumerate(STRATA))):
        place = F.when(F.col("cardinality") < edge, i).otherwise(place)
    return n.withColumn("stratum", place)


def stratified(candidates: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = ("table_id", "colid")) -> DataFrame:
    """``n`` candidates taken from the strata in turn, in a seeded order within each."""
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys)
    return candidates.withColumn("turn", F.row_number().over(w)).orderBy("turn", "stratum").limit(n)


def spearman(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """``n, rho`` of two ``(key, value)`` tables: means by key, joined, ranks with ties averaged."""
    a = left.where("key is not null and value is not null").groupBy("key").agg(F.avg("value").alias("a"))
    b = right.where("key is not null and value is not null").groupBy("key").agg(F.avg("value").alias("b"))
    # A mean of doubles depends on the order in which its parts arrive, so it may differ in its last bits each time it is
    # computed; the ranks are joined by it, so it is computed once and stored.
    where = f"{shared_dir(left.sparkSession)}/spearman-{uuid.uuid4().hex}"
    a.join(b, "key").select(F.col("a").cast("double"), F.col("b").cast("double")).write.parquet(where)
    j = left.sparkSession.read.schema("a double, b double").parquet(where)

    def ranks(df: DataFrame, c: str) -> DataFrame:
        n = df.groupBy(c).agg(F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.join(n.select(c, (below + (F.col("n") + 1) / 2).alias(f"r{c}")), c)

    r = ranks(ranks(j, "a"), "b")
    n, rho = r.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho")).first()
    remove(left.sparkSession, where)
    return left.sparkSession.createDataFrame([(n, rho if n >= least else None)], "n long, rho double")


def row_pairs(cells: DataFrame, c1: int, c2: int) -> DataFrame:
    a = cells.where(F.col("colid") == c1).select("table_id", "rowid", F.col("token").alias("a"))
    b = cells.where(F.col("colid") == c2).select("table_id", "rowid", F.col("token").alias("b"))
    return a.join(b, ["table_id", "rowid"]).select("table_id", "a", "b").distinct()


def not_supersets(query_pairs: DataFrame, candidate_pairs: DataFrame) -> DataFrame:
    """Candidate tables that lack at least one of the query's row pairs."""
    n = query_pairs.select("a", "b").distinct()
    have = candidate_pairs.join(n, ["a", "b"], "left_semi").groupBy("table_id").agg(F.count("*").alias("have"))
    total = n.agg(F.count("*").alias("total"))
    c = candidate_pairs.select("table_id").distinct().join(have, "table_id", "left")
    return c.join(F.broadcast(total), F.lit(True)).where(F.coalesce("have", F.lit(0)) < F.col("total")).select("table_id")


def negative_samples(cells: DataFrame, query_tokens: DataFrame, exclude: int, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of other tables whose first cell is not in the query, in a seeded order."""
    rows = cells.where((F.col("colid") == 0) & (F.col("token") != "") & (F.col("table_id") != exclude)).join(query_tokens, "token", "left_anti")
    return rows.select("table_id", "rowid", "token").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "table_id", "rowid")), "table_id", "rowid").limit(n)
