"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings ``(rid, tid, pos)`` of every training token that occurs in a
query window; ``rid`` numbers the documents of the index. One posting a document, of the sentinel
term, holds its length. ``search`` ranks the terms of each window by their number of postings and
intersects offset-adjusted lists from the rarest: the two rarest lists give candidate starts, and
only postings of documents with candidates are asked for the other terms. With ``slop`` 0 this finds
exact phrases; with more, phrases whose words are each at most ``slop`` places off (proximity).

Scale: the texts are read once and never shuffled. A document's postings come from one row, and a
term with very many postings is not grouped: lists are joined with the (counted, then broadcast or
salted) window terms, and the candidates by document and start.

Defined cases: null and empty texts have a length of 0 and no hits. Items without words have no
window; items of fewer words than the window are one window. Items with a null id hit words but are
not counted or named. Repeated rows are documents of their own. Of both tables only the id and text
columns are read, so other columns do not matter. Empty tables give no hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch, attach
from ._text import let, terms

SENTINEL = " "  # no term has a space


def query_windows(items: DataFrame, width: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, grams``: every window of ``width`` terms, or the whole item if it has fewer."""
    n = F.size("_t")
    spans = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.slice("_t", i + 1, width))
    rows = items.select(F.col(id_col).alias("item_id"), terms(F.col(text_col)).alias("_t")).where(n > 0)
    return rows.select("item_id", F.explode(spans).alias("grams")).distinct()


def build_index(store: Scratch, docs: DataFrame, vocabulary: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``rid, tid, pos, doc_id`` of the terms in ``vocabulary(term, tid)``; the sentinel's
    (tid -1) has the number of terms as ``pos`` and alone carries ``doc_id`` and ``th``, a hash of the text."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.concat(terms(F.col(text_col)), F.array(F.lit(SENTINEL))).alias("_t"))
    rows = rows.select("rid", "doc_id", "th", F.posexplode("_t").alias("pos", "term"))
    hits = attach(rows, vocabulary, ["term"])
    return store.cut(hits.select("rid", F.col("tid").cast("int"), "pos", *[F.when(F.col("tid") == -1, F.col(c)).alias(c) for c in ("doc_id", "th")]), "index")


def search(store: Scratch, index: DataFrame, window_terms: DataFrame, slop: int = 0) -> DataFrame:
    """``rid, wid, start``: where each window of ``window_terms(wid, off, tid)`` is found."""
    counts = index.groupBy("tid").agg(F.count("*").alias("cf"))
    n = Window.partitionBy("wid")
    ranked = attach(window_terms, counts, ["tid"], "left")
    ranked = ranked.withColumn("n", F.count("*").over(n)).withColumn("have", F.count("cf").over(n)).where("n = have")
    ranked = ranked.withColumn("r", F.row_number().over(n.orderBy("cf", "off")))
    ranked = store.cut(ranked.select("wid", "off", "tid", "n", "r"), "ranked")
    postings = index.where("tid >= 0").select("rid", "tid", "pos")

    def starts(rank: int) -> DataFrame:
        return attach(postings, ranked.where(F.col("r") == rank).select("tid", "wid", "off", "n"), ["tid"]).select("rid", "wid", "n", (F.col("pos") - F.col("off")).alias("start"))

    # With reach, a match at the beginning of a text may have its rarest term earlier than its offset.
    first = starts(1).where(F.col("start") >= -slop)
    if slop == 0:
        second = starts(2).select("rid", "wid", "start")
        found = first.where("n = 1").union(first.where("n > 1").join(second, ["rid", "wid", "start"], "left_semi").select(*first.columns))
    else:
        found = first
    found = store.cut(found.distinct(), "candidates")
    # The remaining terms are looked up in the postings of the candidates' documents only.
    left = attach(found, ranked.where(F.col("r") > (2 if slop == 0 else 1)).select("wid", "off", "tid"), ["wid"]).select("rid", "tid", "wid", "start", "off")
    some = attach(postings, found.select("rid").distinct(), ["rid"], "left_semi")
    if slop == 0:
        near = left.withColumn("pos", F.col("start") + F.col("off")).join(some, ["rid", "tid", "pos"])
    else:
        # One equi-key for each place within reach.
        reach = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
        near = left.withColumn("d", reach).withColumn("pos", F.col("start") + F.col("off") + F.col("d")).join(some, ["rid", "tid", "pos"])
    seen = near.groupBy("rid", "wid", "start").agg(F.countDistinct("off").alias("got"))
    need = F.greatest(F.col("n") - (2 if slop == 0 else 1), F.lit(0))
    return found.join(seen, ["rid", "wid", "start"], "left").where(F.coalesce("got", F.lit(0)) == need).select("rid", "wid", "start")


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, *, width: int = 8, min_items: int = 2, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash`` for every row of
    ``docs``; with the hash (``xxhash64``) rows that repeat an id can be told apart."""
    store = Scratch(spark, "decontam")
    grams = store.cut(query_windows(items, width), "grams")
    # Windows and terms are named by rank; both tables grow with the benchmark, not with the corpus.
    windows = store.cut(grams.select("grams").distinct().select(F.xxhash64(F.array_join("grams", " ")).alias("wid"), "grams"), "windows")
    flat = windows.select("wid", F.posexplode("grams").alias("off", "term"))
    names = flat.select("term").distinct().select("term", F.row_number().over(Window.orderBy("term")).alias("tid"))
    names = store.cut(names.union(spark.createDataFrame([(SENTINEL, -1)], "term string, tid int")), "terms")
    window_terms = store.cut(flat.join(names, "term").select("wid", "off", "tid"), "window_terms")
    index = build_index(store, docs, names, id_col=id_col, text_col=text_col)
    found = store.cut(search(store, index, window_terms, slop), "found")
    docs_of = store.cut(index.where("tid = -1").select("rid", "doc_id", F.col("th").alias("text_hash"), F.col("pos").cast("long").alias("n_words")), "lengths")
    store.keep("found", "lengths", "grams", "windows")

    lengths = windows.select("wid", F.size("grams").alias("len"))
    spans = attach(found, lengths, ["wid"]).groupBy("rid", "start").agg(F.max("len").alias("len"))
    # Positions covered by the spans of a document, each once.
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("end", F.col("start") + F.col("len") + slop).withColumn("from", F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).cast("long").alias("n_hit"))
    owners = grams.where("item_id is not null").select(F.xxhash64(F.array_join("grams", " ")).alias("wid"), "item_id").distinct()
    named = attach(found.select("rid", "wid").distinct(), owners, ["wid"]).select("rid", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = docs_of.join(hit, "rid", "left").join(named, "rid", "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.least(F.coalesce("n_hit", F.lit(0).cast("long")), F.col("n_words")).alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"), (F.size(items_col) >= min_items).alias("contaminated"), "text_hash",
    )
