"""Line dedup by content-defined chunks.

A rolling hash over each line and the line before it ends a chunk wherever it is divisible by
``mean_lines``, so boundaries depend on the lines around them and not on their place in the text.
A chunk of two lines or more that is found again anywhere in the table is removed, except where it
comes first (by ``doc_id``, nulls last, then place). Chunks are found by hash; one is removed only
after its bytes were compared with those of the first.

Scale: chunks are listed without their text (hash, place); counts are combined before the shuffle.
Only texts of documents with a repeated chunk are asked for its bytes. A chunk that a third of all
documents have is one row in the list of first chunks, joined by a key that adaptive execution splits.

Defined cases: null texts stay null, empty ones empty. A text whose chunks are all removed becomes
empty. A text of equal lines only is one chunk or single lines. Repeated rows with one ``doc_id`` and
the same text are one document: their chunks are compared with other documents' and within the text.
Other columns are kept as they are; internal names start with an underscore and are structs of their
own, so clashing names do not matter. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, attach
from ._text import let, whole_row

_PLACE = 1 << 31  # a chunk is the number first_line * _PLACE + lines


def chunk_spans(lines: Column, mean_lines: int) -> Column:
    """Array of ``first_line * 2**31 + number_of_lines``."""

    def ends(h: Column) -> Column:
        roll = lambda i: F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(mean_lines)) == 0
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == F.size(h) - 1) | roll(i))

    def spans(e: Column) -> Column:
        first = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1)
        return F.transform(e, lambda x, k: first(k).cast("long") * _PLACE + (x - first(k) + 1))

    return let(let(F.transform(lines, lambda x: F.xxhash64(x)), ends), spans)


def _of(lines: Column, span: Column) -> Column:
    return F.slice(lines, (F.floor(span / _PLACE) + 1).cast("int"), F.pmod(span, F.lit(_PLACE)).cast("int"))


def repeated_chunks(store: Scratch, rows: DataFrame, mean_lines: int, min_lines: int = 2) -> DataFrame:
    """Of ``rows(doc_id, th, text)``: ``doc_id, th, spans`` of the chunks to remove."""
    lines = F.split("text", "\n")
    found = rows.where("text is not null").select(
        "doc_id", "th",
        F.explode(let(lines, lambda a: F.transform(F.filter(chunk_spans(a, mean_lines), lambda s: F.pmod(s, F.lit(_PLACE)) >= min_lines), lambda s: F.struct(s.alias("span"), F.xxhash64(_of(a, s)).alias("h"))))).alias("c"),
    )
    found = store.cut(found.select("doc_id", "th", F.col("c.span").alias("span"), F.col("c.h").alias("h")).dropDuplicates(["doc_id", "th", "span"]), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "span")
    first = found.groupBy("h").agg(F.min(place).alias("f"), F.count("*").alias("k")).where("k > 1").select("h", "f")
    # Written first, so that both sides of the join are dealt for it and a hot chunk can be split.
    own = found.join(store.cut(first, "first"), "h").withColumn("lead", F.expr("doc_id <=> f.doc_id and th = f.th and span = f.span"))
    own = store.cut(own.select("doc_id", "th", "span", "h", "lead"), "repeated")

    ids = own.select("doc_id").distinct()
    texts = attach(rows, ids, ["doc_id"], "left_semi", salted=False).dropDuplicates(["doc_id", "th"])
    per = own.groupBy("doc_id", "th").agg(F.collect_list(F.struct("span", "h", "lead")).alias("cs")).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    pieces = texts.join(per, F.expr("doc_id <=> _d and th = _t")).select(
        "doc_id", "th", F.explode(let(lines, lambda a: F.transform("cs", lambda c: F.struct(c["span"].alias("span"), c["h"].alias("h"), c["lead"].alias("lead"), F.array_join(_of(a, c["span"]), "\n").alias("bytes"))))).alias("c")
    )
    pieces = store.cut(pieces.select("doc_id", "th", "c.*"), "pieces")
    leads = pieces.where("lead").select("h", F.col("bytes").alias("_bytes"))
    same = pieces.where("not lead").join(leads, "h").where(F.col("bytes") == F.col("_bytes"))
    return same.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"))


def dedup_lines(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = 3) -> DataFrame:
    """The rows of ``docs`` with repeated chunks taken out of the text, and ``_lines, _removed`` (input
    columns of these two names are replaced)."""
    store = Scratch(spark, "lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    gone = store.cut(repeated_chunks(store, rows, mean_lines), "gone").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    store.keep("gone")
    whole = docs.select(whole_row(docs), docs[id_col].alias("_id"), docs[text_col].alias("_text"), F.xxhash64(docs[text_col]).alias("_th"))
    both = attach(whole, gone, ["_id", "_th"], "left", salted=False, cells=F.size("_spans"))
    lines = F.split("_text", "\n")
    keep = let(lines, lambda a: F.array_join(F.flatten(F.transform(F.array_except(chunk_spans(a, mean_lines), F.col("_spans")), lambda s: _of(a, s))), "\n"))
    text = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(keep)
    removed = F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda x, s: x + F.pmod(s, F.lit(_PLACE))), F.lit(0).cast("long"))
    return both.select(
        *[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("_lines", "_removed")],
        F.coalesce(F.size(lines).cast("long"), F.lit(0).cast("long")).alias("_lines"), removed.alias("_removed"),
    )
