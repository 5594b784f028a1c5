"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence about a page are added as log odds over the languages of a labelled sample:

* text: naive Bayes over hashed character trigrams of the whole visible text, weighed as
  ``most_grams`` average trigrams at most, because neighbouring trigrams are not independent;
* the language declared in the markup (``<html lang>``);
* the address suffix: a language-like path segment, else the host's last label;
* a prior of the page's host, smoothed towards its domain's, which is smoothed towards that of all
  pages. Host and domain counts are grouped sums of the languages that text alone suggests, and a
  page's own vote is taken out of them, so it does not confirm itself.

How far declarations and suffixes can be believed is learned from all pages: the table of (language
by text, evidence) is counted and smoothed.

Scale: pages are read once for the text scores, which are written to the shared folder; the rest works
on one short row a page. Host counts are combined before the shuffle, and joined back as a counted,
then broadcast or salted side, so a host with a third of all pages is spread. The trigram model is
fitted on a sample of labelled documents, of an expected size of at most ``sample`` (a parameter) for
each language; all labelled languages have one. It is sent to the workers as the trigrams that each
language's sample has, so its size is that of the samples, BUCKETS numbers a language at most.

Defined cases: null or empty markup has no text evidence; a null or odd address has no suffix and
host ''. A page without any evidence gets the prior of all pages. Equal scores go to the first
language in code-point order. Repeated rows get equal results. Only the named columns are read.
Without labelled documents, or without pages, the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrays import shipped
from ._store import Scratch, attach
from ._text import let, unit_hash

shipped(__name__)

BUCKETS = 1 << 15
HELD = 64  # languages whose counts a task holds at once
PARTS = 1 << 20  # bytes worked on at once


def buckets(text: bytes) -> np.ndarray:
    """Counts of the text's hashed byte trigrams, over the whole text."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    data = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    for i in range(0, max(len(data) - 2, 0), PARTS):
        d = data[i : i + PARTS + 2]
        g = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        out += np.bincount(g >> np.uint32(17), minlength=BUCKETS)
    return out


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in total.items():
            k = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(counts[k])], names=["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in total:
                if len(total) == HELD:
                    yield from out()
                total[lang] = np.zeros(BUCKETS, np.int64)
            total[lang] += buckets((text or "").lower().encode())
    yield from out()


class Model:
    """Smoothed log probabilities: each language's for a trigram its sample lacks, and by bucket what the others add."""

    def __init__(self, n_langs: int, lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        sums = np.bincount(lang, weights=n, minlength=n_langs) + 0.5 * BUCKETS
        order = np.lexsort((lang, bucket))
        self.base = np.log(0.5 / sums)
        self.lang = lang[order].astype(np.int32)
        self.more = np.log1p(2.0 * n[order])
        self.start = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Log likelihood of the counts in each language."""
        k = np.flatnonzero(counts)
        size = self.start[k + 1] - self.start[k]
        at = np.repeat(self.start[k] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.base * counts.sum() + np.bincount(self.lang[at], weights=self.more[at] * np.repeat(counts[k], size), minlength=len(self.base))


def fit(spark: SparkSession, labelled: DataFrame, sample: int, seed: int = 5) -> tuple[list[str], Model]:
    """All labelled languages, and their model."""
    rows = labelled.where("lang is not null")
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(found)
    at = {g: i for i, g in enumerate(langs)}
    if not langs:
        return [], Model(0, *[np.zeros(0, np.int64)] * 3)
    share = F.element_at(F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, sample / found[g]))]), F.col("lang"))
    got = rows.where(unit_hash(seed, F.col("doc_id")) <= share).select("lang", "text").mapInArrow(_train, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return langs, Model(len(langs), np.array([at[x] for x in got["lang"].to_pylist()], np.int64), got["bucket"].to_numpy(), got["n"].to_numpy())


def articles(html: Column) -> Column:
    """All that is inside articles, nested ones included; '' if there is none with an end."""

    def step(s: Column, piece: Column) -> Column:
        depth = F.when(piece.rlike(r"(?i)^<article[\s/>]"), s["depth"] + 1).when(piece.rlike(r"(?i)^</article[\s/>]"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return let(depth, lambda d: F.struct(d.alias("depth"), F.when(d > 0, F.concat(s["kept"], F.array(piece))).otherwise(s["kept"]).alias("kept")))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    inside = F.aggregate(F.split(html, r"(?i)(?=</?article[\s/>])"), start, step, lambda s: F.array_join(s["kept"], " "))
    return F.when(html.rlike(r"(?is)<article[\s/>].*?</article[\s/>]"), inside).otherwise(F.lit(""))


def visible(html: Column) -> Column:
    """Visible text: all articles if the page has any, without scripts, styles, comments and tags."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    shown = lambda x: F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "[ \\t\\r\\n]+", " ")
    return let(bare, lambda b: let(shown(articles(b)), lambda a: F.when(F.trim(a) != "", a).otherwise(shown(b))))


def evidence(pages: DataFrame, langs: list[str]) -> DataFrame:
    """``page_id, host, domain, declared, suffix, text`` of each page; what is absent is ''."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    segments = F.transform(F.split(path, "/"), lambda s: F.lower(F.regexp_replace(s, "[-_].*$", "")))
    named = F.get(F.filter(segments, lambda s: s.isin(langs)), F.lit(0))
    declared = F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    last = F.substring_index(host, ".", -1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.when(F.size(F.split(host, r"\.")) > 2, F.substring_index(host, ".", -2)).otherwise(host).alias("domain"),
        declared.alias("declared"), F.coalesce(named, F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("."), last))).alias("suffix"), visible(F.col("html")).alias("text"),
    )


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for text in batch.column(5).to_pylist():
                counts = buckets((text or "").lower().encode())
                out.append(model.score(counts))
                n.append(int(counts.sum()))
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(model.base)), pa.array(np.concatenate([np.zeros(0), *out])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], scores, pa.array(n, pa.int64())], names=["page_id", "host", "domain", "declared", "suffix", "ll", "grams"])

    return score


def identify(spark: SparkSession, pages: DataFrame, labelled: DataFrame, *, sample: int = 4000, most_grams: float = 12.0, host_weight: float = 5.0, domain_weight: float = 20.0) -> DataFrame:
    """``page_id, lang, confidence, text_lang, declared, suffix, host`` for every row of ``pages``."""
    store = Scratch(spark, "langid")
    langs, model = fit(spark, labelled, sample)
    n = len(langs)
    if not n:
        return spark.createDataFrame([], "page_id long, lang string, confidence double, text_lang string, declared string, suffix string, host string")
    scored = evidence(pages, langs).mapInArrow(_scorer(model), "page_id long, host string, domain string, declared string, suffix string, ll array<double>, grams long")
    best = F.array_position("ll", F.array_max("ll")).cast("int") - 1  # the first of equal ones
    flat = F.array_max("ll") == F.array_min("ll")
    rows = store.cut(scored.withColumn("vote", F.when(~flat, best)), "scores")

    names = F.array(*[F.lit(x) for x in langs])
    tally = [F.coalesce(F.sum((F.col("vote") == i).cast("double")), F.lit(0.0)) for i in range(n)]

    def counted(by: list[str], name: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.array(*tally).alias(name))

    total = [x + 1.0 for x in counted([], "t").first()["t"]]
    prior = F.array(*[F.lit(x / sum(total)) for x in total])

    def belief(column: str) -> DataFrame:
        """Smoothed log P(evidence | language) of each value; absent evidence says nothing."""
        c = counted([column], "c")
        kinds = c.count() + 1
        sums = [x - 1.0 for x in total]
        odds = F.transform("c", lambda x, i: F.log((x + 1.0) / (F.get(F.array(*[F.lit(s) for s in sums]), i) + F.lit(float(kinds)))))
        return c.select(column, F.when(F.col(column) == "", F.array(*[F.lit(0.0)] * n)).otherwise(odds).alias(f"b_{column}"))

    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((F.col("vote") == i).cast("double"), F.lit(0.0)))
    x = attach(attach(rows, belief("declared"), ["declared"], "left"), belief("suffix"), ["suffix"], "left")
    x = attach(attach(x, counted(["host"], "h"), ["host"], "left"), counted(["domain"], "d"), ["domain"], "left").withColumn("own", own)
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    minus = lambda a: F.zip_with(a, "own", lambda p, q: p - q)
    smooth = lambda a, base, w: F.zip_with(a, base, lambda c, p: (c + w * p) / (size(a) + w))
    x = x.withColumn("h", minus("h")).withColumn("d", minus("d"))
    x = x.withColumn("pd", smooth(F.col("d"), prior, domain_weight)).withColumn("ph", smooth(F.col("h"), F.col("pd"), host_weight))
    logsum = F.transform(F.arrays_zip("ll", "b_declared", "b_suffix", "ph"), lambda z: F.least(F.lit(1.0), F.lit(most_grams) / F.greatest("grams", F.lit(1))) * (z["ll"] - F.array_max("ll")) + z["b_declared"] + z["b_suffix"] + F.log(z["ph"]))
    x = x.withColumn("s", logsum).withColumn("at", F.array_position("s", F.array_max("s")).cast("int"))
    confidence = 1 / size(F.transform("s", lambda v: F.exp(v - F.array_max("s"))))
    return x.select("page_id", F.element_at(names, F.col("at")).alias("lang"), confidence.alias("confidence"), F.get(names, F.col("vote")).alias("text_lang"), "declared", "suffix", "host")
