"""Removal of long repeated word sequences by recompression.

Every text is rewritten in rounds over its symbols, starting from its words: first runs of two or
three equal symbols get one name, then, twice, neighbouring pairs of a left and a right symbol (a bit
of the symbol's name says which) get one name. A name is a fingerprint of what it stands for, so the
naming is global without a dictionary, and whether symbols merge depends on the symbols alone:
equal substrings get equal symbols except near their ends. A symbol stands for 12 words at most, and
within 12 words of the end of a substring symbols may differ; so every window of 50 words has a
symbol that starts 12 to 26 words after the window does, wherever the window occurs. The one with
the least rank is the window's anchor. An anchor's high-level name covers the 36 words that all its
windows share.

1. Anchors are listed with their high-level names; a Spark round over all of them keeps the names of
   two or more documents.
2. For shared anchors, the whole extent of the anchor's windows is named. Where a smaller document
   has the same extent, all windows of the extent are repeats.
3. For names with different extents, the windows themselves are named and compared.
4. Every repeat has a witness, the place in the smallest document. Neighbouring repeats with one
   witness are joined to long ones, and the words of each are compared with those of its witness. If
   any differ, a name stood for two things, and all rounds are run again with other names. So names
   only have to reveal repeats; what is removed was compared word by word.

Words covered by repeated windows are removed. Texts whose words are all equal are recognised first
by their SHA-256 digest: only the one with the smallest id takes part.

Scale: names are grouped sums combined before the shuffle and joined back with an exchange of their own
(``dealt``), so a passage in a third of all documents is split over tasks. About one anchor for nine
words is shuffled; texts are shuffled only where a document has shared anchors, and repeated words
once for their document and once for their witness.

Defined cases: null and empty texts have no words; texts under 50 words lose none. Rows that repeat
a ``doc_id`` are documents with equal ids: neither is smaller than the other. A null id counts as
larger than all others. Only the id and text columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrays import Spans, U, chunks, mix, shipped, slices, tidy
from ._store import Scratch, attach, dealt

shipped(__name__)

WINDOW = 50
#: Longest symbol, and words at each end of a window whose symbols may differ: 3 after runs, 6 and 12 after the pair rounds.
LONGEST = 12
FIRST, LAST = LONGEST, WINDOW - 2 * LONGEST  #: an anchor starts so many words after its window
_SEEDS = mix(np.arange(1, 9, dtype=U) * U(0x9E3779B97F4A7C15))

FOUND = "doc_id long, th long, n_words long, sha string, keys array<long>, at array<int>"
EXTENTS = "doc_id long, th long, p int, lo int, hi int, extent long, wins array<long>"
WORDS = "doc_id long, th long, lo int, n int, words binary"
KEPT = "doc_id long, th long, n_removed long, sha string"
#: Bits of a name in the first run of the rounds (each further run has twice as many, up to 64), and runs at most.
NAME_BITS, RUNS = 64, 8
#: Bytes of words that a worker hands on at once.
BATCH_BYTES = 1 << 22


def parse(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and the word each starts at, after the run round and two pair rounds. ``text`` numbers
    the words' texts; symbols never reach over two."""
    sym, start = words, np.arange(len(words))
    if len(sym) < 2:
        return sym, start
    new = np.ones(len(sym), dtype=bool)
    new[1:] = (sym[1:] != sym[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    length = np.diff(first, append=len(sym))
    run = (length == 2) | (length == 3)
    named = sym.copy()
    named[first[run]] = mix(sym[first[run]] * _SEEDS[0] + length[run].astype(U))
    inner = np.repeat(run, length) & ~new
    sym, start = named[~inner], start[~inner]
    for r in (1, 2):
        right = (mix(sym ^ _SEEDS[r]) & U(1)).astype(bool)
        pair = ~right[:-1] & right[1:] & (text[start[:-1]] == text[start[1:]])
        named = sym.copy()
        k = np.flatnonzero(pair)
        named[k] = mix(sym[k] * _SEEDS[3] + mix(sym[k + 1] * _SEEDS[4]) + U(r))
        keep = np.ones(len(sym), dtype=bool)
        keep[k + 1] = False
        sym, start = named[keep], start[keep]
    return sym, start


def anchors(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts of all texts, and the anchor (a word index) of each."""
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    many = np.maximum(n - WINDOW + 1, 0)
    starts = np.arange(many.sum()) + np.repeat(at[:-1] - (np.cumsum(many) - many), many)
    if not len(starts):
        return starts, starts
    sym, where = parse(words, text)
    rank = np.full(len(words), np.iinfo(U).max, dtype=U)
    rank[where] = mix(sym ^ _SEEDS[5]) >> U(1)
    # Leftmost least rank among LAST - FIRST + 1 places, by doubling.
    width, have = LAST - FIRST + 1, 1
    best = np.arange(len(words))
    while have < width:
        step = min(have, width - have)
        other = best[step:]
        own = best[: len(best) - step]
        best = np.where(rank[other] < rank[own], other, own)
        have += step
    return starts, best[starts + FIRST]


def _names(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> U(64 - bits)).view(np.int64)


def _find(batches: Iterator[pa.RecordBatch], seed: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, sha, keys, where = [], [], [], []
        for c in chunks(batch.column(2), seed=seed):
            starts, anchor = anchors(c.words, c.at)
            p = np.unique(anchor)
            key = _names(Spans(c.words).of(p - FIRST, p + WINDOW - LAST), bits)
            cut = np.searchsorted(p, c.at)
            for k, t in enumerate(c.texts):
                n_words.append(c.at[k + 1] - c.at[k])
                sha.append(hashlib.sha256(b" ".join(t.split())).hexdigest())
                keys.append(key[cut[k] : cut[k + 1]])
                where.append((p[cut[k] : cut[k + 1]] - c.at[k]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), _lists(keys, np.int64), _lists(where, np.int32)],
            names=["doc_id", "th", "n_words", "sha", "keys", "at"],
        )
    tidy()


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, kind), *parts])))


def _extents(batches: Iterator[pa.RecordBatch], seed: int, bits: int) -> Iterator[pa.RecordBatch]:
    """For the listed anchors of each text: their windows ``lo`` to ``hi``, the extent's name, and the windows' names."""
    for batch in batches:
        wanted = batch.column(3)
        for c in chunks(batch.column(2), seed=seed):
            spans = Spans(c.words)
            starts, anchor = anchors(c.words, c.at)
            out = []
            for k in range(c.hi - c.lo):
                p = np.asarray(wanted[c.lo + k].values, dtype=np.int64) + c.at[k]
                a, b = np.searchsorted(starts, [c.at[k], c.at[k + 1]])
                own = anchor[a:b]
                # A text's windows with one anchor follow each other.
                lo, hi = np.searchsorted(own, p, "left") + a, np.searchsorted(own, p, "right") + a - 1
                out.append((np.full(len(p), c.lo + k), p, starts[lo], starts[hi], np.full(len(p), c.at[k])))
            row, p, lo, hi, base = (np.concatenate(x) for x in zip(*out, strict=True))
            extent = _names(mix(spans.of(lo, hi + WINDOW) ^ mix((p - lo).astype(U) * U(64) + (hi - lo).astype(U))), bits)
            size = hi - lo + 1
            each = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            wins = _names(spans.of(each, each + WINDOW), bits)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array((x - base).astype(np.int32)) for x in (p, lo, hi)), pa.array(extent), pa.ListArray.from_arrays(pa.array(offsets), pa.array(wins))],
                names=["doc_id", "th", "p", "lo", "hi", "extent", "wins"],
            )
    tidy()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each listed place, joined by spaces."""
    for batch in batches:
        rows, places, out, size = [], [], [], 0

        def flush(batch=batch, rows=rows, places=places, out=out):
            take = pa.array(rows, pa.int64())
            lo, n = (pa.array([x[k] for x in places], pa.int32()) for k in ("lo", "n"))
            return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), lo, n, pa.array(out, pa.binary())], names=["doc_id", "th", "lo", "n", "words"])

        for start, texts in slices(batch.column(2)):
            for k, (text, wanted) in enumerate(zip(texts, batch.column(3).slice(start, len(texts)).to_pylist(), strict=True)):
                words = text.split()
                for x in wanted:
                    rows.append(start + k)
                    places.append(x)
                    out.append(b" ".join(words[x["lo"] : x["lo"] + x["n"]]))
                    size += len(out[-1])
                    if size > BATCH_BYTES:
                        yield flush()
                        size = 0
                        for x in (rows, places, out):
                            x.clear()
        yield flush()
    tidy()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the words covered by the windows from ``lo`` to ``hi`` of each listed span."""
    for batch in batches:
        removed, sha = [], []
        for start, texts in slices(batch.column(2)):
            for text, spans in zip(texts, batch.column(3).slice(start, len(texts)).to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                for s in spans:
                    edge[s["lo"]] += 1
                    edge[s["hi"] + WINDOW] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "th", "n_removed", "sha"])
    tidy()


def repeated_spans(store: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows(doc_id, th, text)``: a line for each row with ``first`` (the smallest id with the
    same words), and the spans ``doc_id, th, lo, hi`` of windows that a smaller document has too."""
    for run in range(RUNS):
        line, pieces, texts = _revealed(store, rows, run, min(64, NAME_BITS << run))
        spans = store.cut(_compared(store, pieces, texts), "spans")
        if spans.where("not same").limit(1).count() == 0:
            return line, spans
    raise RuntimeError(f"names stood for different words in each of {RUNS} runs")


SMALLER = "w is not null and (doc_id is null or w.doc_id < doc_id)"


def _witness(lo: str):
    """The first place of a group: of the smallest id, null ids aside."""
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th", F.col(lo).alias("lo")))).alias("w")


def _revealed(store: Scratch, rows: DataFrame, seed: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, repeats ``doc_id, th, lo, hi, w(doc_id, th, lo)`` by name, and the texts they are in."""
    found = store.cut(rows.mapInArrow(partial(_find, seed=seed, bits=bits), FOUND), "found")
    equal = dealt(found, ["sha"], F.min("doc_id").alias("first"))
    line = store.cut(found.select("doc_id", "th", "n_words", "sha").join(equal, "sha"), "lines")
    lead = line.where("doc_id <=> first").select("doc_id", "th")
    listed = found.where("n_words >= 50").join(lead.dropDuplicates(), _by(found, lead), "left_semi").select("doc_id", "th", F.explode(F.arrays_zip("keys", "at")).alias("x"))
    listed = store.cut(listed.select("doc_id", "th", F.col("x.keys").alias("key"), F.col("x.at").alias("p")), "anchors")
    shared = dealt(listed, ["key"], F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max(F.col("doc_id").isNull()).alias("none")).where("a < b or (a is not null and none)").select("key")
    shared = store.cut(listed.join(shared, "key"), "shared")
    store.drop("found")
    store.drop("anchors")

    per = shared.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    texts = attach(rows, shared.select("doc_id").distinct(), ["doc_id"], "left_semi", salted=False)
    texts = store.cut(texts.dropDuplicates(["doc_id", "th"]).join(per.withColumnsRenamed({"doc_id": "_d", "th": "_t"}), F.expr("doc_id <=> _d and th = _t")).select("doc_id", "th", "text", "ps"), "texts")
    ext = texts.mapInArrow(partial(_extents, seed=seed, bits=bits), EXTENTS)
    key = shared.dropDuplicates(["doc_id", "th", "p"]).withColumnsRenamed({"doc_id": "_d", "th": "_t", "p": "_p"})
    ext = store.cut(ext.join(key, F.expr("doc_id <=> _d and th = _t and p = _p")).select("doc_id", "th", "key", "p", "lo", "hi", "extent", "wins"), "extents")
    several = dealt(ext, ["key"], F.min("extent").alias("x"), F.max("extent").alias("y")).where("x <> y").select("key")
    ext = store.cut(ext.join(dealt(ext, ["key", "extent"], _witness("lo")), ["key", "extent"]), "judged")
    whole = ext.where(SMALLER).select("doc_id", "th", "lo", "hi", "w")
    # Extents that differ below one name: their windows, named with their place before the anchor.
    part = ext.where(f"not ({SMALLER})").join(several, "key").select("doc_id", "th", "key", (F.col("p") - F.col("lo")).alias("o"), "lo", F.posexplode("wins").alias("j", "win"))
    part = store.cut(part.select("doc_id", "th", "key", (F.col("o") - F.col("j")).alias("o"), (F.col("lo") + F.col("j")).alias("lo"), "win"), "windows")
    # The smallest document of an extent is never settled by it, so the unsettled windows have all witnesses.
    single = part.join(dealt(part, ["key", "o", "win"], _witness("lo")), ["key", "o", "win"]).where(SMALLER).select("doc_id", "th", "lo", F.col("lo").alias("hi"), "w")
    return line, store.cut(_long(whole.union(single)), "pieces"), texts


def _long(pieces: DataFrame) -> DataFrame:
    """Neighbouring pieces with one witness as one: ``doc_id, th, lo, hi, wd, wt, wl``."""
    t = pieces.select("doc_id", "th", "lo", "hi", F.col("w.doc_id").alias("wd"), F.col("w.th").alias("wt"), (F.col("w.lo") - F.col("lo")).alias("shift"))
    w = Window.partitionBy("doc_id", "th", "wd", "wt", "shift").orderBy("lo")
    t = t.withColumn("new", F.coalesce(F.col("lo") > F.lag("hi").over(w) + 1, F.lit(True)).cast("int"))
    t = t.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.groupBy("doc_id", "th", "wd", "wt", "shift", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return t.select("doc_id", "th", "lo", "hi", "wd", "wt", (F.col("lo") + F.col("shift")).alias("wl"))


def _compared(store: Scratch, pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, th, lo, hi, same``: whether the piece's words are those of its witness."""
    n = (F.col("hi") - F.col("lo") + WINDOW).cast("int").alias("n")
    places = pieces.select("doc_id", "th", "lo", n).union(pieces.select("wd", "wt", "wl", n)).distinct()
    per = places.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "n")).alias("places")).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    words = texts.join(per, F.expr("doc_id <=> _d and th = _t")).select("doc_id", "th", "text", "places").mapInArrow(_words, WORDS)
    words = store.cut(words, "words")
    side = lambda x: words.withColumnsRenamed({c: f"{x}_{c}" for c in words.columns})
    both = pieces.withColumn("n", n).join(side("a"), F.expr("doc_id <=> a_doc_id and th = a_th and lo = a_lo and n = a_n")).join(side("b"), F.expr("wd = b_doc_id and wt = b_th and wl = b_lo and n = b_n"))
    return both.select("doc_id", "th", "lo", "hi", (F.col("a_words") == F.col("b_words")).alias("same"))


def _by(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def remove_repeats(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``."""
    store = Scratch(spark, "substring")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    line, spans = repeated_spans(store, rows)
    store.keep("lines", "spans", "texts")
    per = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    texts = spark.read.schema("doc_id long, th long, text string").parquet(f"{store.root}/texts")
    kept = texts.join(per, F.expr("doc_id <=> _d and th = _t")).select("doc_id", "th", "text", "spans").mapInArrow(_remove, KEPT)
    kept = kept.withColumnsRenamed({"doc_id": "_d", "th": "_t", "sha": "_sha"})
    copy = (F.col("n_words") >= WINDOW) & F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("first") < F.col("doc_id")))
    out = line.join(kept, F.expr("doc_id <=> _d and th = _t"), "left")
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )
