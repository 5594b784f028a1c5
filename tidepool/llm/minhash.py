"""Near-duplicate groups by b-bit MinHash.

Each text becomes the set of its distinct 5-word shingles. 128 minima are cut into 25 bands of 5 for
candidates, and their low 4 bits are packed into eight longs. Texts with the same shingle set are one
class, so exact copies never meet. Candidates:

1. In every band bucket whose classes are in several components, each class outside the largest is
   paired with one leader of it (a star, not all pairs), at first the class whose minima are the most
   common, then others by chance. Pairs need enough equal low bits: the collision-corrected estimate
   is ``(matches / 128 - 1/16) / (1 - 1/16)``. They are confirmed on the full sets, and components of
   the links are formed. This is repeated while it finds links.
2. The classes of buckets that are then still in several components are joined exactly, by prefix
   filtering on their shingles in order of frequency, so no link between the texts of a bucket is
   lost; pairs within a component are not tried.

A pair misses all bands with a chance of 4e-7 at a similarity of 0.85 and 5e-5 at 0.8, and falls
below the bit-count threshold with about 3e-7.

Scale: every text is read once, and those of candidate pairs a second time. What is shuffled is 25
band keys a class, pairs, and the shingle sets of classes in pairs or in unsettled buckets. Hot buckets are joined by keys
that adaptive execution splits; nothing is collected.

Defined cases: a text of fewer than 5 words is one shingle of all its words; null texts and texts
without words have an empty set and are linked with nothing. Rows that repeat a ``doc_id`` are one
document with several texts. Rows with a null id are linked but never name a component: they are
kept unless their component has a name. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrays import SLICE_ROWS, Spans, U, chunks, mix, shipped, tidy
from ._store import Scratch, attach, components, dealt

shipped(__name__)

SHINGLE, PERMS, BANDS, ROWS, BITS = 5, 128, 25, 5, 4
MIN_ROUNDS, MAX_ROUNDS = 2, 8
_A = mix(np.arange(1, PERMS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_B = mix(np.arange(1, PERMS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))
_BAND = mix(np.arange(1, BANDS + 1, dtype=U))

SIGNATURES = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>, packed array<long>"
SETS = "s1 long, s2 long, shingles array<long>"


def shingle_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """For each text of the column its sorted distinct shingles."""
    for c in chunks(col, lower=True):
        spans, n = Spans(c.words), len(c.words)
        i = np.arange(n)
        grams = spans.of(i, np.minimum(i + SHINGLE, n))
        for k in range(c.hi - c.lo):
            a, b = c.at[k], c.at[k + 1]
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                yield spans.of(np.array([a]), np.array([b]))
            else:
                yield grams[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(PERMS, np.iinfo(U).max, dtype=U)
    for i in range(0, len(shingles), 2048):
        np.minimum(best, (shingles[i : i + 2048, None] * _A + _B).min(axis=0), out=best)
    return best


def pack(low: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum, 16 to a long."""
    per = 64 // BITS
    shift = np.arange(per, dtype=U) * U(BITS)
    return ((low & U((1 << BITS) - 1)).reshape(-1, per) << shift).sum(axis=1, dtype=U)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sig, bands, packed = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            if len(s):
                m = minima(s)
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                rows = m[: BANDS * ROWS].reshape(BANDS, ROWS)
                key = _BAND.copy()
                for r in range(ROWS):
                    key = mix(key ^ rows[:, r])
                bands.append(key.view(np.int64))
                packed.append(pack(m).view(np.int64))
            else:
                sig.append(bytes(16))
                bands.append(np.zeros(0, np.int64))
                packed.append(np.zeros(0, np.int64))
        s = np.frombuffer(b"".join(sig), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), lists(bands), lists(packed)],
            names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "bands", "packed"],
        )
    tidy()


def lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            sets = list(shingle_sets(batch.column(1).slice(lo, SLICE_ROWS)))
            s = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), lists([x.view(np.int64) for x in sets])], names=["s1", "s2", "shingles"])
    tidy()


def matches(a: Column, b: Column) -> Column:
    """Equal low-bit groups of two packed signatures, by bit counts."""
    ones = F.lit(int("1" * 16, 16))

    def differing(x: Column) -> Column:
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(ones))

    return F.lit(PERMS) - F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def least_matches(percent: int) -> int:
    """Matches that a pair of the similarity has at least, but for a chance of about 3e-7: five
    standard deviations below the mean. 90 of 128 at 0.85 (110 are expected), 81 at 0.8."""
    p = percent / 100 + (1 - percent / 100) / 2**BITS
    return math.floor(PERMS * p - 5 * math.sqrt(PERMS * p * (1 - p)))


def estimate(found: Column) -> Column:
    c = 1 / 2**BITS
    return (found / PERMS - c) / (1 - c)


def near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash, kept`` for every row of ``docs``; links have
    ``100 * intersection >= percent * union``. With the hash (``xxhash64``) rows that repeat an id can
    be told apart."""
    store = Scratch(spark, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = store.cut(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_signatures, SIGNATURES), "signatures")
    # A class is a set of shingles; its name is the smallest doc_id that has it (null if none).
    names = dealt(sig.where("n_shingles > 0"), ["s1", "s2"], F.min("doc_id").alias("cls"))
    member = store.cut(sig.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(names, ["s1", "s2"], "left"), "member")
    reps = names.where("cls is not null").join(sig.select("s1", "s2", F.col("doc_id").alias("cls"), "n_shingles", "bands", "packed"), ["s1", "s2", "cls"])
    reps = store.cut(reps.dropDuplicates(["s1", "s2"]).select("cls", "s1", "s2", F.col("n_shingles").alias("n"), "bands", "packed"), "reps")
    store.drop("signatures")

    band = reps.select("cls", F.explode("bands").alias("key"))
    several = dealt(band, ["key"], F.count("*").alias("c")).where("c > 1")
    bucket = store.cut(band.join(several, "key"), "buckets")
    # How common a class's minima are: the text from which others were made has the highest weight.
    weight = store.cut(bucket.groupBy("cls").agg(F.sum("c").alias("w")), "weights")
    bucket = store.cut(bucket.select("key", "cls").join(weight, "cls"), "weighted")
    links, comp, old = None, weight.select("cls", F.col("cls").alias("comp")), []
    for r in range(MAX_ROUNDS):
        mixed = store.cut(_mixed(bucket, comp), f"mixed{r}")
        star = mixed.where("comp <> lead.comp").select(F.col("cls").alias("a"), F.col("lead.cls").alias("b"))
        star = _likely(star.distinct(), reps, percent)
        if r == 0:
            star = star.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
        new = store.cut(_confirmed(store, star, reps, rows, percent, f"sets{r}"), f"links{r}")
        found = new.count()
        links = new if links is None else links.union(new)
        if found or r == 0:
            comp = components(store, links, f"cc{r}-")
            comp = store.cut(weight.select("cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("comp")), f"comp{r}")
            bucket = bucket.join(_still_mixed(bucket, comp), "key")
        for name in old:
            store.drop(name)
        old = [f"mixed{r}", f"sets{r}"]
        bucket = store.cut(bucket.withColumn("w", F.xxhash64("key", "cls", F.lit(r))), f"buckets{r}")
        if r >= MIN_ROUNDS - 1 and found * 20 <= links.count():
            break

    left = store.cut(bucket.select("cls").distinct(), "left")
    sets = _sets_of(store, left, reps, rows, "sets")
    cross = store.cut(_prefix_pairs(sets, comp, percent), "cross")
    more = store.cut(_similar(_likely(cross, reps, percent).select("a", "b"), sets, percent), "links")

    named = member.join(components(store, links.union(more), "cc").select(F.col("node").alias("cls"), "component"), "cls", "left")
    out = store.cut(named.select("doc_id", "n_shingles", F.coalesce("component", "cls", "doc_id").alias("component_id"), "text_hash"), "result")
    store.keep("result")
    return out.withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _still_mixed(bucket: DataFrame, comp: DataFrame) -> DataFrame:
    """``key`` of the buckets whose classes are in several components."""
    return dealt(bucket.join(comp, "cls"), ["key"], F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")


def _mixed(bucket: DataFrame, comp: DataFrame) -> DataFrame:
    """``key, cls, comp`` and the bucket's ``lead(comp, cls)``: of the component with most members, the
    class with the highest weight. Grouped maxima only."""
    inside = bucket.join(comp, "cls")
    per = inside.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max(F.struct("w", "cls")).alias("top"))
    lead = dealt(per, ["key"], F.max(F.struct("c", "top", "comp")).alias("x"))
    lead = lead.select("key", F.struct(F.col("x.comp").alias("comp"), F.col("x.top.cls").alias("cls")).alias("lead"))
    return inside.select("key", "cls", "comp").join(lead, "key")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose low bits match often enough, with ``m``."""
    side = lambda x: reps.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("packed").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(fits).withColumn("m", matches(F.col("pa"), F.col("pb"))).where(F.col("m") >= least_matches(percent)).select("a", "b", "m")


def _sets_of(store: Scratch, classes: DataFrame, reps: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``cls, shingles`` of the classes, from their texts."""
    texts = attach(rows, classes.select(F.col("cls").alias("doc_id")), ["doc_id"], "left_semi", salted=False)
    sets = texts.select("doc_id", "text").mapInArrow(_sets, SETS)
    return store.cut(sets.join(reps.select("s1", "s2", "cls"), ["s1", "s2"]).dropDuplicates(["s1", "s2"]).select("cls", "shingles"), name)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u")).where(100 * F.col("i") >= percent * F.col("u")).select("a", "b")


def _confirmed(store: Scratch, pairs: DataFrame, reps: DataFrame, rows: DataFrame, percent: int, name: str) -> DataFrame:
    pairs = store.cut(pairs.select("a", "b"), f"{name}-pairs")
    ids = store.cut(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), f"{name}-ids")
    return _similar(pairs, _sets_of(store, ids, reps, rows, name), percent)


def _size_class(n: Column) -> Column:
    """Classes of sizes that differ by 2 % at most."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(1.02))).cast("int")


def _prefix_pairs(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of different components that can be similar enough, by prefixes.

    With shingles in order of their frequency among these classes, similar sets share one of the first
    ``n - ceil(percent * n / 100) + 1`` of each, and what is left after the first shared one must be
    enough. Shingles of one class take places but meet nothing, so texts that were each changed in
    several places meet few others. Every prefix key with several components pairs the classes
    outside its largest with the others.

    What is left from a key on bounds the partner's size, from above by ``most`` and by the similarity
    itself. The join is by key and size class, so only pairs of fitting sizes are made: pages of one
    template, where what is left is the template, meet only where they are similar enough.
    """
    flat = sets.select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    df = dealt(flat, ["key"], F.count("*").alias("df")).where("df > 1")
    known = flat.join(df, "key").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("ks"))
    first = F.col("n") - F.size("ks")
    take = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1 - first
    prefix = known.where(take > 0).select("cls", "n", F.posexplode(F.slice("ks", F.lit(1), take)).alias("i", "k"), first.alias("first"))
    prefix = prefix.select(F.col("k.key").alias("key"), "cls", "n", (F.col("n") - F.col("first") - F.col("i")).alias("rest")).join(comp, "cls")
    most = F.floor(F.col("rest") * (100 + percent) / percent).cast("int") - F.col("n")
    prefix = prefix.withColumns({"least": F.ceil(F.lit(percent) * F.col("n") / 100).cast("int"), "most": F.least(F.floor(F.lit(100) * F.col("n") / percent).cast("int"), most)}).where("least <= most")
    sizes = prefix.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = dealt(sizes, ["key"], F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count("*").alias("k")).where("k > 1").select("key", "main")
    some = prefix.join(main, "key")
    sides = ("cls", "n", "most", "comp")
    a = some.where("comp <> main").select("key", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))).alias("size"), *[F.col(c).alias(f"{c}_a") for c in sides])
    b = some.select("key", _size_class(F.col("n")).alias("size"), "main", *[F.col(c).alias(f"{c}_b") for c in sides])
    fits = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and n_b <= most_a and n_a <= most_b")
    met = a.join(b, (a["key"] == b["key"]) & (a["size"] == b["size"]) & F.expr("comp_a <> comp_b and (comp_b = main or cls_a < cls_b)") & fits)
    return met.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
