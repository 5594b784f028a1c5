"""The cell normaliser and the row signature, as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOKEN = 200
#: Characters that a token leaves out, and those with Unicode's White_Space property, which it does not begin or end with.
DROPPED = "\\'\"\t\n\r"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Up to so many query tokens become a literal list, which reaches the Parquet scan; more are joined.
LITERAL_TOKENS = 200

# Fixed values of the row signature.
ALPHABET = " 0123456789abcdefghijklmnopqrstuvwxyz"
SEGMENTS, RARE, CHAR_BITS, LENGTH_BITS = 3, 5, 111, 17


def token(value: Column) -> Column:
    """Lower-case text without quotes, backslashes, tabs and line ends, trimmed and cut; '' for null, nan and none."""
    # By an expression that names the text once: Spark evaluates it again for each mention in a branch.
    return F.coalesce(F.regexp_replace(cleaned(value), r"^(?:nan|none)\z", ""), F.lit(""))


def cleaned(value: Column) -> Column:
    """``token`` before null, nan and none become ''; without regular expressions, which took most of a cell's time."""
    text = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), DROPPED, F.lower(value.cast("string")))
    return F.substring(F.btrim(text, F.lit(SPACES)), 1, MAX_TOKEN)


def plain(value: Column) -> Column:
    """``cleaned`` of a number, date, time or truth value, whose text has nothing to clean."""
    return F.lower(value.cast("string"))


def plain_token(value: Column) -> Column:
    """``token`` of such a value."""
    return F.coalesce(F.replace(plain(value), F.lit("nan"), F.lit("")), F.lit(""))


def named(text: Column) -> Column:
    """``token`` of a column of cleaned texts."""
    return F.when(text.isNull() | text.isin("nan", "none"), "").otherwise(text)


def raw_cell(value: Column) -> Column:
    """A cell as it is written, for code overlap; null for empty cells and nan."""
    text = value.cast("string")
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def tokens_of(spark: SparkSession, values: Iterable | DataFrame) -> DataFrame:
    """Distinct, non-empty ``token`` rows of a list of values or of a DataFrame's first column."""
    if isinstance(values, DataFrame):
        rows = values.select(token(values[values.columns[0]]).alias("token"))
    else:
        rows = spark.createDataFrame([(None if v is None else str(v),) for v in values], "v string").select(token(F.col("v")).alias("token"))
    return rows.where("token <> ''").distinct()


def signature(tok: Column) -> Column:
    """``struct(hi, lo)``: the token's 128-bit signature as two longs.

    The five rarest characters (ties by character) each set the bit of their alphabet place and of
    the third of the token in which they lie on average; the field is rotated by the token's length,
    and one more bit tells that length. A rotation moves every set bit by the same distance, so the
    signature is a list of at most six bit positions.
    """
    n = F.length(tok)
    turn = F.floor(F.lit(CHAR_BITS) * F.pmod(n, F.lit(LENGTH_BITS)) / F.lit(LENGTH_BITS)).cast("int")

    def bits(chars: Column) -> Column:
        def stat(c: Column) -> Column:
            places = F.filter(F.transform(chars, lambda x, i: F.when(x == c, i)), lambda i: i.isNotNull())
            mean = F.aggregate(places, F.lit(0.0), lambda a, i: a + i) / F.size(places)
            return F.struct(F.size(places).alias("k"), c.alias("c"), (mean / n).alias("m"))

        rare = F.slice(F.array_sort(F.transform(F.array_distinct(chars), stat)), 1, RARE)
        known = F.filter(rare, lambda s: F.position(s["c"], F.lit(ALPHABET)) > 0)
        at = F.transform(known, lambda s: (F.position(s["c"], F.lit(ALPHABET)) - 1) * SEGMENTS + F.greatest(F.floor(s["m"] * SEGMENTS - 1e-6).cast("int"), F.lit(0)))
        return F.transform(at, lambda p: F.pmod(p + turn, F.lit(CHAR_BITS)))

    chars = F.get(F.transform(F.array(F.split(tok, "")), bits), F.lit(0))
    places = F.when(n == 0, F.array(F.lit(CHAR_BITS))).otherwise(F.concat(chars, F.array(F.lit(CHAR_BITS) + F.pmod(n, F.lit(LENGTH_BITS)))))
    one = F.lit(1).cast("long")

    def half(low: int) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, p: F.when((p >= low) & (p < low + 64), a.bitwiseOR(F.call_function("shiftleft", one, F.pmod(p, F.lit(64))))).otherwise(a))

    return F.struct(half(64).alias("hi"), half(0).alias("lo"))


def signatures(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``hi, lo`` of many tokens at once, each as ``signature`` gives it."""
    texts = tokens.to_pylist()
    n = np.array([len(x) for x in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    places = np.arange(len(chars)) - np.repeat(np.cumsum(n) - n, n)
    each, at, k = np.unique(np.repeat(np.arange(len(n)), n) << 21 | chars, return_inverse=True, return_counts=True)
    mean = np.bincount(at, weights=places, minlength=len(each)) / k
    order = np.lexsort((each, k, each >> 21))
    tok, c, mean = each[order] >> 21, each[order] & ((1 << 21) - 1), mean[order]
    letter = np.full(129, -1)
    letter[[ord(x) for x in ALPHABET]] = np.arange(len(ALPHABET))
    letter = letter[np.minimum(c, 128)]
    rare = (np.arange(len(tok)) - np.searchsorted(tok, tok) < RARE) & (letter >= 0)
    tok, letter, mean = tok[rare], letter[rare], mean[rare]
    third = np.maximum(np.floor(mean / n[tok] * SEGMENTS - 1e-6).astype(np.int64), 0)
    turn = np.floor(CHAR_BITS * (n % LENGTH_BITS) / LENGTH_BITS).astype(np.int64)
    bit = np.concatenate([(letter * SEGMENTS + third + turn[tok]) % CHAR_BITS, CHAR_BITS + n % LENGTH_BITS])
    tok = np.concatenate([tok, np.arange(len(n))])
    halves = np.zeros((2, len(n)), np.uint64)
    np.bitwise_or.at(halves, (bit // 64, tok), np.uint64(1) << (bit % 64).astype(np.uint64))
    lo, hi = halves.view(np.int64)
    return hi, lo


def covers(row_hi: Column, row_lo: Column, hi: Column, lo: Column) -> Column:
    """Whether the row signature has all bits of the other."""
    zero = F.lit(0).cast("long")
    return (hi.bitwiseAND(F.bitwise_not(row_hi)) == zero) & (lo.bitwiseAND(F.bitwise_not(row_lo)) == zero)
