"""Column expressions on whole texts. All are JVM-side; none looks at a prefix only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as in ``[^\x20\x09-\x0D]+``.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside lambdas (where a plain
    column expression would be evaluated again for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of ``[^\\x20\\x09-\\x0D]+`` of the whole text; null and blank texts have none."""
    return let(
        F.trim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS)),
    )


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(word: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def terms(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    split = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.transform(F.filter(split, lambda w: w != ""), ascii_lower)


def unit_hash(seed: int, value: Column) -> Column:
    """A number in (0, 1) that is fixed by the seed and the value, from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(value.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``_row``, so that their names cannot clash with an operator's own."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias("_row")
