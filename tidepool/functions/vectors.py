"""Vector expressions; sums are in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(v: Column, eps: float = 1e-12) -> Column:
    """Unit length; a zero vector stays zero."""
    return once(v, lambda u: once(F.greatest(norm(u), F.lit(eps)), lambda n: F.transform(u, lambda x: x.cast("double") / n)))


def code(v: Column, planes: list[list[float]]) -> Column:
    """One bit for each hyperplane the vector lies above, the first plane's being the highest."""

    def bits(u: Column) -> Column:
        out = F.lit(0)
        for p in planes:
            out = out * 2 + (dot(u, F.lit([float(x) for x in p])) > 0).cast("int")
        return out.cast("int")

    return once(v, bits)
