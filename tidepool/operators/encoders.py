"""Column vectors: a registry of encoders, the built-in one, and building and querying a vector index.

An encoder maps cells ``(table_id, colid, rowid, value)`` to ``(table_id, colid, embedding)``. The
built-in ``hashing`` encoder averages the hashed trigram vectors of a column's different values, so
it needs no model file. Encoders with a model of their own are registered by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalise
from ..sources.lake import Lake
from ..sources.storage import exists
from .vectors import hashing_encoder

Encoder = Callable[[DataFrame], DataFrame]
_ENCODERS: dict[str, Encoder] = {}
#: Characters of a cell, and rows of a table, that an encoder looks at.
CELL_CHARS, DIM = 64, 32


def register(name: str, encoder: Encoder) -> None:
    if name in _ENCODERS:
        raise ValueError(f"encoder {name!r} is registered already")
    _ENCODERS[name] = encoder


def get(name: str) -> Encoder:
    if name not in _ENCODERS:
        raise KeyError(f"no encoder {name!r}; there are {sorted(_ENCODERS)}")
    return _ENCODERS[name]


def hashing(cells: DataFrame) -> DataFrame:
    """The normalised mean of the vectors of a column's different values; columns without values have none."""
    values = cells.where("value is not null").select("table_id", "colid", F.substring("value", 1, CELL_CHARS).alias("value")).distinct()
    v = values.select("table_id", "colid", F.posexplode(hashing_encoder(F.col("value"), DIM)).alias("i", "x"))
    sums = v.groupBy("table_id", "colid", "i").agg(F.avg("x").alias("x"))
    rows = sums.groupBy("table_id", "colid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("e"))
    return rows.select("table_id", "colid", normalise(F.col("e")).alias("embedding"))


register("hashing", hashing)


def vector_index(lake: Lake, encoder: str = "hashing", names: list[str] | None = None) -> DataFrame:
    """``global_id, table_id, colid, embedding`` of a lake's columns; written once for each encoder."""
    names = names or lake.names
    path = f"{lake.root}/vectors-{encoder}-{'-'.join(str(lake.id_of(n)) for n in names)}"
    if not exists(lake.spark, f"{path}/_SUCCESS"):
        parts = None
        for n in names:
            v = get(encoder)(lake.raw(n))
            parts = v if parts is None else parts.unionByName(v)
        ids = lake.columns().select("global_id", "table_id", "colid")
        parts.join(F.broadcast(ids), ["table_id", "colid"]).select("global_id", "table_id", "colid", "embedding").write.mode("overwrite").parquet(path)
    return lake.spark.read.parquet(path)


def query_vectors(spark: SparkSession, df: DataFrame, encoder: str = "hashing") -> DataFrame:
    """``query_col, embedding`` of a table that is not in the lake; columns without values are left out."""
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) < len(lowered):
        raise ValueError(f"column names repeat: {df.columns}")
    if not df.columns or df.limit(1).count() == 0:
        raise ValueError("the query table is empty")
    cells = F.array(*[F.struct(F.lit(j).alias("colid"), F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("value")) for j, c in enumerate(df.columns)])
    rows = df.select(F.explode(cells).alias("c")).select(F.lit(-1).alias("table_id"), "c.colid", F.lit(0).cast("long").alias("rowid"), "c.value").where("value <> 'NaN'")
    return get(encoder)(rows).select(F.col("colid").alias("query_col"), "embedding")
