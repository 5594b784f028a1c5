"""Cells of arriving rows, appended to an index; windowed counts of arriving events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import token


def cells_of(rows: DataFrame, table_id: int, rowid: str) -> DataFrame:
    """Cells of a stream whose rows carry their number; quadrants need a whole table and are null."""
    cells = F.array(*[F.struct(F.lit(j).alias("colid"), token(F.col(f"`{c}`")).alias("token")) for j, c in enumerate(x for x in rows.columns if x != rowid)])
    return rows.select(F.lit(table_id).alias("table_id"), F.col(rowid).cast("long").alias("rowid"), F.explode(cells).alias("c")).select("table_id", "c.colid", "rowid", "c.token", F.lit(None).cast("boolean").alias("quadrant"))


def append(stream: DataFrame, table_id: int, rowid: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write the stream's cells batch by batch. A batch replaces its own folder, so a batch that is
    run again after a failure is not appended twice."""

    def write(batch: DataFrame, number: int) -> None:
        cells_of(batch, table_id, rowid).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Windowed counts by event type; what is later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def arriving(spark: SparkSession, schema: str, folder: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
