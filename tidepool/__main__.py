"""Command line: build an index of a folder of CSV or Parquet tables, and search it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import profiling
from .plans import nodes as N
from .plans import tasks
from .plans.planner import Engine, Options
from .sources import readers
from .sources.lake import Lake


def lake_of(spark: SparkSession, a: argparse.Namespace) -> Lake:
    if a.tables:
        return Lake.from_parquet(spark, a.folder, a.tables.split(","), a.index)
    return Lake.from_csv(spark, a.folder, a.index)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidepool", description=__doc__)
    p.add_argument("command", choices=["ingest", "keyword", "column", "rows", "correlation", "union", "registry", "frequencies", "types", "audit"])
    p.add_argument("folder")
    p.add_argument("--index", required=True, help="folder of the written index")
    p.add_argument("--tables", default="", help="names of Parquet tables, by commas; CSV files otherwise")
    p.add_argument("--values", default="", help="query values, by commas; for rows and correlation rows by semicolons (key,number for correlation)")
    p.add_argument("--table", default="", help="query table of the lake, for union")
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--no-pushdown", action="store_true")
    p.add_argument("--resume", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tidepool").getOrCreate()
    lake = lake_of(spark, a)
    engine = Engine(lake, options=Options(pushdown=not a.no_pushdown))
    values = [v for v in a.values.split(",") if v]
    rows = [tuple(r.split(",")) for r in a.values.split(";") if r]
    if a.command == "ingest":
        lake.build(a.resume)
        print(f"{lake.by_token().count()} cells of {len(lake.names)} tables; copies agree: {lake.copies_agree()}")
        return
    out = {
        "keyword": lambda: lake.named(engine.run(N.Keyword(values, k=a.k))).orderBy("rank"),
        "column": lambda: lake.named(engine.run(N.SingleColumn(values, k=a.k))).orderBy("rank"),
        "rows": lambda: lake.named(engine.run(N.MultiColumn(rows, k=a.k))).orderBy("rank"),
        "correlation": lambda: lake.named(engine.run(N.Correlation([r[0] for r in rows], [float(r[1]) for r in rows], k=a.k))).orderBy("rank"),
        "union": lambda: lake.named(engine.run(tasks.union_by_votes(lake.frames[a.table], a.k))).orderBy("rank"),
        "registry": lake.columns,
        "frequencies": lambda: profiling.token_frequencies(lake.by_token()).orderBy("n", ascending=False),
        "types": lambda: profiling.column_types(lake.by_row()).orderBy("table_id", "colid"),
        "audit": lambda: readers.storage_audit(spark, lake.root),
    }[a.command]()
    out.show(a.k if a.command == "frequencies" else 1000, truncate=60)


if __name__ == "__main__":
    main()
