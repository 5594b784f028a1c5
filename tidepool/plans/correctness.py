"""What pushdown and input order change: arms of one plan, compared with plain set semantics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, setops
from .nodes import Difference, Intersection, Node
from .planner import Engine, Options

ARMS = ("optimised", "forward", "backward", "no_pushdown", "exact_first", "widened")


def _with(engine: Engine, **changes) -> Engine:
    return replace(engine, options=replace(engine.options, **changes), _memo={})


def run_arm(engine: Engine, node: Node, arm: str, width: int = 500) -> DataFrame:
    """One arm's ranking: cost order, the given order, its reverse, plain set semantics, approximate
    inputs last, or approximate filters widened."""
    if arm == "optimised":
        return engine.run(node)
    if arm in ("forward", "backward"):
        if isinstance(node, Intersection):
            node = replace(node, inputs=node.inputs if arm == "forward" else node.inputs[::-1], fixed=True)
        return engine.run(node)
    options: dict = {"no_pushdown": {"pushdown": False}, "exact_first": {"exact_first": True}, "widened": {"guard_width": width}}[arm]
    return _with(engine, **options).run(node)


def full_result(engine: Engine, node: Intersection | Difference) -> DataFrame:
    """The set that no input's cut limits: every table that all inputs match, or the first but not the second."""
    legs = [engine.scored(x).select("table_id").distinct() for x in node.inputs]
    out = legs[0]
    for leg in legs[1:]:
        out = out.join(leg, "table_id", "left_semi" if isinstance(node, Intersection) else "left_anti")
    return out


def sound(engine: Engine, node: Intersection) -> bool:
    """All arms' tables are in the full intersection."""
    full = full_result(engine, node)
    return all(run_arm(engine, node, a).join(full, "table_id", "left_anti").limit(1).count() == 0 for a in ("optimised", "forward", "backward", "no_pushdown"))


def compare(engine: Engine, node: Node, arms: Sequence[str] = ARMS) -> DataFrame:
    """``arm`` with retention, additions, changed, distance and overlap of ranks against plain semantics."""
    as_run = lambda df: df.select(F.lit(0).alias("query"), "rank", F.col("table_id").alias("item"))
    # The arms search the same cells many times.
    engine.lake.by_token()
    ref = as_run(setops.distinct_tables(run_arm(engine, node, "no_pushdown")))
    out = None
    for a in arms:
        row = metrics.compared(as_run(setops.distinct_tables(run_arm(engine, node, a))), ref).select(F.lit(a).alias("arm"), "retention", "additions", "changed", "distance", "rbo")
        out = row if out is None else out.unionByName(row)
    return out


def width_curve(engine: Engine, node: Intersection, widths: Sequence[int]) -> DataFrame:
    """``width, n, recovered``: how much of the full intersection is found when the inputs are wider."""
    full = full_result(engine, node)
    total = full.count()
    rows = []
    for w in widths:
        wide = replace(node, inputs=tuple(x.cut(max(w, x.k)) for x in node.inputs))
        n = engine.run(wide.cut(max(w, node.k))).select("table_id").distinct().join(full, "table_id", "left_semi").count()
        rows.append((w, n, n / total if total else 1.0))
    return engine.lake.spark.createDataFrame(rows, "width int, n long, recovered double")


def disagreement(runs: DataFrame) -> DataFrame:
    """``runs(arm, repeat, rank, item)``: how often two runs differ, within and between arms, as lists and as sets."""
    listed = runs.groupBy("arm", "repeat").agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("l"), F.sort_array(F.collect_set("item")).alias("s"))
    a, b = listed.select(F.struct("arm", "repeat").alias("x"), "l", "s"), listed.select(F.struct("arm", "repeat").alias("y"), F.col("l").alias("l2"), F.col("s").alias("s2"))
    # Runs of an experiment: a stated, small set.
    pairs = a.join(F.broadcast(b), F.col("x") < F.col("y"))
    return pairs.groupBy((F.col("x.arm") == F.col("y.arm")).alias("same_arm")).agg(F.count("*").alias("pairs"), F.avg((F.col("l") != F.col("l2")).cast("double")).alias("lists_differ"), F.avg((F.col("s") != F.col("s2")).cast("double")).alias("sets_differ"))


def allowed_set(engine: Engine, positives: DataFrame, c: int, size: int, outside: DataFrame, seed: int = 0) -> DataFrame:
    """A table filter for pushdown experiments: the first ``c`` positives and seeded decoys that are not in ``outside``."""
    first = positives.orderBy("rank").limit(c).select("table_id")
    others = engine.lake.sidecar().select("table_id").join(outside.select("table_id"), "table_id", "left_anti").join(first, "table_id", "left_anti")
    return first.unionByName(others.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "table_id")), "table_id").limit(max(0, size - c)))
