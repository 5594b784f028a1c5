"""Ready-made plans for common discovery tasks. Query tables are Spark DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .nodes import Correlation, Counter, Difference, Intersection, Keyword, MultiColumn, Node, SimHash, SingleColumn, Union


def keyword_search(values, k: int = 10) -> Node:
    return Keyword(values, k=k)


def single_column_join(values, k: int = 10) -> Node:
    return SingleColumn(values, k=k)


def multi_column_join(rows, k: int = 10) -> Node:
    return MultiColumn(rows, k=k)


def correlation_search(source, target=None, k: int = 10) -> Node:
    return Correlation(source, target, k=k)


def _each_column(df: DataFrame, k: int) -> tuple[Node, ...]:
    return tuple(SingleColumn(df.select(f"`{c}`"), k=k) for c in df.columns)


def union_search(df: DataFrame, k: int = 10) -> Node:
    return Union(_each_column(df, 10 * k), k=k)


def union_by_votes(df: DataFrame, k: int = 10) -> Node:
    return Counter(_each_column(df, 10 * k), k=k)


def union_by_codes(table_id: int, colids: Sequence[int], k: int = 10) -> Node:
    return Counter(tuple(SimHash(table_id=table_id, colid=c, k=10 * k) for c in colids), k=k)


def imputation(examples, queries, k: int = 10) -> Node:
    """Tables that hold the example rows and the keys to be filled."""
    return Intersection((MultiColumn(examples, k=10 * k), SingleColumn(queries, k=30 * k)), k=k)


def augmentation(examples, queries, k: int = 10) -> Node:
    return imputation(examples, queries, k)


def dependent_data(df: DataFrame, first: Sequence[str], second: Sequence[str], k: int = 10) -> Node:
    """Tables joinable on either pair of columns; only the named columns' values are used."""
    pair = lambda cols: Intersection(tuple(SingleColumn(df.select(f"`{c}`"), k=k) for c in cols[:2]), k=k)
    return Union((pair(first), pair(second)), k=k)


def features(df: DataFrame, key: str, target: str, known: str, k: int = 10) -> Node:
    """Columns that go with the target but not with a known feature."""
    return Difference((Correlation(df.select(key, target), k=10 * k), Correlation(df.select(key, known), k=10 * k)), k=k)


def collinearity(df: DataFrame, key: str, target: str, known: str, columns: Sequence[str], k: int = 10) -> Node:
    return Intersection((MultiColumn(df.select(*columns), k=2 * k), features(df, key, target, known, k)), k=k)


def negative_examples(wanted: DataFrame, unwanted: DataFrame, k: int = 10) -> Node:
    """Tables with the wanted rows but not the unwanted ones."""
    return Difference((MultiColumn(wanted, k=4 * k), MultiColumn(unwanted, k=2 * k)), k=k)


def complex_search(examples: DataFrame, key: str, target: str, k: int = 2) -> Node:
    """Unionable by votes, joinable by the first column, or correlated with the target."""
    return Union((Counter(_each_column(examples, 10 * k), k=k), SingleColumn(examples.select(examples.columns[0]), k=k), Correlation(examples.select(key, target), k=k)), k=4 * k)


def any_of_votes(plans: Sequence[Node], k: int = 10) -> Node:
    """An ensemble: several plans vote."""
    return Counter(tuple(plans), k=k)
