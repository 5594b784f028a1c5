"""Immutable plan nodes: leaf searches and the combiners over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

# Logical costs of the leaf searches.
COSTS = {"SemanticJoin": 1, "SemanticUnion": 2, "Keyword": 3, "SingleColumn": 4, "SimHash": 5, "Correlation": 6, "MultiColumn": 10}


@dataclass(frozen=True)
class Node:
    k: int = field(default=10, kw_only=True)
    order_cost: float | None = field(default=None, kw_only=True)
    predicted: float = field(default=1.0, kw_only=True)

    approximate = False
    inputs = ()

    @property
    def cost(self) -> float:
        return COSTS[type(self).__name__]

    @property
    def runtime(self) -> float:
        return self.predicted

    @property
    def ordering(self) -> float:
        return self.cost if self.order_cost is None else self.order_cost

    def cut(self, k: int) -> Node:
        return replace(self, k=k)


class Seeker(Node):
    pass


@dataclass(frozen=True)
class Keyword(Seeker):
    values: Any


@dataclass(frozen=True)
class SingleColumn(Seeker):
    values: Any


@dataclass(frozen=True)
class MultiColumn(Seeker):
    rows: Any


@dataclass(frozen=True)
class Correlation(Seeker):
    source: Any
    target: Any = None


@dataclass(frozen=True)
class SimHash(Seeker):
    """By the codes of a stored column, or of values."""

    values: Any = None
    table_id: int | None = None
    colid: int | None = None
    approximate = True


@dataclass(frozen=True)
class SemanticUnion(Seeker):
    """By all columns of a stored table, or by vectors ``(query_col, embedding)``."""

    table_id: int | None = None
    vectors: DataFrame | None = None
    colid: int | None = None
    rollup: str = "decay_vote"
    k_coarse: int | None = None
    vote_factor: float = 2.0
    prefilter: bool = True
    threshold: float = 0.5
    approximate = True


@dataclass(frozen=True)
class SemanticJoin(SemanticUnion):
    """By one column."""

    def __post_init__(self) -> None:
        if self.vectors is None and self.colid is None:
            raise ValueError("a join search needs one query column")


@dataclass(frozen=True)
class Combiner(Node):
    inputs: tuple[Node, ...] = ()

    def __post_init__(self) -> None:
        if not self.inputs:
            raise ValueError("a combiner needs at least one input")
        if not all(isinstance(x, Node) for x in self.inputs):
            raise TypeError("a combiner's inputs must be plan nodes")

    @property
    def cost(self) -> float:
        return sum(x.cost for x in self.inputs)

    @property
    def runtime(self) -> float:
        return sum(x.runtime for x in self.inputs)

    @property
    def approximate(self) -> bool:  # type: ignore[override]
        return any(x.approximate for x in self.inputs)


@dataclass(frozen=True)
class Intersection(Combiner):
    """Inputs run from the cheapest on, each within the tables that the one before it found; the last
    ranks. ``fixed``: keep the given order."""

    fixed: bool = False

    @property
    def cost(self) -> float:
        return min(x.cost for x in self.inputs)


@dataclass(frozen=True)
class Difference(Combiner):
    """The first input without the tables of the second."""

    def __post_init__(self) -> None:
        super().__post_init__()
        if len(self.inputs) != 2:
            raise ValueError("a difference needs exactly two inputs")

    @property
    def cost(self) -> float:
        return self.inputs[1].cost


@dataclass(frozen=True)
class Union(Combiner):
    pass


@dataclass(frozen=True)
class Counter(Combiner):
    pass


@dataclass(frozen=True)
class Fusion(Combiner):
    weights: tuple[float, ...] = ()
    constant: float = 60.0


def flat(nodes: Sequence[Node]) -> tuple[Node, ...]:
    return tuple(nodes)
