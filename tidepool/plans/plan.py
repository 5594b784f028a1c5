"""Named plan steps, validated as they are added."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from .nodes import Combiner, Node
from .planner import Engine


class Plan:
    """Steps by name; the one step that no other uses is run."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.steps: dict[str, Node] = {}
        self.ends: list[str] = []

    def add(self, name: str, node: Node, inputs: list[str] | None = None) -> Plan:
        if name in self.steps:
            raise ValueError(f"step {name!r} exists already")
        if not (isinstance(node, Node) or isinstance(node, type) and issubclass(node, Combiner)):
            raise TypeError(f"step {name!r} is not a plan node")
        combines = isinstance(node, Combiner) or isinstance(node, type)
        if inputs and not combines:
            raise ValueError(f"leaf search {name!r} takes no inputs")
        for x in inputs or []:
            if x not in self.steps:
                raise KeyError(x)
        if isinstance(node, type):
            node = node(tuple(self.steps[x] for x in inputs or []))
        elif inputs:
            node = replace(node, inputs=tuple(self.steps[x] for x in inputs))
        self.steps[name] = node
        self.ends = [x for x in self.ends if x not in (inputs or [])] + [name]
        return self

    @property
    def terminal(self) -> Node:
        if len(self.ends) != 1:
            raise ValueError(f"a plan needs one last step, not {self.ends}")
        return self.steps[self.ends[0]]

    def run(self) -> DataFrame:
        return self.engine.run(self.terminal)

    def ids(self) -> list[int]:
        return self.engine.ids(self.terminal)
