"""Catalogue: tables as versions with their schema, and the other named things. A snapshot shares the versions."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.errors import CatalogError
from graphloom.versions import Frames, Version, copied


@dataclass
class NodeTable:
    name: str
    key: str
    columns: dict[str, T.DataType]
    data: Version | DataFrame | None
    types: dict[str, str] = field(default_factory=dict)  # as declared
    defaults: dict[str, Any] = field(default_factory=dict)  # expressions
    serial: set = field(default_factory=set)
    comment: str = ""
    foreign: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.data, Version):
            self.data = Version(self.data)

    @property
    def frame(self) -> DataFrame:
        return self.data.frame(self.key)

    @frame.setter
    def frame(self, frame: DataFrame) -> None:
        self.data = Version(frame)

    @property
    def key_type(self) -> T.DataType:
        return self.columns[self.key]


@dataclass
class RelTable:
    """One frame for each (FROM, TO) pair: _src, _dst (keys of the nodes), _eid, and the properties."""

    name: str
    pairs: list[tuple[str, str]]
    columns: dict[str, T.DataType]
    frames: Frames | dict[tuple[str, str], DataFrame]
    types: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, Any] = field(default_factory=dict)
    multiplicity: str = "MANY_MANY"
    comment: str = ""
    foreign: bool = False
    single: tuple[str, ...] = ()  # ends of which the edge's identity is made: a node has one edge from there

    def __setattr__(self, name: str, value) -> None:
        super().__setattr__(name, Frames(value) if name == "frames" and not isinstance(value, Frames) else value)

    def one_edge(self, end: str) -> bool:
        """Whether a node has at most one edge whose `end` (_src or _dst) it is. Orders of joins rest on it, no results."""
        return end in self.single or self.multiplicity in ("ONE_ONE", "MANY_ONE" if end == "_src" else "ONE_MANY")


@dataclass
class Sequence:
    name: str
    start: int
    increment: int
    low: int
    high: int
    cycle: bool
    value: int | None = None

    def next(self) -> int:
        if self.value is None:
            self.value = self.start
            return self.value
        value = self.value + self.increment
        if not self.low <= value <= self.high:
            if not self.cycle:
                raise CatalogError(f"sequence {self.name} has reached its bound")
            value = self.low if self.increment > 0 else self.high
        self.value = value
        return value


@dataclass
class Macro:
    name: str
    params: list[tuple[str, Any]]
    body: Any


@dataclass
class Catalog:
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    rels: dict[str, RelTable] = field(default_factory=dict)
    sequences: dict[str, Sequence] = field(default_factory=dict)
    macros: dict[str, Macro] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)
    graphs: dict[str, dict] = field(default_factory=dict)  # projected
    batches: dict[str, int] = field(default_factory=dict)  # the last micro-batch of each stream
    any_graph: bool = False
    version: int = 0

    def snapshot(self) -> Catalog:
        out = copy.copy(self)
        for name in ("nodes", "rels", "sequences", "macros", "types", "indexes", "graphs", "batches"):
            setattr(out, name, {k: copied(v) for k, v in getattr(self, name).items()})
        return out

    @staticmethod
    def find(entries: dict, name: str):
        """The entry's own name, whatever its case."""
        if name in entries:
            return name
        return next((k for k in entries if k.lower() == name.lower()), None)

    def node(self, name: str) -> NodeTable:
        found = self.find(self.nodes, name)
        if found is None:
            raise CatalogError(f"node table {name} does not exist")
        return self.nodes[found]

    def rel(self, name: str) -> RelTable:
        found = self.find(self.rels, name)
        if found is None:
            raise CatalogError(f"rel table {name} does not exist")
        return self.rels[found]

    def table(self, name: str) -> NodeTable | RelTable:
        if (found := self.find(self.nodes, name)) is not None:
            return self.nodes[found]
        if (found := self.find(self.rels, name)) is not None:
            return self.rels[found]
        raise CatalogError(f"table {name} does not exist")

    def has_table(self, name: str) -> bool:
        return self.find(self.nodes, name) is not None or self.find(self.rels, name) is not None

    def table_id(self, name: str) -> int:
        return [*self.nodes, *self.rels].index(name)
