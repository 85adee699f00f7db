"""What names stand for while a query is compiled, and typed expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.registry import MISSING

_NUMBERS = count(1)
#: Word of the columns that hold a row's place, for updates.
ORDER = "ord"


def fresh(word: str = "c") -> str:
    """A column name that no other column has."""
    return f"__{word}{next(_NUMBERS)}"


@dataclass
class Binding:
    """kind: value, node, rel, rec (recursive relationship) or path. Its columns are in the state's frame."""

    kind: str
    col: str | None = None  # value; path and rec: the struct, if tracked
    labels: tuple = ()  # tables that it can be of
    props: dict[str, str] = field(default_factory=dict)
    key: str | None = None  # node: its key; rel: its edge id
    label: str | None = None  # column of the label
    src: str | None = None
    dst: str | None = None
    src_label: str | None = None
    dst_label: str | None = None
    length: str | None = None
    cost: str | None = None
    nodes: str | None = None
    rels: str | None = None
    parts: tuple = ()  # path: the variables of its nodes and relationships
    scanned: bool = True  # node: whether its properties are there

    def columns(self) -> list[str]:
        own = [self.col, self.key, self.label, self.src, self.dst, self.src_label, self.dst_label, self.length, self.cost, self.nodes, self.rels]
        return list(dict.fromkeys(c for c in [*own, *self.props.values()] if c))

    def prop(self, name: str) -> str | None:
        if name in self.props:
            return self.props[name]
        return next((c for p, c in self.props.items() if p.lower() == name.lower()), None)


@dataclass
class State:
    df: DataFrame
    scope: dict[str, Binding] = field(default_factory=dict)

    def with_(self, df: DataFrame, **more: Binding) -> State:
        return State(df, {**self.scope, **more})


class Expr:
    """A column; its twin without lambda variables, which has a type on `frame`; and a literal's value."""

    __slots__ = ("col", "twin", "frame", "value", "_type", "fields")

    def __init__(self, col: Column, frame: DataFrame, twin: Column | None = None, value=MISSING, type_: T.DataType | None = None):
        self.col, self.twin, self.frame, self.value, self._type = col, col if twin is None else twin, frame, value, type_

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self.frame.select(self.twin.alias("x")).schema[0].dataType
        return self._type


def lit(value, frame: DataFrame) -> Expr:
    import datetime
    from decimal import Decimal

    if isinstance(value, bool) or value is None or isinstance(value, (float, str, bytes, datetime.date, datetime.datetime)):
        col = F.lit(value)
    elif isinstance(value, int):
        col = F.lit(value).cast("long") if -(2**63) <= value < 2**63 else F.lit(Decimal(value)).cast("decimal(38,0)")
    elif isinstance(value, (list, tuple)):
        col = F.array(*(lit(x, frame).col for x in value))
    elif isinstance(value, dict):
        col = F.struct(*(lit(x, frame).col.alias(k) for k, x in value.items()))
    else:
        col = F.lit(value)
    return Expr(col, frame, value=value)
