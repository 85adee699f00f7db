"""Syntax trees. Expressions first, then patterns, clauses and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Star:
    of: str | None = None


@dataclass(frozen=True)
class Prop:
    of: Any
    key: str


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple
    distinct: bool = False
    named: tuple = ()


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Case:
    of: Any
    whens: tuple
    other: Any


@dataclass(frozen=True)
class ListLit:
    items: tuple


@dataclass(frozen=True)
class StructLit:
    fields: tuple


@dataclass(frozen=True)
class Lambda:
    params: tuple
    body: Any


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    lo: Any
    hi: Any


@dataclass(frozen=True)
class Cast:
    of: Any
    type: str


@dataclass(frozen=True)
class Sub:
    """EXISTS or COUNT over a pattern."""

    kind: str
    patterns: tuple
    where: Any = None


@dataclass(frozen=True)
class NodePat:
    var: str | None
    labels: tuple = ()
    props: tuple = ()


@dataclass(frozen=True)
class RelPat:
    var: str | None
    types: tuple = ()
    direction: str = "out"
    props: tuple = ()
    rec: Any = None


@dataclass(frozen=True)
class Rec:
    """`*` part: kind, bounds, weight property, and the comprehension's variables, filter and projections."""

    kind: str = "DEFAULT"
    lo: int | None = None
    hi: int | None = None
    weight: str | None = None
    rel_var: str | None = None
    node_var: str | None = None
    where: Any = None
    rel_items: tuple | None = None
    node_items: tuple | None = None


@dataclass(frozen=True)
class Path:
    var: str | None
    nodes: tuple
    rels: tuple


@dataclass
class Match:
    paths: list
    where: Any = None
    optional: bool = False
    hint: Any = None


@dataclass
class Unwind:
    expr: Any
    var: str


@dataclass
class Item:
    expr: Any
    alias: str | None
    text: str


@dataclass
class Project:
    """WITH or RETURN."""

    items: list
    distinct: bool = False
    order: list = field(default_factory=list)
    skip: Any = None
    limit: Any = None
    where: Any = None
    final: bool = False


@dataclass
class CallFunc:
    name: str
    args: list
    yields: list = field(default_factory=list)
    where: Any = None
    named: tuple = ()


@dataclass
class LoadFrom:
    source: Any
    options: dict
    headers: list = field(default_factory=list)
    where: Any = None


@dataclass
class Create:
    paths: list


@dataclass
class Merge:
    path: Path
    on_match: list = field(default_factory=list)
    on_create: list = field(default_factory=list)


@dataclass
class SetProps:
    items: list  # (target expr or variable, value)


@dataclass
class Delete:
    vars: list
    detach: bool


@dataclass
class Query:
    """Single queries joined by UNION; all[i] tells whether union i keeps duplicates."""

    parts: list
    all: list = field(default_factory=list)


@dataclass
class Command:
    """Any statement besides queries: a kind and its arguments."""

    kind: str
    args: dict


@dataclass
class Explain:
    statement: Any
    mode: str
