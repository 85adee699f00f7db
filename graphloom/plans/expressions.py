"""Expressions to columns."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import BindError
from graphloom.functions.registry import MISSING, SCALARS, cast
from graphloom.parser import ast as A
from graphloom.plans.scope import Binding, Expr, State, fresh, lit
from graphloom.types import parse_type

AGGREGATES = frozenset(("count", "count_star", "sum", "avg", "min", "max", "collect"))
LAMBDAS = frozenset(("list_transform", "list_filter", "list_reduce", "any", "all", "none", "single", "list_any", "list_all", "list_none", "list_single"))


def children(e) -> list:
    """Direct parts of a syntax tree."""
    out = []
    if is_dataclass(e) and not isinstance(e, type):
        for f in fields(e):
            x = getattr(e, f.name)
            out += _flat(x)
    return out


def _flat(x) -> list:
    if isinstance(x, (list, tuple)):
        return [z for y in x for z in _flat(y)]
    return [x] if is_dataclass(x) and not isinstance(x, type) else []


def walk(e):
    yield e
    for x in children(e):
        yield from walk(x)


def has_aggregate(e) -> bool:
    if isinstance(e, A.Func) and e.name in AGGREGATES:
        return True
    if isinstance(e, A.Sub):
        return False
    return any(has_aggregate(x) for x in children(e))


def names_in(e) -> set[str]:
    return {x.name for x in walk(e) if isinstance(x, A.Var)}


class Compiler:
    """Expressions of one state. subs: columns made for subqueries, by their syntax tree; known: columns that stand
    for whole trees (what has been grouped or projected)."""

    def __init__(self, session, state: State, subs: dict | None = None, known: dict | None = None, lambdas: dict[str, Expr] | None = None, frame: DataFrame | None = None):
        self.session, self.state, self.subs, self.known, self.lambdas = session, state, subs or {}, known or {}, lambdas or {}
        self.frame = state.df if frame is None else frame

    def inner(self, lambdas: dict[str, Expr], frame: DataFrame) -> Compiler:
        return Compiler(self.session, self.state, self.subs, self.known, {**self.lambdas, **lambdas}, frame)

    def expr(self, col: Column, twin: Column | None = None, value=MISSING) -> Expr:
        return Expr(col, self.frame, twin, value)

    def __call__(self, e) -> Expr:
        if e in self.known:
            return self.expr(F.col(self.known[e]))
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def boolean(self, e) -> Column:
        found = self(e)
        if not isinstance(found.type, (T.BooleanType, T.NullType)):
            raise BindError("a predicate must be BOOL")
        return found.col.cast("boolean")

    # ---- leaves

    def _lit(self, e: A.Lit) -> Expr:
        return lit(e.value, self.frame)

    def _param(self, e: A.Param) -> Expr:
        if e.name not in self.session.params:
            raise BindError(f"parameter {e.name} not found")
        return lit(self.session.params[e.name], self.frame)

    def _star(self, e: A.Star) -> Expr:
        raise BindError("* can't stand here")

    def _var(self, e: A.Var) -> Expr:
        if e.name in self.lambdas:
            return self.lambdas[e.name]
        if e.name not in self.state.scope:
            raise BindError(f"variable {e.name} is not in scope")
        return self.expr(self.value(self.state.scope[e.name]))

    def value(self, b: Binding) -> Column:
        """The whole of what a name stands for."""
        if b.kind == "value":
            return F.col(b.col)
        if b.kind == "node":
            return self.node(b)
        if b.kind == "rel":
            return self.rel(b)
        if b.kind == "rec":
            if not b.nodes:
                raise BindError("this recursive relationship isn't tracked")
            return F.struct(F.col(b.nodes).alias("_NODES"), F.col(b.rels).alias("_RELS"))
        return self.path(b)

    def ident(self, label: Column, key: Column, labels: tuple) -> Column:
        table = F.lit(-1)
        for name in labels:
            table = F.when(label == name, F.lit(self.session.catalog.table_id(name))).otherwise(table)
        offset = key.cast("long") if isinstance(self.frame.select(key).schema[0].dataType, T.IntegralType) else F.xxhash64(key)
        return F.struct(table.cast("long").alias("table"), offset.alias("offset"))

    def node(self, b: Binding, names: list[tuple[str, T.DataType]] | None = None) -> Column:
        own = [F.col(b.props[p]).alias(p) for p in b.props] if names is None else [(F.col(b.prop(p)) if b.prop(p) else F.lit(None)).cast(t).alias(p) for p, t in names]
        return F.when(F.col(b.key).isNotNull(), F.struct(self.ident(F.col(b.label), F.col(b.key), b.labels).alias("_ID"), F.col(b.label).alias("_LABEL"), *own))

    def rel(self, b: Binding, names: list[tuple[str, T.DataType]] | None = None) -> Column:
        nodes = tuple(self.session.catalog.nodes)
        own = [F.col(b.props[p]).alias(p) for p in b.props] if names is None else [(F.col(b.prop(p)) if b.prop(p) else F.lit(None)).cast(t).alias(p) for p, t in names]
        ends = [self.ident(F.col(x), F.col(k), nodes).alias(n) for n, x, k in (("_SRC", b.src_label, b.src), ("_DST", b.dst_label, b.dst))]
        return F.when(F.col(b.key).isNotNull(), F.struct(*ends, F.col(b.label).alias("_LABEL"), F.struct(F.lit(0).cast("long").alias("table"), F.xxhash64(F.col(b.key)).alias("offset")).alias("_ID"), *own))

    def path(self, b: Binding) -> Column:
        parts = [self.state.scope[v] for v in b.parts]
        kinds = {"node": {}, "rel": {}}
        for p in parts:
            if p.kind in kinds:
                for name, col in p.props.items():
                    kinds[p.kind].setdefault(name, self.frame.select(col).schema[0].dataType)
        recs = [p for p in parts if p.kind == "rec"]
        for p in recs:
            for kind, col in (("node", p.nodes), ("rel", p.rels)):
                for f in self.frame.select(col).schema[0].dataType.elementType.fields:
                    if f.name not in ("_ID", "_LABEL", "_SRC", "_DST"):
                        kinds[kind].setdefault(f.name, f.dataType)
        nodes, rels = [], []
        same = lambda kind: list(kinds[kind].items())

        def widen(col: str, kind: str) -> Column:
            has = self.frame.select(col).schema[0].dataType.elementType.fieldNames()
            lead = ("_ID", "_LABEL") if kind == "node" else ("_SRC", "_DST", "_LABEL", "_ID")
            return F.transform(F.col(col), lambda x: F.struct(*(x[n].alias(n) for n in lead), *((x[n] if n in has else F.lit(None)).cast(t).alias(n) for n, t in same(kind))))

        for p in parts:
            if p.kind == "node":
                nodes.append(F.array(self.node(p, same("node"))))
            elif p.kind == "rel":
                rels.append(F.array(self.rel(p, same("rel"))))
            else:
                nodes.append(widen(p.nodes, "node"))
                rels.append(widen(p.rels, "rel"))
        empty = F.array() if not rels else None
        return F.struct(F.concat(*nodes).alias("_NODES"), (F.concat(*rels) if rels else empty).alias("_RELS"))

    # ---- composites

    def _prop(self, e: A.Prop) -> Expr:
        if isinstance(e.of, A.Var) and e.of.name not in self.lambdas and e.of.name in self.state.scope:
            b = self.state.scope[e.of.name]
            if b.kind in ("node", "rel"):
                col = b.prop(e.key)
                if col is None:
                    raise BindError(f"cannot find property {e.key} for {e.of.name}")
                return self.expr(F.col(col))
        of = self(e.of)
        if isinstance(of.type, T.MapType):
            return self.expr(of.col[e.key], of.twin[e.key])
        if isinstance(of.type, T.ArrayType) and isinstance(of.type.elementType, T.StructType):
            return self.expr(F.transform(of.col, lambda x: x[e.key]), F.transform(of.twin, lambda x: x[e.key]))
        if not isinstance(of.type, T.StructType):
            raise BindError(f"{e.key} is asked of a value without fields")
        name = next((n for n in of.type.fieldNames() if n.lower() == e.key.lower()), None)
        if name is None:
            raise BindError(f"invalid struct field name: {e.key}")
        return self.expr(of.col[name], of.twin[name])

    def _listlit(self, e: A.ListLit) -> Expr:
        items = [self(x) for x in e.items]
        if items and all(x.value is not MISSING for x in items):
            value = [x.value for x in items]
        else:
            value = MISSING
        return self.expr(F.array(*(x.col for x in items)), F.array(*(x.twin for x in items)), value)

    def _structlit(self, e: A.StructLit) -> Expr:
        items = [(k, self(x)) for k, x in e.fields]
        return self.expr(F.struct(*(x.col.alias(k) for k, x in items)), F.struct(*(x.twin.alias(k) for k, x in items)))

    def _index(self, e: A.Index) -> Expr:
        of = self(e.of)
        if isinstance(of.type, T.MapType):
            return self._apply("map_extract", [of, self(e.at)])
        return self._apply("list_extract", [of, self(e.at)])

    def _slice(self, e: A.Slice) -> Expr:
        zero = A.Lit(0)
        return self._apply("list_slice", [self(e.of), self(e.lo or zero), self(e.hi or zero)])

    def _cast(self, e: A.Cast) -> Expr:
        of, to = self(e.of), parse_type(e.type, self.session.catalog.types)
        word = e.type.split("(")[0].strip()
        return self.expr(cast(of.col, of.type, to, word), cast(of.twin, of.type, to, word))

    def _case(self, e: A.Case) -> Expr:
        of = self(e.of) if e.of is not None else None
        out = twin = None
        for when, then in e.whens:
            test = self._apply("=", [of, self(when)]) if of is not None else self(when)
            t = self(then)
            out = F.when(test.col, t.col) if out is None else out.when(test.col, t.col)
            twin = F.when(test.twin, t.twin) if twin is None else twin.when(test.twin, t.twin)
        other = self(e.other)
        return self.expr(out.otherwise(other.col), twin.otherwise(other.twin))

    def _op(self, e: A.Op) -> Expr:
        if e.op in ("=", "<>") and all(isinstance(x, A.Var) and x.name not in self.lambdas and x.name in self.state.scope and self.state.scope[x.name].kind in ("node", "rel") for x in e.args):
            a, b = (self.state.scope[x.name] for x in e.args)
            same = (F.col(a.key) == F.col(b.key)) & (F.col(a.label) == F.col(b.label))
            return self.expr(same if e.op == "=" else ~same)
        args = [self(x) for x in e.args]
        if e.op == "neg" and args[0].value is not MISSING and isinstance(args[0].value, (int, float)):
            return lit(-args[0].value, self.frame)
        return self._apply(e.op, args)

    def _lambda(self, e: A.Lambda) -> Expr:
        raise BindError("a lambda stands only as an argument of a list function")

    def _sub(self, e: A.Sub) -> Expr:
        if e not in self.subs:
            raise BindError("a subquery can't stand here")
        return self.expr(F.col(self.subs[e]))

    # ---- functions

    def _apply(self, name: str, args: list[Expr]) -> Expr:
        f = SCALARS.get(name)
        if f is None:
            raise BindError(f"function {name} does not exist")
        types, values = [a.type for a in args], [a.value for a in args]
        try:
            out = f([a.col for a in args], types, values)
            twin = out if all(a.col is a.twin for a in args) else f([a.twin for a in args], types, values)
        except (TypeError, IndexError, AttributeError, KeyError, StopIteration) as x:
            raise BindError(f"{name} doesn't take these arguments: {', '.join(t.simpleString() for t in types)} ({x})") from x
        return self.expr(out, twin)

    def _func(self, e: A.Func) -> Expr:
        name = e.name
        if name in AGGREGATES:
            raise BindError(f"an aggregate function ({name}) can't stand here")
        if name in LAMBDAS and e.args and isinstance(e.args[-1], A.Lambda):
            return self._with_lambda(name, e)
        special = getattr(self, f"f_{name}", None)
        if special:
            return special(e)
        if name in self.session.udfs:
            made = self.session.udfs[name]
            args = [self(x) for x in e.args]
            return self.expr(made(*(a.col for a in args)), made(*(a.twin for a in args)))
        macro = self.session.catalog.find(self.session.catalog.macros, name)
        if macro is not None:
            return self._macro(self.session.catalog.macros[macro], e)
        return self._apply(name, [self(x) for x in e.args])

    def _macro(self, macro, e: A.Func) -> Expr:
        given = dict(zip((p for p, _ in macro.params), e.args, strict=False)) | dict(e.named)
        bound = {}
        for p, default in macro.params:
            arg = given.get(p, default)
            if arg is None:
                raise BindError(f"macro {macro.name} lacks argument {p}")
            bound[p] = self(arg)
        return self.inner(bound, self.frame)(macro.body)

    def _with_lambda(self, name: str, e: A.Func) -> Expr:
        name = name.removeprefix("list_") if name in ("list_any", "list_all", "list_none", "list_single") else name
        of, fn = self(e.args[0]), e.args[-1]
        if not isinstance(of.type, T.ArrayType):
            raise BindError(f"{name} takes a list")
        element = of.type.elementType

        def body(params: list[str], cols) -> Expr:
            """The body's column with its parameters bound; its type is found on a frame that has them as columns."""
            frame, bound = self.frame, {}
            for p, c in zip(params, cols, strict=True):
                stand = fresh("l")
                frame = frame.withColumn(stand, F.lit(None).cast(element))
                bound[p] = Expr(c, frame, F.col(stand), type_=element)
            return self.inner({k: Expr(x.col, frame, x.twin, type_=element) for k, x in bound.items()}, frame)(fn.body)

        if name == "list_reduce":
            params = list(fn.params)
            run = lambda of_: F.reduce(F.slice(of_, 2, F.greatest(F.size(of_) - 1, F.lit(0))), F.get(of_, 0), lambda a, x: body(params, [a, x]).col.cast(element))
            return self.expr(F.when(F.size(of.col) > 0, run(of.col)), F.when(F.size(of.twin) > 0, run(of.twin)))
        one = lambda x: body([fn.params[0]], [x]).col
        test = lambda x: F.coalesce(one(x).cast("boolean"), F.lit(False))
        makes = {
            "list_transform": lambda o: F.transform(o, one),
            "list_filter": lambda o: F.filter(o, test),
            "any": lambda o: F.exists(o, test),
            "all": lambda o: F.forall(o, test),
            "none": lambda o: ~F.exists(o, test),
            "single": lambda o: F.size(F.filter(o, test)) == 1,
        }
        return self.expr(makes[name](of.col), makes[name](of.twin))

    # functions of names rather than of values

    def _bound(self, e, *kinds: str) -> Binding | None:
        if isinstance(e, A.Var) and e.name not in self.lambdas:
            b = self.state.scope.get(e.name)
            if b is not None and b.kind in kinds:
                return b
        return None

    def f_id(self, e: A.Func) -> Expr:
        if b := self._bound(e.args[0], "node"):
            return self.expr(F.when(F.col(b.key).isNotNull(), self.ident(F.col(b.label), F.col(b.key), b.labels)))
        if b := self._bound(e.args[0], "rel"):
            return self.expr(F.struct(F.lit(0).cast("long").alias("table"), F.xxhash64(F.col(b.key)).alias("offset")))
        of = self(e.args[0])
        return self.expr(of.col["_ID"], of.twin["_ID"])

    def f_rowid(self, e: A.Func) -> Expr:
        found = self.f_id(e)
        return self.expr(found.col["offset"], found.twin["offset"])

    def f_label(self, e: A.Func) -> Expr:
        if b := self._bound(e.args[0], "node", "rel"):
            return self.expr(F.col(b.label))
        of = self(e.args[0])
        return self.expr(of.col["_LABEL"], of.twin["_LABEL"])

    f_labels = f_type = f_label

    def f_keys(self, e: A.Func) -> Expr:
        if b := self._bound(e.args[0], "node", "rel"):
            return self.expr(F.array(*(F.lit(p) for p in b.props)))
        names = [n for n in self(e.args[0]).type.fieldNames() if not n.startswith("_")]
        return self.expr(F.array(*(F.lit(n) for n in names)))

    def _end(self, e: A.Func, src: bool) -> Expr:
        b = self._bound(e.args[0], "rel")
        if b is None:
            raise BindError("start_node and end_node take a relationship of this query")
        key, label = (b.src, b.src_label) if src else (b.dst, b.dst_label)
        for n in self.state.scope.values():
            if n.kind == "node" and n.scanned and key in (n.key,):
                return self.expr(self.node(n))
        for n in self.state.scope.values():
            if n.kind == "node" and n.scanned and (b.parts and n is self.state.scope.get(b.parts[0 if src else 1])):
                return self.expr(self.node(n))
        return self.expr(F.struct(self.ident(F.col(label), F.col(key), tuple(self.session.catalog.nodes)).alias("_ID"), F.col(label).alias("_LABEL")))

    def f_start_node(self, e: A.Func) -> Expr:
        return self._end(e, True)

    def f_end_node(self, e: A.Func) -> Expr:
        return self._end(e, False)

    def f_length(self, e: A.Func) -> Expr:
        if b := self._bound(e.args[0], "rec"):
            return self.expr(F.col(b.length))
        if b := self._bound(e.args[0], "path"):
            total = F.lit(0).cast("long")
            for v in b.parts:
                p = self.state.scope[v]
                total = total + (F.col(p.length) if p.kind == "rec" else F.lit(int(p.kind == "rel")).cast("long"))
            return self.expr(total)
        of = self(e.args[0])
        if isinstance(of.type, T.StructType) and "_RELS" in of.type.fieldNames():
            return self.expr(F.size(of.col["_RELS"]).cast("long"), F.size(of.twin["_RELS"]).cast("long"))
        return self._apply("size", [of])

    def f_cost(self, e: A.Func) -> Expr:
        b = self._bound(e.args[0], "rec")
        if b is None or not b.cost:
            raise BindError("cost takes a weighted shortest path")
        return self.expr(F.col(b.cost))

    def _part(self, e: A.Func, field: str) -> Expr:
        of = self(e.args[0])
        return self.expr(of.col[field], of.twin[field])

    def f_nodes(self, e: A.Func) -> Expr:
        return self._part(e, "_NODES")

    def f_rels(self, e: A.Func) -> Expr:
        return self._part(e, "_RELS")

    f_relationships = f_rels

    def f_properties(self, e: A.Func) -> Expr:
        of, key = self(e.args[0]), self(e.args[1]).value
        has = [n for n in of.type.elementType.fieldNames() if n.lower() == str(key).lower()]
        if not has:
            raise BindError(f"invalid property name: {key}")
        return self.expr(F.transform(of.col, lambda x: x[has[0]]), F.transform(of.twin, lambda x: x[has[0]]))

    def _unique(self, e: A.Func, field: str) -> Expr:
        of = self(e.args[0])
        run = lambda c: F.size(F.array_distinct(F.transform(c[field], lambda x: x["_ID"]))) == F.size(c[field])
        return self.expr(run(of.col), run(of.twin))

    def f_is_trail(self, e: A.Func) -> Expr:
        return self._unique(e, "_RELS")

    def f_is_acyclic(self, e: A.Func) -> Expr:
        return self._unique(e, "_NODES")

    def f_struct_pack(self, e: A.Func) -> Expr:
        return self._structlit(A.StructLit(e.named))

    def f_union_value(self, e: A.Func) -> Expr:
        tag, of = e.named[0][0], self(e.named[0][1])
        return self.expr(F.struct(F.lit(tag).alias("tag"), of.col.alias(tag)), F.struct(F.lit(tag).alias("tag"), of.twin.alias(tag)))

    def f_cast(self, e: A.Func) -> Expr:
        return self._cast(A.Cast(e.args[0], str(self(e.args[1]).value)))

    def f_nextval(self, e: A.Func) -> Expr:
        return lit(self.session.sequence(self(e.args[0]).value).next(), self.frame)

    def f_currval(self, e: A.Func) -> Expr:
        seq = self.session.sequence(self(e.args[0]).value)
        if seq.value is None:
            raise BindError(f"nextval of {seq.name} must come first")
        return lit(seq.value, self.frame)

    def f_stem(self, e: A.Func) -> Expr:
        from graphloom.functions.text import stem_column

        of = self(e.args[0])
        return self.expr(stem_column(of.col), stem_column(of.twin))
