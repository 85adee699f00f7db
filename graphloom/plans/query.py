"""Clauses of a query, one after the other, to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import BindError
from graphloom.parser import ast as A
from graphloom.plans.expressions import AGGREGATES, Compiler, children, has_aggregate, walk
from graphloom.plans.factorised import by_weight, weighted
from graphloom.plans.matching import Matcher
from graphloom.plans.scope import ORDER, Binding, State, fresh
from graphloom.plans.subqueries import with_subqueries
from graphloom.types import HUGE, can_order, is_int, is_interval

UPDATES = (A.Create, A.Merge, A.SetProps, A.Delete)


def mentioned(clauses: list) -> set[str]:
    """Names that expressions use; a star uses all."""
    out: set[str] = set()
    for c in clauses:
        for x in walk(c):
            if isinstance(x, A.Var):
                out.add(x.name)
            elif isinstance(x, A.Star):
                out.add(x.of or "*")
    if "*" in out or any(isinstance(x, A.Func) and x.name in ("start_node", "end_node") for c in clauses for x in walk(c)):
        out |= {p.var for c in clauses for x in walk(c) if isinstance(x, (A.NodePat, A.RelPat, A.Path)) for p in [x] if p.var}
    return out


def tracked(clauses: list) -> set[str]:
    """Recursive relationships and paths used other than for length() and cost()."""
    out: set[str] = set()

    def look(e) -> None:
        if isinstance(e, A.Func) and e.name in ("length", "cost") and e.args and isinstance(e.args[0], A.Var):
            return
        if isinstance(e, A.Var):
            out.add(e.name)
        if isinstance(e, A.Star):
            out.add(e.of or "*")
        for x in children(e):
            look(x)

    for c in clauses:
        look(c)
    if "*" in out:
        out |= {x.var for c in clauses for x in walk(c) if isinstance(x, A.RelPat) and x.var}
    return out


class Runner:
    def __init__(self, session):
        self.session = session

    def run(self, q: A.Query) -> DataFrame:
        frames = [self.single(clauses) for clauses in q.parts]
        if len(set(q.all)) > 1:
            raise BindError("union and union all can't be used together")
        out = frames[0]
        for df in frames[1:]:
            if len(df.columns) != len(out.columns):
                raise BindError("the number of columns to union must be the same")
            for a, b in zip(out.schema, df.schema, strict=True):
                if a.dataType.simpleString() != b.dataType.simpleString() and not isinstance(a.dataType, T.NullType) and not isinstance(b.dataType, T.NullType):
                    raise BindError(f"{a.name} has data type {a.dataType.simpleString()} but {b.dataType.simpleString()} was expected")
            out = out.union(df)
        return out.distinct() if q.all and not q.all[0] else out

    def single(self, clauses: list) -> DataFrame:
        state = State(self.session.one, {})
        self.session.tracked = tracked(clauses)
        self.matcher = Matcher(self.session, mentioned(clauses))
        self.weight, self.matcher.demand = None, self.demand(clauses)
        if len(clauses) > 1 and isinstance(clauses[0], A.Match) and isinstance(clauses[1], A.Project) and self.session.setting("enable_plan_optimizer"):
            found = weighted(self, *clauses[:2])
            if found is not None:
                state, self.weight = found
                clauses = clauses[1:]
        for c in clauses:
            state, self.weight = self.clause(state, c), None
        if isinstance(clauses[-1], UPDATES):
            return self.session.spark.createDataFrame([], T.StructType([]))
        if isinstance(clauses[-1], A.CallFunc | A.LoadFrom):
            return self.project(state, A.Project([A.Item(A.Star(), None, "*")], final=True))
        return self.result(state) if not isinstance(clauses[-1], A.Project) else state.df

    def demand(self, clauses: list) -> int | None:
        """How many paths are enough for a query that is one recursive relationship and a LIMIT, and nothing that could
        drop, join or order paths."""
        if len(clauses) != 2 or not isinstance(clauses[0], A.Match) or not isinstance(clauses[1], A.Project):
            return None
        m, p = clauses
        if p.limit is None or p.distinct or p.order or m.optional or m.where is not None or len(m.paths) != 1 or len(m.paths[0].rels) != 1 or m.paths[0].rels[0].rec is None:
            return None
        nodes = m.paths[0].nodes
        if nodes[0].props and nodes[1].props or nodes[0].var and nodes[0].var == nodes[1].var or any(has_aggregate(i.expr) or any(isinstance(x, A.Sub) for x in walk(i.expr)) for i in p.items):
            return None
        return self.number(p.limit, "limit") + (self.number(p.skip, "skip") if p.skip is not None else 0)

    def result(self, state: State) -> DataFrame:
        raise BindError("a query must end with RETURN or an update")

    def clause(self, state: State, c) -> State | DataFrame:
        if isinstance(c, A.Match):
            return self.matcher.clause(state, c)
        if isinstance(c, A.Unwind):
            return self.unwind(state, c)
        if isinstance(c, A.Project):
            out = self.project(state, c)
            return State(out, {}) if c.final else self.matcher.where(out, c.where)
        if isinstance(c, A.LoadFrom):
            from graphloom.sources.scan import scan

            df = scan(self.session, c.source, c.options, c.headers)
            return self.matcher.where(self.table(state, df, df.columns), c.where)
        if isinstance(c, A.CallFunc):
            from graphloom.functions.tables import call_table

            df = call_table(self.session, c, Compiler(self.session, state))
            if c.yields:
                missing = [n for n, _ in c.yields if n not in df.columns]
                if missing:
                    raise BindError(f"unknown yield variable {missing[0]}")
                df = df.select(*(F.col(f"`{n}`").alias(a or n) for n, a in c.yields))
            return self.matcher.where(self.table(state, df, df.columns), c.where)
        from graphloom.operators.dml import update

        return update(self, state, c)

    def table(self, state: State, df: DataFrame, names: list[str]) -> State:
        for n in names:
            if n in state.scope:
                raise BindError(f"variable {n} already exists")
        cols = {n: fresh("v") for n in names}
        df = df.select(*(F.col(f"`{n}`").alias(c) for n, c in cols.items()))
        return state.with_(df if self.matcher.unit(state) else state.df.crossJoin(df), **{n: Binding("value", c) for n, c in cols.items()})

    def unwind(self, state: State, c: A.Unwind) -> State:
        of, col = Compiler(self.session, state)(c.expr), fresh("u")
        if isinstance(of.type, T.NullType):
            return state.with_(state.df.withColumn(col, F.lit(None).cast("long")).limit(0), **{c.var: Binding("value", col)})
        kind = of.type if isinstance(of.type, T.ArrayType) else None
        if kind is None:
            raise BindError("UNWIND takes a list")
        values = of.col if not isinstance(kind.elementType, T.NullType) else of.col.cast("array<string>")
        return state.with_(state.df.select("*", F.posexplode(values).alias(fresh(ORDER), col)), **{c.var: Binding("value", col)})

    # ---- projections

    def expand(self, state: State, items: list[A.Item]) -> list[A.Item]:
        out = []
        for i in items:
            if isinstance(i.expr, A.Star) and i.expr.of is None:
                names = [n for n in state.scope if not n.startswith("__")]
                if not names:
                    raise BindError("RETURN or WITH * is not allowed when there are no variables in scope")
                out += [A.Item(A.Var(n), None, n) for n in names]
            elif isinstance(i.expr, A.Star):
                b = state.scope.get(i.expr.of)
                if b is None:
                    raise BindError(f"variable {i.expr.of} is not in scope")
                if b.kind in ("node", "rel"):
                    out += [A.Item(A.Prop(A.Var(i.expr.of), p), None, f"{i.expr.of}.{p}") for p in b.props]
                else:
                    kind = Compiler(self.session, state)(A.Var(i.expr.of)).type
                    out += [A.Item(A.Prop(A.Var(i.expr.of), p), None, f"{i.expr.of}.{p}") for p in kind.fieldNames()]
            else:
                out.append(i)
        return out

    def name_of(self, i: A.Item, final: bool) -> str:
        if i.alias:
            return i.alias
        if isinstance(i.expr, A.Var):
            return i.expr.name
        if not final:
            raise BindError(f"expression in WITH must be aliased: {i.text}")
        return i.text

    def project(self, state: State, p: A.Project):
        items = self.expand(state, p.items)
        names = [self.name_of(i, p.final) for i in items]
        if len(set(names)) < len(names):
            raise BindError("multiple result columns with the same name are not supported")
        exprs = [i.expr for i in items]
        grouped = any(has_aggregate(e) for e in exprs)
        state, subs = with_subqueries(self.matcher, state, [*exprs, *(e for e, _ in p.order)])
        known: dict = {}
        if grouped:
            state, known = self.aggregate(state, exprs, subs)
        compiler = Compiler(self.session, state, subs if not grouped else {}, known)
        scope, new, lead = {}, {}, {}
        for name, e in zip(names, exprs, strict=True):
            if isinstance(e, A.Var) and e not in known and e.name in state.scope:
                b = state.scope[e.name]
                if b.kind != "value" and not p.final:
                    scope[name] = b
                    continue
                if b.kind == "path" and not p.final:
                    scope[name] = b
                    continue
            found = compiler(e)
            col = fresh("r")
            new[col] = found.col
            scope[name] = Binding("value", col)
            lead[name] = e
        before = state
        df = state.df.withColumns(new) if new else state.df
        if p.distinct:
            df = self.distinct(df, scope)
        order_scope = scope if (p.distinct or grouped) else {**before.scope, **scope}
        taken = {e: scope[n].col for n, e in lead.items()}
        if p.order:
            df = self.order(State(df, order_scope), p.order, {} if p.distinct or grouped else subs, {**(known if not p.distinct else {}), **taken})
        if p.skip is not None:
            df = df.offset(self.number(p.skip, "skip"))
        if p.limit is not None:
            df = df.limit(self.number(p.limit, "limit"))
        if p.final:
            return df.select(*(F.col(scope[n].col).alias(n) for n in names))
        keep = dict.fromkeys(c for b in scope.values() for c in b.columns())
        for n, b in list(scope.items()):
            if b.kind == "path":
                for v in b.parts:
                    scope.setdefault(v, state.scope[v])
                    keep.update(dict.fromkeys(state.scope[v].columns()))
        return State(df.select(*keep), scope)

    def distinct(self, df: DataFrame, scope: dict[str, Binding]) -> DataFrame:
        keys, rest = [], []
        for b in scope.values():
            if b.kind == "node":
                keys += [b.key, b.label]
                rest += list(b.props.values())
            elif b.kind == "rel":
                keys.append(b.key)
                rest += [c for c in b.columns() if c != b.key]
            else:
                keys += b.columns()
        for k in keys:
            if isinstance(df.schema[k].dataType, T.MapType):
                raise BindError("DISTINCT doesn't take maps")
        keys = list(dict.fromkeys(keys))
        rest = [c for c in dict.fromkeys(rest) if c not in keys]
        if not rest:
            return df.select(*keys).distinct()
        return df.groupBy(*keys).agg(*(F.first(c).alias(c) for c in rest))

    def order(self, state: State, order: list, subs: dict, known: dict) -> DataFrame:
        compiler, keys = Compiler(self.session, state, subs, known), []
        for e, up in order:
            if has_aggregate(e) and e not in known:
                raise BindError("ORDER BY an aggregate that isn't projected")
            found = compiler(e)
            if not can_order(found.type):
                raise BindError("cannot order by a list, struct, map, node or relationship")
            col = found.col
            if is_interval(found.type):
                from graphloom.functions.registry import interval_micros

                col = interval_micros(col)
            keys.append(col.asc_nulls_last() if up else col.desc_nulls_first())
        return state.df.orderBy(*keys)

    def number(self, e, what: str) -> int:
        if not isinstance(e, (A.Lit, A.Param)):
            raise BindError(f"the number of rows to {what} must be a literal or parameter")
        n = e.value if isinstance(e, A.Lit) else self.session.params.get(e.name)
        if not isinstance(n, int) or n < 0:
            raise BindError(f"the number of rows to {what} must be a non-negative integer")
        return n

    # ---- aggregation

    def aggregate(self, state: State, exprs: list, subs: dict) -> tuple[State, dict]:
        """state grouped by the items without aggregates; known has a column for each item or aggregate."""
        compiler = Compiler(self.session, state, subs)
        known, keys, payload, scope, before = {}, [], [], {}, {}
        for e in exprs:
            if has_aggregate(e):
                continue
            if isinstance(e, A.Var) and e.name in state.scope and state.scope[e.name].kind in ("node", "rel"):
                b = state.scope[e.name]
                own = [b.key, b.label] if b.kind == "node" else [b.key]
                keys += own
                payload += [c for c in b.columns() if c not in own]
                scope[e.name] = b
                continue
            found = compiler(e)
            if isinstance(found.type, T.MapType):
                raise BindError("maps can't be group keys")
            col = fresh("g")
            before[col] = found.col
            keys.append(col)
            known[e] = col
        aggs: dict = {}
        for e in exprs:
            if has_aggregate(e):
                for f in self.aggregates(e):
                    if f not in known:
                        known[f] = col = fresh("a")
                        aggs[col] = self.one(compiler, f) if self.weight is None else by_weight(compiler, f, self.weight, self.one)
        df = state.df.withColumns(before) if before else state.df
        keys = list(dict.fromkeys(keys))
        payload = [c for c in dict.fromkeys(payload) if c not in keys]
        made = [c.alias(n) for n, c in aggs.items()] + [F.first(c).alias(c) for c in payload]
        return State(df.groupBy(*keys).agg(*made), scope), known

    def aggregates(self, e) -> list:
        if isinstance(e, A.Func) and e.name in AGGREGATES:
            if any(has_aggregate(a) for a in e.args):
                raise BindError("aggregates can't be nested")
            return [e]
        return [f for x in children(e) for f in self.aggregates(x)]

    def one(self, compiler: Compiler, f: A.Func) -> Column:
        if f.name == "count_star":
            return F.count(F.lit(1))
        arg = f.args[0]
        if f.name == "count" and isinstance(arg, A.Var) and arg.name in compiler.state.scope:
            b = compiler.state.scope[arg.name]
            if b.kind in ("node", "rel"):
                cols = [F.col(b.key), F.col(b.label)] if b.kind == "node" else [F.col(b.key)]
                return F.count_distinct(*cols) if f.distinct else F.count(cols[0])
            if b.kind == "rec":
                return F.count(F.col(b.length))
        e = compiler(arg)
        if f.name == "count":
            return F.count_distinct(e.col) if f.distinct else F.count(e.col)
        if f.name == "collect":
            made = F.collect_set(e.col) if f.distinct else F.collect_list(e.col)
            return F.when(F.size(made) > 0, made)
        if f.name in ("min", "max"):
            return F.min(e.col) if f.name == "min" else F.max(e.col)
        if not isinstance(e.type, T.NumericType):
            raise BindError(f"{f.name} takes numbers")
        if f.name == "avg":
            x = e.col.cast("double")
            return F.sum_distinct(x) / F.count_distinct(x) if f.distinct else F.avg(x)
        x = e.col.cast(HUGE) if is_int(e.type) else e.col
        return F.sum_distinct(x) if f.distinct else F.sum(x)
