"""Patterns to joins.

A node variable is a scan of its tables, a relationship a scan of its (table, FROM, TO) combinations, and a pattern
the equi-joins between them; Catalyst prunes columns and pushes filters into the scans. Labels that a pattern can't
have are dropped first, and nodes whose properties nobody asks for aren't scanned: an edge's key stands for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import BindError
from graphloom.parser import ast as A
from graphloom.plans.cycles import cycle
from graphloom.plans.expressions import Compiler, names_in, walk
from graphloom.plans.orders import better
from graphloom.plans.paths import recursive_frame
from graphloom.plans.scope import Binding, State, fresh


def conjuncts(e) -> list:
    if isinstance(e, A.Op) and e.op == "and":
        return [y for x in e.args for y in conjuncts(x)]
    return [] if e is None else [e]


def _common(types: list[T.DataType]) -> T.DataType:
    return types[0] if all(t == types[0] for t in types) else T.LongType() if all(isinstance(t, T.IntegralType) for t in types) else T.StringType()


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def node_scan(session, labels: tuple) -> tuple[DataFrame, Binding]:
    """All nodes of the tables; properties that a table lacks are NULL."""
    tables = [session.catalog.node(x) for x in labels]
    key_type = _common([t.key_type for t in tables])
    props: dict[str, list[T.DataType]] = {}
    for t in tables:
        for p, kind in t.columns.items():
            props.setdefault(p, []).append(kind)
    b = Binding("node", labels=labels, key=fresh("k"), label=fresh("t"), props={p: fresh("p") for p in props})
    frames = []
    for t in tables:
        own = [(F.col(f"`{p}`") if p in t.columns else F.lit(None)).cast(_common(kinds)).alias(b.props[p]) for p, kinds in props.items()]
        frames.append(t.frame.select(F.col(f"`{t.key}`").cast(key_type).alias(b.key), F.lit(t.name).alias(b.label), *own))
    return union(frames), b


def combos(session, types: tuple) -> list[tuple[str, str, str]]:
    """(table, FROM, TO) of the relationship tables, of all if none is named."""
    tables = [session.catalog.rel(x) for x in types] or list(session.catalog.rels.values())
    return [(t.name, *pair) for t in tables for pair in t.pairs]


def rel_scan(session, some: list[tuple[str, str, str]], direction: str) -> tuple[DataFrame, Binding, tuple[str, str, str, str]]:
    """Edges of the combinations, and the columns (from, from's label, to, to's label) in the walk's direction."""
    catalog = session.catalog
    ends = [catalog.node(x).key_type for _, a, b in some for x in (a, b)]
    key_type = _common(ends)
    props: dict[str, list[T.DataType]] = {}
    for name, _, _ in some:
        for p, kind in catalog.rel(name).columns.items():
            props.setdefault(p, []).append(kind)
    b = Binding("rel", labels=tuple(dict.fromkeys(n for n, _, _ in some)), key=fresh("e"), label=fresh("t"), src=fresh("s"), dst=fresh("d"), src_label=fresh("st"), dst_label=fresh("dt"), props={p: fresh("p") for p in props})
    walk = tuple(fresh("w") for _ in range(4))
    frames = []
    for name, a, z in some:
        t = catalog.rel(name)
        base = t.frames[(a, z)].select(
            F.concat(F.lit(f"{name}:{a}:{z}:"), F.col("_eid").cast("string")).alias(b.key), F.lit(name).alias(b.label), F.col("_src").cast(key_type).alias(b.src), F.col("_dst").cast(key_type).alias(b.dst), F.lit(a).alias(b.src_label), F.lit(z).alias(b.dst_label),
            *((F.col(f"`{p}`") if p in t.columns else F.lit(None)).cast(_common(kinds)).alias(b.props[p]) for p, kinds in props.items()),
        )
        forth = ((b.src, b.src_label, b.dst, b.dst_label),) if direction == "out" else ((b.dst, b.dst_label, b.src, b.src_label),) if direction == "in" else ((b.src, b.src_label, b.dst, b.dst_label), (b.dst, b.dst_label, b.src, b.src_label))
        frames += [base.withColumns({w: F.col(c) for w, c in zip(walk, cols, strict=True)}) for cols in forth]
    return union(frames), b, walk


def same_key(df1: DataFrame, a: str, df2: DataFrame, b: str) -> Column:
    ta, tb = df1.schema[a].dataType, df2.schema[b].dataType
    x, y = F.col(a), F.col(b)
    return x == y if ta == tb or isinstance(ta, T.NumericType) and isinstance(tb, T.NumericType) else x.cast("string") == y.cast("string")


class Matcher:
    """used: names that expressions of the whole query mention."""

    def __init__(self, session, used: set[str]):
        self.session, self.used = session, used
        self.early: list = []  # conjuncts that a search need not wait for
        self.asked: list = []  # conjuncts that the caller applies to the pattern's matches
        self.demand: int | None = None  # how many paths of a search are enough
        self.late: set[str] = set()  # nodes that are scanned when the pattern is joined

    def labels(self, node: A.NodePat) -> tuple:
        names = [self.session.catalog.node(x).name for x in node.labels]
        return tuple(names) or tuple(self.session.catalog.nodes)

    def infer(self, paths: list[A.Path], names: dict, scope: dict[str, Binding], hints: dict[str, tuple]) -> tuple[dict[str, tuple], dict[int, list]]:
        """Labels of every node variable, combinations of every relationship, narrowed until nothing changes. hints: the
        labels that variables have outside of the pattern."""
        labels: dict[str, tuple] = {}
        for path in paths:
            for node in path.nodes:
                v = names[id(node)]
                own = scope[v].labels if v in scope and scope[v].kind == "node" else labels.get(v, hints.get(v, tuple(self.session.catalog.nodes)))
                labels[v] = tuple(x for x in own if x in self.labels(node)) if node.labels else own
        some: dict[int, list] = {}
        changed = True
        while changed:
            changed = False
            for path in paths:
                for i, rel in enumerate(path.rels):
                    a, b = names[id(path.nodes[i])], names[id(path.nodes[i + 1])]
                    if rel.rec is not None:
                        some.setdefault(id(rel), combos(self.session, rel.types))
                        continue
                    found = some.get(id(rel), combos(self.session, rel.types))
                    fits = {"out": lambda c: c[1] in labels[a] and c[2] in labels[b], "in": lambda c: c[2] in labels[a] and c[1] in labels[b]}
                    fits["both"] = lambda c: fits["out"](c) or fits["in"](c)
                    kept = [c for c in found if fits[rel.direction](c)]
                    near = {x for c in kept for x in ((c[1],) if rel.direction == "out" else (c[2],) if rel.direction == "in" else c[1:])}
                    far = {x for c in kept for x in ((c[2],) if rel.direction == "out" else (c[1],) if rel.direction == "in" else c[1:])}
                    for v, ok in ((a, near), (b, far)):
                        narrowed = tuple(x for x in labels[v] if x in ok)
                        if narrowed != labels[v]:
                            labels[v], changed = narrowed, True
                    if kept != some.get(id(rel)):
                        some[id(rel)], changed = kept, True
        return labels, some

    def match(self, state: State, paths: list[A.Path], hints: dict[str, tuple] | None = None, where: list | None = None) -> State:
        """state joined with all paths (inner). Conjuncts of `where`, which the caller applies, restrict the nodes from
        which recursive relationships are searched."""
        recursive = any(r.rec is not None for path in paths for r in path.rels)
        outer, plain = (self.early, self.asked), [c for c in where or () if not any(isinstance(x, A.Sub) for x in walk(c))]
        self.early, self.asked = plain if recursive else [], plain
        try:
            return self.joined(state, paths, hints or {})
        finally:
            self.early, self.asked = outer

    def ready(self, state: State) -> State:
        """state filtered by the early conjuncts whose variables are all there."""
        waiting = []
        for c in self.early:
            names = names_in(c)
            if names and names <= set(state.scope):
                state = State(state.df.filter(Compiler(self.session, state).boolean(c)), state.scope)
            else:
                waiting.append(c)
        self.early = waiting
        return state

    def pinned(self, var: str) -> bool:
        """Whether an early conjunct compares a property of the variable with a value."""
        for c in self.early:
            if isinstance(c, A.Op) and c.op in ("=", "in") and names_in(c) == {var} and any(isinstance(x, A.Prop) and x.of == A.Var(var) for x in c.args):
                return True
        return False

    def joined(self, state: State, paths: list[A.Path], hints: dict[str, tuple]) -> State:
        names: dict[int, str] = {}
        for path in paths:
            for p in (*path.nodes, *path.rels):
                names[id(p)] = p.var or fresh("anon")
        for path in paths:
            for rel in path.rels:
                if rel.var and (rel.var in state.scope or sum(r.var == rel.var for p in paths for r in p.rels) > 1):
                    raise BindError(f"bind relationship {rel.var} to relationship with same name is not supported")
        self.used = self.used | {names[id(n)] for path in paths for n in path.nodes if n.props}
        labels, some = self.infer(paths, names, state.scope, hints)
        if self.session.setting("enable_plan_optimizer") and (found := cycle(self, state, paths, names, labels, some)) is not None:
            return found
        if self.session.setting("enable_plan_optimizer") and (order := better(self, paths, names, some, set(state.scope))) is not None:
            return self.ordered(state, order, names, labels, some)
        for path in paths:
            state = self.path(state, path, names, labels, some)
        return state

    def ordered(self, state: State, order: list[tuple[A.RelPat, A.NodePat, A.NodePat, bool]], names: dict, labels: dict, some: dict) -> State:
        """The relationships joined in this order; properties of nodes come last, when the cycle is closed."""
        nodes = [n for _, near, far, _ in order for n in (near, far)]
        given = {names[id(n)] for n in nodes if n.props} | set(state.scope)
        outer, self.late = self.late, {names[id(n)] for n in nodes} - given
        try:
            for rel, near, far, forward in order:
                if near.props and names[id(near)] not in state.scope:
                    state = self.scan(state, names[id(near)], labels[names[id(near)]])
                state = self.extend(state, rel, near, far, forward, names, labels, some, False)
            late = self.late
        finally:
            self.late = outer
        for n in nodes:
            state = self.inline(state, n, names)
        for v in sorted(late & self.used):
            old = state.scope[v]
            found, b = node_scan(self.session, labels[v])
            test = same_key(state.df, old.key, found, b.key)
            if len(labels[v]) > 1:
                test = test & (F.col(old.label) == F.col(b.label))
            state = state.with_(state.df.join(found, test), **{v: b})
        return state

    def wants(self, var: str, node: A.NodePat) -> bool:
        return bool(node.props) or var in self.used and var not in self.late

    def path(self, state: State, path: A.Path, names: dict, labels: dict, some: dict) -> State:
        order = list(range(len(path.rels)))
        bound = [i for i, n in enumerate(path.nodes) if names[id(n)] in state.scope]
        start = bound[0] if bound else next((i for i, n in enumerate(path.nodes) if n.props), next((i for i, n in enumerate(path.nodes) if self.pinned(names[id(n)])), 0))
        first = path.nodes[start]
        if names[id(first)] not in state.scope:
            elide = path.rels and path.rels[start if start < len(path.rels) else start - 1].rec is None and not self.wants(names[id(first)], first) and not path.var
            if not elide:
                state = self.scan(state, names[id(first)], labels[names[id(first)]])
        state = self.inline(state, first, names)
        for i in [j for j in order if j >= start] + [j for j in reversed(order) if j < start]:
            forward = i >= start
            near, far = (path.nodes[i], path.nodes[i + 1]) if forward else (path.nodes[i + 1], path.nodes[i])
            state = self.extend(state, path.rels[i], near, far, forward, names, labels, some, bool(path.var))
        if path.var:
            parts = [names[id(path.nodes[0])]]
            for i, rel in enumerate(path.rels):
                parts += [names[id(rel)], names[id(path.nodes[i + 1])]]
            state = state.with_(state.df, **{path.var: Binding("path", parts=tuple(parts))})
        return state

    def empty(self, state: State, df: DataFrame, var: str, b: Binding) -> State:
        return state.with_(state.df.crossJoin(df.limit(0)), **{var: b})

    def scan(self, state: State, var: str, labels: tuple) -> State:
        every = labels or tuple(self.session.catalog.nodes)
        if not every:
            raise BindError("no node table exists in database")
        df, b = node_scan(self.session, every)
        if not labels:
            return self.empty(state, df, var, b)
        return state.with_(df if self.unit(state) else state.df.crossJoin(df), **{var: b})

    def unit(self, state: State) -> bool:
        return not state.scope and state.df is self.session.one

    def inline(self, state: State, node, names: dict) -> State:
        """Filters of {key: value} in a pattern."""
        for key, value in node.props:
            test = A.Op("=", (A.Prop(A.Var(names[id(node)]), key), value))
            state = State(state.df.filter(Compiler(self.session, state).boolean(test)), state.scope)
        return state

    def extend(self, state: State, rel: A.RelPat, near: A.NodePat, far: A.NodePat, forward: bool, names: dict, labels: dict, some: dict, named: bool) -> State:
        direction = rel.direction if forward or rel.direction == "both" else {"out": "in", "in": "out"}[rel.direction]
        a, b, r = names[id(near)], names[id(far)], names[id(rel)]
        if rel.rec is not None:
            return self.inline(self.recursive(self.ready(state), rel, a, b, r, direction, forward, labels, some[id(rel)], named), far, names)
        fits = some[id(rel)]
        every = fits or combos(self.session, rel.types)
        if not every:
            raise BindError("no rel table exists in database")
        df, edge, (fr, fr_label, to, to_label) = rel_scan(self.session, every, direction)
        if not fits:
            df = df.limit(0)
        if direction == "both":
            df = df.filter(F.col(fr_label).isin(*(labels[a] or ("",))) & F.col(to_label).isin(*(labels[b] or ("",))))
        if a not in state.scope:  # its properties aren't asked for: the edge's key is enough
            node = Binding("node", labels=labels[a], key=fr, label=fr_label, scanned=False)
            state = state.with_(df if self.unit(state) else state.df.crossJoin(df), **{a: node, r: edge})
            test = None
        else:
            node = state.scope[a]
            test = same_key(state.df, node.key, df, fr)
            if len(labels[a]) > 1 or len(node.labels) > 1:
                test = test & (F.col(node.label) == F.col(fr_label))
        if test is not None:
            if b in state.scope:
                test = test & same_key(state.df, state.scope[b].key, df, to)
                if len(labels[b]) > 1 or len(state.scope[b].labels) > 1:
                    test = test & (F.col(state.scope[b].label) == F.col(to_label))
            state = state.with_(state.df.join(df, test), **{r: edge})
        elif b in state.scope and b != a:
            state = State(state.df.filter(same_key(state.df, state.scope[b].key, state.df, to) & (F.col(state.scope[b].label) == F.col(to_label))), state.scope)
        elif b == a:
            state = State(state.df.filter((F.col(fr) == F.col(to)) & (F.col(fr_label) == F.col(to_label))), state.scope)
        edge.parts = (a, b) if direction == "out" else (b, a) if direction == "in" else ()
        if b not in state.scope:
            if self.wants(b, far) or named:
                nodes, node = node_scan(self.session, labels[b] or tuple(self.session.catalog.nodes))
                test = same_key(state.df, to, nodes, node.key)
                if len(labels[b]) > 1:
                    test = test & (F.col(to_label) == F.col(node.label))
                state = state.with_(state.df.join(nodes, test), **{b: node})
            else:
                state = state.with_(state.df, **{b: Binding("node", labels=labels[b], key=to, label=to_label, scanned=False)})
        state = self.inline(state, rel, names)
        return self.inline(state, far, names)

    def recursive(self, state: State, rel: A.RelPat, a: str, b: str, r: str, direction: str, forward: bool, labels: dict, every: list, named: bool) -> State:
        rec = rel.rec
        top = int(self.session.setting("var_length_extend_max_depth"))
        lo, hi = (1 if rec.lo is None else rec.lo), (top if rec.hi is None else rec.hi)
        if hi > top:
            raise BindError(f"upper bound of rel {rel.var or ''} exceeds maximum: {top}")
        if lo > hi:
            raise BindError(f"lower bound of rel {rel.var or ''} is greater than its upper bound")
        kind = self.session.setting("recursive_pattern_semantic").upper() if rec.kind == "DEFAULT" else rec.kind
        if "SHORTEST" in kind and lo != 1:
            raise BindError("lower bound of shortest/all_shortest path must be 1")
        if not every:
            raise BindError("no rel table exists in database")
        track = named or rel.var is not None and (rel.var in self.session.tracked or rec.rel_items is not None)
        source = state.scope[a]
        given = b in state.scope
        found, out = recursive_frame(self, state, source, kind, lo, hi, rel, direction, every, labels[b], track, forward, state.scope[b] if given else None)
        test = same_key(state.df, source.key, found, out["src"]) & (F.col(source.label) == F.col(out["src_label"]))
        if given:
            target = state.scope[b]
            test = test & same_key(state.df, target.key, found, out["dst"]) & (F.col(target.label) == F.col(out["dst_label"]))
        binding = Binding("rec", length=out["len"], nodes=out.get("nodes"), rels=out.get("rels"), cost=out.get("cost"), parts=(a, b))
        state = state.with_(state.df.join(found, test), **{r: binding})
        if not given:
            nodes, node = node_scan(self.session, labels[b])
            state = state.with_(state.df.join(nodes, same_key(state.df, out["dst"], nodes, node.key) & (F.col(out["dst_label"]) == F.col(node.label))), **{b: node})
        return state

    # ---- whole clauses

    def where(self, state: State, e) -> State:
        """state filtered; conjuncts apply one by one. Those without subqueries come first; those that are an EXISTS alone,
        or its negation, are semi and anti joins; other subqueries become columns."""
        from graphloom.plans.subqueries import semi_joined, subqueries, with_subqueries

        parts = [(c, bool(subqueries(c))) for c in conjuncts(e)]
        for c, nested in parts:
            if not nested:
                state = State(state.df.filter(Compiler(self.session, state).boolean(c)), state.scope)
        rest = []
        for c, nested in parts:
            if nested:
                found = semi_joined(self, state, c)
                if found is None:
                    rest.append(c)
                else:
                    state = found
        state, subs = with_subqueries(self, state, rest)
        for c in rest:
            state = State(state.df.filter(Compiler(self.session, state, subs).boolean(c)), state.scope)
        return state

    def clause(self, state: State, m: A.Match) -> State:
        if not m.optional:
            return self.where(self.match(state, m.paths, where=conjuncts(m.where)), m.where)
        return self.optional(state, m)

    def apart(self, state: State, paths: list[A.Path], where) -> tuple[State, dict[str, Binding], list]:
        """The pattern on its own: its state, its bindings of names that `state` has too, and conjuncts that need state.
        A pattern with a recursive relationship starts at the nodes that `state` has, not at all nodes."""
        mine = {p.var for path in paths for p in (*path.nodes, *path.rels) if p.var} | {path.var for path in paths if path.var}
        shared = [v for v in state.scope if v in mine]
        outer = [c for c in conjuncts(where) if (names_in(c) & set(state.scope)) - mine]
        inline = {id(p): [kv for kv in p.props if names_in(kv[1]) & set(state.scope)] for path in paths for p in (*path.nodes, *path.rels)}
        if any(inline.values()):
            raise BindError("properties in an optional or nested pattern can't use outer variables; use WHERE")
        hints = {v: state.scope[v].labels for v in shared if state.scope[v].kind == "node"}
        seeded = hints and any(r.rec is not None for path in paths for r in path.rels)
        inner = [c for c in conjuncts(where) if c not in outer]
        alone = self.match(self.seeds(state, paths, list(hints)) if seeded else State(self.session.one, {}), paths, hints, inner)
        alone = self.where(alone, reduce(lambda x, y: A.Op("and", (x, y)), inner) if inner else None)
        return alone, {v: alone.scope[v] for v in shared}, outer

    def seeds(self, state: State, paths: list[A.Path], names: list[str]) -> State:
        """The distinct nodes that the names stand for in `state`, with the labels that the pattern allows, in columns of
        their own: from them the pattern's search begins."""
        scope, keys, test = {}, [], F.lit(True)
        cols: dict[str, Column] = {}
        for v in names:
            o = state.scope[v]
            allowed = [set(self.labels(n)) for path in paths for n in path.nodes if n.var == v]
            labels = tuple(x for x in o.labels if all(x in a for a in allowed))
            new = {c: fresh("m") for c in (o.key, o.label, *o.props.values())}
            cols |= {n: F.col(c) for c, n in new.items()}
            keys += [new[o.key], new[o.label]]
            test = test & F.col(new[o.key]).isNotNull() & F.col(new[o.label]).isin(*(labels or ("",)))
            scope[v] = Binding("node", labels=labels, key=new[o.key], label=new[o.label], props={p: new[c] for p, c in o.props.items()}, scanned=o.scanned)
        return State(state.df.select(*(c.alias(n) for n, c in cols.items())).filter(test).dropDuplicates(keys), scope)

    def tie(self, state: State, alone: State, shared: dict[str, Binding]) -> Column | None:
        test = None
        for v, b in shared.items():
            o = state.scope[v]
            one = same_key(state.df, o.key, alone.df, b.key)
            if len(o.labels) > 1 or len(b.labels) > 1:
                one = one & (F.col(o.label) == F.col(b.label))
            test = one if test is None else test & one
        return test

    def optional(self, state: State, m: A.Match) -> State:
        alone, shared, outer = self.apart(state, m.paths, m.where)
        more = {v: b for v, b in alone.scope.items() if v not in shared}
        test = self.tie(state, alone, shared)
        both = State(state.df.crossJoin(alone.df), {**state.scope, **more})  # for types alone
        for c in outer:
            one = Compiler(self.session, both).boolean(c)
            test = one if test is None else test & one
        df = state.df.join(alone.df, test if test is not None else F.lit(True), "left")
        return State(df, both.scope)
