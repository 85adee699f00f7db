"""Aggregates of acyclic patterns without the pattern's product.

`MATCH (a)-[:R]->(b)-[:S]->(c) RETURN a.x, count(*)` needs of b and c only how many ways lead on from a. If everything that
is returned comes from one node variable, that node is the root, and each subtree sends it a table (key, label, ways): the
edges, grouped by their near end, summing the ways of the far end. The grouped sums are combined before each shuffle and
hold a row for each node at most, so the number of matches may be any, the work is that of the edges. The root's rows
then carry the product of their subtrees' ways as a weight, by which counts and sums are taken; a minimum or maximum and
distinct aggregates need only that there is a way.

This holds where one MATCH of a connected tree of single-step relationships is followed by a projection with aggregates,
each conjunct of WHERE is about one variable, and relationships are not named outside WHERE. Else the plan is the joins'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.parser import ast as A
from graphloom.plans.expressions import Compiler, has_aggregate, names_in, walk
from graphloom.plans.matching import Matcher, conjuncts, node_scan, rel_scan, same_key
from graphloom.plans.scope import Binding, State, fresh

#: Aggregates that a weight can stand for.
WEIGHTED = frozenset(("count_star", "count", "sum", "min", "max", "avg"))


def root_of(matcher: Matcher, m: A.Match, p: A.Project) -> tuple[str | None, dict[str, list]] | None:
    """The node variable that the projection is about, None if it is about none, and the conjuncts by variable. None if
    the pattern isn't of this kind."""
    if m.optional or m.hint is not None or sum(len(path.rels) for path in m.paths) < 2 or any(path.var or r.rec is not None for path in m.paths for r in path.rels):
        return None
    exprs = [i.expr for i in p.items]
    if not any(has_aggregate(e) for e in exprs) or any(isinstance(x, (A.Sub, A.Star)) for e in [*exprs, *(e for e, _ in p.order)] for x in walk(e)):
        return None
    if any(isinstance(x, A.Func) and (x.name == "collect" or x.name in ("start_node", "end_node")) for e in exprs for x in walk(e)):
        return None
    nodes = {n.var for path in m.paths for n in path.nodes if n.var}
    rels = {r.var for path in m.paths for r in path.rels if r.var}
    aliases = {i.alias for i in p.items if i.alias}
    used = {v for e in exprs for v in names_in(e)} | {v for e, _ in p.order for v in names_in(e) if v not in aliases}
    if used & rels or not used <= nodes or len(used) > 1:
        return None
    by: dict[str, list] = {}
    for c in conjuncts(m.where):
        names = names_in(c)
        if len(names) != 1 or not names <= nodes | rels or any(isinstance(x, A.Sub) for x in walk(c)):
            return None
        by.setdefault(next(iter(names)), []).append(c)
    return next(iter(used), None), by


class Tree:
    """The pattern as a graph of node variables; edges hold the relationship and its ends."""

    def __init__(self, matcher: Matcher, m: A.Match, conditions: dict[str, list]):
        self.matcher, self.session, self.conditions = matcher, matcher.session, conditions
        self.names = {id(x): x.var or fresh("anon") for path in m.paths for x in (*path.nodes, *path.rels)}
        self.inline: dict[str, list] = {}
        self.near: dict[str, list] = {}
        for path in m.paths:
            for n in path.nodes:
                self.inline.setdefault(self.names[id(n)], []).extend(n.props)
                self.near.setdefault(self.names[id(n)], [])
            for i, rel in enumerate(path.rels):
                a, b = (self.names[id(x)] for x in path.nodes[i : i + 2])
                self.near[a].append((rel, b, rel.direction))
                self.near[b].append((rel, a, {"out": "in", "in": "out", "both": "both"}[rel.direction]))
        self.labels, self.some = matcher.infer(m.paths, self.names, {}, {})

    def is_tree(self) -> bool:
        seen, todo = set(), [next(iter(self.near))]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [u for _, u, _ in self.near[v]]
        return len(seen) == len(self.near) == sum(map(len, self.near.values())) // 2 + 1 and all(self.some[id(r)] for e in self.near.values() for r, _, _ in e) and all(self.labels.values())

    def filtered(self, state: State, var: str, props: list) -> State:
        for key, value in props:
            state = State(state.df.filter(Compiler(self.session, state).boolean(A.Op("=", (A.Prop(A.Var(var), key), value)))), state.scope)
        for c in self.conditions.get(var, ()):
            state = State(state.df.filter(Compiler(self.session, state).boolean(c)), state.scope)
        return state

    def message(self, parent: str, rel: A.RelPat, child: str, direction: str) -> tuple[DataFrame, str, str, str]:
        """(key, label, ways) of the parent's nodes: how many matches of the subtree behind the relationship they have."""
        df, edge, (fr, fr_label, to, to_label) = rel_scan(self.session, self.some[id(rel)], direction)
        state = self.filtered(State(df, {self.names[id(rel)]: edge}), self.names[id(rel)], list(rel.props))
        df = state.df.filter(F.col(fr_label).isin(*self.labels[parent]) & F.col(to_label).isin(*self.labels[child]))
        ways = F.count(F.lit(1))
        below = self.table(child, parent, bool(self.inline[child] or self.conditions.get(child)))
        if below is not None:
            far, key, label, own = below
            df = df.join(far, same_key(df, to, far, key) & (F.col(to_label) == F.col(label)))
            ways = F.sum(own) if own else ways
        out = (fresh("k"), fresh("t"), fresh("w"))
        return df.groupBy(F.col(fr).alias(out[0]), F.col(fr_label).alias(out[1])).agg(ways.alias(out[2])), *out

    def table(self, var: str, parent: str | None, scan: bool) -> tuple[DataFrame, str, str, str | None] | None:
        """The nodes of the variable that match all that is below it: (frame, key, label, column of the ways, if any). None
        if they aren't restricted at all."""
        parts = [self.message(var, r, u, d) for r, u, d in self.near[var] if u != parent]
        df, self.binding = None, None
        if scan:
            df, b = node_scan(self.session, self.labels[var])
            state = self.filtered(State(df, {var: b}), var, self.inline[var])
            df, key, label, own = state.df, b.key, b.label, None
            binding = b
        elif not parts:
            return None
        else:
            df, key, label, own = parts.pop(0)
            binding = Binding("node", labels=self.labels[var], key=key, label=label, scanned=False)
        for more, k, t, w in parts:
            df = df.join(more, same_key(df, key, more, k) & (F.col(label) == F.col(t)))
            new = fresh("w")
            df, own = df.withColumn(new, F.col(own) * F.col(w) if own else F.col(w)), new
        self.binding = binding
        return df, key, label, own


def weighted(runner, m: A.Match, p: A.Project) -> tuple[State, Column] | None:
    """The root's rows and the weight of each, or None."""
    found = root_of(runner.matcher, m, p)
    if found is None:
        return None
    var, conditions = found
    tree = Tree(runner.matcher, m, conditions)
    if not tree.is_tree():
        return None
    root = var or max(tree.near, key=lambda v: len(tree.near[v]))
    df, _, _, own = tree.table(root, None, bool(var or tree.inline[root] or conditions.get(root)))
    return State(df, {root: tree.binding}), F.col(own)


def by_weight(compiler: Compiler, f: A.Func, weight: Column, one) -> Column:
    """An aggregate of rows that stand for `weight` rows each; one: the same without weights."""
    if f.name not in WEIGHTED or f.distinct or f.name in ("min", "max"):
        return one(compiler, f)
    if f.name == "count_star":
        return F.coalesce(F.sum(weight), F.lit(0).cast("long"))
    arg = f.args[0]
    b = compiler.state.scope.get(arg.name) if isinstance(arg, A.Var) else None
    x = F.col(b.key) if b is not None and b.kind == "node" else compiler(arg).col
    held = F.when(x.isNotNull(), weight)
    if f.name == "count":
        return F.coalesce(F.sum(held), F.lit(0).cast("long"))
    one(compiler, f)  # its checks of the type
    if f.name == "avg":
        return F.sum(x.cast("double") * weight) / F.sum(held)
    kind = compiler(arg).type
    from graphloom.types import HUGE, is_int

    return F.sum(x.cast(HUGE) * weight) if is_int(kind) else F.sum(x * weight)
