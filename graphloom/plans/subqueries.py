"""EXISTS alone in a WHERE as a semi join, NOT EXISTS as an anti join. Other EXISTS and COUNT subqueries as columns: the
pattern alone is grouped by what it shares with the outer query and joined to it from the left, so a row is never doubled."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.parser import ast as A
from graphloom.plans.expressions import Compiler, names_in, walk
from graphloom.plans.scope import State, fresh


def subqueries(e) -> list[A.Sub]:
    out = [x for x in walk(e) if isinstance(x, A.Sub)]
    nested = {y for x in out for y in walk(x.where) if isinstance(y, A.Sub)} if out else set()
    return [x for x in dict.fromkeys(out) if x not in nested]


def semi_joined(matcher, state: State, e) -> State | None:
    """state filtered by an EXISTS of what it shares with the pattern, or by its negation; None if e is something else."""
    negated = isinstance(e, A.Op) and e.op == "not"
    sub = e.args[0] if negated else e
    if not isinstance(sub, A.Sub) or sub.kind == "COUNT":
        return None
    alone, shared, outer = matcher.apart(state, list(sub.patterns), sub.where)
    if not shared and not outer:
        return None
    test = matcher.tie(state, alone, shared)
    both = State(state.df.crossJoin(alone.df), {**state.scope, **{v: b for v, b in alone.scope.items() if v not in shared}})  # for types alone
    for c in outer:
        one = Compiler(matcher.session, both).boolean(c)
        test = one if test is None else test & one
    return State(state.df.join(alone.df, test, "left_anti" if negated else "left_semi"), state.scope)


def with_subqueries(matcher, state: State, expressions: list) -> tuple[State, dict]:
    """state with a column for each subquery, and the columns' names."""
    subs: dict[A.Sub, str] = {}
    for e in expressions:
        for sub in subqueries(e):
            if sub not in subs:
                state, subs[sub] = _joined(matcher, state, sub)
    return state, subs


def _joined(matcher, state: State, sub: A.Sub) -> tuple[State, str]:
    out = fresh("q")
    alone, shared, outer = matcher.apart(state, list(sub.patterns), sub.where)
    value = F.count(F.lit(1)).alias(out)
    if not shared and not outer:
        one = alone.df.agg(value)
        df = state.df.crossJoin(one)
    else:
        keys = [c for v in shared for c in (state.scope[v].key, state.scope[v].label)]
        for c in outer:
            for v in sorted(names_in(c) & set(state.scope)):
                keys += state.scope[v].columns()
        keys = list(dict.fromkeys(keys))
        test = matcher.tie(state, alone, shared)
        probe = state.df.select(*keys).distinct()
        both = State(state.df.crossJoin(alone.df), {**state.scope, **{v: b for v, b in alone.scope.items() if v not in shared}})
        for c in outer:
            one = Compiler(matcher.session, both).boolean(c)
            test = one if test is None else test & one
        met = probe.join(alone.df, test)
        renamed = {k: fresh("j") for k in keys}
        counted = met.groupBy(*keys).agg(value).withColumnsRenamed(renamed)
        on = None
        for k, n in renamed.items():
            one = F.col(k).eqNullSafe(F.col(n))
            on = one if on is None else on & one
        df = state.df.join(counted, on, "left").drop(*renamed.values())
    found = F.coalesce(F.col(out), F.lit(0).cast("long"))
    return State(df.withColumn(out, found if sub.kind == "COUNT" else found > 0), state.scope), out
