"""CREATE, SET, DELETE and MERGE on the rows of a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import BindError, RunError
from graphloom.operators.tables import declared, numbered, put_nodes, put_rels
from graphloom.parser import ast as A
from graphloom.plans.expressions import Compiler
from graphloom.plans.scope import ORDER, Binding, State, fresh
from graphloom.storage import staged
from graphloom.versions import Version, matching


def update(runner, state: State, c) -> State:
    """The clause's changes are made; the state that follows sees them."""
    session = runner.session
    if isinstance(c, A.Create):
        return create(session, state, c.paths)
    if isinstance(c, A.SetProps):
        return set_props(session, fixed(state), c.items)
    if isinstance(c, A.Delete):
        return delete(session, fixed(state), c)
    return merge(runner, state, c)


def fixed(state: State) -> State:
    """The state's rows written and numbered, so later changes of tables don't touch them."""
    return State(staged(state.df.withColumn(fresh(ORDER), F.monotonically_increasing_id())), state.scope)


def order_of(df: DataFrame) -> F.Column:
    """A row's place: that of its UNWIND values and then of its row, outer clauses first."""
    own = sorted((c for c in df.columns if c.startswith(f"__{ORDER}")), key=lambda c: int(c.removeprefix(f"__{ORDER}")))
    return F.struct(*own)


def _names(paths: list) -> dict[int, str]:
    return {id(p): p.var or fresh("anon") for path in paths for p in (*path.nodes, *path.rels)}


def create(session, state: State, paths: list[A.Path], names: dict | None = None) -> State:
    names = names or _names(paths)
    state = fixed(state)
    nodes, rels = {}, []
    for path in paths:
        for n in path.nodes:
            v = names[id(n)]
            if v in state.scope or v in nodes:
                if (n.labels or n.props) and v in state.scope:
                    raise BindError(f"variable {v} is bound already and can't be created")
                continue
            if len(n.labels) != 1:
                raise BindError("create node expects one label")
            nodes[v] = n
        for i, r in enumerate(path.rels):
            if r.direction == "both" or len(r.types) != 1 or r.rec is not None:
                raise BindError("create rel expects one type and a direction")
            rels.append((names[id(r)], r, names[id(path.nodes[i])], names[id(path.nodes[i + 1])]))
    new: dict[str, Binding] = {}
    df = state.df
    for v, n in nodes.items():
        df, new[v] = _values(session, State(df, {**state.scope, **new}), session.catalog.node(n.labels[0]), n.props, v)
    state = State(staged(df), {**state.scope, **new})
    for v, n in nodes.items():
        table, b = session.catalog.node(n.labels[0]), new[v]
        put_nodes(table, state.df.select(*(F.col(b.props[p]).alias(p) for p in table.columns)), written=True)
    for v, r, a, z in rels:
        if r.direction == "in":
            a, z = z, a
        table = session.catalog.rel(r.types[0])
        df, b = _values(session, state, table, r.props, v)
        src, dst = state.scope[a], state.scope[z]
        b.key, b.src, b.dst, b.src_label, b.dst_label = fresh("e"), src.key, dst.key, src.label, dst.label
        df = df.withColumn(b.key + "u", F.call_function("uuid"))
        df = staged(df.withColumn(b.key, F.concat(F.lit(f"{table.name}:"), F.col(src.label), F.lit(":"), F.col(dst.label), F.lit(":"), F.col(b.key + "u"))))
        state = State(df, {**state.scope, v: b})
        made = False
        for pair in table.pairs:
            if pair[0] in src.labels and pair[1] in dst.labels:
                made = True
                rows = df.filter((F.col(src.label) == pair[0]) & (F.col(dst.label) == pair[1]))
                ends = [F.col(x.key).cast(session.catalog.node(t).key_type).alias(n) for x, t, n in ((src, pair[0], "_src"), (dst, pair[1], "_dst"))]
                put_rels(session, table, pair, rows.select(*ends, F.col(b.key + "u").alias("_eid"), *(F.col(b.props[p]).alias(p) for p in table.columns)))
        if not made:
            raise BindError(f"table {table.name} doesn't connect {src.labels} to {dst.labels}")
    return state


def _values(session, state: State, table, props: tuple, var: str) -> tuple[DataFrame, Binding]:
    """state's frame with a column for each property of a new node or edge."""
    given = dict(props)
    unknown = [k for k in given if k not in table.columns]
    if unknown:
        raise BindError(f"cannot find property {unknown[0]} for {var}")
    compiler, node = Compiler(session, state), hasattr(table, "key")
    b = Binding("node" if node else "rel", labels=(table.name,), label=fresh("t"), props={p: fresh("p") for p in table.columns})
    df, cols = state.df, {b.label: F.lit(table.name)}
    for p, c in b.props.items():
        if p in table.__dict__.get("serial", ()) and p not in given:
            seq = session.sequence(f"{table.name}_{p}_serial")
            first = seq.start if seq.value is None else seq.value + seq.increment
            df = numbered(df, c, first)
            seq.value = first + df.count() - 1 if not df.isEmpty() else seq.value
            continue
        e = given.get(p, table.defaults.get(p))
        found = compiler(e) if e is not None else None
        cols[c] = declared(session, table, p, found.col, found.type) if found is not None else F.lit(None).cast(table.columns[p])
    df = df.withColumns(cols)
    if node:
        b.key = b.props[table.key]
        if table.key not in given and table.key not in table.serial and table.key not in table.defaults:
            raise BindError(f"create node {var} expects primary key {table.key} as input")
    return df, b


def set_props(session, state: State, items: list) -> State:
    flat = []
    for target, value in items:
        if isinstance(target, A.Var):
            if not isinstance(value, A.StructLit):
                raise BindError("SET of a whole variable takes {..}")
            flat += [(A.Prop(target, k), v) for k, v in value.fields]
        else:
            flat.append((target, value))
    compiler, by_var = Compiler(session, state), {}
    for target, value in flat:
        if not isinstance(target, A.Prop) or not isinstance(target.of, A.Var) or target.of.name not in state.scope:
            raise BindError("SET takes properties of variables")
        b = state.scope[target.of.name]
        if b.kind not in ("node", "rel"):
            raise BindError(f"cannot set properties of {target.of.name}")
        by_var.setdefault(target.of.name, {})[target.key] = compiler(value)
    for var, changes in by_var.items():
        b = state.scope[var]
        cols = {}
        for p, e in changes.items():
            tables = [session.catalog.table(x) for x in b.labels]
            if not any(p in t.columns for t in tables):
                raise BindError(f"cannot find property {p} for {var}")
            if b.kind == "node" and any(p == t.key for t in tables):
                raise BindError(f"cannot set property {p}: it is the primary key; delete and create the node instead")
            owner = next(t for t in tables if p in t.columns)
            cols[p] = (fresh("n"), declared(session, owner, p, e.col, e.type))
        df = staged(state.df.withColumns(dict(cols.values())))
        values = F.struct(*(F.col(n).alias(f"__v_{p}") for p, (n, _) in cols.items()))
        last = df.filter(F.col(b.key).isNotNull()).groupBy(F.col(b.key).alias("__k"), F.col(b.label).alias("__l")).agg(F.max_by(values, order_of(df)).alias("v"))
        rows = staged(last.select("__k", "__l", "v.*"))
        for name in b.labels:
            _rewrite(session.catalog.table(name), rows.filter(F.col("__l") == name).drop("__l"), {p: f"__v_{p}" for p in cols})
        shown = {b.prop(p): F.col(n) for p, (n, _) in cols.items() if b.prop(p)}
        state = State(df.withColumns(shown), state.scope)
    return state


def _rewrite(table, rows: DataFrame, new: dict[str, str]) -> None:
    """Replaces the rows of the keys __k by ones with new values. Only these are written, once: their keys drop the old."""
    new = {p: c for p, c in new.items() if p in table.columns}
    if not new or rows.isEmpty():
        return
    if table.foreign:
        raise BindError(f"{table.name} is read in place and can't be changed")

    def changed(version: Version, key: str, rows: DataFrame) -> Version:
        frame = version.frame(key)
        met = matching(frame, key, rows).join(rows, F.col(f"`{key}`") == F.col("__k"))
        made = staged(met.select(*(F.col(new[c]).cast(table.columns[c]).alias(c) if c in new else F.col(f"`{c}`") for c in frame.columns)))
        return version.minus(made.select(F.col(f"`{key}`").alias("__k"))).plus(made)

    if hasattr(table, "key"):
        table.data = changed(table.data, table.key, rows)
    else:
        for pair, version in list(table.frames.versions.items()):
            own = _edges_of(table, pair, rows)
            if not own.isEmpty():
                table.frames[pair] = changed(version, "_eid", own)


def _edges_of(table, pair: tuple[str, str], rows: DataFrame) -> DataFrame:
    """Rows of a pair of the table, their __k cut down to the edge's own id."""
    lead = f"{table.name}:{pair[0]}:{pair[1]}:"
    return rows.filter(F.startswith(F.col("__k"), F.lit(lead))).withColumn("__k", F.substring(F.col("__k"), len(lead) + 1, 2**31 - 1))


def delete(session, state: State, c: A.Delete) -> State:
    bound = []
    for e in c.vars:
        b = state.scope.get(e.name) if isinstance(e, A.Var) else None
        if b is None or b.kind not in ("node", "rel"):
            raise BindError("DELETE takes nodes and relationships")
        bound.append(b)
    for b in bound:
        if b.kind == "rel":
            gone = state.df.filter(F.col(b.key).isNotNull()).select(F.col(b.key).alias("__k")).distinct()
            for name in b.labels:
                _drop_rels(session.catalog.rel(name), gone)
    for b in bound:
        if b.kind != "node":
            continue
        for name in b.labels:
            table = session.catalog.node(name)
            if table.foreign:
                raise BindError(f"{table.name} is read in place and can't be changed")
            gone = staged(state.df.filter(F.col(b.key).isNotNull() & (F.col(b.label) == name)).select(F.col(b.key).cast(table.key_type).alias("__k")).distinct())
            if gone.isEmpty():
                continue
            for rel in session.catalog.rels.values():
                for pair, version in list(rel.frames.versions.items()):
                    for end, of in zip(("_src", "_dst"), pair, strict=True):
                        if of != name:
                            continue
                        edges = matching(version.frame("_eid"), end, gone).select(F.col("_eid").alias("__k"))
                        if not c.detach:
                            if not edges.isEmpty():
                                raise RunError(f"node in table {name} has connected edges in table {rel.name}, which cannot be deleted; please delete the edges first or try DETACH DELETE")
                            continue
                        edges = staged(edges)
                        if not edges.isEmpty():
                            rel.frames[pair] = version = version.minus(edges)
            table.data = table.data.minus(gone)
    return state


def _drop_rels(table, gone: DataFrame) -> None:
    if table.foreign:
        raise BindError(f"{table.name} is read in place and can't be changed")
    for pair, version in list(table.frames.versions.items()):
        own = staged(_edges_of(table, pair, gone))
        if not own.isEmpty():
            table.frames[pair] = version.minus(own)


def merge(runner, state: State, c: A.Merge) -> State:
    """Rows that match the pattern keep their matches. Of the others one row for each distinct pattern creates it;
    the rest, which a row-by-row run would have matched to it, are matched to it too."""
    session, row, made = runner.session, fresh("row"), fresh("made")
    state = fixed(state)
    state = State(staged(state.df.withColumn(row, F.monotonically_increasing_id())), state.scope)
    names = _names([c.path])
    found = fixed(runner.matcher.match(state, [_named(c.path, names)]))
    missing = staged(state.df.join(found.df.select(row).distinct(), row, "left_anti"))
    parts = [State(found.df.withColumn(made, F.lit(False)), found.scope)]
    if not missing.isEmpty():
        compiler = Compiler(session, State(missing, state.scope))
        keys = [compiler(v).col for p in (*c.path.nodes, *c.path.rels) for _, v in p.props]
        keys += [F.col(x) for n in c.path.nodes if names[id(n)] in state.scope for x in (state.scope[names[id(n)]].key, state.scope[names[id(n)]].label)]
        tagged = missing.withColumn("__keys", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.lit(0).alias("z")))
        first = staged(tagged.groupBy("__keys").agg(F.min(row).alias(row)).select(row))
        create(session, State(missing.join(first, row, "left_semi"), state.scope), [c.path], names)
        again = runner.matcher.match(State(missing, state.scope), [_named(c.path, names)])
        again = fixed(State(again.df.join(first.withColumn(made, F.lit(True)), row, "left").withColumn(made, F.coalesce(made, F.lit(False))), again.scope))
        parts.append(again)
    state = _together(parts, [row, made], state.scope)
    for items, flag in ((c.on_create, True), (c.on_match, False)):
        if items:
            chosen = State(state.df.filter(F.col(made) == flag), state.scope)
            rest = State(state.df.filter(F.col(made) != flag), state.scope)
            state = _together([set_props(session, fixed(chosen), items), rest], [row, made], {})
    return state


def _named(path: A.Path, names: dict) -> A.Path:
    """The pattern with its anonymous parts named, so they bind."""
    import dataclasses

    return A.Path(path.var, tuple(dataclasses.replace(n, var=names[id(n)]) for n in path.nodes), tuple(dataclasses.replace(r, var=names[id(r)]) for r in path.rels))


def _together(parts: list[State], extra: list[str], outer: dict) -> State:
    """States of one scope, bound to different columns, as one."""
    first = parts[0]
    frames = [first.df]
    for p in parts[1:]:
        cols = {}
        for v, b in first.scope.items():
            for mine, theirs in zip(_ordered(b), _ordered(p.scope[v]), strict=True):
                cols[mine] = F.col(theirs)
        frames.append(p.df.select(*(c.alias(n) for n, c in cols.items()), *extra))
    keep = list(dict.fromkeys([c for b in first.scope.values() for c in _ordered(b)] + extra))
    return State(staged(reduce(DataFrame.unionByName, [f.select(*keep) for f in frames])), first.scope)


def _ordered(b: Binding) -> list[str]:
    own = [b.col, b.key, b.label, b.src, b.dst, b.src_label, b.dst_label, b.length, b.cost, b.nodes, b.rels]
    return [c for c in own if c] + [b.props[p] for p in b.props]
