"""Recursive relationships, level by level.

The frame of a search has a row for each path: its source, its end, and if asked for its edges, inner nodes and cost.
A level joins it with the edges on its end. Searches of a few levels stay one plan; deeper ones write each level to a
table, so lineage stays short and an empty level ends the search.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import BindError, RunError
from graphloom.parser import ast as A
from graphloom.plans.expressions import Compiler, walk
from graphloom.plans.scope import Binding, State, fresh
from graphloom.storage import staged

#: Levels that one plan may hold; ends of a frontier that are sent with the scan of the edges.
FLAT, FEW = 4, 1000


def edges(matcher, rel: A.RelPat, direction: str, some: list, track: bool) -> DataFrame:
    """(f, fl, t, tl, eid, edge?, weight?, inner?, node?): filtered edges in the walk's direction.
    inner tells whether the end may be an inner node of a path."""
    from graphloom.plans.matching import node_scan, rel_scan, same_key

    rec, session = rel.rec, matcher.session
    df, b, (f, fl, t, tl) = rel_scan(session, some, direction)
    state = State(df, {})
    rel_name, node_name = rec.rel_var or fresh("r"), rec.node_var or fresh("n")
    state = state.with_(df, **{rel_name: b})
    for key, value in rel.props:
        state = State(state.df.filter(Compiler(session, state).boolean(A.Op("=", (A.Prop(A.Var(rel_name), key), value)))), state.scope)
    wheres = _split(rec.where)
    about_node = [w for w in wheres if any(isinstance(x, A.Var) and x.name == node_name for x in walk(w))]
    for w in wheres:
        if w not in about_node:
            state = State(state.df.filter(Compiler(session, state).boolean(w)), state.scope)
    extra = [F.col(f).alias("f"), F.col(fl).alias("fl"), F.col(t).alias("t"), F.col(tl).alias("tl"), F.col(b.key).alias("eid")]
    if rec.weight:
        if b.prop(rec.weight) is None:
            raise BindError(f"cannot find property {rec.weight} for the weight")
        kind = state.df.schema[b.prop(rec.weight)].dataType
        if not isinstance(kind, T.NumericType):
            raise BindError("a path's weight must be a number")
        extra.append(F.col(b.prop(rec.weight)).cast("double").alias("weight"))
    if track or about_node:
        labels = tuple(dict.fromkeys(x for _, a, z in some for x in (a, z)))
        nodes, n = node_scan(session, labels)
        state = state.with_(state.df.join(nodes, same_key(state.df, t, nodes, n.key) & (F.col(tl) == F.col(n.label))), **{node_name: n})
        compiler = Compiler(session, state)
        test = None
        for w in about_node:
            one = F.coalesce(compiler.boolean(w), F.lit(False))
            test = one if test is None else test & one
        extra.append((test if test is not None else F.lit(True)).alias("inner"))
        if track:
            extra += [_part(compiler, n, node_name, rec.node_items, True).alias("node"), _part(compiler, b, rel_name, rec.rel_items, False).alias("edge")]
    return state.df.select(*extra)


def kept(steps: DataFrame) -> DataFrame:
    """The edges, written if making them takes more than a scan; a scan is repeated by each level, where its filters and
    columns reach the files."""
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    return staged(steps) if re.search(r"\b(Join|Aggregate|Window|Generate|Distinct|Repartition\w*|MapInArrow|LogicalRDD)\b", plan) else steps


def ahead(frontier: DataFrame, steps: DataFrame) -> DataFrame | None:
    """The edges that a level may take: of a frontier with few ends those of the ends alone, as a filter that the scan can
    use. None if the frontier is empty."""
    ends = frontier.select("f", "fl").distinct().limit(FEW + 1).collect()
    if not ends:
        return None
    if len(ends) > FEW:
        return steps
    test = F.lit(False)
    for label in sorted({r["fl"] for r in ends}):
        test = test | (F.col("fl") == label) & F.col("f").isin([r["f"] for r in ends if r["fl"] == label])
    return steps.filter(test)


def _part(compiler: Compiler, b: Binding, name: str, items, node: bool) -> Column:
    """The struct of a node or edge of a path: whole, or the items of a projection."""
    if items is None:
        return compiler.node(b) if node else compiler.rel(b)
    whole = compiler.node(b, []) if node else compiler.rel(b, [])
    lead = ("_ID", "_LABEL") if node else ("_SRC", "_DST", "_LABEL", "_ID")
    return F.struct(*(whole[x].alias(x) for x in lead), *(compiler(e).col.alias(alias) for alias, e in items))


def _split(e) -> list:
    from graphloom.plans.matching import conjuncts

    return conjuncts(e)


def recursive_frame(matcher, state: State, source: Binding, kind: str, lo: int, hi: int, rel: A.RelPat, direction: str, some: list, labels: tuple, track: bool, forward: bool, target: Binding | None) -> tuple[DataFrame, dict[str, str]]:
    """The paths from the state's sources, and the names of the frame's columns."""
    steps = edges(matcher, rel, direction, some, track)
    weighted = "WSHORTEST" in kind
    need_edges = track or kind == "TRAIL"
    if weighted and not steps.filter("weight < 0").isEmpty():
        raise RunError("found negative weight; weighted shortest paths need weights of 0 and more")
    key_type = steps.schema["f"].dataType
    start = state.df.select(F.col(source.key).cast(key_type).alias("s"), F.col(source.label).alias("sl")).filter("s is not null").distinct()
    cols = {"s": F.col("s"), "sl": F.col("sl"), "f": F.col("s"), "fl": F.col("sl"), "len": F.lit(0).cast("long")}
    if need_edges:
        cols["eids"] = F.array().cast("array<string>")
    if kind == "ACYCLIC":
        cols["seen"] = F.array(F.struct(F.col("s").alias("k"), F.col("sl").alias("l")))
    if weighted:
        cols["cost"] = F.lit(0.0)
    if track:
        cols["nodes"] = F.array().cast(T.ArrayType(steps.schema["node"].dataType))
        cols["rels"] = F.array().cast(T.ArrayType(steps.schema["edge"].dataType))
        cols["last"] = F.lit(None).cast(steps.schema["node"].dataType)
    if "inner" in steps.columns:
        cols["ok"] = F.lit(True)
    frontier = start.select(*(c.alias(n) for n, c in cols.items()))
    if weighted:
        found = _cheapest(frontier, steps, kind, hi, track, cols)
    elif "SHORTEST" in kind:
        found = _shortest(frontier, steps, kind, hi, track, cols)
    else:
        found = _walks(frontier, steps, kind, lo, hi, track, cols, matcher.demand, labels)
    if labels:
        found = found.filter(F.col("fl").isin(*labels))
    out = {"src": fresh("s"), "src_label": fresh("sl"), "dst": fresh("d"), "dst_label": fresh("dl"), "len": fresh("n")}
    named = {"s": out["src"], "sl": out["src_label"], "f": out["dst"], "fl": out["dst_label"], "len": out["len"]}
    if weighted:
        out["cost"] = named["cost"] = fresh("c")
    if track:
        out["nodes"], out["rels"] = fresh("ns"), fresh("rs")
        named |= {"nodes": out["nodes"], "rels": out["rels"]}
    picked = [F.col(k) if k not in ("nodes", "rels") or forward else F.reverse(k) for k in named]
    return found.select(*(c.alias(n) for c, n in zip(picked, named.values(), strict=True))), out


def _step(frontier: DataFrame, steps: DataFrame, cols: dict, kind: str) -> DataFrame:
    """Paths longer by an edge. A path goes on only through an inner node that the pattern allows."""
    if "ok" in cols:
        frontier = frontier.filter("ok")
    side = steps.withColumnsRenamed({"f": "ef", "fl": "efl"})
    met = frontier.join(side, (F.col("f") == F.col("ef")) & (F.col("fl") == F.col("efl")))
    if kind == "TRAIL":
        met = met.filter(~F.array_contains("eids", F.col("eid")))
    new = {"s": F.col("s"), "sl": F.col("sl"), "f": F.col("t"), "fl": F.col("tl"), "len": F.col("len") + 1}
    if "eids" in cols:
        new["eids"] = F.array_append("eids", F.col("eid"))
    if kind == "ACYCLIC":
        new["seen"] = F.array_append("seen", F.struct(F.col("t").alias("k"), F.col("tl").alias("l")))
    if "cost" in cols:
        new["cost"] = F.col("cost") + F.col("weight")
    if "nodes" in cols:
        new["nodes"] = F.when(F.col("last").isNull(), F.col("nodes")).otherwise(F.array_append("nodes", F.col("last")))
        new["rels"] = F.array_append("rels", F.col("edge"))
        new["last"] = F.col("node")
    if "ok" in cols:
        new["ok"] = F.col("inner")
    return met.select(*(c.alias(n) for n, c in new.items()))


def _walks(frontier: DataFrame, steps: DataFrame, kind: str, lo: int, hi: int, track: bool, cols: dict, demand: int | None, labels: tuple) -> DataFrame:
    """demand: so many paths to nodes of the labels are enough, and levels after those that have them aren't searched."""
    from graphloom.plans.matching import union

    levels = [frontier] if lo == 0 else []
    deep = hi > FLAT
    if deep:
        steps, frontier = kept(steps), staged(frontier)
    for depth in range(1, hi + 1):
        if kind == "ACYCLIC" and depth > 1:  # the end is exempt, inner nodes must differ
            n = F.size("seen")
            frontier = frontier.filter(~F.array_contains(F.slice("seen", 1, n - 1), F.element_at("seen", -1)))
        near = ahead(frontier, steps) if deep else steps
        if near is None:
            break
        frontier = _step(frontier, near, cols, kind)
        if deep:
            frontier = staged(frontier)
        if depth >= lo:
            levels.append(frontier)
            if deep and demand is not None:
                demand -= (frontier.filter(F.col("fl").isin(*labels)) if labels else frontier).limit(max(1, demand)).count()
                if demand <= 0:
                    break
    return union(levels) if levels else frontier.limit(0)


def _shortest(frontier: DataFrame, steps: DataFrame, kind: str, hi: int, track: bool, cols: dict) -> DataFrame:
    """First arrivals of each (source, end). SHORTEST keeps one path of a pair, ALL SHORTEST each of the least length."""
    from graphloom.plans.matching import union

    steps, frontier = kept(steps), staged(frontier)
    pair = ["s", "sl", "f", "fl"]
    rest = [c for c in cols if c not in pair]
    visited, levels = frontier.select(*pair), []
    for _ in range(hi):
        near = ahead(frontier, steps)
        if near is None:
            break
        level = _step(frontier, near, cols, kind)
        if kind == "SHORTEST":  # one shuffle finds the pairs that are new and takes a path of each
            before = visited.select(*pair, *(F.lit(None).cast(level.schema[c].dataType).alias(c) for c in rest), F.lit(True).alias("before"))
            both = level.withColumn("before", F.lit(False)).unionByName(before).groupBy(*pair).agg(F.max("before").alias("before"), *(F.first(c).alias(c) for c in rest))
            level = both.filter(~F.col("before")).select(*cols)
        else:
            level = level.join(visited, pair, "left_anti")
        frontier = staged(level)
        levels.append(frontier)
        visited = visited.unionByName(frontier.select(*pair).distinct() if kind != "SHORTEST" else frontier.select(*pair))
    return union(levels) if levels else frontier.limit(0)


def _cheapest(frontier: DataFrame, steps: DataFrame, kind: str, hi: int, track: bool, cols: dict) -> DataFrame:
    """Relaxation by levels: a path goes on while its cost is the best, or equal to it for ALL, of its pair so far."""
    from graphloom.plans.matching import union

    steps, frontier = kept(steps), staged(frontier)
    pair = ["s", "sl", "f", "fl"]
    every, levels = kind.startswith("ALL"), []
    best = frontier.select(*pair, F.col("cost").alias("best"))
    for _ in range(hi):
        near = ahead(frontier, steps)
        if near is None:
            break
        level = _step(frontier, near, cols, kind).join(best, pair, "left")
        level = level.filter(F.col("best").isNull() | ((F.col("cost") <= F.col("best")) if every else (F.col("cost") < F.col("best")))).drop("best")
        level = level.filter((F.col("f") != F.col("s")) | (F.col("fl") != F.col("sl")))
        if every:
            least = level.groupBy(*pair).agg(F.min("cost").alias("m"))
            level = level.join(least, pair).filter("cost = m").drop("m")
        else:
            level = level.withColumn("pick", F.struct("cost", "len")).groupBy(*pair).agg(*(F.min_by(c, "pick").alias(c) for c in cols if c not in pair)).select(*cols)
        frontier = staged(level.select(*cols))
        levels.append(frontier)
        best = staged(best.unionByName(frontier.select(*pair, F.col("cost").alias("best"))).groupBy(*pair).agg(F.min("best").alias("best")))
    if not levels:
        return frontier.limit(0)
    found = union(levels).join(best, pair).filter("cost = best").drop("best")
    if not every:
        found = found.groupBy(*pair).agg(*(F.min_by(c, "len").alias(c) for c in cols if c not in pair)).select(*cols)
    return found
