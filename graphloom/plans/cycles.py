"""Cycles of three and four relationships over one table, by a hypercube shuffle and intersections.

Binary joins of a cycle make every open path first, which around nodes of many edges is far more than the edges and the
cycles. Here each node variable has as many shares as the root of the cells; a node's share is a hash of its key. An edge
goes to all cells that agree with the shares of its two ends, in one shuffle, and every match meets in just one cell. There
the edges are sorted adjacency lists: for two ends the shorter list is looked up in the other, so a cell of n edges does
work in proportion to n^1.5 and to its matches, in blocks of bounded size. The edges of a node of many edges are spread over
the shares of their other ends.

A cell's edges are copied to many cells, though. Four relationships have a second way: the two-step paths around two opposite
nodes, from Spark's joins, meet on their ends. Which nodes, and whether these paths are fewer than the copies, is estimated
from a sketch of the nodes' edges, so hubs on both sides go to the cells and everything else isn't copied.

This is taken for a pattern that is such a cycle and nothing else, begins a query, and whose relationships are of one
many-to-many table and not named elsewhere. Foreign keys, whose joins don't grow, stay with Spark's joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import BindError
from graphloom.parser import ast as A
from graphloom.plans.expressions import Compiler, names_in, walk
from graphloom.plans.scope import Binding, State, fresh

#: Pairs that are looked at in one step; cells for each shuffle partition; sums of a sketch.
BLOCK, CELLS, SUMS = 1 << 18, 2, 1 << 14
BACK = {"in": "out", "out": "in", "both": "both"}


def around(matcher, paths: list[A.Path], names: dict, labels: dict, some: dict) -> list[tuple[str, A.RelPat, str]] | None:
    """The cycle as (node variable, relationship, its direction from there), or None."""
    rels = [(r, names[id(p.nodes[i])], names[id(p.nodes[i + 1])]) for p in paths for i, r in enumerate(p.rels)]
    nodes = {names[id(n)] for p in paths for n in p.nodes}
    if len(rels) not in (3, 4) or len(nodes) != len(rels) or any(p.var for p in paths) or any(len(labels[v]) != 1 for v in nodes):
        return None
    if any(r.rec is not None or r.props or r.var and r.var in matcher.used or not some[id(r)] for r, _, _ in rels):
        return None
    tables = {t for r, _, _ in rels for t, _, _ in some[id(r)]}
    if any({t for t, _, _ in some[id(r)]} != tables for r, _, _ in rels) or any(matcher.session.catalog.rel(t).multiplicity != "MANY_MANY" for t in tables):
        return None
    first = at = names[id(paths[0].nodes[0])]
    out, left = [], list(rels)
    while left:
        found = next(((x, x[2], x[0].direction) for x in left if x[1] == at), None) or next(((x, x[1], BACK[x[0].direction]) for x in left if x[2] == at), None)
        if found is None or found[1] == at or any(v == found[1] for v, _, _ in out) and not (found[1] == first and len(left) == 1):
            return None
        out.append((at, found[0][0], found[2]))
        left.remove(found[0])
        at = found[1]
    return out if at == first else None


class Lists:
    """Sorted adjacency lists of distinct pairs, and how often each pair occurs."""

    def __init__(self, u: np.ndarray, v: np.ndarray, width: int):
        self.width = width
        self.keys, self.times = np.unique(u * width + v, return_counts=True)
        self.of = self.keys // width

    def range(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = np.searchsorted(self.of, u)
        return lo, np.searchsorted(self.of, u, "right") - lo

    def find(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How often each pair occurs."""
        key = u * self.width + v
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, self.times[at], 0) if len(self.keys) else np.zeros(len(key), np.int64)


def common(left: Lists, right: Lists, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the pair, neighbour, times) for the common neighbours of each pair (u, v), in blocks."""
    a, n = left.range(u)
    b, m = right.range(v)
    for mine, lo, size, other, far in ((left, a, n, right, v), (right, b, m, left, u)):
        chosen = np.flatnonzero((n <= m) if mine is left else (n > m))
        upto = np.cumsum(size[chosen])
        start = 0
        while start < len(chosen):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + BLOCK, "right")))
            some = chosen[start:stop]
            of = np.repeat(some, size[some])
            at = np.arange(len(of)) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + lo[of]
            x = mine.keys[at] % mine.width
            times = mine.times[at] * other.find(far[of], x)
            kept = np.flatnonzero(times)
            if len(kept):
                yield of[kept], x[kept], times[kept]
            start = stop


def matches(edges: list[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[list[np.ndarray]]:
    """Blocks of matches, a column for each node of the cycle; edge i goes from node i to the next."""
    lists = [Lists(u, v, width) for u, v in edges]
    back = Lists(edges[-1][1], edges[-1][0], width)  # from the first node to the last
    a, b, times = lists[0].keys // width, lists[0].keys % width, lists[0].times
    if len(edges) == 3:
        for of, c, more in common(lists[1], back, b, a):
            yield [np.repeat(x, times[of] * more) for x in (a[of], b[of], c)]
        return
    lo, n = back.range(a)
    towards = Lists(edges[2][1], edges[2][0], width)  # from the last node to the third
    upto, start = np.cumsum(n), 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + BLOCK, "right")))
        first = np.repeat(np.arange(start, stop), n[start:stop])
        at = np.arange(len(first)) - np.repeat(np.cumsum(n[start:stop]) - n[start:stop], n[start:stop]) + lo[first]
        d, weight = back.keys[at] % width, times[first] * back.times[at]
        for of, c, more in common(lists[1], towards, b[first], d):
            yield [np.repeat(x, weight[of] * more) for x in (a[first][of], b[first][of], c, d[of])]
        start = stop


def tested(matcher, df: DataFrame, keys: dict[str, str], labels: dict) -> DataFrame:
    """df by those conjuncts of the WHERE, which is applied to the matches anyway, that only compare these nodes' keys."""
    scope = {}
    for v, key in keys.items():
        table = matcher.session.catalog.node(labels[v][0])
        if df.schema[key].dataType == table.key_type:
            scope[v] = Binding("node", labels=labels[v], key=key, props={table.key: key})
    for c in matcher.asked:
        parts = list(walk(c))
        bare = sum(isinstance(x, A.Var) for x in parts) != sum(isinstance(x, A.Prop) for x in parts)
        if bare or not names_in(c) or not names_in(c) <= set(scope) or not all(isinstance(x, (A.Op, A.Prop, A.Var, A.Lit)) for x in parts):
            continue
        try:
            df = df.filter(Compiler(matcher.session, State(df, scope)).boolean(c))
        except BindError:  # about another property
            continue
    return df


def edge_sums(legs: dict[tuple, DataFrame]) -> tuple[dict[tuple, np.ndarray], dict[tuple, int]]:
    """Of each leg sums of signed edges by a hash of the node they start at, and its edges. The product of two legs' sums
    is near the number of their pairs of edges that start at one node."""
    order = list(legs)
    frames = [legs[x].select(F.lit(i).alias("leg"), F.pmod(F.xxhash64("u"), F.lit(SUMS)).cast("int").alias("at"), (F.pmod(F.xxhash64("u", F.lit(1)), F.lit(2)) * 2 - 1).alias("sign")) for i, x in enumerate(order)]
    every = frames[0]
    for df in frames[1:]:
        every = every.unionByName(df)
    sums, edges = {x: np.zeros(SUMS) for x in order}, dict.fromkeys(order, 0)
    for r in every.groupBy("leg", "at").agg(F.sum("sign").alias("s"), F.count("*").alias("n")).toLocalIterator():  # at most SUMS rows for each leg
        sums[order[r["leg"]]][r["at"]] = r["s"]
        edges[order[r["leg"]]] += r["n"]
    return sums, edges


def paths_of_two(matcher, found: list[tuple[str, A.RelPat, str]], labels: dict, some: dict, shares: int, keys: dict[str, str]) -> DataFrame | None:
    """The matches of a cycle of four by paths around two opposite nodes, or None if the cells' copies are fewer."""
    from graphloom.plans.matching import rel_scan

    legs: dict[tuple, DataFrame] = {}
    of: dict[tuple[int, int], tuple] = {}
    for i, (v, rel, direction) in enumerate(found):
        j = (i + 1) % 4
        for a, b, way in ((i, j, direction), (j, i, BACK[direction])):
            fr_label, to_label = labels[found[a][0]][0], labels[found[b][0]][0]
            of[a, b] = (tuple(some[id(rel)]), way, fr_label, to_label)
            if of[a, b] not in legs:
                df, _, (fr, frl, to, tol) = rel_scan(matcher.session, some[id(rel)], way)
                legs[of[a, b]] = df.filter((F.col(frl) == fr_label) & (F.col(tol) == to_label)).select(F.col(fr).alias("u"), F.col(to).alias("v"))
    if len({t for df in legs.values() for t in (df.schema["u"].dataType, df.schema["v"].dataType)}) > 1:
        return None
    sums, edges = edge_sums(legs)
    pairs = [max(0.0, float(sums[of[i, (i + 1) % 4]] @ sums[of[i, (i - 1) % 4]])) for i in range(4)]
    middle = 0 if pairs[0] + pairs[2] <= pairs[1] + pairs[3] else 1
    if pairs[middle] + pairs[middle + 2] > shares**2 * sum(edges[of[i, (i + 1) % 4]] for i in range(4)):
        return None
    name = [v for v, _, _ in found]
    ends = sorted(((middle + 1) % 4, (middle + 3) % 4))
    halves = []
    for at in (middle, middle + 2):  # alike if their legs are alike, so that Spark shuffles once
        cols = {name[i]: fresh("k") for i in (at, *ends)}
        same = fresh("k")
        one, two = (legs[of[at, e]].select(F.col("u").alias(c), F.col("v").alias(cols[name[e]])) for e, c in zip(ends, (cols[name[at]], same), strict=True))
        halves.append((tested(matcher, one.join(two, F.col(cols[name[at]]) == F.col(same)).drop(same), cols, labels), cols))
    (one, left), (two, right) = halves
    df = one.join(two, [F.col(left[name[e]]) == F.col(right[name[e]]) for e in ends])
    df = df.select(*(F.col({**right, **left}[v]).alias(keys[v]) for v in name))
    return tested(matcher, df, keys, labels)


def in_cells(matcher, found: list[tuple[str, A.RelPat, str]], labels: dict, some: dict, shares: int, keys: dict[str, str]) -> DataFrame | None:
    """The matches by the hypercube, or None if the ends' keys aren't of one type."""
    from graphloom.plans.matching import rel_scan

    k = len(found)
    frames, kinds = [], set()
    for i, (v, rel, direction) in enumerate(found):
        after = found[(i + 1) % k][0]
        df, _, (fr, fr_label, to, to_label) = rel_scan(matcher.session, some[id(rel)], direction)
        df = df.filter((F.col(fr_label) == labels[v][0]) & (F.col(to_label) == labels[after][0])).select(F.col(fr).alias("u"), F.col(to).alias("v"))
        kinds |= {df.schema["u"].dataType, df.schema["v"].dataType}
        mine, next_ = F.pmod(F.xxhash64("u"), F.lit(shares)), F.pmod(F.xxhash64("v"), F.lit(shares))
        cell = mine * shares**i + next_ * shares ** ((i + 1) % k)
        for j in range(k):
            if j not in (i, (i + 1) % k):
                axis = fresh("x")
                df = df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
                cell = cell + F.col(axis) * shares**j
        frames.append(df.select(cell.cast("long").alias("cell"), F.lit(i).alias("edge"), "u", "v"))
    if len(kinds) > 1:
        return None
    kind = next(iter(kinds)).simpleString()
    order = [keys[v] for v, _, _ in found]
    schema = ", ".join(f"{c} {kind}" for c in order)

    def local(table: pa.Table) -> pa.Table:
        edge = table.column("edge").to_numpy()
        codes, values = pd.factorize(pd.concat([table.column(c).to_pandas() for c in ("u", "v")], ignore_index=True))
        u, v = codes[: len(edge)].astype(np.int64), codes[len(edge) :].astype(np.int64)
        blocks = list(matches([(u[edge == i], v[edge == i]) for i in range(k)], max(1, len(values))))
        columns = [np.concatenate([b[i] for b in blocks]) if blocks else np.zeros(0, np.int64) for i in range(k)]
        return pa.table({name: pa.array(np.asarray(values)[c], table.column("u").type) for name, c in zip(order, columns, strict=True)})

    def union(some: list[DataFrame]) -> DataFrame:
        out = some[0]
        for df in some[1:]:
            out = out.unionByName(df)
        return out

    return union(frames).groupBy("cell").applyInArrow(local, schema)


def cycle(matcher, state: State, paths: list[A.Path], names: dict, labels: dict, some: dict) -> State | None:
    """The pattern's matches, or None if it isn't of this kind."""
    from graphloom.plans.matching import node_scan, same_key

    found = around(matcher, paths, names, labels, some) if matcher.unit(state) else None
    if found is None:
        return None
    k = len(found)
    session = matcher.session
    inline: dict[str, list] = {}
    for p in paths:
        for n in p.nodes:
            inline.setdefault(names[id(n)], []).append(n)
    shares = max(2, round((CELLS * int(session.spark.conf.get("spark.sql.shuffle.partitions"))) ** (1 / k)))
    keys = {v: fresh("k") for v, _, _ in found}
    df = paths_of_two(matcher, found, labels, some, shares, keys) if k == 4 else None
    if df is None:
        df = in_cells(matcher, found, labels, some, shares, keys)
    if df is None:
        return None
    state = State(df, {})
    for v, _, _ in found:
        label = fresh("t")
        state = state.with_(state.df.withColumn(label, F.lit(labels[v][0])), **{v: Binding("node", labels=labels[v], key=keys[v], label=label, scanned=False)})
    for v, _, _ in found:
        if any(matcher.wants(v, n) for n in inline[v]):
            nodes, b = node_scan(session, labels[v])
            state = state.with_(state.df.join(nodes, same_key(state.df, keys[v], nodes, b.key)), **{v: b})
        for n in inline[v]:
            state = matcher.inline(state, n, names)
    return state
