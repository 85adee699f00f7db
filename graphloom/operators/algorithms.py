"""Graph algorithms as loops of joins. Edges are (src, dst) frames, nodes (id) frames; every round is written to a
table of the shared folder, so lineage stays short and rounds survive lost executors. The driver sees only counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import RunError
from graphloom.storage import settled, staged


def both_ways(edges: DataFrame) -> DataFrame:
    edges = edges.select("src", "dst").filter("src <> dst")
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def weakly_connected_components(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component): the least id that a node is connected to. Each round a node points to its least neighbour if that
    is less than itself, pointers are jumped to their roots, and the graph is contracted to the roots: of the nodes that
    still have edges at most half are left, so rounds and data shrink. The rounds' pointers are then put together from the
    smallest on. A caller's own cap of rounds raises if it is reached before."""
    return settled(lambda: _weak(nodes, edges, rounds))


def _weak(nodes: DataFrame, edges: DataFrame, rounds: int | None) -> DataFrame:
    edges = staged(both_ways(edges))
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        if rounds is not None and len(maps) >= rounds:
            raise RunError(f"connected components aren't complete after {rounds} rounds")
        top = staged(edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("root")))
        while True:
            far = top.select(F.col("id").alias("r"), F.col("root").alias("rr"))
            top = staged(top.join(far, F.col("root") == F.col("r")).select("id", F.col("rr").alias("root"), F.col("root").alias("old")))
            if top.filter("root <> old").isEmpty():
                break
        top = top.select("id", "root")
        maps.append(top)
        ends = edges.join(top.withColumnsRenamed({"id": "src", "root": "s"}), "src").join(top.withColumnsRenamed({"id": "dst", "root": "d"}), "dst")
        edges = staged(ends.filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct())
    found = None
    for top in reversed(maps):
        if found is not None:
            top = top.join(found.withColumnsRenamed({"id": "r", "root": "rr"}), F.col("root") == F.col("r"), "left").select("id", F.coalesce("rr", "root").alias("root"))
        found = staged(top)
    if found is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def strongly_connected_components(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component): forward-backward colouring. Each round nodes without in- or out-edges leave, and with them the
    chains that they begin or end, components of their own; of the others every node gets the least id that reaches it;
    from each colour's root the nodes of the colour that reach the root form a component and leave. Rounds go on until no
    node is left; a caller's own cap of rounds raises if it is reached before."""
    return settled(lambda: _strong(nodes, edges, rounds))


def _chains(left: DataFrame, arcs: DataFrame, end: str, other: str) -> DataFrame:
    """Nodes that aren't the `end` of an edge, and those of which the only such edge leads, by only edges, to one. Pointers
    along only edges are doubled, so a chain takes the logarithm of its length."""
    one = arcs.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("d"), F.min(other).alias("o"))
    known = left.join(one, "id", "left")
    to = staged(known.select("id", F.when(F.col("d") == 1, F.col("o")).otherwise(F.col("id")).alias("to"), F.col("d").isNull().alias("free")))
    for _ in range(max(1, to.count()).bit_length() + 1):  # a ring never ends
        far = to.select(F.col("id").alias("f"), F.col("to").alias("ft"), F.col("free").alias("ff"))
        to = staged(to.join(far, F.col("to") == F.col("f")).select("id", F.col("ft").alias("to"), F.col("ff").alias("free"), (F.col("to") != F.col("ft")).alias("moved")))
        if to.filter("moved").isEmpty():
            break
    return to.filter("free").select("id")


def _strong(nodes: DataFrame, edges: DataFrame, rounds: int | None) -> DataFrame:
    left = staged(nodes.select("id"))
    arcs = staged(edges.select("src", "dst").filter("src <> dst").distinct())
    done, count = None, 0
    while not left.isEmpty():
        if rounds is not None and count >= rounds:
            raise RunError(f"strongly connected components aren't complete after {rounds} rounds")
        count += 1
        lone = staged(_chains(left, arcs, "dst", "src").union(_chains(left, arcs, "src", "dst")).distinct())
        if not lone.isEmpty():
            found = lone.select("id", F.col("id").alias("component"))
            done = found if done is None else staged(done.unionByName(found))
            left = staged(left.join(lone, "id", "left_anti"))
            arcs = staged(arcs.join(lone.withColumnRenamed("id", "src"), "src", "left_anti").join(lone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
            continue
        colour = staged(left.withColumn("c", F.col("id")))
        while True:  # forward: the least ancestor
            near = arcs.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.min("c").alias("near"))
            new = staged(colour.join(near, F.col("id") == F.col("dst"), "left").select("id", F.least("c", F.coalesce("near", "c")).alias("c"), F.col("c").alias("old")))
            colour = new.select("id", "c")
            if new.filter("c <> old").isEmpty():
                break
        same = staged(arcs.join(colour.withColumnsRenamed({"id": "src", "c": "sc"}), "src").join(colour.withColumnsRenamed({"id": "dst", "c": "dc"}), "dst").filter("sc = dc").select("src", "dst", "sc"))
        reached = frontier = staged(colour.filter("id = c").select("id", "c"))
        while True:  # backward: what reaches the root within its colour
            step = same.join(frontier, (F.col("dst") == F.col("id")) & (F.col("sc") == F.col("c"))).select(F.col("src").alias("id"), "c").distinct()
            frontier = staged(step.join(reached, ["id", "c"], "left_anti"))
            if frontier.isEmpty():
                break
            reached = staged(reached.unionByName(frontier))
        found = reached.select("id", F.col("c").alias("component"))
        done = found if done is None else staged(done.unionByName(found))
        left = staged(left.join(found.select("id"), "id", "left_anti"))
        arcs = staged(arcs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return done if done is not None else nodes.select("id", F.col("id").alias("component"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank); ranks sum to 1, and what nodes without out-edges hold is dealt to all."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    arcs = staged(edges.select("src", "dst").join(degree, "src"))
    ranks = staged(nodes.select("id", F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        given = arcs.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        lost = ranks.join(degree, F.col("id") == F.col("src"), "left_anti").agg(F.sum("rank")).first()[0] or 0.0
        new = ranks.join(given, F.col("id") == F.col("dst"), "left").select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("given", F.lit(0.0)) + F.lit(lost / n))).alias("rank"), F.col("rank").alias("old"))
        new = staged(new)
        ranks = new.select("id", "rank")
        if (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    return ranks


def k_core(nodes: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """(id, k_degree): the largest k whose core holds the node; with k given, the nodes of that core alone. Nodes of the
    least degree leave together; of degree 1 with the whole paths that they end, found as components of the nodes of at
    most two edges."""
    return settled(lambda: _cores(nodes, edges, k))


def _cores(nodes: DataFrame, edges: DataFrame, k: int | None) -> DataFrame:
    arcs = staged(both_ways(edges))
    left, cores, level = staged(nodes.select("id")), None, 0
    while not left.isEmpty():
        degree = left.join(arcs.groupBy("src").agg(F.count(F.lit(1)).alias("d")), F.col("id") == F.col("src"), "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
        degree = staged(degree)
        gone = degree.filter(F.col("d") <= level).select("id")
        if gone.isEmpty():
            level = degree.agg(F.min("d")).first()[0]
            continue
        if level == 1:
            few = degree.filter("d <= 2")
            within = arcs.join(few.select(F.col("id").alias("src")), "src", "left_semi").join(few.select(F.col("id").alias("dst")), "dst", "left_semi")
            path = staged(weakly_connected_components(few.select("id"), within).join(few, "id"))
            gone = path.join(path.filter("d <= 1").select("component").distinct(), "component", "left_semi").select("id")
        found = gone.withColumn("k_degree", F.lit(level).cast("long"))
        cores = found if cores is None else staged(cores.unionByName(found))
        left = staged(left.join(gone, "id", "left_anti"))
        arcs = staged(arcs.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    if cores is None:
        cores = nodes.select("id", F.lit(0).cast("long").alias("k_degree"))
    return cores if k is None else cores.filter(F.col("k_degree") >= k)


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): each round a node takes the most frequent label near it, the least of equals."""
    arcs = staged(both_ways(edges))
    labels = staged(nodes.select("id", F.col("id").alias("community")))
    for _ in range(rounds):
        votes = arcs.join(labels, F.col("dst") == F.col("id")).groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("best"))
        new = staged(labels.join(best, F.col("id") == F.col("src"), "left").select("id", F.coalesce("best", "community").alias("community"), F.col("community").alias("old")))
        labels = new.select("id", "community")
        if new.filter("community <> old").isEmpty():
            break
    return labels


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 10, phases: int = 10) -> DataFrame:
    """(id, louvain_id): phases of local moves by modularity gain, then communities become nodes. Half of the nodes,
    by hash and round, move at a time, so that two neighbours don't swap for ever."""
    members = staged(nodes.select("id", F.col("id").alias("louvain_id")))
    arcs = edges.select("src", "dst").filter("src <> dst")
    arcs = staged(arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    total = arcs.agg(F.sum("w")).first()[0]
    if not total:
        return members
    for _ in range(phases):
        degree = staged(arcs.groupBy("src").agg(F.sum("w").alias("deg")))
        comm = staged(degree.select(F.col("src").alias("v"), F.col("src").alias("c"), "deg"))
        moved = False
        for r in range(rounds):
            sums = comm.groupBy("c").agg(F.sum("deg").alias("tot"))
            into = arcs.filter("src <> dst").join(comm.select(F.col("v").alias("dst"), F.col("c").alias("to")), "dst").groupBy(F.col("src").alias("v"), "to").agg(F.sum("w").alias("k"))
            stay = into.select("v", F.col("to").alias("c"), F.col("k").alias("k0"))
            options = into.join(comm, "v").join(sums.withColumnsRenamed({"c": "to", "tot": "tot_to"}), "to").join(sums, "c").join(stay, ["v", "c"], "left")
            gain = (F.col("k") - F.coalesce("k0", F.lit(0.0))) - F.col("deg") * (F.col("tot_to") - (F.col("tot") - F.col("deg"))) / total
            best = options.filter(F.col("to") != F.col("c")).withColumn("gain", gain).filter("gain > 1e-9").groupBy("v").agg(F.min_by("to", F.struct(-F.col("gain"), F.col("to"))).alias("best"))
            best = best.filter(F.pmod(F.xxhash64("v", F.lit(r)), F.lit(2)) == 0)
            new = staged(comm.join(best, "v", "left").select("v", F.coalesce("best", "c").alias("c"), "deg", F.col("c").alias("old")))
            comm = new.select("v", "c", "deg")
            changed = not new.filter("c <> old").isEmpty()
            moved = moved or changed
            if not changed and r:
                break
        if not moved:
            break
        names = comm.groupBy("c").agg(F.min("v").alias("name"))
        comm = staged(comm.join(names, "c").select("v", F.col("name").alias("c")))
        members = staged(members.join(comm, F.col("louvain_id") == F.col("v"), "left").select("id", F.coalesce("c", "louvain_id").alias("louvain_id")))
        arcs = staged(arcs.join(comm.withColumnsRenamed({"v": "src", "c": "sc"}), "src").join(comm.withColumnsRenamed({"v": "dst", "c": "dc"}), "dst").groupBy(F.col("sc").alias("src"), F.col("dc").alias("dst")).agg(F.sum("w").alias("w")))
    return members


def shortest_path(edges: DataFrame, source, target, most: int = 30) -> list:
    """Ids of one shortest path without regard to direction, [] if there is none. Levels are frames; only the path
    itself, at most `most` ids, comes to the driver."""
    if source == target:
        return [source]
    arcs = staged(both_ways(edges))
    spark = edges.sparkSession
    kind = arcs.schema["src"].dataType
    seen = frontier = spark.createDataFrame([(source,)], "id " + kind.simpleString()).withColumn("parent", F.lit(None).cast(kind))
    levels = [frontier]
    for _ in range(most):
        step = frontier.select(F.col("id").alias("src")).join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = staged(step.join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            return []
        levels.append(frontier)
        if not frontier.filter(F.col("id") == F.lit(target)).isEmpty():
            path = [target]
            for level in reversed(levels[1:]):
                path.append(level.filter(F.col("id") == F.lit(path[-1])).first()["parent"])
            return path[::-1]
        seen = staged(seen.unionByName(frontier))
    return []


def degree_centrality(nodes: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """(id, in_degree, out_degree, degree, centrality): degree over the count of other nodes."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    n = nodes.agg((F.count(F.lit(1)) - 1).alias("others"))
    df = nodes.select("id").join(into, "id", "left").join(out, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    total = {"in": F.col("in_degree"), "out": F.col("out_degree"), "both": F.col("in_degree") + F.col("out_degree")}[direction]
    return df.crossJoin(F.broadcast(n)).select("id", "in_degree", "out_degree", total.alias("degree"), F.when(F.col("others") > 0, total / F.col("others")).otherwise(0.0).alias("centrality"))


def node_similarity(edges: DataFrame, metric: str = "jaccard", least: float = 0.0) -> DataFrame:
    """(a, b, similarity) of nodes with a common neighbour, a < b; overlap divides by the smaller set. Common
    neighbours are counted by pairs that meet at them, never by all pairs of nodes."""
    arcs = both_ways(edges)
    size = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    pairs = arcs.select(F.col("src").alias("a"), "dst").join(arcs.select(F.col("src").alias("b"), "dst"), "dst").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    df = pairs.join(size.withColumnsRenamed({"src": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"src": "b", "n": "nb"}), "b")
    value = F.col("k") / (F.col("na") + F.col("nb") - F.col("k")) if metric == "jaccard" else F.col("k") / F.least("na", "nb")
    return df.select("a", "b", value.alias("similarity")).filter(F.col("similarity") >= least)
