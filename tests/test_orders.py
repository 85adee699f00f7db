"""Cycles over tables whose nodes have one edge are joined without the pairs of a node that many share."""

import re

import pytest

CLOSED = "MATCH (c:C)-[:LIVES]->(n:N)<-[:BASED]-(s:S), (c)-[:PLACED]->(o:O)-[:BY]->(s) RETURN n.w AS w, count(*) AS n, sum(c.v) AS v"
TEXTS = [
    CLOSED,
    "MATCH (c:C {v: 1})-[:LIVES]->(n:N)<-[:BASED]-(s:S)<-[:BY]-(o:O)<-[:PLACED]-(c) WHERE s.k > 3 RETURN c.k AS c, s.k AS s, o.k AS o",
    "MATCH (c:C)-[:LIVES]->(n:N)<-[:BASED]-(s:S), (c)-[:PLACED]->(o:O)-[b:BY]->(s {k: 7}) RETURN n.w AS w, sum(b.q) AS q",
    "MATCH (n:N) WHERE n.k < 2 MATCH (n)<-[:LIVES]-(c:C)-[:PLACED]->(o:O)-[:BY]->(s:S)-[:BASED]->(n) RETURN n.w AS w, count(*) AS n",
    "MATCH (c:C) OPTIONAL MATCH (c)-[:LIVES]->(n:N)<-[:BASED]-(s:S)<-[:BY]-(o:O)<-[:PLACED]-(c) RETURN c.k AS c, count(o.k) AS n",
]


@pytest.fixture
def g(graph, spark):
    nodes = {"C": "id AS c, id % 3 AS v, id % 2 AS n", "S": "id AS s, id % 2 AS n", "N": "id AS n, concat('w', id) AS w", "O": "id AS o, id % 40 AS c"}
    frames = {x: spark.range({"C": 40, "S": 30, "N": 3, "O": 120}[x]).selectExpr(*e.split(", ", 1 if x == "N" else -1)) for x, e in nodes.items()}
    for x, f in frames.items():
        graph.add_nodes(x, f.withColumnRenamed(x.lower(), "k").drop(*({"n", "c"} & set(f.columns) - {x.lower()})), "k")
    graph.add_rels("LIVES", frames["C"].select("c", "n"), ("C", "c"), ("N", "n"), ["c"])
    graph.add_rels("BASED", frames["S"].select("s", "n"), ("S", "s"), ("N", "n"), ["s"])
    graph.add_rels("PLACED", frames["O"].select("c", "o"), ("C", "c"), ("O", "o"), ["o"])
    lines = spark.range(500).selectExpr("id % 120 AS o", "id * 7 % 30 AS s", "id AS q")
    return graph.add_rels("BY", lines, ("O", "o"), ("S", "s"), ["q"])


@pytest.mark.parametrize("text", TEXTS)
def test_orders_against_the_text(g, text):
    got = sorted(map(repr, g.query(text).collect()))
    g.settings["enable_plan_optimizer"] = False
    assert got and got == sorted(map(repr, g.query(text).collect()))


def test_shared_nodes_are_not_paired(g):
    g.settings["enable_plan_optimizer"] = True
    plan = g.query(CLOSED)._jdf.queryExecution().optimizedPlan().toString()
    # left-deep: the first leaves are joined first, and the suppliers (30 rows) come after the lines (500)
    leaves = re.findall(r"Range \(0, (\d+)", plan)
    assert leaves.index("30") > leaves.index("500"), leaves
