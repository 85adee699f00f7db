"""Cycles by cells against Spark's joins and against plain loops."""

import random
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.plans import cycles

TEXTS = [
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(c:P)-[:E]->(a) RETURN a.k AS a, b.k AS b, c.k AS c",
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(c:P), (a)-[:E]->(c) RETURN count(*) AS n, sum(b.v) AS s",
    "MATCH (a:P)-[:E]-(b:P)-[:E]-(c:P)-[:E]-(a) WHERE a.k < b.k AND b.k < c.k RETURN count(*) AS n",
    "MATCH (a:P {v: 1})-[:E]->(b:P)<-[:E]-(c:P)-[:E]->(d:P)<-[:E]-(a) RETURN a.k AS a, d.k AS d, count(*) AS n",
    "MATCH (a:P)-[:E]->(b), (b)-[:E]->(c), (c)-[:E]->(d), (d)-[:E]->(a) RETURN count(*) AS n",
]
JOINS = [
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(c:P) RETURN count(*) AS n, sum(a.v) + sum(c.v) AS s",
    "MATCH (a:P)-[e:E]->(b:P)-[:E]->(c:P)-[:E]->(a) RETURN sum(e.w) AS n",
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(a)-[:E]->(c:P) RETURN count(*) AS n, min(a.k + b.k + c.k) AS m",
    "MATCH (a:P)-[:E]->(b:P)-[:F]->(c:P)-[:E]->(a) RETURN count(*) AS n",
]


@pytest.fixture(params=["long", "string"])
def g(graph, spark, request):
    r = random.Random(5)
    graph.add_nodes("P", spark.createDataFrame([(i, i % 4) for i in range(30)], "k long, v long").selectExpr(f"CAST(k AS {request.param}) AS k", "v"), "k")
    edges = [(r.randrange(30), r.randrange(30), i) for i in range(150)] + [(0, i, 200 + i) for i in range(30)] + [(i, 0, 300 + i) for i in range(30)] + [(1, 2, 400), (1, 2, 401)]
    frame = spark.createDataFrame(edges, "a long, b long, w long").selectExpr(f"CAST(a AS {request.param}) AS a", f"CAST(b AS {request.param}) AS b", "w")
    graph.add_rels("E", frame, ("P", "a"), ("P", "b"), ["w"])
    return graph.add_rels("F", frame.filter("w % 2 = 0"), ("P", "a"), ("P", "b"), ["w"])


@pytest.mark.parametrize("text", [*TEXTS, *JOINS])
def test_cells_against_joins(g, text):
    df = g.query(text)
    assert ("FlatMapGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()) == (text in TEXTS)
    g.settings["enable_plan_optimizer"] = False
    assert sorted(map(repr, df.collect())) == sorted(map(repr, g.query(text).collect()))


pairs = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(pairs, min_size=3, max_size=4), st.sampled_from([1, 3, 1 << 18]))
def test_matches_against_loops(edges, block):
    k = len(edges)
    old, cycles.BLOCK = cycles.BLOCK, block
    try:
        arrays = [tuple(np.array([e[i] for e in some], np.int64) for i in (0, 1)) for some in edges]
        got = sorted(x for b in cycles.matches(arrays, 5) for x in zip(*(c.tolist() for c in b), strict=True))
    finally:
        cycles.BLOCK = old
    want = sorted(tuple(e[0] for e in chosen) for chosen in product(*edges) if all(chosen[i][1] == chosen[(i + 1) % k][0] for i in range(k)))
    assert got == want


BY_PATHS = [
    "MATCH (a:L)-[:H]->(p:R)<-[:H]-(b:L)-[:H]->(q:R)<-[:H]-(a) WHERE a.k < b.k AND p.k < q.k RETURN p.v AS v, count(*) AS n, sum(b.k - a.k) AS s",
    "MATCH (p:R)<-[:H]-(a:L)-[:H]->(q:R)<-[:H]-(b:L)-[:H]->(p) WHERE p.k <> q.k AND a.k + b.k > 9 AND b.v = 1 RETURN a.k AS a, b.k AS b, p.k AS p, q.k AS q",
    "MATCH (a:L)-[:H]->(p:R {v: 1})<-[:H]-(b:L)-[:H]->(q:R)<-[:H]-(a) RETURN count(*) AS n, min(a.k) AS m, max(q.k) AS x",
]


@pytest.mark.parametrize("text", BY_PATHS)
def test_cycles_of_four_without_copies(graph, spark, text):
    r = random.Random(3)
    for label, n in (("L", 90), ("R", 25)):
        graph.add_nodes(label, spark.createDataFrame([(i, i % 3) for i in range(n)], "k long, v long"), "k")
    edges = [(i, r.randrange(25), j) for i in range(90) for j in range(i % 4)] + [(4, 7, 10), (4, 7, 11), (5, 7, 12)]  # some twice
    graph.add_rels("H", spark.createDataFrame(edges, "a long, b long, w long"), ("L", "a"), ("R", "b"), ["a", "w"])
    df = graph.query(text)
    assert "FlatMapGroupsInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(repr, df.collect()))
    graph.settings["enable_plan_optimizer"] = False
    assert got == sorted(map(repr, graph.query(text).collect()))
