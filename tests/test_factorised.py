"""Aggregates by weights against the joins' plan."""

import random

import pytest

QUERIES = [
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(c:P)-[:F]->(q:Q) RETURN count(*) AS n",
    "MATCH (a:P)-[:E]->(b:P)-[:E]-(c:P) WHERE c.v > 1 RETURN b.v AS v, count(*) AS n, sum(b.k) AS s, min(b.k) AS m, avg(b.k) AS a, count(b.v) AS c, count(DISTINCT b.k) AS d ORDER BY v",
    "MATCH (a:P)-[x:E]->(b:P)<-[y:E]-(c) WHERE x.w > 3 AND y.w < 7 AND a.v = 1 RETURN c, count(*) AS n, count(c) AS m",
    "MATCH (a)-[:E|F]->(b)-[:F]->(q {v: 1}) RETURN count(*) AS n",
    "MATCH (a:P)-[:E]->(b:P), (b)-[:E]->(c:P), (b)-[:F]->(q) RETURN sum(b.v) AS s, count(*) + 1 AS n, max(b.v) AS m",
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(c:P) WHERE b.k > 1000 RETURN count(*) AS n, sum(b.v) AS s",
    "MATCH (a)-[:F]-(b)-[:E]-(c) RETURN label(b) AS l, count(*) AS n",
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(c:P) WITH b, count(*) AS n WHERE n > 20 RETURN b.k AS k, n",
]
JOINS = [
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(a) RETURN count(*) AS n",
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(c:P) WHERE a.v < c.v RETURN count(*) AS n",
    "MATCH (a:P)-[:E]->(b:P)-[e:E]->(c:P) RETURN sum(e.w) AS n",
    "MATCH (a:P)-[:E]->(b:P)-[:E]->(c:P) RETURN a.v AS x, c.v AS y, count(*) AS n",
]


@pytest.fixture
def g(graph, spark):
    r = random.Random(1)
    graph.add_nodes("P", spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(40)], "k long, v long"), "k")
    graph.add_nodes("Q", spark.createDataFrame([(i, i % 3) for i in range(20)], "k long, v long"), "k")
    edges = sorted({(r.randrange(40), r.randrange(40)) for _ in range(150)})
    graph.add_rels("E", spark.createDataFrame([(a, b, a * b % 9) for a, b in edges], "a long, b long, w long"), ("P", "a"), ("P", "b"), ["a", "b"])
    graph.add_rels("F", spark.createDataFrame([(r.randrange(40), r.randrange(20)) for _ in range(60)], "a long, b long"), ("P", "a"), ("Q", "b"))
    return graph


@pytest.mark.parametrize("text", [*QUERIES, *JOINS])
def test_weights_against_joins(g, text):
    df = g.query(text)
    joins = df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    g.settings["enable_plan_optimizer"] = False
    plain = g.query(text)
    assert sorted(map(repr, df.collect())) == sorted(map(repr, plain.collect()))
    before = plain._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert joins > before if text in QUERIES else joins == before


def test_a_product_that_is_never_made(graph, spark):
    """10^15 matches of 1,000 edges a step."""
    graph.add_nodes("A", spark.range(10).withColumnRenamed("id", "k"), "k")
    graph.add_rels("R", spark.range(1000).selectExpr("id", "id % 10 AS a", "id div 100 AS b"), ("A", "a"), ("A", "b"), ["id"])
    got = graph.query("MATCH (a:A)-[:R]->()-[:R]->()-[:R]->()-[:R]->()-[:R]->()-[:R]->(g:A) RETURN count(*)").first()[0]
    assert got == 10 * 100**6
