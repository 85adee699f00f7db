"""Versions of tables, snapshots, conflicts, folding, and what a change writes."""

import glob
import os
import random

import pytest

from graphloom.errors import CatalogError, RunError
from graphloom.session import GraphSession
from graphloom.storage import own_dir
from graphloom.versions import MOST_PARTS


@pytest.fixture
def g(spark):
    g = GraphSession(spark)
    g.script("CREATE NODE TABLE P(id INT64, v INT64, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P, w INT64)")
    g.query("UNWIND range(1, 6) AS x CREATE (:P {id: x, v: 0})")
    g.query("MATCH (a:P), (b:P) WHERE b.id = a.id + 1 CREATE (a)-[:K {w: a.id}]->(b)")
    return g


def nodes(g):
    return {r[0]: r[1] for r in g.query("MATCH (p:P) RETURN p.id, p.v").collect()}


def edges(g):
    return sorted(r[0] for r in g.query("MATCH (:P)-[k:K]->(:P) RETURN k.w").collect())


def written(spark):
    return sum(os.path.getsize(f) for f in glob.glob(own_dir(spark).removeprefix("file://") + "/**/*.parquet", recursive=True))


def test_a_change_writes_its_own_rows(spark):
    """One row of 200,000 that are stored in megabytes."""
    g = GraphSession(spark)
    big = spark.range(200_000).selectExpr("id", "uuid() AS s")
    g.query("CREATE NODE TABLE B(id INT64, s STRING, PRIMARY KEY(id))")
    g.add_object("big", big)
    g.query("COPY B FROM big")
    base = written(spark)
    assert base > 5_000_000
    for text in ("CREATE (:B {id: -1, s: 'x'})", "MATCH (b:B {id: 7}) SET b.s = 'y'", "MATCH (b:B {id: 8}) DELETE b", "MERGE (b:B {id: -2}) ON CREATE SET b.s = 'z'"):
        before = written(spark)
        g.query(text)
        assert 0 < written(spark) - before < 60_000, text
    assert g.query("MATCH (b:B) RETURN count(*)").first()[0] == 200_001
    assert {r[0]: r[1] for r in g.query("MATCH (b:B) WHERE b.id < 9 AND size(b.s) < 3 RETURN b.id, b.s").collect()} == {-1: "x", 7: "y", -2: "z"}


def test_the_last_row_sets(g):
    g.query("UNWIND [1, 2, 3, 4] AS x MATCH (p:P {id: 1}) SET p.v = x")
    g.query("MATCH (p:P {id: 2}) UNWIND [5, 9, 7] AS x UNWIND [x, x + 1] AS y SET p.v = y")
    g.query("UNWIND [3, 2, 1] AS x MATCH (:P)-[k:K]->(:P {id: 6}) SET k.w = x")
    assert nodes(g) == {1: 4, 2: 8, 3: 0, 4: 0, 5: 0, 6: 0} and edges(g) == [1, 1, 2, 3, 4]


def test_a_failed_statement_changes_nothing(g):
    with pytest.raises(RunError):
        g.query("CREATE (:P {id: 9}), (:P {id: 1})")
    assert len(nodes(g)) == 6 and g.own is None


def test_sessions_see_their_snapshot(g):
    other = g.connect()
    other.query("BEGIN TRANSACTION")
    g.query("MATCH (p:P {id: 1}) SET p.v = 5")
    assert nodes(other)[1] == 0 and nodes(g)[1] == 5
    other.query("MATCH (p:P {id: 2}) SET p.v = 6")
    assert nodes(g)[2] == 0
    other.query("COMMIT")
    assert nodes(g) == nodes(other) == {1: 5, 2: 6, 3: 0, 4: 0, 5: 0, 6: 0}
    lazy = g.query("MATCH (p:P) RETURN sum(p.v)")
    other.query("MATCH (p:P) SET p.v = 1")
    assert lazy.first()[0] == 11 and g.shared.log[-1][1] == [(("P",), 1, 1)]


@pytest.mark.parametrize(
    ("first", "second", "fails"),
    [
        ("MATCH (p:P {id: 1}) SET p.v = 1", "MATCH (p:P {id: 1}) SET p.v = 2", True),
        ("MATCH (p:P {id: 1}) SET p.v = 1", "MATCH (p:P {id: 2}) SET p.v = 2", False),
        ("CREATE (:P {id: 10})", "CREATE (:P {id: 10})", True),
        ("CREATE (:P {id: 10})", "CREATE (:P {id: 11})", False),
        ("MATCH (p:P {id: 3}) DETACH DELETE p", "MATCH (p:P {id: 3}) SET p.v = 1", True),
        ("MATCH (p:P {id: 1}) DETACH DELETE p", "MATCH (p:P {id: 6}) DETACH DELETE p", False),
        ("MATCH (p:P {id: 6}) DETACH DELETE p", "MATCH (a:P {id: 6}), (b:P {id: 1}) CREATE (a)-[:K {w: 9}]->(b)", True),
        ("MATCH (a:P {id: 6}), (b:P {id: 1}) CREATE (a)-[:K {w: 9}]->(b)", "MATCH (p:P {id: 6}) DETACH DELETE p", True),
        ("MATCH (:P {id: 1})-[k:K]->() SET k.w = 0", "MATCH (:P {id: 1})-[k:K]->() DELETE k", True),
        ("MATCH (:P {id: 1})-[k:K]->() SET k.w = 0", "MATCH (p:P {id: 1}) SET p.v = 0", False),
        ("ALTER TABLE P ADD x INT64", "MATCH (p:P {id: 1}) SET p.v = 2", True),
        ("ALTER TABLE P ADD x INT64", "MATCH (:P {id: 1})-[k:K]->() SET k.w = 0", False),
        ("CREATE NODE TABLE Q(id INT64, PRIMARY KEY(id))", "CREATE NODE TABLE Q(id INT64, PRIMARY KEY(id))", True),
        ("CREATE NODE TABLE Q(id INT64, PRIMARY KEY(id))", "CREATE NODE TABLE R(id INT64, PRIMARY KEY(id))", False),
    ],
)
def test_conflicts(g, first, second, fails):
    other = g.connect()
    g.query("BEGIN TRANSACTION")
    other.query("BEGIN TRANSACTION")
    g.query(first)
    other.query(second)
    g.query("COMMIT")
    if fails:
        with pytest.raises(RunError, match="conflict"):
            other.query("COMMIT")
        assert other.own is None and nodes(other) == nodes(g)
    else:
        other.query("COMMIT")
        once = GraphSession(g.spark)
        once.script("CREATE NODE TABLE P(id INT64, v INT64, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P, w INT64)")
        once.query("UNWIND range(1, 6) AS x CREATE (:P {id: x, v: 0})")
        once.query("MATCH (a:P), (b:P) WHERE b.id = a.id + 1 CREATE (a)-[:K {w: a.id}]->(b)")
        once.query(first)
        once.query(second)
        assert nodes(g) == nodes(once) and edges(g) == edges(once)


def test_rollback_and_errors(g):
    g.query("BEGIN TRANSACTION")
    g.query("MATCH (p:P) DETACH DELETE p")
    g.query("CREATE NODE TABLE Q(id INT64, PRIMARY KEY(id))")
    with pytest.raises(RunError):
        g.query("CHECKPOINT")
    with pytest.raises(RunError):
        g.connect().query("CHECKPOINT")
    g.query("ROLLBACK")
    assert len(nodes(g)) == 6 and edges(g) == [1, 2, 3, 4, 5]
    with pytest.raises(CatalogError):
        g.query("MATCH (q:Q) RETURN q")
    for text in ("COMMIT", "ROLLBACK"):
        with pytest.raises(RunError):
            g.query(text)


def test_folding_keeps_rows(g):
    r, want = random.Random(1), nodes(g)
    for i in range(MOST_PARTS // 2 + 3):
        key = r.randint(1, 8)
        if key in want and r.random() < 0.3:
            g.query("MATCH (p:P {id: $k}) DETACH DELETE p", {"k": key})
            del want[key]
        else:
            g.query("MERGE (p:P {id: $k}) SET p.v = $v", {"k": key, "v": i})
            want[key] = i
        assert len(g.main.nodes["P"].data.parts) <= MOST_PARTS
    assert nodes(g) == want
    g.query("CHECKPOINT")
    assert nodes(g) == want and not g.main.nodes["P"].data.parts


def test_an_edge_table_of_a_frame(spark):
    g = GraphSession(spark)
    g.add_nodes("P", spark.range(5).withColumnRenamed("id", "k"), "k")
    g.add_rels("E", spark.createDataFrame([(0, 1, 7), (1, 2, 8), (2, 3, 9)], "a long, b long, w long"), ("P", "a"), ("P", "b"))
    g.query("MATCH (:P {k: 1})-[e:E]->() DELETE e")
    g.query("MATCH (:P {k: 2})-[e:E]->() SET e.w = 1")
    g.query("MATCH (a:P {k: 3}), (b:P {k: 4}) CREATE (a)-[:E {w: 2}]->(b)")
    assert sorted(map(tuple, g.query("MATCH (a)-[e:E]->(b) RETURN a.k, e.w, b.k").collect())) == [(0, 7, 1), (2, 1, 3), (3, 2, 4)]
