"""Reading queries on the demo graph."""

import pytest

from graphloom.errors import BindError, ParseError


@pytest.fixture
def q(demo):
    return lambda text, **params: [tuple(r) for r in demo.query(text, params).collect()]


def test_match_filter_order_null_order(q):
    assert q("MATCH (u:User) WHERE u.age > 28 RETURN u.name, u.age ORDER BY u.age DESC") == [("Zhang", 50), ("Karissa", 40), ("Adam", 30)]
    assert q("UNWIND [2, NULL, 1] AS x RETURN x ORDER BY x") == [(1,), (2,), (None,)]
    assert q("UNWIND [2, NULL, 1] AS x RETURN x ORDER BY x DESC SKIP 1 LIMIT 1") == [(2,)]


def test_two_hops_and_implicit_groups(q):
    assert q("MATCH (a:User)-[:Follows]->(b:User)-[:LivesIn]->(c:City) RETURN c.name, count(*), min(a.age) ORDER BY c.name") == [("Guelph", 1, 50), ("Kitchener", 2, 30), ("Waterloo", 1, 30)]
    assert q("MATCH (a:User)-[e:Follows]->(b:User) RETURN sum(e.since) + 1 AS s, avg(b.age) AS m, collect(DISTINCT e.since)[1] IS NOT NULL AS c") == [(8084, 41.25, True)]
    assert q("MATCH (u:User) WHERE u.age > 100 RETURN count(*), sum(u.age), collect(u.name)") == [(0, None, None)]


def test_labels_and_directions(q):
    assert q("MATCH (a)-[r]->(b) RETURN label(a), label(r), label(b), count(*) AS n ORDER BY n, label(r)") == [("User", "Follows", "User", 4), ("User", "LivesIn", "City", 4)]
    assert q("MATCH (a:User {name: 'Zhang'})-[:Follows]-(b) RETURN b.name ORDER BY b.name") == [("Adam",), ("Karissa",), ("Noura",)]
    assert q("MATCH (a:User)<-[:Follows]-(b:User {name: 'Adam'}) RETURN a.name ORDER BY a.name") == [("Karissa",), ("Zhang",)]
    assert q("MATCH (n:User:City) RETURN n.age IS NULL AS c, count(*) ORDER BY c") == [(False, 4), (True, 3)]
    assert q("MATCH (c:City)-[:Follows]->(u) RETURN count(*)") == [(0,)]


def test_cycle_walks_reuse_edges(q):
    assert q("MATCH (a:User)-[:Follows]->(b:User)-[:Follows]->(c:User), (a)-[:Follows]->(c) RETURN a.name, b.name, c.name") == [("Adam", "Karissa", "Zhang")]
    assert q("MATCH (a:User {name:'Adam'})-[e:Follows*1..3]-(b:User {name:'Adam'}) RETURN count(*)") == [(4,)]


def test_optional_exists_count(q):
    assert q("MATCH (a:User) OPTIONAL MATCH (a)-[:Follows]->(b:User) WHERE b.age > 45 RETURN a.name, b.name ORDER BY a.name") == [("Adam", "Zhang"), ("Karissa", "Zhang"), ("Noura", None), ("Zhang", None)]
    assert q("MATCH (a:User) WHERE NOT EXISTS { MATCH (a)-[:Follows]->(b:User) WHERE b.age > a.age } RETURN a.name ORDER BY a.name") == [("Noura",), ("Zhang",)]
    assert q("MATCH (a:User) WHERE (a)-[:Follows]->(:User) RETURN count(*)") == [(3,)]
    assert q("MATCH (a:User) RETURN a.name, COUNT { MATCH (a)-[:Follows]->(:User) } AS k ORDER BY k DESC, a.name LIMIT 2") == [("Adam", 2), ("Karissa", 1)]
    assert q("OPTIONAL MATCH (a:User) WHERE a.age > 100 RETURN a.name") == [(None,)]


def test_with_union_distinct(q):
    assert q("MATCH (a:User)-[:Follows]->(b:User) WITH a, count(b) AS n WHERE n > 1 MATCH (a)-[:LivesIn]->(c) RETURN a.name, n, c.name") == [("Adam", 2, "Waterloo")]
    assert q("MATCH (a:User)-[:LivesIn]->(c) RETURN DISTINCT c.name ORDER BY c.name") == [("Guelph",), ("Kitchener",), ("Waterloo",)]
    assert sorted(q("RETURN 1 AS x UNION ALL RETURN 1 AS x")) == [(1,), (1,)]
    assert q("RETURN 1 AS x UNION RETURN 1 AS x") == [(1,)]
    with pytest.raises(BindError):
        q("RETURN 1 AS x UNION RETURN 1 AS x UNION ALL RETURN 2 AS x")
    with pytest.raises(BindError):
        q("RETURN 1 AS x UNION RETURN 'a' AS x")


def test_recursive_kinds(q):
    assert q("MATCH (a:User {name:'Adam'})-[e:Follows*1..3]->(b:User) RETURN b.name, length(e) AS n ORDER BY n, b.name") == [("Karissa", 1), ("Zhang", 1), ("Noura", 2), ("Zhang", 2), ("Noura", 3)]
    assert q("MATCH (a:User {name:'Adam'})-[e:Follows* SHORTEST 1..5]->(b:User) RETURN b.name, length(e) AS n ORDER BY b.name") == [("Karissa", 1), ("Noura", 2), ("Zhang", 1)]
    assert q("MATCH (a:User {name:'Adam'})-[e:Follows* TRAIL 1..4]-(b:User {name:'Adam'}) RETURN count(*)") == [(2,)]
    assert q("MATCH (a:User {name:'Adam'})-[e:Follows* ACYCLIC 1..2]->(b:User) RETURN count(*)") == [(4,)]
    assert q("MATCH p = (a:User {name:'Adam'})-[e:Follows*2..2]->(b:User {name:'Zhang'}) RETURN properties(nodes(p), 'name'), properties(rels(e), 'since'), is_trail(p), is_acyclic(p), length(p)") == [(["Adam", "Karissa", "Zhang"], [2020, 2021], True, True, 2)]
    assert q("MATCH (a:User {name:'Adam'})-[e:Follows*1..3 (r, n | WHERE r.since = 2020)]->(b) RETURN b.name ORDER BY b.name") == [("Karissa",), ("Zhang",)]
    assert q("MATCH (a:User {name:'Adam'})-[e:Follows*2..3 (r, n | WHERE n.age < 45)]->(b) RETURN b.name, length(e) ORDER BY b.name") == [("Zhang", 2)]
    assert q("MATCH (a:User {name:'Adam'})-[:Follows*0..1]->(b) RETURN b.name ORDER BY b.name") == [("Adam",), ("Karissa",), ("Zhang",)]
    with pytest.raises(BindError):
        q("MATCH (a:User)-[e*1..31]->(b) RETURN a")
    with pytest.raises(BindError):
        q("MATCH (a:User)-[e* SHORTEST 2..3]->(b) RETURN a")


def test_weighted(graph, spark):
    roads = [("A", "B", 50), ("A", "C", 50), ("A", "D", 100), ("B", "D", 40), ("C", "D", 40), ("C", "E", 80), ("D", "E", 30), ("D", "F", 80), ("E", "F", 40)]
    graph.add_nodes("Location", spark.createDataFrame([(x,) for x in "ABCDEF"], "name string"), "name")
    graph.add_rels("ROAD", spark.createDataFrame(roads, "a string, b string, cost long"), ("Location", "a"), ("Location", "b"), ["a", "b"])
    q = lambda text: [tuple(r) for r in graph.query(text).collect()]
    assert q("MATCH (a:Location {name:'A'})-[e:ROAD* WSHORTEST(cost)]->(b:Location) RETURN b.name, cost(e) ORDER BY b.name") == [("B", 50.0), ("C", 50.0), ("D", 90.0), ("E", 120.0), ("F", 160.0)]
    got = q("MATCH (a:Location {name:'A'})-[e:ROAD* ALL WSHORTEST(cost)]->(b:Location {name:'F'}) RETURN properties(nodes(e), 'name'), cost(e)")
    assert sorted(got) == [(["B", "D", "E"], 160.0), (["C", "D", "E"], 160.0)]
    assert q("MATCH (a:Location {name:'A'})-[e:ROAD* ALL SHORTEST]->(b:Location {name:'E'}) RETURN length(e)") == [(2,), (2,)]


def test_parameters_prepare_explain(demo, q):
    assert q("MATCH (u:User) WHERE u.age = $a RETURN u.name", a=40) == [("Karissa",)]
    p = demo.prepare("MATCH (u:User) WHERE u.age IN $l RETURN count(*) AS n")
    assert p.execute(l=[30, 40]).first()["n"] == 2
    assert p.execute(l=[1]).first()["n"] == 0
    assert "Filter" in demo.query("EXPLAIN MATCH (u:User) WHERE u.age > 3 RETURN u.name").first()["plan"]
    assert demo.query("PROFILE MATCH (u:User) RETURN u.name").first()["num_rows"] == 4


def test_errors(q):
    for bad in ("MATCH (a:Nobody) RETURN a", "MATCH (u:User) RETURN u.nothing", "RETURN x", "MATCH (u:User) RETURN u ORDER BY u", "RETURN sum(count(1))", "MATCH (u:User) RETURN u.name LIMIT u.age", "RETURN nofunction(1)", "UNWIND 3 AS x RETURN x", "MATCH (u:User) WITH u.name RETURN 1"):
        with pytest.raises(BindError):
            q(bad)
    for bad in ("RETURN 1 != 2", "RETURN 1 < 2 < 3", "MATCH (u:User", "FETCH 3", "MATCH (u:User) WITH u"):
        with pytest.raises(ParseError):
            q(bad)


def test_node_values(q):
    (row,) = q("MATCH (u:User {name:'Adam'})-[e:Follows]->(v {name:'Zhang'}) RETURN u, e, keys(u), id(u) = id(u)")
    assert row[0]["_LABEL"] == "User" and row[0]["age"] == 30 and row[1]["since"] == 2020 and row[2] == ["name", "age"] and row[3]
    assert q("MATCH (u:User {name:'Adam'})-[e:Follows]->(v {name:'Zhang'}) RETURN start_node(e).name, end_node(e).name") == [("Adam", "Zhang")]
    assert q("MATCH (a:User)-[e:Follows]->(b:User) RETURN a.*, b.name ORDER BY a.name, b.name LIMIT 1") == [("Adam", 30, "Karissa")]


@pytest.fixture
def line(graph, spark):
    """A line of 60 nodes and a star around its end."""
    graph.add_nodes("N", spark.range(100).selectExpr("id AS k", "id % 7 AS v"), "k")
    graph.add_nodes("M", spark.range(5).selectExpr("id AS k"), "k")
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(60, i) for i in range(61, 100)], "a long, b long")
    return graph.add_rels("E", edges, ("N", "a"), ("N", "b"), ["a", "b"])


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("MATCH (a:N {k: 7}) OPTIONAL MATCH (a)-[e:E*1..6]->(b) RETURN count(b)", [(6,)]),
        ("MATCH (a:N) WHERE a.k = 7 OPTIONAL MATCH (a)-[e:E*1..6]->(b) WHERE b.v > a.v RETURN count(b)", [(6,)]),
        ("MATCH (a:N) WHERE a.k = 6 AND EXISTS { MATCH (a)-[:E*1..6]->(b) WHERE b.v = 5 } RETURN a.k", [(6,)]),
        ("MATCH (a:N) WHERE a.k = 6 AND NOT EXISTS { MATCH (a)-[:E*1..6]->(b) WHERE b.v = 6 } RETURN a.k", [(6,)]),
        ("MATCH (a:N {k: 6}) RETURN COUNT { MATCH (a)-[:E*1..6]->(b) } AS n", [(6,)]),
        ("MATCH (a:N)-[e:E*1..6]->(b:N) WHERE a.k = 3 AND b.v <> 3 RETURN count(*)", [(6,)]),
        ("MATCH (a:N)-[e:E*1..6]->(b:N) WHERE b.k = 9 RETURN count(*)", [(6,)]),
        ("MATCH (a:N)-[e:E* SHORTEST 1..6]->(b:N) WHERE a.k IN [3] RETURN max(length(e))", [(6,)]),
        ("MATCH (a:M)-[:E*1..6]->(b) RETURN count(*)", [(0,)]),
        ("MATCH (a {k: 3}) OPTIONAL MATCH (a:M)-[:E*1..6]->(b) RETURN count(a), count(b)", [(2, 0)]),
    ],
)
def test_searches_begin_at_what_is_known(line, spark, monkeypatch, text, rows):
    """One row a level is written, not one for each node."""
    from graphloom.plans import paths

    written = []
    monkeypatch.setattr(paths, "staged", lambda df, f=paths.staged: written.append(f(df)) or written[-1])
    got = [tuple(r) for r in line.query(text).collect()]
    assert got == rows
    assert all(df.count() <= 5 for df in written if "s" in df.columns)


def test_exists_is_a_semi_join(line):
    plan = lambda text: line.query(text)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan("MATCH (a:N) WHERE EXISTS { MATCH (a)-[:E]->(b:N) WHERE b.v > a.v } RETURN a.k")
    assert "LeftAnti" in plan("MATCH (a:N) WHERE NOT (a)-[:E]->(:N) RETURN a.k")
    assert line.query("MATCH (a:N) WHERE NOT (a)-[:E]->(:N) RETURN count(*)").first()[0] == 39
    assert line.query("MATCH (a:N) WHERE (a)-[:E]->(:N) OR a.k = 99 RETURN count(*)").first()[0] == 62
    assert line.query("MATCH (a:N) WHERE NOT NOT EXISTS { MATCH (a)-[:E]->() } AND a.k > 50 RETURN count(*)").first()[0] == 10


@pytest.mark.parametrize(("text", "rows", "levels"), [("MATCH (a:N {k: 0})-[e:E*1..30]->(b:N) RETURN b.k LIMIT 3", 3, 3), ("MATCH (a:N {k: 0})-[e:E*4..30]->(b) RETURN b.k SKIP 1 LIMIT 1", 1, 5), ("MATCH (a:N {k: 0})-[e:E*1..9]->(b:N) RETURN count(*) LIMIT 1", 1, 9), ("MATCH (a:N {k: 0})-[e:E*1..9]->(b:N) RETURN b.k ORDER BY b.k DESC LIMIT 2", 2, 9), ("MATCH (a:N)-[e:E*1..9]->(b:N {k: 9}) RETURN a.k LIMIT 9", 9, 9), ("MATCH (a:N {k: 0})-[e:E*1..9]->(b:M) RETURN b.k LIMIT 2", 0, 9)])
def test_a_limit_ends_the_search(line, monkeypatch, text, rows, levels):
    from graphloom.plans import paths

    made = []
    monkeypatch.setattr(paths, "_step", lambda *a, f=paths._step: made.append(1) or f(*a))
    assert line.query(text).count() == rows and len(made) == levels
