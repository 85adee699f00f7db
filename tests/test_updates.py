"""DDL, DML, bulk load, transactions, catalogue calls, projected graphs, search, the Python API."""

import numpy as np
import pandas as pd
import pytest

from graphloom.api import AuditedDatabase, AuditLog, Database, DataExporter, GraphAlgorithms, VectorIndex
from graphloom.errors import BindError, CatalogError, ParseError, RunError


@pytest.fixture
def people(graph):
    graph.script("CREATE NODE TABLE P(id INT64, name STRING DEFAULT 'x', tags STRING[], PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P, w INT64)")
    return graph


def test_create_set_delete(people, run):
    run("CREATE (a:P {id: 1, name: 'a'})-[:K {w: 3}]->(b:P {id: 2})")
    assert run("MATCH (a:P)-[k:K]->(b:P) RETURN a.name, k.w, b.name") == [("a", 3, "x")]
    run("MATCH (a:P {id: 1}), (b:P {id: 2}) CREATE (b)-[:K {w: 4}]->(a)")
    assert run("MATCH (a:P)-[k:K]->(b:P) RETURN sum(k.w)") == [(7,)]
    assert run("MATCH (a:P {id: 1}) SET a.name = a.name + '!', a.tags = ['t'] RETURN a.name, a.tags") == [("a!", ["t"])]
    run("MATCH (:P)-[k:K]->(:P {id: 1}) SET k.w = k.w * 10")
    assert run("MATCH ()-[k:K]->() RETURN k.w ORDER BY k.w") == [(3,), (40,)]
    with pytest.raises(RunError):
        run("MATCH (a:P {id: 1}) DELETE a")
    with pytest.raises(RunError):
        run("CREATE (a:P {id: 1})")
    with pytest.raises(BindError):
        run("MATCH (a:P) SET a.id = 3")
    run("MATCH (:P {id: 1})-[k:K]->() DELETE k")
    run("MATCH (a:P {id: 1}) DETACH DELETE a")
    assert run("MATCH (a:P) RETURN a.id") == [(2,)] and run("MATCH ()-[k:K]->() RETURN count(*)") == [(0,)]


def test_merge(people, run):
    run("UNWIND [1, 1, 2] AS x MERGE (a:P {id: x}) ON CREATE SET a.name = 'new' ON MATCH SET a.name = 'old'")
    assert run("MATCH (a:P) RETURN a.id, a.name ORDER BY a.id") == [(1, "old"), (2, "new")]
    run("MATCH (a:P {id: 1}), (b:P {id: 2}) MERGE (a)-[k:K {w: 1}]->(b)")
    run("MATCH (a:P {id: 1}), (b:P {id: 2}) MERGE (a)-[k:K {w: 1}]->(b)")
    assert run("MATCH ()-[k:K]->() RETURN count(*)") == [(1,)]


def test_ddl(people, run):
    run("ALTER TABLE P ADD age INT32 DEFAULT 7")
    run("CREATE (:P {id: 1}), (:P {id: 2, age: 9})")
    assert run("MATCH (p:P) RETURN p.age ORDER BY p.age") == [(7,), (9,)]
    run("ALTER TABLE P RENAME age TO years")
    run("ALTER TABLE P RENAME TO Person")
    assert run("MATCH (p:Person)-[k:K]->() RETURN count(*)") == [(0,)]
    assert [r[1] for r in run("CALL table_info('Person') RETURN *")] == ["id", "name", "tags", "years"]
    run("ALTER TABLE Person DROP years")
    with pytest.raises(BindError):
        run("ALTER TABLE Person DROP id")
    with pytest.raises(BindError):
        run("DROP TABLE Person")
    run("COMMENT ON TABLE Person IS 'people'")
    assert run("CALL show_tables() WHERE type = 'NODE' RETURN name, comment") == [("Person", "people")]
    run("DROP TABLE K")
    run("DROP TABLE IF EXISTS K")
    run("CREATE NODE TABLE IF NOT EXISTS Person(id INT64 PRIMARY KEY)")
    for bad in ("CREATE NODE TABLE Q(a INT64)", "CREATE NODE TABLE Q(a BOOL, PRIMARY KEY(a))", "CREATE NODE TABLE Q(a INT64, a INT64, PRIMARY KEY(a))", "CREATE NODE TABLE Person(a INT64 PRIMARY KEY)", "CREATE NODE TABLE Q(a NOTYPE PRIMARY KEY)"):
        with pytest.raises(BindError):
            run(bad)
    with pytest.raises(ParseError):
        run("CREATE NODE Q")


def test_sequences_macros_types_settings(people, run):
    run("CREATE SEQUENCE s START 5 INCREMENT 2")
    assert run("RETURN nextval('s') AS a, nextval('s') AS b, currval('s') AS c") == [(5, 7, 7)]
    run("CREATE NODE TABLE S(id SERIAL, v INT64, PRIMARY KEY(id))")
    run("UNWIND [10, 20] AS x CREATE (:S {v: x})")
    run("CREATE (:S {v: 30})")
    assert run("MATCH (s:S) RETURN s.id ORDER BY s.id") == [(0,), (1,), (2,)]
    run("CREATE MACRO addto(a, b := 10) AS a + b")
    assert run("RETURN addto(1), addto(1, 2), addto(1, b := 3)") == [(11, 3, 4)]
    run("CREATE TYPE money AS DECIMAL(10, 2)")
    run("CREATE NODE TABLE M(id INT64, m money, st STRUCT(a INT64, b STRING), mp MAP(STRING, INT64), u UNION(a INT64, b STRING), ar INT64[2], PRIMARY KEY(id))")
    run("CREATE (:M {id: 1, m: 1.255, ar: [1, 2]})")
    assert str(run("MATCH (m:M) RETURN m.m")[0][0]) in ("1.26", "1.25")
    with pytest.raises(Exception):  # noqa: B017
        run("CREATE (:M {id: 2, ar: [1]})")
    run("CALL var_length_extend_max_depth = 3")
    assert run("CALL current_setting('var_length_extend_max_depth') RETURN *") == [("3",)]
    with pytest.raises(BindError):
        run("CALL no_such_thing = 3")


def test_copy(people, run, tmp_path, graph):
    (tmp_path / "p.csv").write_text('id|name|tags\n1|"a|b"|[x,y]\n2||[]\n')
    run(f"COPY P FROM '{tmp_path}/p.csv'")
    assert run("MATCH (p:P) RETURN p.id, p.name, p.tags ORDER BY p.id") == [(1, "a|b", ["x", "y"]), (2, None, [])]
    (tmp_path / "k.csv").write_text("1,2,5\n1,9,6\n")
    with pytest.raises(RunError):
        run(f"COPY K FROM '{tmp_path}/k.csv'")
    run(f"COPY K FROM '{tmp_path}/k.csv' (IGNORE_ERRORS=true)")
    assert run("MATCH ()-[k:K]->() RETURN k.w") == [(5,)]
    assert any("9" in r[0] for r in run("CALL show_warnings() RETURN message"))
    run(f"COPY (MATCH (p:P) RETURN p.id AS id, p.tags AS tags) TO '{tmp_path}/out.csv' (HEADER=true)")
    run(f"COPY (MATCH (p:P) RETURN p.id AS id, p.tags AS tags) TO '{tmp_path}/out.parquet'")
    assert run(f"LOAD FROM '{tmp_path}/out.parquet' WHERE id = 1 RETURN id, tags") == [(1, ["x", "y"])]
    assert sorted(run(f"LOAD WITH HEADERS (id INT64, tags STRING[]) FROM '{tmp_path}/out.csv' (HEADER=true) RETURN *")) == [(1, ["x", "y"]), (2, [])]
    np.save(tmp_path / "a.npy", np.arange(3))
    np.save(tmp_path / "b.npy", np.array([1.5, 2.5, 3.5]))
    assert sorted(run(f"LOAD FROM ['{tmp_path}/a.npy', '{tmp_path}/b.npy'] RETURN *")) == [(0, 1.5), (1, 2.5), (2, 3.5)]
    (tmp_path / "j.json").write_text('[{"a": 1}, {"a": 2}]')
    assert run(f"LOAD FROM '{tmp_path}/j.json' RETURN sum(a)") == [(3,)]
    graph.add_object("things", pd.DataFrame({"id": [7], "name": ["t"]}))
    run("COPY P(id, name) FROM things")
    run("COPY P(id, name) FROM (UNWIND [8] AS x RETURN x, 'u')")
    assert run("MATCH (p:P) RETURN count(*)") == [(4,)]
    run("CREATE NODE TABLE Q AS MATCH (p:P) RETURN p.id AS id, p.name AS n")
    assert run("MATCH (q:Q {id: 7}) RETURN q.n") == [("t",)]


def test_transactions_export_graphs(people, run, tmp_path, spark):
    run("CREATE (:P {id: 1})-[:K {w: 1}]->(:P {id: 2})")
    run("BEGIN TRANSACTION")
    run("CREATE (:P {id: 3})")
    run("ROLLBACK")
    assert run("MATCH (p:P) RETURN count(*)") == [(2,)]
    run("BEGIN TRANSACTION READ ONLY")
    with pytest.raises(BindError):
        run("CREATE (:P {id: 3})")
    run("COMMIT")
    run(f"EXPORT DATABASE '{tmp_path}/db'")
    from graphloom.session import GraphSession

    other = GraphSession(spark)
    other.query(f"IMPORT DATABASE '{tmp_path}/db'")
    assert [tuple(r) for r in other.query("MATCH (a:P)-[k:K]->(b:P) RETURN a.id, k.w, b.id").collect()] == [(1, 1, 2)]
    run(f"ATTACH '{tmp_path}/db' AS d")
    assert run("LOAD FROM d.P RETURN count(*)") == [(2,)]
    run("CREATE GRAPH g ANY")
    run("USE GRAPH g")
    run("CREATE (:_nodes {label: 'X', data: '{}'})")
    assert run("MATCH (n:_nodes) RETURN n.label") == [("X",)]
    run("USE GRAPH main")
    run("DETACH d")
    assert run("MATCH (p:P) RETURN count(*)") == [(2,)]


def test_projected_graphs(demo, run):
    demo.query("CALL project_graph('G', ['User'], ['Follows'])")
    assert {r[2] for r in run("CALL wcc('G') RETURN label, node, group_id")} == {"Adam"}
    assert sorted(r[0] for r in run("CALL k_core_decomposition('G') RETURN k_degree")) == [1, 2, 2, 2]
    ranks = dict(run("CALL page_rank('G') RETURN node, rank"))
    assert abs(sum(ranks.values()) - 1) < 1e-6 and max(ranks, key=ranks.get) == "Noura"
    assert len({r[0] for r in run("CALL scc('G') RETURN group_id")}) == 4
    demo.query("CALL project_graph_cypher('C', 'MATCH (a:User)-[e:Follows]->(b:User) RETURN a, e, b')")
    assert len(run("CALL wcc('C') RETURN *")) == 4
    assert run("CALL show_projected_graphs() RETURN name ORDER BY name") == [("C",), ("G",)]
    demo.query("CALL drop_projected_graph('G')")
    with pytest.raises(RunError):
        run("CALL wcc('G') RETURN *")


def test_search(graph, run, spark):
    graph.add_nodes("D", spark.createDataFrame([(1, "graphs and trees", [1.0, 0.0]), (2, "running graphs", [0.0, 1.0]), (3, "nothing", [0.6, 0.8])], "id long, t string, v array<double>"), "id")
    graph.query("CALL create_fts_index('D', 'f', ['t'])")
    assert [r[0] for r in run("CALL query_fts_index('D', 'f', 'graph trees') RETURN node.id, score ORDER BY score DESC")] == [1, 2]
    graph.query("CALL create_vector_index('D', 'v', 'v', metric := 'l2')")
    assert [r[0] for r in run("CALL query_vector_index('D', 'v', [0.0, 1.0], 2) RETURN node.id, distance ORDER BY distance")] == [2, 3]
    with pytest.raises(BindError):
        graph.query("CALL query_vector_index('D', 'w', [0.0, 1.0], 2)")
    graph.add_function("twice", lambda s: s * 2, "long", vectorized=False)
    assert run("RETURN twice(4) AS x") == [(8,)]


def test_python_api(spark, tmp_path):
    db = AuditedDatabase(spark, actor="me")
    db.create_node_table("N", {"id": "INT64", "t": "STRING"}, "id")
    db.create_edge_table("E", "N", "N", {"w": "INT64"})
    for i in range(3):
        db.create_node("N", {"id": i, "t": f"node {i}"})
    db.create_edge("E", 0, 1, {"w": 5})
    assert db.update_node("N", 2, {"t": "two"}) and db.get_node("N", 2) == {"id": 2, "t": "two"} and db.get_node("N", 9) is None
    assert db.get_edges("N", 1)[0]["properties"] == {"w": 5}
    assert [r["id"] for r in db.search("NODE", ["N"])] == [0, 1]
    assert db.delete_node("N", 2) and len(db.get_nodes_by_type("N")) == 2
    assert [r["action"] for r in db.log.get_history("N:2")] == ["delete_node", "update_node", "create_node"]
    assert db.log.count() == 6 and isinstance(db.log, AuditLog)
    a = GraphAlgorithms(db)
    assert a.shortest_path("N", "E", 0, 1) == [0, 1]
    assert {r["id"]: r["degree"] for r in a.degree_centrality("N", "E").collect()} == {0: 1, 1: 1}
    assert len({r["louvain_id"] for r in a.louvain("N", "E").collect()}) == 1
    DataExporter(db).to_parquet("N", f"{tmp_path}/n.parquet")
    DataExporter(db).query_to_csv("MATCH (n:N) RETURN n.id AS id", f"{tmp_path}/n.csv")
    db.begin_transaction()
    db.delete_edge("E", 0, 1)
    db.rollback()
    assert len(db.get_canvas_data()["edges"]) == 1 and db.query_df("MATCH (n:N) RETURN count(*) AS c").c[0] == 2 and db.query_arrow("RETURN 1 AS x").num_rows == 1
    assert VectorIndex(db).list_indices() == [] and isinstance(db, Database)
    with pytest.raises(CatalogError):
        db.get_node("Nope", 1)


def test_stream(graph, run, spark, tmp_path):
    from graphloom.streaming.ingest import copy_stream

    run("CREATE NODE TABLE V(id INT64, x STRING, PRIMARY KEY(id))")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, x string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, x string").parquet(f"{tmp_path}/in")
    copy_stream(graph, "V", stream, f"{tmp_path}/cp").awaitTermination()
    assert run("MATCH (v:V) RETURN v.id ORDER BY v.id") == [(1,), (2,)]


def test_a_batch_of_edges_that_runs_again_adds_nothing(graph, run, spark, tmp_path):
    from graphloom.errors import BindError
    from graphloom.streaming.ingest import copy_stream

    graph.script("CREATE NODE TABLE V(id INT64, PRIMARY KEY(id)); CREATE NODE TABLE W(id INT64, PRIMARY KEY(id)); CREATE REL TABLE E(FROM V TO V, FROM V TO W, w INT64)")
    run("CREATE (:V {id: 1}), (:V {id: 2}), (:W {id: 1})")
    for i, rows in enumerate(([(1, 1, 5), (2, 1, 6)], [(2, 1, 7), (9, 1, 8)])):
        spark.createDataFrame(rows, "a long, b long, w long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("a long, b long, w long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    with pytest.raises(BindError):
        copy_stream(graph, "E", stream, f"{tmp_path}/cp")
    run("BEGIN TRANSACTION")
    copy_stream(graph, "E", stream, f"{tmp_path}/cp", pair=("V", "W")).awaitTermination()
    assert run("MATCH ()-[e:E]->() RETURN count(*)") == [(0,)]
    run("COMMIT")
    assert run("MATCH (v:V)-[e:E]->(w:W) RETURN v.id, w.id, e.w ORDER BY e.w") == [(1, 1, 5), (2, 1, 6), (2, 1, 7)]
    for commit in (tmp_path / "cp" / "commits").glob("*1*"):  # Spark lost the note that batch 1 was done
        commit.unlink()
    copy_stream(graph, "E", stream, f"{tmp_path}/cp", pair=("V", "W")).awaitTermination()
    assert run("MATCH ()-[e:E]->() RETURN count(*)") == [(3,)]


def test_components_run_to_their_end(spark):
    import random

    from graphloom.operators import algorithms as al

    order = list(range(300))
    random.Random(2).shuffle(order)
    chains = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299) if i != 150], "src long, dst long")
    found = {r["id"]: r["component"] for r in al.weakly_connected_components(spark.range(301), chains).collect()}
    assert found == {x: min(order[:151]) for x in order[:151]} | {x: min(order[151:]) for x in order[151:]} | {300: 300}
    with pytest.raises(RunError):
        al.weakly_connected_components(spark.range(301), chains, 1)


def test_settled_removes_its_own_tables_alone(spark):
    import threading

    from graphloom import storage

    inside, go = threading.Event(), threading.Event()
    kept = {}

    def other():
        inside.wait()
        kept["other"] = storage.staged(spark.range(4))
        go.set()

    def make():
        first = kept["first"] = storage.staged(spark.range(3))
        inside.set()
        go.wait()
        return storage.settled(lambda: storage.staged(first))

    thread = threading.Thread(target=other)
    thread.start()
    assert storage.settled(make).count() == 3
    thread.join()
    assert kept["other"].count() == 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(kept["first"].inputFiles()[0]).count()


def test_algorithms_against_small_graphs(spark):
    from graphloom.operators import algorithms as al

    nodes = spark.range(7)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3)], "src long, dst long")
    rows = lambda df: {r[0]: r[1] for r in df.collect()}
    assert rows(al.weakly_connected_components(nodes, edges)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6}
    assert rows(al.strongly_connected_components(nodes, edges)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    assert rows(al.k_core(nodes, edges)) == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 0, 6: 0}
    two = spark.createDataFrame([(a, b) for base in (0, 4) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 4)], "src long, dst long")
    found = rows(al.louvain(spark.range(8), two))
    assert len(set(found.values())) == 2 and len({found[i] for i in range(4)}) == 1
    sim = {(r["a"], r["b"]): r["similarity"] for r in al.node_similarity(edges).collect()}
    assert sim[(0, 1)] == pytest.approx(1 / 3)
    assert al.shortest_path(edges, 0, 4) == [0, 2, 3, 4] and al.shortest_path(edges, 0, 6) == []


def test_strong_components_lose_no_node(spark):
    from graphloom.errors import RunError
    from graphloom.operators import algorithms as al

    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(300, 301), (301, 302), (302, 300), (302, 303)], "src long, dst long")
    assert {r["id"]: r["component"] for r in al.strongly_connected_components(spark.range(304), chain, 2).collect()} == {i: min(i, 300) if i < 303 else i for i in range(304)}
    with pytest.raises(RunError):
        al.strongly_connected_components(spark.range(304), chain, 1)
    cores = {r["id"]: r["k_degree"] for r in al.k_core(spark.range(304), chain).collect()}
    assert cores == {i: 2 if i in (300, 301, 302) else 1 for i in range(304)}
    deep = spark.createDataFrame([(i, j) for i in range(6) for j in range(i + 1, 6)] + [(5, 6), (6, 7), (7, 6)], "src long, dst long")
    assert {r["id"]: r["component"] for r in al.strongly_connected_components(spark.range(8), deep).collect()} == {i: min(i, 6) for i in range(8)}


def test_history_is_whole(spark):
    """More entries of a target than the default limit of a query, newest first."""
    log = AuditLog(Database(spark))
    table = log.db.session.catalog.node(AuditLog.TABLE)
    rows = [(i, "t", "me", f"a{i}", "N:1" if i % 2 else "N:2", "{}") for i in range(240)]
    table.frame = spark.createDataFrame(rows, "id long, at string, actor string, action string, target string, detail string").select(*table.columns)
    assert [r["action"] for r in log.get_history("N:1")] == [f"a{i}" for i in range(239, 0, -2)]
    assert len(log.query(target="N:1")) == 100


def test_the_text_index_follows_the_table(graph, run, spark):
    import math

    from graphloom.functions import text

    run("CREATE NODE TABLE D(id INT64, t STRING, PRIMARY KEY(id))")
    run("CREATE (:D {id: 1, t: 'red apple, red'}), (:D {id: 2, t: 'green apples'}), (:D {id: 3, t: 'pear'}), (:D {id: 4})")
    run("CALL create_fts_index('D', 'i', ['t'])")

    def check():
        docs = {i: text.asked_words(spark, t) and [x.rstrip("s") for x in t.replace(",", "").split()] for i, t in run("MATCH (d:D) RETURN d.id, coalesce(d.t, '')")}
        mean, want = sum(map(len, docs.values())) / len(docs), {}
        for w in ("apple", "red"):
            df = sum(w in ws for ws in docs.values())
            for i, ws in docs.items():
                if w in ws:
                    want[i] = want.get(i, 0) + math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        got = dict(run("CALL query_fts_index('D', 'i', 'red apple') RETURN node.id, score"))
        assert got == pytest.approx(want) and got

    check()
    index = lambda: graph.catalog.indexes["i"]["data"]
    first = index().segments[0]
    run("MATCH (d:D {id: 2}) SET d.t = 'red'")
    run("CREATE (:D {id: 5, t: 'apple apple pear'})")
    run("MATCH (d:D {id: 1}) DELETE d")
    check()
    assert index().segments[0] is first and len(index().segments) == 2
    run("MATCH (d:D {id: 5}) DELETE d")
    check()
    run("CHECKPOINT")
    check()
    run("ALTER TABLE D ADD x INT64")
    check()
    assert len(index().segments) == 1
    plan = index().search("red")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,red)" in plan or "In(word" in plan
    run("CALL drop_fts_index('D', 'i')")
