"""Table functions: CALL f(..)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import graphloom
from graphloom.catalog import NodeTable
from graphloom.errors import BindError, RunError
from graphloom.functions.registry import MISSING, SCALARS
from graphloom.operators import algorithms, vector
from graphloom.types import type_name

TABLES: dict = {}


def table_function(*names: str):
    def put(f):
        for n in names:
            TABLES[n] = f
        return f

    return put


def call_table(session, c, compiler) -> DataFrame:
    f = TABLES.get(c.name.lower())
    if f is None:
        raise BindError(f"{c.name} is no table function")
    args = [_value(compiler, a) for a in c.args]
    named = {k.lower(): _value(compiler, v) for k, v in c.named}
    try:
        return f(session, *args, **named)
    except TypeError as e:
        if "argument" not in str(e):
            raise
        raise BindError(f"{c.name} doesn't take these arguments") from e


def _value(compiler, e):
    from graphloom.parser import ast as A

    if isinstance(e, A.StructLit):
        return {k: _value(compiler, v) for k, v in e.fields}
    if isinstance(e, A.ListLit):
        return [_value(compiler, x) for x in e.items]
    found = compiler(e)
    if found.value is MISSING:
        return compiler.frame.limit(1).select(found.col.alias("x")).first()["x"]
    return found.value


@table_function("current_setting")
def current_setting(session, name):
    return session.rows([(str(session.setting(name)),)], f"`{name}` string")


@table_function("catalog_version")
def catalog_version(session):
    return session.rows([(session.catalog.version,)], "version long")


@table_function("db_version")
def db_version(session):
    return session.rows([(graphloom.VERSION,)], "version string")


@table_function("show_tables")
def show_tables(session):
    c = session.catalog
    rows = [(c.table_id(t.name), t.name, "NODE", "local", t.comment) for t in c.nodes.values()] + [(c.table_id(t.name), t.name, "REL", "local", t.comment) for t in c.rels.values()]
    return session.rows(rows, "id long, name string, type string, `database name` string, comment string")


@table_function("show_graphs")
def show_graphs(session):
    return session.rows([("main", "TYPED")] + [(n, "ANY" if c.any_graph else "TYPED") for n, c in session.databases.items()], "name string, type string")


@table_function("show_warnings")
def show_warnings(session):
    if not session.warnings:
        return session.rows([], "message string")
    out = session.warnings[0]
    for w in session.warnings[1:]:
        out = out.unionByName(w)
    return out.limit(int(session.setting("warning_limit")))


@table_function("clear_warnings")
def clear_warnings(session):
    session.warnings = []
    return session.message("warnings cleared")


@table_function("show_macros")
def show_macros(session):
    return session.rows([(m.name, ", ".join(p for p, _ in m.params)) for m in session.catalog.macros.values()], "name string, definition string")


@table_function("table_info")
def table_info(session, name):
    t = session.catalog.table(name)
    key = getattr(t, "key", None)
    rows = [(i, n, t.types.get(n) or type_name(k), str(getattr(t.defaults.get(n), "value", t.defaults.get(n))) if n in t.defaults else "NULL", n == key) for i, (n, k) in enumerate(t.columns.items())]
    return session.rows(rows, "`property id` int, name string, type string, `default expression` string, `primary key` boolean")


@table_function("show_sequences")
def show_sequences(session):
    return session.rows([(s.name, "local", s.start, s.increment, s.low, s.high, s.cycle) for s in session.catalog.sequences.values()], "name string, `database name` string, `start value` long, increment long, `min value` long, `max value` long, cycle boolean")


@table_function("show_connection")
def show_connection(session, name):
    t = session.catalog.rel(name)
    rows = [(a, b, session.catalog.node(a).key, session.catalog.node(b).key) for a, b in t.pairs]
    return session.rows(rows, "`source table name` string, `destination table name` string, `source table primary key` string, `destination table primary key` string")


def _frame(session, name) -> DataFrame:
    t = session.catalog.table(name)
    if isinstance(t, NodeTable):
        return t.frame
    out = None
    for f in t.frames.values():
        out = f if out is None else out.unionByName(f)
    return out


@table_function("storage_info")
def storage_info(session, name):
    """A row for each column of each partition: rows held and NULLs."""
    f = _frame(session, name)
    cols = [c for c in f.columns if not c.startswith("_")]
    per = f.withColumn("__p", F.spark_partition_id()).groupBy("__p").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(cols)))
    return per.select(F.col("__p").cast("long").alias("node_group_id"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("num_values"), (F.col("n") - F.col(f"n_{i}")).alias("num_nulls")) for i, c in enumerate(cols)))).alias("x")).select("node_group_id", "x.*")


@table_function("stats_info")
def stats_info(session, name):
    """Rows, and approximate distinct counts of the columns."""
    f = _frame(session, name)
    cols = [x.name for x in f.schema if not x.name.startswith("_") and not isinstance(x.dataType, (T.MapType, T.ArrayType, T.StructType))]
    return f.agg(F.count(F.lit(1)).alias("cardinality"), *(F.approx_count_distinct(F.col(f"`{c}`")).alias(f"{c}_distinct_count") for c in cols))


@table_function("fsm_info", "file_info", "disk_size_info", "bm_info")
def files(session):
    """Files behind the tables; Spark manages pages and buffers itself."""
    rows = []
    for t in (*session.catalog.nodes.values(), *session.catalog.rels.values()):
        for f in [t.frame] if isinstance(t, NodeTable) else list(t.frames.values()):
            rows += [(t.name, x) for x in f.inputFiles()]
    return session.rows(rows, "table_name string, file string")


@table_function("show_attached_databases")
def show_attached_databases(session):
    return session.rows([(n, "LOCAL") for n in session.databases], "name string, `database type` string")


@table_function("show_functions")
def show_functions(session):
    from graphloom.plans.expressions import AGGREGATES, LAMBDAS

    kinds = [(n.upper(), "SCALAR_FUNCTION") for n in sorted({*SCALARS, *LAMBDAS})] + [(n.upper(), "AGGREGATE_FUNCTION") for n in sorted(AGGREGATES)] + [(n.upper(), "TABLE_FUNCTION") for n in sorted(TABLES)]
    return session.rows(kinds, "name string, type string")


@table_function("show_loaded_extensions", "show_official_extensions")
def extensions(session):
    return session.rows([(x, "OFFICIAL") for x in sorted(session.extensions)], "`extension name` string, `extension source` string")


@table_function("show_indexes")
def show_indexes(session):
    return session.rows([(i["table"], n, i["kind"], i["columns"], True) for n, i in session.catalog.indexes.items()], "`table name` string, `index name` string, `index type` string, `property names` array<string>, `extension loaded` boolean")


@table_function("_cache_array_column_locally")
def cache_column(session, table, column):
    session.catalog.node(table).frame.select(F.col(f"`{column}`")).cache().count()
    return session.message(f"cached {column}")


# ---- projected graphs and algorithms


@table_function("project_graph")
def project_graph(session, name, nodes, rels):
    """nodes and rels: names, or {name: predicate} with n and r standing for the node and relationship."""
    if name in session.catalog.graphs:
        raise RunError(f"project graph {name} already exists")
    as_map = lambda x: x if isinstance(x, dict) else {n if isinstance(n, str) else n["table"]: "" if isinstance(n, str) else n.get("predicate", "") for n in x}
    nodes, rels = as_map(nodes), as_map(rels)
    for n in nodes:
        session.catalog.node(n)
    for r in rels:
        session.catalog.rel(r)
    session.catalog.graphs[name] = {"type": "NATIVE", "nodes": nodes, "rels": rels}
    return session.message(f"project graph {name} created")


@table_function("project_graph_cypher")
def project_graph_cypher(session, name, query):
    if name in session.catalog.graphs:
        raise RunError(f"project graph {name} already exists")
    session.catalog.graphs[name] = {"type": "CYPHER", "query": query}
    return session.message(f"project graph {name} created")


@table_function("drop_projected_graph")
def drop_projected_graph(session, name):
    if session.catalog.graphs.pop(name, None) is None:
        raise RunError(f"project graph {name} does not exist")
    return session.message(f"project graph {name} dropped")


@table_function("show_projected_graphs")
def show_projected_graphs(session):
    return session.rows([(n, g["type"]) for n, g in session.catalog.graphs.items()], "name string, type string")


@table_function("projected_graph_info")
def projected_graph_info(session, name):
    g = _graph(session, name)
    if g["type"] == "CYPHER":
        return session.rows([(g["query"],)], "`cypher statement` string")
    rows = [("NODE", n, p) for n, p in g["nodes"].items()] + [("REL", r, p) for r, p in g["rels"].items()]
    return session.rows(rows, "`table type` string, `table name` string, predicate string")


def _graph(session, name):
    if name not in session.catalog.graphs:
        raise RunError(f"cannot find graph {name}")
    return session.catalog.graphs[name]


def graph_frames(session, name) -> tuple[DataFrame, DataFrame]:
    """(id struct<label,key>) and (src, dst) of a projected graph."""
    g, nodes, edges = _graph(session, name), None, None
    if g["type"] == "CYPHER":
        df = session.query(g["query"])
        ends = [f.name for f in df.schema if isinstance(f.dataType, T.StructType) and "_ID" in f.dataType.fieldNames()]
        cols = df.columns
        rel = next((f.name for f in df.schema if isinstance(f.dataType, T.StructType) and "_SRC" in f.dataType.fieldNames()), None)
        plain = [c for c in ends if c != rel]
        ident = lambda c: F.struct(F.col(f"`{c}`._LABEL").alias("label"), F.col(f"`{c}`._ID.offset").cast("string").alias("key"))
        if len(plain) < 2:
            raise BindError(f"the graph's query must return both nodes of its relationships; it returns {cols}")
        edges = df.select(ident(plain[0]).alias("src"), ident(plain[1]).alias("dst")).filter("src is not null and dst is not null")
        nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        return nodes, edges
    for n, p in g["nodes"].items():
        t = session.catalog.node(n)
        df = session.query(f"MATCH (n:`{n}`) {'WHERE ' + p if p else ''} RETURN n.`{t.key}` AS key")
        one = df.select(F.struct(F.lit(n).alias("label"), F.col("key").cast("string").alias("key")).alias("id"))
        nodes = one if nodes is None else nodes.unionByName(one)
    for r, p in g["rels"].items():
        for a, b in session.catalog.rel(r).pairs:
            if a not in g["nodes"] or b not in g["nodes"]:
                continue
            wheres = [w for w in (p, g["nodes"][a].replace("n.", "a_.") if g["nodes"][a] else "", g["nodes"][b].replace("n.", "b_.") if g["nodes"][b] else "") if w]
            ka, kb = session.catalog.node(a).key, session.catalog.node(b).key
            df = session.query(f"MATCH (a_:`{a}`)-[r:`{r}`]->(b_:`{b}`) {'WHERE ' + ' AND '.join(f'({w})' for w in wheres) if wheres else ''} RETURN a_.`{ka}` AS s, b_.`{kb}` AS d")
            one = df.select(F.struct(F.lit(a).alias("label"), F.col("s").cast("string").alias("key")).alias("src"), F.struct(F.lit(b).alias("label"), F.col("d").cast("string").alias("key")).alias("dst"))
            edges = one if edges is None else edges.unionByName(one)
    if edges is None:
        edges = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    return nodes, edges


def _shown(session, name, df: DataFrame, value: str, rename: str) -> DataFrame:
    """id.label and id.key as columns, the key as a number where the graph's keys are."""
    g = _graph(session, name)
    number = g["type"] == "CYPHER" or all(isinstance(session.catalog.node(n).key_type, T.IntegralType) for n in g["nodes"])
    key = F.col("id.key").cast("long") if number else F.col("id.key")
    col = F.col(value)
    if isinstance(df.schema[value].dataType, T.StructType):
        col = F.col(f"{value}.key").cast("long") if number else F.col(f"{value}.key")
    return df.select(F.col("id.label").alias("label"), key.alias("node"), col.alias(rename))


@table_function("weakly_connected_components", "wcc")
def wcc(session, graph, maxiterations=100):
    return _shown(session, graph, algorithms.weakly_connected_components(*graph_frames(session, graph), maxiterations), "component", "group_id")


@table_function("strongly_connected_components", "scc", "strongly_connected_components_kosaraju", "scc_ko")
def scc(session, graph, maxiterations=None):
    return _shown(session, graph, algorithms.strongly_connected_components(*graph_frames(session, graph), maxiterations), "component", "group_id")


@table_function("page_rank", "pr")
def page_rank(session, graph, dampingfactor=0.85, maxiterations=20, tolerance=1e-6):
    return _shown(session, graph, algorithms.pagerank(*graph_frames(session, graph), dampingfactor, maxiterations, tolerance), "rank", "rank")


@table_function("k_core_decomposition", "kcore")
def kcore(session, graph):
    return _shown(session, graph, algorithms.k_core(*graph_frames(session, graph)), "k_degree", "k_degree")


@table_function("louvain")
def louvain(session, graph, maxphases=10, maxiterations=10):
    return _shown(session, graph, algorithms.louvain(*graph_frames(session, graph), maxiterations, maxphases), "louvain_id", "louvain_id")


@table_function("label_propagation")
def label_propagation(session, graph, maxiterations=10):
    return _shown(session, graph, algorithms.label_propagation(*graph_frames(session, graph), maxiterations), "community", "label_id")


# ---- vector and text indexes: records; searches are exact


def _index(session, table, name, columns, kind, options):
    if name in session.catalog.indexes:
        raise BindError(f"index {name} already exists in table {table}")
    t = session.catalog.node(table)
    for c in columns:
        if c not in t.columns:
            raise BindError(f"cannot find property {c} for {table}")
    session.catalog.indexes[name] = {"table": t.name, "columns": columns, "kind": kind, "options": options}
    return session.message(f"index {name} has been created")


def _find(session, table, name, kind) -> dict:
    i = session.catalog.indexes.get(name)
    if i is None or i["kind"] != kind or i["table"].lower() != table.lower():
        raise BindError(f"table {table} doesn't have an index with name {name}")
    return i


@table_function("create_vector_index")
def create_vector_index(session, table, name, column, metric="cosine", **options):
    vector.distance(F.lit(None).cast("array<double>"), [0.0], metric)
    return _index(session, table, name, [column], "HNSW", {"metric": metric, **options})


@table_function("query_vector_index")
def query_vector_index(session, table, name, query, k, **_):
    i = _find(session, table, name, "HNSW")
    t = session.catalog.node(table)
    found = vector.nearest(t.frame, i["columns"][0], list(query), int(k), i["options"]["metric"])
    return found.select(F.struct(F.lit(t.name).alias("_LABEL"), *(F.col(f"`{c}`") for c in t.columns)).alias("node"), "distance")


@table_function("drop_vector_index", "drop_fts_index")
def drop_index(session, table, name):
    if session.catalog.indexes.get(name, {}).get("table", "").lower() != table.lower():
        raise BindError(f"table {table} doesn't have an index with name {name}")
    del session.catalog.indexes[name]
    return session.message(f"index {name} has been dropped")


@table_function("create_fts_index")
def create_fts_index(session, table, name, columns, **options):
    from graphloom.functions.text import InvertedIndex

    i = _index(session, table, name, list(columns), "FTS", options)
    t = session.catalog.node(table)
    session.catalog.indexes[name]["data"] = InvertedIndex.of(t.data, t.key, list(columns))
    return i


@table_function("query_fts_index")
def query_fts_index(session, table, name, query, conjunctive=False, k=1.2, b=0.75, top=None):
    i = _find(session, table, name, "FTS")
    t = session.catalog.node(table)
    i["data"] = i["data"].at(t.data, t.key)
    scores = i["data"].search(query, conjunctive, k, b)
    out = t.frame.join(scores, F.col(f"`{t.key}`") == F.col("k")).select(F.struct(F.lit(t.name).alias("_LABEL"), *(F.col(f"`{c}`") for c in t.columns)).alias("node"), "score")
    return out.orderBy(F.desc("score")).limit(int(top)) if top else out


# ---- files as table functions


def _files(kind):
    def f(session, path, **options):
        from graphloom.sources import scan

        return getattr(scan, kind)(session, [path], {k.upper(): v for k, v in options.items()}, None)

    return f


for _kind, _names in (("csv", ("read_csv_serial", "read_csv_parallel")), ("json", ("json_scan",)), ("npy", ("read_npy",))):
    for _n in _names:
        TABLES[_n] = _files(_kind)
TABLES["read_parquet"] = lambda session, path: session.spark.read.parquet(path)
