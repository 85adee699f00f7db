"""Database: nodes and edges by methods, for applications that don't write queries."""

from __future__ import annotations

import datetime
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import BindError
from graphloom.operators import algorithms, vector
from graphloom.operators.ddl import write
from graphloom.session import GraphSession


def _props(data: dict[str, Any], prefix: str = "") -> str:
    return ", ".join(f"`{k}`: ${prefix}{k}" for k in data)


class Database:
    def __init__(self, spark: SparkSession, session: GraphSession | None = None):
        self.spark, self.session = spark, session or GraphSession(spark)

    # ---- queries

    def execute(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        return self.session.query(text, params)

    def query(self, text: str, params: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.execute(text, params).toLocalIterator()]

    def query_df(self, text: str, params: dict[str, Any] | None = None):
        return self.execute(text, params).toPandas()

    def query_arrow(self, text: str, params: dict[str, Any] | None = None):
        return self.execute(text, params).toArrow()

    # ---- tables

    def create_node_table(self, name: str, columns: dict[str, str], primary_key: str) -> None:
        cols = ", ".join(f"`{c}` {t}" for c, t in columns.items())
        self.execute(f"CREATE NODE TABLE IF NOT EXISTS `{name}`({cols}, PRIMARY KEY(`{primary_key}`))")

    def create_edge_table(self, name: str, source: str, target: str, columns: dict[str, str] | None = None) -> None:
        cols = "".join(f", `{c}` {t}" for c, t in (columns or {}).items())
        self.execute(f"CREATE REL TABLE IF NOT EXISTS `{name}`(FROM `{source}` TO `{target}`{cols})")

    def drop_table(self, name: str) -> None:
        self.execute(f"DROP TABLE IF EXISTS `{name}`")

    # ---- nodes

    def _key(self, table: str) -> str:
        return self.session.catalog.node(table).key

    def create_node(self, table: str, data: dict[str, Any]) -> Any:
        self.execute(f"CREATE (n:`{table}` {{{_props(data)}}})", data)
        return data[self._key(table)]

    def get_node(self, table: str, key: Any) -> dict[str, Any] | None:
        found = self.query(f"MATCH (n:`{table}`) WHERE n.`{self._key(table)}` = $key RETURN n.*", {"key": key})
        return {k.removeprefix("n."): v for k, v in found[0].items()} if found else None

    def get_nodes_by_type(self, table: str, limit: int | None = None) -> list[dict[str, Any]]:
        found = self.query(f"MATCH (n:`{table}`) RETURN n.*" + (f" LIMIT {int(limit)}" if limit is not None else ""))
        return [{k.removeprefix("n."): v for k, v in r.items()} for r in found]

    def update_node(self, table: str, key: Any, data: dict[str, Any]) -> bool:
        """Sets the properties given; the others stay."""
        if self.get_node(table, key) is None:
            return False
        data = {k: v for k, v in data.items() if k != self._key(table)}
        if data:
            self.execute(f"MATCH (n:`{table}`) WHERE n.`{self._key(table)}` = $__key SET " + ", ".join(f"n.`{k}` = ${k}" for k in data), {**data, "__key": key})
        return True

    def delete_node(self, table: str, key: Any) -> bool:
        if self.get_node(table, key) is None:
            return False
        self.execute(f"MATCH (n:`{table}`) WHERE n.`{self._key(table)}` = $key DETACH DELETE n", {"key": key})
        return True

    # ---- edges

    def create_edge(self, table: str, source: Any, target: Any, data: dict[str, Any] | None = None, pair: tuple[str, str] | None = None) -> None:
        a, b = pair or self.session.catalog.rel(table).pairs[0]
        data = data or {}
        self.execute(f"MATCH (a:`{a}`), (b:`{b}`) WHERE a.`{self._key(a)}` = $__a AND b.`{self._key(b)}` = $__b CREATE (a)-[:`{table}` {{{_props(data)}}}]->(b)", {**data, "__a": source, "__b": target})

    def get_edges(self, node_table: str, key: Any, direction: str = "both", edge_table: str | None = None) -> list[dict[str, Any]]:
        """Edges of a node: type, source, target and properties."""
        out: list[DataFrame] = []
        for rel in self.session.catalog.rels.values():
            if edge_table and rel.name != edge_table:
                continue
            for (a, b), f in rel.frames.items():
                for end, of, way in (("_src", a, "out"), ("_dst", b, "in")):
                    if of == node_table and direction in (way, "both"):
                        props = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rel.columns))) if rel.columns else F.lit("{}")
                        out.append(f.filter(F.col(end) == F.lit(key)).select(F.lit(rel.name).alias("type"), F.lit(way).alias("direction"), F.col("_src").cast("string").alias("source"), F.col("_dst").cast("string").alias("target"), props.alias("properties")))
        rows = [r.asDict() for df in out for r in df.toLocalIterator()]
        return [{**r, "properties": json.loads(r["properties"])} for r in rows]

    def delete_edge(self, table: str, source: Any, target: Any, pair: tuple[str, str] | None = None) -> None:
        a, b = pair or self.session.catalog.rel(table).pairs[0]
        self.execute(f"MATCH (a:`{a}`)-[r:`{table}`]->(b:`{b}`) WHERE a.`{self._key(a)}` = $a AND b.`{self._key(b)}` = $b DELETE r", {"a": source, "b": target})

    # ---- search and views

    def search(self, text: str, tables: list[str] | None = None, limit: int = 20) -> list[dict[str, Any]]:
        """Nodes whose string properties contain the text, whatever its case, by table and key."""
        out: list[dict[str, Any]] = []
        for t in self.session.catalog.nodes.values():
            if tables and t.name not in tables:
                continue
            cols = [c for c, k in t.columns.items() if isinstance(k, T.StringType)]
            if not cols or len(out) >= limit:
                continue
            test = None
            for c in cols:
                one = F.contains(F.lower(F.col(f"`{c}`")), F.lit(text.lower()))
                test = one if test is None else test | one
            out += [{"_label": t.name, **r.asDict(recursive=True)} for r in t.frame.filter(test).orderBy(F.col(f"`{t.key}`")).limit(limit - len(out)).collect()]
        return out

    def get_canvas_data(self) -> dict[str, list[dict[str, Any]]]:
        """All nodes and edges, for drawing: meant for graphs that fit a screen."""
        nodes = [{"_label": t.name, **r.asDict(recursive=True)} for t in self.session.catalog.nodes.values() for r in t.frame.toLocalIterator()]
        edges = [{"type": t.name, "source": r["_src"], "target": r["_dst"]} for t in self.session.catalog.rels.values() for f in t.frames.values() for r in f.select("_src", "_dst").toLocalIterator()]
        return {"nodes": nodes, "edges": edges}

    # ---- transactions

    def begin_transaction(self) -> None:
        self.execute("BEGIN TRANSACTION")

    def commit(self) -> None:
        self.execute("COMMIT")

    def rollback(self) -> None:
        self.execute("ROLLBACK")

    begin_batch, end_batch = begin_transaction, commit

    # ---- delta tables

    def import_delta_table(self, path: str, table: str, primary_key: str) -> None:
        """Needs the delta package on Spark's class path."""
        frame = self.spark.read.format("delta").load(path)
        self.session.add_nodes(table, frame, primary_key)

    @classmethod
    def from_delta_lake(cls, spark: SparkSession, nodes: dict[str, tuple[str, str]]) -> Database:
        out = cls(spark)
        for table, (path, key) in nodes.items():
            out.import_delta_table(path, table, key)
        return out


class GraphAlgorithms:
    """Algorithms over one node table and one rel table of it."""

    def __init__(self, db: Database):
        self.db = db

    def frames(self, node_table: str, edge_table: str) -> tuple[DataFrame, DataFrame]:
        c = self.db.session.catalog
        t, r = c.node(node_table), c.rel(edge_table)
        nodes = t.frame.select(F.col(f"`{t.key}`").alias("id"))
        return nodes, r.frames[(t.name, t.name)].select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))

    def weakly_connected_components(self, node_table: str, edge_table: str) -> DataFrame:
        return algorithms.weakly_connected_components(*self.frames(node_table, edge_table))

    def strongly_connected_components(self, node_table: str, edge_table: str) -> DataFrame:
        return algorithms.strongly_connected_components(*self.frames(node_table, edge_table))

    def pagerank(self, node_table: str, edge_table: str, damping: float = 0.85, max_iterations: int = 20, tolerance: float = 1e-6) -> DataFrame:
        return algorithms.pagerank(*self.frames(node_table, edge_table), damping, max_iterations, tolerance)

    def louvain(self, node_table: str, edge_table: str) -> DataFrame:
        return algorithms.louvain(*self.frames(node_table, edge_table))

    def k_core(self, node_table: str, edge_table: str, k: int | None = None) -> DataFrame:
        return algorithms.k_core(*self.frames(node_table, edge_table), k)

    def shortest_path(self, node_table: str, edge_table: str, source: Any, target: Any) -> list:
        return algorithms.shortest_path(self.frames(node_table, edge_table)[1], source, target)

    def degree_centrality(self, node_table: str, edge_table: str, direction: str = "both") -> DataFrame:
        return algorithms.degree_centrality(*self.frames(node_table, edge_table), direction)

    def node_similarity(self, node_table: str, edge_table: str, metric: str = "jaccard", least: float = 0.0) -> DataFrame:
        return algorithms.node_similarity(self.frames(node_table, edge_table)[1], metric, least)


class VectorIndex:
    def __init__(self, db: Database):
        self.db = db

    def create_index(self, table: str, column: str, name: str, metric: str = "cosine") -> None:
        self.db.execute(f"CALL create_vector_index('{table}', '{name}', '{column}', metric := '{metric}')")

    def drop_index(self, table: str, name: str) -> None:
        self.db.execute(f"CALL drop_vector_index('{table}', '{name}')")

    def search(self, table: str, name: str, query: list[float], k: int = 10) -> list[dict[str, Any]]:
        i = self.db.session.catalog.indexes.get(name)
        if i is None or i["table"] != table:
            raise BindError(f"table {table} doesn't have an index with name {name}")
        t = self.db.session.catalog.node(table)
        return [r.asDict(recursive=True) for r in vector.nearest(t.frame, i["columns"][0], query, k, i["options"]["metric"]).collect()]

    def hybrid_search(self, table: str, name: str, query: list[float], edge_table: str, k: int = 10) -> list[dict[str, Any]]:
        """The k nearest nodes, each with the keys of its neighbours over the edge table."""
        found, catalog = self.search(table, name, query, k), self.db.session.catalog
        key, keys = catalog.node(table).key, [row[catalog.node(table).key] for row in found]
        near: dict[Any, list[str]] = {x: [] for x in keys}
        for pair, edges in catalog.rel(edge_table).frames.items():
            for end, other, of in (("_src", "_dst", pair[0]), ("_dst", "_src", pair[1])):
                if of == catalog.node(table).name:  # one query for all nodes found
                    for r in edges.filter(F.col(end).isin(keys)).select(end, F.col(other).cast("string")).toLocalIterator():
                        near[r[0]].append(r[1])
        return [{**row, "neighbours": near[row[key]]} for row in found]

    def list_indices(self) -> list[dict[str, Any]]:
        return [{"name": n, **i} for n, i in self.db.session.catalog.indexes.items() if i["kind"] == "HNSW"]


class DataExporter:
    def __init__(self, db: Database):
        self.db = db

    def _frame(self, table: str) -> DataFrame:
        from graphloom.functions.tables import _frame

        return _frame(self.db.session, table)

    def to_parquet(self, table: str, path: str) -> None:
        self._frame(table).write.mode("overwrite").parquet(path)

    def to_csv(self, table: str, path: str) -> None:
        write(self.db.session, self._frame(table), path, {})

    def from_csv(self, table: str, path: str, **options: Any) -> None:
        text = ", ".join(f"{k}={json.dumps(v)}" for k, v in options.items())
        self.db.execute(f"COPY `{table}` FROM '{path}'" + (f" ({text})" if text else ""))

    def from_parquet(self, table: str, path: str) -> None:
        self.db.execute(f"COPY `{table}` FROM '{path}'")

    def query_to_parquet(self, text: str, path: str) -> None:
        self.db.execute(text).write.mode("overwrite").parquet(path)

    def query_to_csv(self, text: str, path: str) -> None:
        write(self.db.session, self.db.execute(text), path, {})


class AuditLog:
    """Appended rows (at, actor, action, target, detail) in a node table."""

    TABLE = "_AuditLog"

    def __init__(self, db: Database):
        self.db = db
        db.create_node_table(self.TABLE, {"id": "SERIAL", "at": "STRING", "actor": "STRING", "action": "STRING", "target": "STRING", "detail": "STRING"}, "id")

    def append(self, action: str, target: str, actor: str = "system", detail: dict[str, Any] | None = None) -> None:
        at = datetime.datetime.now(datetime.UTC).isoformat()
        row = {"at": at, "actor": actor, "action": action, "target": target, "detail": json.dumps(detail or {}, default=str)}
        self.db.execute(f"CREATE (n:`{self.TABLE}` {{{_props(row)}}})", row)

    def query(self, action: str | None = None, actor: str | None = None, target: str | None = None, limit: int | None = 100, newest_first: bool = False) -> list[dict[str, Any]]:
        given = {k: v for k, v in (("action", action), ("actor", actor), ("target", target)) if v is not None}
        where = " AND ".join(f"n.{k} = ${k}" for k in given)
        found = self.db.query(f"MATCH (n:`{self.TABLE}`) {'WHERE ' + where if where else ''} RETURN n.* ORDER BY n.id{' DESC' if newest_first else ''}{'' if limit is None else f' LIMIT {int(limit)}'}", given)
        return [{k.removeprefix("n."): v for k, v in r.items()} for r in found]

    def get_history(self, target: str) -> list[dict[str, Any]]:
        """All entries of the target, newest first."""
        return self.query(target=target, limit=None, newest_first=True)

    def count(self) -> int:
        return self.db.session.catalog.node(self.TABLE).frame.count()

    def export_jsonl(self, path: str) -> None:
        self.db.session.catalog.node(self.TABLE).frame.write.mode("overwrite").json(path)


class AuditedDatabase(Database):
    """A database whose changes of nodes and edges are logged."""

    def __init__(self, spark: SparkSession, session: GraphSession | None = None, actor: str = "system"):
        super().__init__(spark, session)
        self.actor, self.log = actor, AuditLog(Database(spark, self.session))

    def create_node(self, table: str, data: dict[str, Any]) -> Any:
        key = super().create_node(table, data)
        self.log.append("create_node", f"{table}:{key}", self.actor, data)
        return key

    def update_node(self, table: str, key: Any, data: dict[str, Any]) -> bool:
        before = self.get_node(table, key)
        done = super().update_node(table, key, data)
        if done:
            self.log.append("update_node", f"{table}:{key}", self.actor, {"before": before, "after": data})
        return done

    def delete_node(self, table: str, key: Any) -> bool:
        before = self.get_node(table, key)
        done = super().delete_node(table, key)
        if done:
            self.log.append("delete_node", f"{table}:{key}", self.actor, {"before": before})
        return done

    def create_edge(self, table: str, source: Any, target: Any, data: dict[str, Any] | None = None, pair: tuple[str, str] | None = None) -> None:
        super().create_edge(table, source, target, data, pair)
        self.log.append("create_edge", f"{table}:{source}->{target}", self.actor, data)
