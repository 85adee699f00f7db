"""GraphSession: a catalogue over a SparkSession and the statements that run against it."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import Catalog, NodeTable, RelTable
from graphloom.dist import ship
from graphloom.errors import BindError, CatalogError
from graphloom.parser import ast as A
from graphloom.parser.parser import parse, parse_all
from graphloom.plans.query import UPDATES, Runner
from graphloom.versions import Shared

SETTINGS = {
    "threads": 0, "warning_limit": 8192, "timeout": 0, "progress_bar": False, "var_length_extend_max_depth": 30, "sparse_frontier_threshold": 1000, "enable_semi_mask": True,
    "disable_map_key_check": False, "enable_zone_map": True, "home_directory": "", "file_search_path": "", "recursive_pattern_semantic": "WALK", "recursive_pattern_factor": 100,
    "debug_enable_multi_writes": False, "checkpoint_threshold": 16777216, "auto_checkpoint": True, "force_checkpoint_on_close": True, "enable_default_hash_index": True,
    "spill_to_disk": True, "enable_plan_optimizer": True, "enable_internal_catalog": False,
}


class GraphSession:
    def __init__(self, spark: SparkSession, shared: Shared | None = None):
        ship(spark)
        self.spark, self.shared = spark, shared or Shared(Catalog())
        self.databases: dict[str, Catalog] = {}
        self.used: str | None = None  # the database in use, None for main
        self.before: Catalog | None = None  # the committed catalogue that the open transaction began with, and its own
        self.own: Catalog | None = None
        self.explicit = False
        self.read_only = False
        self.params: dict[str, Any] = {}
        self.settings = dict(SETTINGS)
        self.udfs: dict[str, Any] = {}
        self.objects: dict[str, Any] = {}
        self.warnings: list[DataFrame] = []
        self.extensions: set[str] = set()
        self.tracked: set[str] = set()
        self.one = spark.range(1).select()

    def connect(self) -> GraphSession:
        """Another session of the same database, with transactions of its own."""
        return GraphSession(self.spark, self.shared)

    # ---- the catalogue and its transactions

    @property
    def main(self) -> Catalog:
        return self.shared.catalog if self.own is None else self.own

    @property
    def catalog(self) -> Catalog:
        return self.databases[self.used] if self.used is not None else self.main

    def begin(self, explicit: bool = False, read_only: bool = False) -> None:
        with self.shared.lock:
            self.before = self.shared.catalog
            self.own = self.before.snapshot()
            self.shared.open.add(id(self))
        self.kept = {name: c.snapshot() for name, c in self.databases.items()} if explicit else {}
        self.explicit, self.read_only = explicit, read_only

    def _end(self) -> tuple[Catalog, Catalog]:
        out = self.before, self.own
        self.before = self.own = None
        self.explicit = self.read_only = False
        return out

    def commit(self) -> None:
        """Publishes the transaction's changes, or fails by conflict; the transaction has ended either way."""
        read_only = self.read_only
        before, own = self._end()
        try:
            if not read_only:
                self.shared.commit(before, own, id(self))
        finally:
            self.shared.open.discard(id(self))

    def rollback(self) -> None:
        if self.explicit:
            self.databases = {name: self.kept.get(name, c) for name, c in self.databases.items()}
        self._end()
        self.shared.open.discard(id(self))

    @contextmanager
    def changing(self) -> Iterator[None]:
        """One statement's changes: part of the open transaction, else a transaction of their own."""
        if self.own is not None:
            yield
            return
        self.begin()
        try:
            yield
        except BaseException:
            self.rollback()
            raise
        self.commit()

    # ---- tables from frames

    def add_nodes(self, name: str, frame: DataFrame, key: str) -> GraphSession:
        """Registers a frame as a node table without copying it."""
        with self.changing():
            self._free(name)
            self.catalog.nodes[name] = NodeTable(name, key, {f.name: f.dataType for f in frame.schema}, frame)
        return self

    def add_rels(self, name: str, frame: DataFrame, src: tuple[str, str], dst: tuple[str, str], ids: list[str] | None = None) -> GraphSession:
        """Registers a frame as a rel table: src and dst are (node table, column); ids make an edge's identity."""
        known = self.catalog.find(self.catalog.rels, name)
        pair = (self.catalog.node(src[0]).name, self.catalog.node(dst[0]).name)
        props = [c for c in frame.columns if c not in (src[1], dst[1])]
        eid = F.concat_ws("|", *(F.col(c).cast("string") for c in ids)) if ids else F.monotonically_increasing_id()
        made = frame.select(F.col(src[1]).alias("_src"), F.col(dst[1]).alias("_dst"), eid.alias("_eid"), *(F.col(c) for c in props)).filter("_src is not null and _dst is not null")
        with self.changing():
            if known:
                self.catalog.rels[known].pairs.append(pair)
                self.catalog.rels[known].frames[pair] = made
                self.catalog.rels[known].single = ()
            else:
                self._free(name)
                self.catalog.rels[name] = RelTable(name, [pair], {c: frame.schema[c].dataType for c in props}, {pair: made}, single=tuple(end for end, (_, c) in (("_src", src), ("_dst", dst)) if ids == [c]))
        return self

    def _free(self, name: str) -> None:
        if self.catalog.has_table(name):
            raise CatalogError(f"{name} already exists in catalog")

    def add_function(self, name: str, f, return_type="string", vectorized: bool = False) -> None:
        """A scalar function of the language: a Python function, run by Arrow batches if vectorized."""
        self.udfs[name.lower()] = F.pandas_udf(f, return_type) if vectorized else F.udf(f, return_type)

    def remove_function(self, name: str) -> None:
        self.udfs.pop(name.lower(), None)

    def add_object(self, name: str, of) -> None:
        """A frame of pandas, Arrow or Spark that LOAD FROM and COPY find by name."""
        self.objects[name] = of

    # ---- statements

    def setting(self, name: str):
        return self.settings[name.lower()]

    def sequence(self, name: str):
        found = self.catalog.find(self.catalog.sequences, str(name))
        if found is None:
            raise CatalogError(f"sequence {name} does not exist")
        return self.catalog.sequences[found]

    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """Runs a statement. Reads are lazy; updates have happened when this returns."""
        return self.run(parse(text), params)

    execute = query

    def script(self, text: str) -> list[DataFrame]:
        return [self.run(s) for s in parse_all(text)]

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, parse(text))

    def run(self, statement, params: dict[str, Any] | None = None) -> DataFrame:
        outer, self.params = self.params, params if params is not None else self.params
        try:
            if isinstance(statement, A.Query):
                if not any(isinstance(c, UPDATES) for part in statement.parts for c in part):
                    return Runner(self).run(statement)
                if self.read_only:
                    raise BindError("cannot execute write operations in a read-only transaction")
                with self.changing():
                    return Runner(self).run(statement)
            if isinstance(statement, A.Explain):
                return self.explain(statement)
            from graphloom.operators.ddl import WRITES, run_command

            if statement.kind not in WRITES or self.read_only:
                return run_command(self, statement)
            with self.changing():
                return run_command(self, statement)
        finally:
            self.params = outer

    def explain(self, e: A.Explain) -> DataFrame:
        if e.mode == "PROFILE":
            began = time.time()
            df = self.run(e.statement)
            rows = df.count()
            return self.rows([(df._jdf.queryExecution().executedPlan().toString(), rows, time.time() - began)], "plan string, num_rows long, seconds double")
        df = self.run(e.statement)
        made = df._jdf.queryExecution()
        return self.rows([((made.optimizedPlan() if e.mode == "LOGICAL" else made.executedPlan()).toString(),)], "plan string")

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def message(self, text: str) -> DataFrame:
        return self.rows([(text,)], "result string")


class Prepared:
    """A parsed statement, run again with other parameters."""

    def __init__(self, session: GraphSession, statement):
        self.session, self.statement = session, statement

    def execute(self, **params: Any) -> DataFrame:
        return self.session.run(self.statement, params)
