"""Streams into tables: each micro-batch is one bulk load, through the same checks as COPY, and one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.errors import BindError


def copy_stream(session, table: str, stream: DataFrame, checkpoint: str, trigger: dict | None = None, pair: tuple[str, str] | None = None) -> StreamingQuery:
    """Loads a streaming frame into a table, a batch at a time; checkpoint is Spark's folder for the stream's place, and
    pair names FROM and TO of a rel table that has several.

    The number of the last batch is part of the commit that loads its rows, so a batch that Spark runs again after a
    failure adds nothing, nodes and edges alike. A node's key that is there already is skipped and leaves a warning.
    Batches are loaded by a session of their own: transactions of the given one neither see nor hold them up.
    """
    from graphloom.operators.ddl import _load_nodes, _load_rels

    name = f"{checkpoint}|{table}"
    t = session.catalog.table(table)
    if not hasattr(t, "key"):
        if pair is None and len(t.pairs) > 1:
            raise BindError(f"{table} connects several pairs of tables; name one by pair=(FROM, TO)")
        pair = tuple(session.catalog.node(x).name for x in pair or t.pairs[0])
        if pair not in t.pairs:
            raise BindError(f"{pair[0]}->{pair[1]} does not exist in {table} table")
    loader = session.connect()
    loader.warnings = session.warnings
    if session.used is not None:
        loader = session

    def load(batch: DataFrame, number: int) -> None:
        with loader.changing():
            catalog = loader.catalog
            if catalog.batches.get(name, -1) >= number:
                return
            t = catalog.table(table)
            if hasattr(t, "key"):
                _load_nodes(loader, t, batch, batch.columns, {"IGNORE_ERRORS": True})
            else:
                _load_rels(loader, t, pair, batch, batch.columns[2:], {"IGNORE_ERRORS": True})
            catalog.batches[name] = number

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
