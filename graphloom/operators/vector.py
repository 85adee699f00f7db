"""Exact nearest neighbours. For one query distances are column expressions and the best k a top-k of the plan; many
queries go against all rows block by block, each task keeping its best k of a query before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.dist import ship
from graphloom.errors import BindError
from graphloom.storage import staged

#: Bytes of query vectors sent to the tasks at once, and rows whose distances a task holds.
BLOCK_BYTES, ROWS = 16 << 20, 512


def distance(column: Column, query: list[float], metric: str) -> Column:
    """cosine and l2 distances, l2sq, and the negated dot product: less is nearer."""
    q = F.array(*(F.lit(float(x)) for x in query))
    wide = column.cast("array<double>")
    total = lambda f: F.aggregate(F.zip_with(wide, q, f), F.lit(0.0), lambda a, x: a + x)
    dot = total(lambda a, b: a * b)
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)) * F.sqrt(F.lit(float(sum(x * x for x in query))))
        return 1 - dot / norm
    if metric in ("l2sq", "l2"):
        square = total(lambda a, b: (a - b) * (a - b))
        return F.sqrt(square) if metric == "l2" else square
    if metric in ("dotproduct", "dot"):
        return -dot
    raise BindError(f"unknown metric {metric}")


def nearest(frame: DataFrame, column: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """The k rows of least distance, with column `distance`."""
    found = frame.filter(F.size(F.col(f"`{column}`")) == len(query)).withColumn("distance", distance(F.col(f"`{column}`"), query, metric))
    return found.orderBy(F.col("distance").asc_nulls_last(), *(F.col(f"`{c}`") for c in frame.columns[:1])).limit(k)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Of each query and row, by their products: right but for rounding."""
    dot = queries @ rows.T
    if metric in ("dot", "dotproduct"):
        return -dot
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "cosine":
            return 1 - dot / (_lengths(queries)[:, None] * _lengths(rows)[None, :])
        square = (queries * queries).sum(axis=1)[:, None] + (rows * rows).sum(axis=1)[None, :] - 2 * dot
        return np.sqrt(np.maximum(square, 0)) if metric == "l2" else square


def _exact(query: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances that don't depend on what else is in a batch, so that equal rows tie."""
    if metric in ("l2", "l2sq"):
        square = ((rows - query) ** 2).sum(axis=1)
        return np.sqrt(square) if metric == "l2" else square
    dot = (rows * query).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dot / (_lengths(query) * _lengths(rows)) if metric == "cosine" else -dot


class _Best:
    """The k nearest rows of each query of a block, so far: by distance, then id."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.distances = np.full((len(queries), k), np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        rough = _distances(self.queries, rows, self.metric)
        slack = 1e-6 * (1 + np.abs(self.distances[:, -1]))
        for q in np.flatnonzero((rough <= (self.distances[:, -1] + slack)[:, None]).any(axis=1)).tolist():
            near = np.flatnonzero(rough[q] <= self.distances[q, -1] + slack[q])
            own = _exact(self.queries[q], rows[near], self.metric)
            known = ~np.isnan(own)
            distances, names = np.append(self.distances[q], own[known]), np.append(self.ids[q], ids[near[known]])
            order = np.lexsort((names, distances))[: self.k]
            self.distances[q], self.ids[q] = distances[order], names[order]


def _against(rows: DataFrame, queries: np.ndarray, names: np.ndarray, k: int, metric: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((queries, names))  # BLOCK_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names = sent.value
        best = _Best(queries, k, metric)
        for batch in batches:
            vectors = batch.column("v")
            flat = np.asarray(vectors.flatten(), np.float64).reshape(batch.num_rows, -1)
            ids = batch.column("id").to_numpy()
            for i in range(0, len(ids), ROWS):
                best.add(ids[i : i + ROWS], flat[i : i + ROWS])
        q, place = np.nonzero(np.isfinite(best.distances))
        yield pa.RecordBatch.from_pydict({"query": names[q], "neighbor": best.ids[q, place], "distance": best.distances[q, place]})

    return rows.mapInArrow(run, "query long, neighbor long, distance double")


def nearest_of_all(queries: DataFrame, rows: DataFrame, key: str, column: str, k: int, metric: str = "cosine") -> DataFrame:
    """(query, rank, neighbor, distance): of each row of queries the k rows of least distance, ties by key. A query is
    its own neighbour if it is among the rows. Null vectors, vectors with a null or of another length than the query's
    have no distance; null keys are left out. Queries come to the driver a block at a time and each block is sent to all
    tasks; a task keeps k rows a query, so a shuffle moves k rows a query and task."""
    if metric not in ("cosine", "l2", "l2sq", "dot", "dotproduct"):
        raise BindError(f"unknown metric {metric}")
    spark = rows.sparkSession
    ship(spark)
    tidy = lambda d: d.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    asked, rows = tidy(queries).withColumn("size", F.size("v")), tidy(rows)
    parts = []

    def close(held: list) -> None:
        size = len(held[0][1])
        found = _against(rows.filter(F.size("v") == size), np.array([v for _, v in held]), np.array([i for i, _ in held]), k, metric)
        order = Window.partitionBy("query").orderBy("distance", "neighbor")  # k rows of each task at most
        parts.append(staged(found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)))

    held: list = []
    for r in asked.orderBy("size", "id").toLocalIterator():
        if held and (len(r["v"]) != len(held[0][1]) or 8 * len(held) * len(r["v"]) >= BLOCK_BYTES):
            close(held)
            held = []
        held.append((r["id"], r["v"]))
    if held:
        close(held)
    if not parts:
        return spark.createDataFrame([], "query long, rank long, neighbor long, distance double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query", "rank", "neighbor", "distance")
