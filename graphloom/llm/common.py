"""What the operators of this subpackage share: table access, word caches, hashes; staged tables are the library's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.dist import ship
from graphloom.storage import settled, staged

__all__ = ["Memo", "as_bytes", "free", "mix", "release", "settled", "slices", "small_batches", "spare", "staged", "substring_hasher", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, null as empty; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so that a worker holds what it makes of few texts at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, like the given ones and none of the columns'."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spare(docs: DataFrame, *names: str) -> DataFrame:
    """docs with columns that are named like an operator's output renamed: `x` becomes `x_in`."""
    for c in docs.columns:
        if c.lower() in names:
            new = f"{c}_in"
            while new.lower() in {x.lower() for x in docs.columns}:
                new += "_in"
            docs = docs.withColumnRenamed(c, new)
    return docs


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers the session's Arrow batches to so many rows: both sides of a Python worker hold whole batches of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def release() -> None:
    """Gives back what a worker's allocators keep after a task."""
    pa.default_memory_pool().release_unused()


class Memo(dict):
    """word -> value, made when first asked for; emptied when it holds `most` words, so its memory is bounded."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_DRAW = np.random.default_rng(20240607)
_BYTES = _DRAW.integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_DRAW.integers(1 << 40, 1 << 62)) * 2 + 1
_POWERS: dict[str, np.ndarray] = {}


def substring_hasher(data: np.ndarray):
    """hash(starts, ends): 64-bit hashes of any substrings of the bytes, by prefix sums of a polynomial modulo 2^64."""
    n = len(data) + 1
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            powers = np.full(max(n, 1 << 18), base, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.multiply.accumulate(powers)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_BYTES[data] * _POWERS["up"][: n - 1], out=sums[1:])
    return lambda a, b: mix((sums[b] - sums[a]) * _POWERS["down"][a])
