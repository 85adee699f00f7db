"""Written tables of the shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Paths of the tables that the innermost settled() of this thread has staged so far.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def own_dir(spark: SparkSession) -> str:
    """The application's folder there."""
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application staged. Frames that read them can't be used after it."""
    _remove(spark, own_dir(spark))


def staged(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends there."""
    path = f"{own_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives as a written table. Tables that this thread staged on the way, which nothing else may read, are
    removed, and a collection of garbage lets Spark's cleaner remove the shuffle files of what is done."""
    made: list[str] = []
    outer = _MADE.set(made)
    try:
        out = staged(make())
    finally:
        _MADE.reset(outer)
    if (above := _MADE.get()) is not None:
        above.append(made[-1])
    spark = out.sparkSession
    for path in made[:-1]:
        _remove(spark, path)
    gc.collect()
    spark._jvm.System.gc()
    return out
