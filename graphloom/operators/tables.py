"""Changes of tables: every change is checked and makes a new version; the old one stays as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.catalog import NodeTable, RelTable
from graphloom.errors import BindError, RunError
from graphloom.functions.registry import cast
from graphloom.storage import staged
from graphloom.types import parse_type
from graphloom.versions import matching


def node_schema(table: NodeTable) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in table.columns.items()])


def rel_schema(session, table: RelTable, pair: tuple[str, str]) -> T.StructType:
    ends = [T.StructField(c, session.catalog.node(n).key_type) for c, n in zip(("_src", "_dst"), pair, strict=True)]
    return T.StructType([*ends, T.StructField("_eid", T.StringType()), *(T.StructField(n, t) for n, t in table.columns.items())])


def put_nodes(table: NodeTable, rows: DataFrame, written: bool = False) -> int:
    """Adds rows with exactly the table's columns, and gives their number; keys must be there and unique. written: rows
    only select from what is staged already."""
    if table.foreign:
        raise BindError(f"{table.name} is read in place and can't be changed")
    rows = rows.select(*(F.col(f"`{c}`") for c in table.columns))
    rows = rows if written else staged(rows)
    keys = rows.select(F.col(f"`{table.key}`").alias("__k"))
    n, nulls, most, key = keys.groupBy("__k").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max(F.col("__k").isNull()), F.max("count"), F.max_by("__k", "count")).first()
    if nulls:
        raise RunError(f"found NULL, which violates the non-null constraint of the primary key {table.key}")
    twice = [key] if n and most > 1 else [r[0] for r in matching(table.frame.select(F.col(f"`{table.key}`")), table.key, keys).limit(1).collect()]
    if twice:
        raise RunError(f"found duplicated primary key value {twice[0]}, which violates the uniqueness constraint of the primary key column")
    table.data = table.data.plus(rows)
    return n


def put_rels(session, table: RelTable, pair: tuple[str, str], rows: DataFrame) -> None:
    """Adds rows that are written already."""
    if table.foreign:
        raise BindError(f"{table.name} is read in place and can't be changed")
    rows = rows.select(*(F.col(f"`{f.name}`") for f in rel_schema(session, table, pair)))
    made = table.frames.versions[pair].plus(rows)
    for end in {"MANY_ONE": ["_src"], "ONE_MANY": ["_dst"], "ONE_ONE": ["_src", "_dst"]}.get(table.multiplicity, []):
        broken = matching(made.frame("_eid"), end, rows.select(F.col(end).alias("__k")).distinct()).groupBy(end).count().filter("count > 1").limit(1).collect()
        if broken:
            raise RunError(f"node {broken[0][0]} has more than one neighbour in table {table.name}, which violates its multiplicity {table.multiplicity}")
    table.frames[pair] = made


def numbered(df: DataFrame, name: str, start: int) -> DataFrame:
    """df with numbers from start on: each partition numbers its own rows after a count of the partitions before it."""
    df = staged(df)
    part = df.withColumn("__part", F.spark_partition_id())
    sizes = {r["__part"]: r["count"] for r in part.groupBy("__part").count().collect()}  # a row for each partition
    bases, at = {}, start
    for p in sorted(sizes):
        bases[p], at = at, at + sizes[p]
    base = F.lit(start)
    if bases:
        base = F.element_at(F.create_map(*(F.lit(x) for kv in bases.items() for x in kv)), F.col("__part"))
    order = Window.partitionBy("__part").orderBy(F.monotonically_increasing_id())
    return part.withColumn(name, (base + F.row_number().over(order) - 1).cast("long")).drop("__part")


def declared(session, table, column: str, value: Column, kind: T.DataType) -> Column:
    """A value as the declared type of the column."""
    name = table.types.get(column, "")
    to = table.columns[column]
    if isinstance(kind, T.StringType) and isinstance(to, (T.ArrayType, T.MapType, T.StructType)) and name.upper() not in ("INTERVAL", "DURATION"):
        return parse_nested(value, to)
    found = cast(value, kind, to, name.split("(")[0])
    if name.endswith("]") and name[-2] != "[":
        n = int(name[name.rindex("[") + 1 : -1])
        found = F.when(value.isNull() | (F.size(found) == n), found).otherwise(F.raise_error(F.lit(f"an array of {n} values is needed for {column}")).cast(to))
    return found


def parse_nested(value: Column, to: T.DataType) -> Column:
    """Lists, maps and structs as CSV files write them: [a,b], {k=v}, {k: v}."""
    body = F.trim(value)
    inner = F.call_function("substring", body, F.lit(2), F.greatest(F.length(body) - 2, F.lit(0)))
    if isinstance(to, T.ArrayType) and not isinstance(to.elementType, (T.ArrayType, T.MapType, T.StructType)):
        items = F.transform(F.split(inner, ","), lambda x: F.nullif(F.trim(x), F.lit("")))
        return F.when(F.trim(inner) == "", F.array().cast(to)).otherwise(items.cast(to))
    if isinstance(to, T.MapType):
        pairs = F.transform(F.split(inner, ","), lambda x: F.split(x, "=", 2))
        return F.when(value.isNotNull(), F.map_from_arrays(F.transform(pairs, lambda p: F.trim(p[0])).cast(T.ArrayType(to.keyType)), F.transform(pairs, lambda p: F.trim(F.get(p, 1))).cast(T.ArrayType(to.valueType))))
    return F.from_json(value, to.simpleString(), {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})


def column_types(session, columns: list[tuple]) -> tuple[dict, dict, dict, set]:
    types = {n: parse_type(t, session.catalog.types) for n, t, _ in columns}
    return types, {n: t for n, t, _ in columns}, {n: d for n, _, d in columns if d is not None}, {n for n, t, _ in columns if t.upper() == "SERIAL"}
