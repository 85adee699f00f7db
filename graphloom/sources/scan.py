"""Sources of LOAD FROM and COPY: files by suffix, lists and globs of them, queries, table functions, objects by name."""

from __future__ import annotations

import re
from json import loads

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import BindError
from graphloom.parser import ast as A
from graphloom.types import parse_type

DELIMITERS = (",", ";", "\t", "|")
SAMPLE = 256


def kind_of(path: str) -> str:
    name = re.sub(r"\.(gz|zst|bz2)$", "", path.rstrip("/").lower())
    suffix = name.rsplit(".", 1)[-1] if "." in name.rsplit("/", 1)[-1] else ""
    kinds = {"csv": "csv", "tsv": "csv", "txt": "csv", "tbl": "csv", "parquet": "parquet", "npy": "npy", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc"}
    if suffix not in kinds:
        raise BindError(f"cannot load from file type {suffix or path}")
    return kinds[suffix]


def resolve(session, path: str) -> str:
    """Relative paths are looked for below the file_search_path."""
    root = session.setting("file_search_path")
    return path if path.startswith("/") or "://" in path or not root else f"{root.split(',')[0].rstrip('/')}/{path}"


def scan(session, source, options: dict, headers: list | None = None) -> DataFrame:
    if isinstance(source, A.Query):
        return session.run(source)
    if isinstance(source, A.CallFunc):
        from graphloom.functions.tables import call_table
        from graphloom.plans.expressions import Compiler
        from graphloom.plans.scope import State

        return call_table(session, source, Compiler(session, State(session.one, {})))
    if isinstance(source, A.Param):
        return frame_of(session, session.params[source.name])
    if isinstance(source, A.Var):
        return named(session, source.name)
    paths = [resolve(session, p) for p in (source if isinstance(source, list) else [source])]
    kinds = {kind_of(p) for p in paths}
    if len(kinds) > 1:
        raise BindError("loading files of different types at once is not supported")
    df = {"csv": csv, "parquet": lambda s, p, o, h: s.spark.read.parquet(*p), "orc": lambda s, p, o, h: s.spark.read.orc(p), "json": json, "npy": npy}[kinds.pop()](session, paths, options, headers)
    if headers and kind_of(paths[0]) != "csv":
        df = df.select(*(F.col(f"`{a}`").cast(parse_type(t, session.catalog.types)).alias(n) for a, (n, t) in zip(df.columns, headers, strict=True)))
    return df


def frame_of(session, x) -> DataFrame:
    """A Spark, pandas or Arrow table as a frame."""
    return x if isinstance(x, DataFrame) else session.spark.createDataFrame(x)


def named(session, name: str) -> DataFrame:
    if name in session.objects:
        return frame_of(session, session.objects[name])
    if "." in name:
        db, _, table = name.partition(".")
        found = session.databases.get(db)
        if found is None:
            raise BindError(f"no database named {db} has been attached")
        t = found.table(table)
        return t.frame if hasattr(t, "key") else next(iter(t.frames.values())).drop("_eid")
    if session.spark.catalog.tableExists(name):
        return session.spark.table(name)
    raise BindError(f"variable {name} is not in scope")


def dialect(session, paths: list[str], options: dict) -> dict:
    """Delimiter, quote and header, as given or else as the first lines suggest."""
    out = {"sep": options.get("DELIM", options.get("DELIMITER")), "quote": options.get("QUOTE", '"'), "escape": options.get("ESCAPE", '"')}
    header = options.get("HEADER")
    if options.get("AUTODETECT", True) is not False and (out["sep"] is None or header is None):
        n = int(options.get("SAMPLE_SIZE", SAMPLE))
        lines = [r[0] for r in session.spark.read.text(paths[0]).limit(n).collect() if r[0]]  # n lines at most

        def cells(line: str, sep: str) -> list[str]:
            return re.split(rf"{re.escape(sep)}(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", line)

        if out["sep"] is None:
            counts = {d: [len(cells(x, d)) for x in lines] for d in DELIMITERS}
            out["sep"] = max(DELIMITERS, key=lambda d: (min(counts[d], default=1) > 1, len(set(counts[d])) == 1, min(counts[d], default=1))) if lines else ","
        if header is None and len(lines) > 1:
            first, rest = cells(lines[0], out["sep"]), [cells(x, out["sep"]) for x in lines[1:]]
            number = lambda x: bool(re.fullmatch(r"\s*-?\d+(\.\d+)?(e-?\d+)?\s*|\d{4}-\d\d-\d\d.*|true|false", x, re.I))
            header = not any(number(x) for x in first) and any(number(x) for r in rest for x in r)
    out["sep"] = out["sep"] or ","
    out["header"] = bool(header) if not isinstance(header, str) else header.lower() == "true"
    return out


def csv(session, paths: list[str], options: dict, headers: list | None) -> DataFrame:
    d = dialect(session, paths, options)
    reader = session.spark.read.option("sep", d["sep"]).option("quote", d["quote"]).option("escape", d["escape"]).option("multiLine", options.get("PARALLEL", True) is False).option("ignoreLeadingWhiteSpace", False)
    nulls = options.get("NULL_STRINGS", [""])
    reader = reader.option("nullValue", nulls[0] if nulls else "")
    skip = int(options.get("SKIP", 0))
    reader = reader.option("mode", "DROPMALFORMED" if options.get("IGNORE_ERRORS") else "PERMISSIVE")
    if headers:
        schema = T.StructType([T.StructField(n, T.StringType()) for n, _ in headers])
        df = reader.option("header", d["header"]).option("enforceSchema", True).schema(schema).csv(paths)
        from graphloom.functions.registry import cast
        from graphloom.operators.tables import parse_nested

        def typed(n: str, t: str):
            to = parse_type(t, session.catalog.types)
            nested = isinstance(to, (T.ArrayType, T.MapType)) or isinstance(to, T.StructType) and t.upper() != "INTERVAL"
            return (parse_nested(F.col(f"`{n}`"), to) if nested else cast(F.col(f"`{n}`"), T.StringType(), to, t)).alias(n)

        df = df.select(*(typed(n, t) for n, t in headers))
    else:
        df = reader.option("header", d["header"]).option("inferSchema", True).csv(paths)
        if not d["header"]:
            df = df.toDF(*(f"column{i}" for i in range(len(df.columns))))
        df = df.select(*(F.col(f"`{f.name}`").cast("long" if isinstance(f.dataType, T.IntegerType) else "timestamp_ntz" if isinstance(f.dataType, T.TimestampType) else f.dataType).alias(f.name) for f in df.schema))
    for extra in nulls[1:]:
        df = df.select(*(F.when(F.col(f"`{f.name}`").cast("string") == extra, None).otherwise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema))
    if skip:
        df = df.offset(skip - int(d["header"])) if skip > int(d["header"]) else df
    return df


def json(session, paths: list[str], options: dict, headers: list | None) -> DataFrame:
    """An object a line, or files that are one array or object each: the first line that isn't empty tells."""
    whole = not re.search(r"\.(jsonl|ndjson)(\.gz)?$", paths[0].lower())
    if whole and (line := session.spark.read.text(paths[0]).filter("trim(value) <> ''").first()):
        try:
            whole = not isinstance(loads(line["value"]), dict)
        except ValueError:
            pass
    return session.spark.read.option("multiLine", whole).json(paths)


def npy(session, paths: list[str], options: dict, headers: list | None) -> DataFrame:
    """A column for each file, rows numbered by place; a file's bytes are parsed where they are read."""
    import io

    import numpy as np
    import pandas as pd

    frames = []
    for i, path in enumerate(paths):

        def rows(batches):
            for pdf in batches:
                for raw in pdf["content"]:
                    x = np.load(io.BytesIO(raw), allow_pickle=False)
                    for at in range(0, len(x), 65536):
                        part = x[at : at + 65536]
                        yield pd.DataFrame({"i": np.arange(at, at + len(part)), "v": list(part) if part.ndim > 1 else part})

        raw = session.spark.read.format("binaryFile").load(path)
        probe = np.load(io.BytesIO(raw.select("content").first()[0]), allow_pickle=False)
        base = {"f4": "float", "f8": "double", "i8": "bigint", "i4": "int", "i2": "smallint"}[probe.dtype.str[1:]]
        frames.append(raw.select("content").mapInPandas(rows, f"i long, v {base if probe.ndim == 1 else f'array<{base}>'}").withColumnRenamed("v", f"column{i}"))
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, "i")
    return out.drop("i")
