"""Catalogue, bulk load, transaction, database and setting statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.catalog import Catalog, Macro, NodeTable, RelTable, Sequence
from graphloom.errors import BindError, RunError
from graphloom.functions.registry import to_text
from graphloom.operators.tables import column_types, declared, node_schema, numbered, put_nodes, put_rels, rel_schema
from graphloom.parser import ast as A
from graphloom.plans.expressions import Compiler
from graphloom.plans.scope import State
from graphloom.sources.scan import scan
from graphloom.storage import staged
from graphloom.types import KEYS, type_name
from graphloom.versions import checkpoint

WRITES = frozenset("create_type create_macro create_graph create_index create_node_table create_node_table_as create_rel_table create_sequence alter drop comment copy_from import".split())


def run_command(session, c: A.Command) -> DataFrame:
    if session.read_only and c.kind in WRITES:
        raise BindError("cannot execute write operations in a read-only transaction")
    found = globals()[f"do_{c.kind}"](session, **{("from_" if k == "from" else k): v for k, v in c.args.items()})
    if c.kind in WRITES:
        session.catalog.version += 1
    return found if isinstance(found, DataFrame) else session.message(found or "done")


def empty(session, schema: T.StructType) -> DataFrame:
    return session.spark.createDataFrame([], schema)


# ---- tables


def _new(session, name: str, if_missing: bool) -> bool:
    if not session.catalog.has_table(name):
        return True
    if if_missing:
        return False
    raise BindError(f"{name} already exists in catalog")


def do_create_node_table(session, name, columns, key, if_missing, options):
    if not _new(session, name, if_missing):
        return f"table {name} already exists"
    names = [n for n, _, _ in columns]
    if len(set(names)) < len(names):
        raise BindError("duplicated column name, column name must be unique")
    if key is None or key not in names:
        raise BindError(f"primary key {key} does not match any of the predefined node properties" if key else "can't find primary key")
    types, words, defaults, serial = column_types(session, columns)
    if not isinstance(types[key], KEYS) or words[key].upper() == "JSON":
        raise BindError(f"primary key {key} has type {words[key]}, which is not supported as a key")
    table = NodeTable(name, key, types, None, words, defaults, serial)
    storage = {k.lower(): v for k, v in options.items()}.get("storage")
    if storage:
        frame = session.spark.read.parquet(storage)
        table.frame, table.foreign = frame.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items())), True
    else:
        table.frame = empty(session, node_schema(table))
    for s in serial:
        session.catalog.sequences[f"{name}_{s}_serial"] = Sequence(f"{name}_{s}_serial", 0, 1, 0, 2**63 - 1, False)
    session.catalog.nodes[name] = table
    return f"table {name} has been created"


def do_create_node_table_as(session, name, source, if_missing):
    if not _new(session, name, if_missing):
        return f"table {name} already exists"
    df = _source(session, source)
    types = {f.name.split(".")[-1]: f.dataType for f in df.schema}
    df = df.toDF(*types)
    table = NodeTable(name, df.columns[0], types, empty(session, T.StructType([T.StructField(n, t) for n, t in types.items()])), {n: type_name(t) for n, t in types.items()})
    put_nodes(table, df)
    session.catalog.nodes[name] = table
    return f"table {name} has been created"


def _source(session, source) -> DataFrame:
    return scan(session, source.source, source.options, source.headers) if isinstance(source, A.LoadFrom) else session.run(source)


def do_create_rel_table(session, name, pairs, columns, multiplicity, if_missing, options, source):
    if not _new(session, name, if_missing):
        return f"table {name} already exists"
    pairs = [(session.catalog.node(a).name, session.catalog.node(b).name) for a, b in pairs]
    if len(set(pairs)) < len(pairs):
        raise BindError("found duplicate FROM-TO")
    if not pairs:
        raise BindError("a rel table needs FROM and TO")
    df = _source(session, source) if source is not None else None
    if df is not None and not columns:
        columns = [(c.split(".")[-1], type_name(df.schema[c].dataType), None) for c in df.columns[2:]]
    types, words, defaults, _ = column_types(session, columns)
    table = RelTable(name, pairs, types, {}, words, defaults, multiplicity)
    options = {k.lower(): v for k, v in options.items()}
    for pair in pairs:
        schema = rel_schema(session, table, pair)
        if "storage" in options:
            frame = session.spark.read.parquet(options["storage"])
            cols = frame.columns
            table.frames[pair] = frame.select(F.col(f"`{cols[0]}`").cast(schema["_src"].dataType).alias("_src"), F.col(f"`{cols[1]}`").cast(schema["_dst"].dataType).alias("_dst"), F.monotonically_increasing_id().cast("string").alias("_eid"), *(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))
            table.foreign = True
        else:
            table.frames[pair] = empty(session, schema)
    session.catalog.rels[name] = table
    if df is not None:
        _load_rels(session, table, pairs[0], df, list(types), {})
    return f"table {name} has been created"


def do_alter(session, table, do, **a):
    t = session.catalog.table(table)
    node = isinstance(t, NodeTable)
    if do == "rename":
        if session.catalog.has_table(a["to"]):
            raise BindError(f"{a['to']} already exists in catalog")
        entries = session.catalog.nodes if node else session.catalog.rels
        items = [(a["to"] if k == t.name else k, v) for k, v in entries.items()]
        entries.clear()
        entries.update(items)
        for r in session.catalog.rels.values() if node else ():
            swap = lambda p: tuple(a["to"] if x == t.name else x for x in p)
            r.pairs, r.frames = [swap(p) for p in r.pairs], {swap(p): f for p, f in r.frames.items()}
        t.name = a["to"]
        return "table renamed"
    if do == "add_pair":
        pair = tuple(session.catalog.node(x).name for x in a["pair"])
        if pair in t.pairs:
            if a["if_missing"]:
                return "the pair exists"
            raise BindError(f"{pair[0]}->{pair[1]} already exists in {t.name} table")
        t.pairs.append(pair)
        t.frames[pair] = empty(session, rel_schema(session, t, pair))
        return "pair added"
    if do == "drop_pair":
        pair = tuple(session.catalog.node(x).name for x in a["pair"])
        if pair not in t.pairs:
            if a["if_exists"]:
                return "no such pair"
            raise BindError(f"{pair[0]}->{pair[1]} does not exist in {t.name} table")
        t.pairs.remove(pair)
        del t.frames[pair]
        return "pair dropped"

    def frames(change) -> None:
        if node:
            t.frame = change(t.frame)
        else:
            t.frames = {p: change(f) for p, f in t.frames.items()}

    if do == "add":
        name, word, default = a["column"]
        if name in t.columns:
            if a["if_missing"]:
                return f"property {name} exists"
            raise BindError(f"{t.name} table already has property {name}")
        types, words, _, _ = column_types(session, [a["column"]])
        t.columns |= types
        t.types |= words
        value = Compiler(session, State(session.one, {}))(default) if default is not None else None
        col = declared(session, t, name, value.col, value.type) if value else F.lit(None).cast(types[name])
        if default is not None:
            t.defaults[name] = default
        frames(lambda f: f.withColumn(name, col))
        return "property added"
    old = a["name"]
    if old not in t.columns:
        if a.get("if_exists"):
            return f"no property {old}"
        raise BindError(f"{t.name} table does not have property {old}")
    if do == "drop":
        if node and old == t.key:
            raise BindError(f"cannot drop property {old} in table {t.name} because it is used as primary key")
        if any(i["table"] == t.name and old in i["columns"] for i in session.catalog.indexes.values()):
            raise BindError(f"cannot drop property {old} in table {t.name} because it is used in an index")
        for d in (t.columns, t.types, t.defaults):
            d.pop(old, None)
        frames(lambda f: f.drop(old))
        return "property dropped"
    to = a["to"]
    if to in t.columns:
        raise BindError(f"property {to} already exists in table {t.name}")
    for field in ("columns", "types", "defaults"):
        setattr(t, field, {to if k == old else k: v for k, v in getattr(t, field).items()})
    frames(lambda f: f.withColumnRenamed(old, to))
    if node and t.key == old:
        t.key = to
    return "property renamed"


def do_drop(session, kind, name, if_exists):
    c = session.catalog
    if kind == "table":
        if not c.has_table(name):
            if if_exists:
                return f"table {name} does not exist"
            raise BindError(f"table {name} does not exist")
        t = c.table(name)
        if isinstance(t, NodeTable):
            used = [r.name for r in c.rels.values() if any(t.name in p for p in r.pairs)]
            if used:
                raise BindError(f"cannot delete node table {t.name} because it is referenced by relationship table {used[0]}")
            del c.nodes[t.name]
        else:
            del c.rels[t.name]
        for i in [k for k, x in c.indexes.items() if x["table"] == t.name]:
            del c.indexes[i]
        return f"table {t.name} has been dropped"
    entries = {"sequence": c.sequences, "macro": c.macros, "type": c.types, "index": c.indexes, "graph": session.databases}[kind]
    found = c.find(entries, name)
    if found is None:
        if if_exists:
            return f"{kind} {name} does not exist"
        raise BindError(f"{kind} {name} does not exist")
    if kind == "sequence" and found.endswith("_serial"):
        raise BindError(f"sequence {found} belongs to a SERIAL column")
    if kind == "graph" and found == session.used:
        session.used = None
    del entries[found]
    return f"{kind} {found} has been dropped"


def do_comment(session, name, text):
    session.catalog.table(name).comment = text
    return f"table {name} comment updated"


def do_create_sequence(session, name, if_missing, increment, min, max, start, cycle):  # noqa: A002
    if session.catalog.find(session.catalog.sequences, name):
        if if_missing:
            return f"sequence {name} already exists"
        raise BindError(f"{name} already exists in catalog")
    if increment == 0:
        raise BindError("INCREMENT must be non-zero")
    low = min if min is not None else (1 if increment > 0 else -(2**63))
    high = max if max is not None else (2**63 - 1 if increment > 0 else -1)
    if low >= high:
        raise BindError("MINVALUE must be less than MAXVALUE")
    first = start if start is not None else (low if increment > 0 else high)
    if not low <= first <= high:
        raise BindError("START must lie between MINVALUE and MAXVALUE")
    session.catalog.sequences[name] = Sequence(name, first, increment, low, high, cycle)
    return f"sequence {name} has been created"


def do_create_type(session, name, type):  # noqa: A002
    from graphloom.types import parse_type

    if name in session.catalog.types:
        raise BindError(f"duplicated type name: {name}")
    parse_type(type, session.catalog.types)
    session.catalog.types[name] = type
    return f"type {name} has been created"


def do_create_macro(session, name, params, body):
    if session.catalog.find(session.catalog.macros, name):
        raise BindError(f"macro {name} already exists")
    session.catalog.macros[name.lower()] = Macro(name, params, body)
    return f"macro {name} has been created"


def do_create_index(session, name, table, columns, if_missing):
    t = session.catalog.node(table)
    if name in session.catalog.indexes:
        if if_missing:
            return f"index {name} already exists"
        raise BindError(f"index {name} already exists in table {t.name}")
    for c in columns:
        if c not in t.columns:
            raise BindError(f"cannot find property {c} for {table}")
    session.catalog.indexes[name] = {"table": t.name, "columns": columns, "kind": "HASH", "options": {}}
    return f"index {name} has been created"


def do_unsupported(session, what, **_):
    raise BindError(what)


# ---- graphs, databases, transactions


def do_create_graph(session, name, any, if_missing):  # noqa: A002
    if name in session.databases:
        if if_missing:
            return f"graph {name} already exists"
        raise BindError(f"graph {name} already exists")
    session.databases[name] = made = Catalog(any_graph=any)
    if any:
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("data", T.StringType())])
        made.nodes["_nodes"] = NodeTable("_nodes", "id", {f.name: f.dataType for f in schema}, empty(session, schema), {"id": "SERIAL", "label": "STRING", "data": "JSON"}, serial={"id"})
        made.sequences["_nodes_id_serial"] = Sequence("_nodes_id_serial", 0, 1, 0, 2**63 - 1, False)
        edge = RelTable("_edges", [("_nodes", "_nodes")], {"label": T.StringType(), "data": T.StringType()}, {}, {"label": "STRING", "data": "JSON"})
        made.rels["_edges"] = edge
        outer, session.used = session.used, name
        edge.frames[("_nodes", "_nodes")] = empty(session, rel_schema(session, edge, ("_nodes", "_nodes")))
        session.used = outer
    return f"graph {name} has been created"


def do_use_graph(session, name):
    if name.lower() == "main":
        session.used = None
        return "used graph main"
    if name not in session.databases:
        raise BindError(f"no graph named {name}")
    session.used = name
    return f"used graph {name}"


do_use = do_use_graph


def do_attach(session, path, alias, options):
    """Another engine's tables: a folder that EXPORT DATABASE wrote, a folder of Parquet tables, or a JDBC url."""
    kind = str(options.get("DBTYPE", "native")).lower()
    name = alias or path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    if name in session.databases:
        raise BindError(f"duplicate attached database name: {name}")
    session.databases[name] = made = Catalog()
    outer, session.used = session.used, name
    try:
        if kind in ("postgres", "sqlite", "duckdb", "jdbc"):
            url = path if path.startswith("jdbc:") else f"jdbc:{'postgresql' if kind == 'postgres' else kind}:{path}"
            for table in options.get("TABLES", []):
                frame = session.spark.read.jdbc(url, table)
                made.nodes[table] = NodeTable(table, frame.columns[0], {f.name: f.dataType for f in frame.schema}, frame, foreign=True)
        elif kind == "parquet":
            for table in options.get("TABLES", []):
                frame = session.spark.read.parquet(f"{path}/{table}.parquet")
                made.nodes[table] = NodeTable(table, frame.columns[0], {f.name: f.dataType for f in frame.schema}, frame, foreign=True)
        else:
            do_import(session, path)
    except BaseException:
        del session.databases[name]
        raise
    finally:
        session.used = outer
    return "attached database successfully"


def do_detach(session, name):
    if name not in session.databases:
        raise BindError(f"database: {name} does not exist")
    if name == session.used:
        session.used = None
    del session.databases[name]
    return "detached database successfully"


def do_begin(session, read_only):
    if session.explicit:
        raise RunError("connection already has an active transaction; it must be committed or rolled back")
    session.begin(explicit=True, read_only=read_only)
    return "transaction begun"


def _open(session) -> None:
    if not session.explicit:
        raise RunError("no active transaction")


def do_commit(session):
    _open(session)
    session.commit()
    return "committed"


def do_rollback(session):
    _open(session)
    session.rollback()
    return "rolled back"


def do_checkpoint(session):
    if session.explicit:
        raise RunError("cannot checkpoint within a transaction")
    with session.shared.lock:
        if session.shared.open:
            raise RunError("cannot checkpoint while other sessions have open transactions")
        checkpoint(session.shared.catalog)
    return "checkpoint done"


def do_extension(session, do, name):
    known = ("json", "fts", "vector", "algo", "httpfs", "duckdb", "postgres", "sqlite", "delta", "iceberg", "azure", "unity_catalog", "neo4j", "llm")
    name = name.strip("'\"").lower()
    if name not in known:
        raise BindError(f"{name} is not an official extension")
    if do in ("install", "load"):
        session.extensions.add(name)
    elif do == "uninstall":
        session.extensions.discard(name)
    return f"extension: {name} has been {do}ed"


def do_setting(session, name, value):
    key = name.lower()
    if key not in session.settings:
        raise BindError(f"invalid option name: {name}")
    found = Compiler(session, State(session.one, {}))(value).value
    if type(found) is not type(session.settings[key]):
        raise BindError(f"{name} takes a value of type {type(session.settings[key]).__name__}")
    if key == "recursive_pattern_semantic" and found.upper() not in ("WALK", "TRAIL", "ACYCLIC"):
        raise BindError(f"cannot parse {found} as a path semantic; supported are WALK, TRAIL, ACYCLIC")
    session.settings[key] = found
    if key == "threads" and found:
        session.spark.conf.set("spark.sql.shuffle.partitions", str(found))
    return f"{name} = {found}"


# ---- bulk load and export


def do_copy_from(session, table, columns, source, by_column, options):
    t = session.catalog.table(table)
    df = scan(session, source if not by_column or isinstance(source, list) else [source], options, _headers(session, t, columns, source, options))
    if isinstance(t, NodeTable):
        return _load_nodes(session, t, df, columns, options)
    pair = t.pairs[0]
    if len(t.pairs) > 1:
        ends = {k.lower(): v for k, v in options.items()}
        if "from" not in ends or "to" not in ends:
            raise BindError(f"the table {t.name} has multiple FROM and TO pairs; give them by the options from and to")
        pair = (session.catalog.node(ends["from"]).name, session.catalog.node(ends["to"]).name)
        if pair not in t.pairs:
            raise BindError(f"rel table {t.name} does not connect {pair[0]} to {pair[1]}")
    return _load_rels(session, t, pair, df, columns or list(t.columns), options)


def _headers(session, t, columns, source, options) -> list | None:
    """Text files are read by the table's own types, so nothing has to be inferred."""
    paths = source if isinstance(source, list) else [source] if isinstance(source, str) else []
    from graphloom.sources.scan import kind_of

    if not paths or kind_of(paths[0]) != "csv":
        return None
    names = columns or [c for c in t.columns if c not in getattr(t, "serial", ())]
    own = [(n, "STRING") for n in names]
    return own if isinstance(t, NodeTable) else [("_from", "STRING"), ("_to", "STRING"), *((n, "STRING") for n in (columns or t.columns))]


def _typed(session, t, df: DataFrame, names: list[str], offset: int = 0) -> list:
    if len(df.columns) - offset != len(names):
        raise BindError(f"number of columns mismatch: expected {len(names) + offset} but got {len(df.columns)}")
    return [declared(session, t, n, F.col(f"`{c}`"), df.schema[c].dataType).alias(n) for n, c in zip(names, df.columns[offset:], strict=True)]


def _load_nodes(session, t: NodeTable, df: DataFrame, columns, options):
    names = columns or [c for c in t.columns if c not in t.serial]
    rows = df.select(*_typed(session, t, df, names))
    for c in t.columns:
        if c in names:
            continue
        if c in t.serial:
            seq = session.sequence(f"{t.name}_{c}_serial")
            first = seq.start if seq.value is None else seq.value + 1
            rows = staged(numbered(rows, c, first))
            seq.value = first + rows.count() - 1
        elif c in t.defaults:
            value = Compiler(session, State(session.one, {}))(t.defaults[c])
            rows = rows.withColumn(c, declared(session, t, c, value.col, value.type))
        else:
            rows = rows.withColumn(c, F.lit(None).cast(t.columns[c]))
    if options.get("IGNORE_ERRORS"):
        rows = staged(rows)
        key = F.col(f"`{t.key}`")
        good = rows.filter(key.isNotNull()).join(t.frame.select(key.alias("__k")), key == F.col("__k"), "left_anti").dropDuplicates([t.key])
        _warn(session, rows.filter(key.isNull()).select(F.lit("found NULL as primary key").alias("message")))
        _warn(session, rows.filter(key.isNotNull()).groupBy(key.alias("k")).count().filter("count > 1").select(F.concat(F.lit("found duplicated primary key value "), F.col("k").cast("string")).alias("message")))
        rows = good
    return f"{put_nodes(t, rows)} tuples have been copied to the {t.name} table"


def _warn(session, messages: DataFrame) -> None:
    session.warnings.append(staged(messages.limit(int(session.setting("warning_limit")))))


def _load_rels(session, t: RelTable, pair, df: DataFrame, names: list[str], options):
    schema = rel_schema(session, t, pair)
    ends = [F.col(f"`{c}`").cast(schema[n].dataType).alias(n) for c, n in zip(df.columns[:2], ("_src", "_dst"), strict=True)]
    rows = df.select(*ends, F.call_function("uuid").alias("_eid"), *_typed(session, t, df, names, 2))
    for c in t.columns:
        if c not in names:
            value = Compiler(session, State(session.one, {}))(t.defaults[c]) if c in t.defaults else None
            rows = rows.withColumn(c, declared(session, t, c, value.col, value.type) if value else F.lit(None).cast(t.columns[c]))
    rows = staged(rows)
    bad = None
    for end, of in (("_src", pair[0]), ("_dst", pair[1])):
        node = session.catalog.node(of)
        missing = rows.join(node.frame.select(F.col(f"`{node.key}`").alias("__k")), F.col(end) == F.col("__k"), "left_anti")
        if options.get("IGNORE_ERRORS"):
            _warn(session, missing.select(F.concat(F.lit("unable to find primary key value "), F.coalesce(F.col(end).cast("string"), F.lit("NULL"))).alias("message")))
            gone = missing.select("_eid")
            bad = gone if bad is None else bad.unionByName(gone)
        elif lost := missing.limit(1).collect():
            raise RunError(f"unable to find primary key value {lost[0][end]}")
    if bad is not None:
        rows = rows.join(bad.distinct(), "_eid", "left_anti")
    rows = staged(rows) if bad is not None else rows
    put_rels(session, t, pair, rows)
    return f"{rows.count()} tuples have been copied to the {t.name} table"


def write(session, df: DataFrame, path: str, options: dict) -> None:
    options = {k.upper(): v for k, v in options.items()}
    name = path.lower().rstrip("/")
    if name.endswith(".parquet"):
        codec = {"UNCOMPRESSED": "none", "SNAPPY": "snappy", "ZSTD": "zstd", "GZIP": "gzip", "LZ4_RAW": "lz4_raw"}.get(str(options.get("COMPRESSION", "SNAPPY")).upper())
        if codec is None:
            raise BindError(f"unrecognized parquet compression option: {options['COMPRESSION']}")
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    elif name.endswith((".csv", ".tsv", ".txt", ".csv.gz")):
        quote = options.get("QUOTE", '"')
        flat = df.select(*(to_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
        writer = flat.write.mode("overwrite").option("header", bool(options.get("HEADER", True))).option("sep", options.get("DELIM", options.get("DELIMITER", ","))).option("quote", quote).option("escape", options.get("ESCAPE", quote)).option("quoteAll", bool(options.get("FORCE_QUOTE", False)))
        (writer.option("compression", "gzip") if name.endswith(".gz") else writer).csv(path)
    elif name.endswith((".json", ".jsonl")):
        df.write.mode("overwrite").json(path)
    else:
        raise BindError(f"cannot export to {path}: its suffix names no format")


def do_copy_to(session, query, path, options):
    df = session.run(query)
    write(session, df, path, options)
    return f"copied to {path}"


def _quoted(x: str) -> str:
    return "`" + x + "`"


def schema_script(session) -> tuple[list[str], list[str]]:
    """Statements that make the catalogue anew, and those that load its tables (with {path} for the folder)."""
    c, ddl, load = session.catalog, [], []
    cols = lambda t: [f"{_quoted(n)} {t.types.get(n) or type_name(k)}" for n, k in t.columns.items()]
    for n, t in c.types.items():
        ddl.append(f"CREATE TYPE {_quoted(n)} AS {t};")
    for s in c.sequences.values():
        if not s.name.endswith("_serial"):
            start = s.start if s.value is None else s.value + s.increment
            ddl.append(f"CREATE SEQUENCE {_quoted(s.name)} INCREMENT {s.increment} MINVALUE {s.low} MAXVALUE {s.high} START {start if s.low <= start <= s.high else s.low} {'CYCLE' if s.cycle else 'NO CYCLE'};")
    for t in c.nodes.values():
        ddl.append(f"CREATE NODE TABLE {_quoted(t.name)}({', '.join(cols(t))}, PRIMARY KEY({_quoted(t.key)}));")
        names = [n for n in t.columns if n not in t.serial]
        load.append(f"COPY {_quoted(t.name)}({', '.join(map(_quoted, names))}) FROM '{{path}}/{t.name}.parquet';")
    for t in c.rels.values():
        pairs = ", ".join(f"FROM {_quoted(a)} TO {_quoted(b)}" for a, b in t.pairs)
        ddl.append(f"CREATE REL TABLE {_quoted(t.name)}({', '.join([pairs, *cols(t), t.multiplicity])});")
        for a, b in t.pairs:
            load.append(f"COPY {_quoted(t.name)} FROM '{{path}}/{t.name}_{a}_{b}.parquet' (from='{a}', to='{b}');")
    return ddl, load


def do_export(session, path, options):
    """schema.cypher and copy.cypher beside a Parquet table for each node table and each pair of a rel table."""
    ddl, load = schema_script(session)
    text = lambda lines, name: session.spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    text(ddl, "schema.cypher")
    text(load, "copy.cypher")
    for t in session.catalog.nodes.values():
        t.frame.select(*(F.col(f"`{c}`") for c in t.columns if c not in t.serial)).write.mode("overwrite").parquet(f"{path}/{t.name}.parquet")
    for t in session.catalog.rels.values():
        for (a, b), f in t.frames.items():
            f.drop("_eid").write.mode("overwrite").parquet(f"{path}/{t.name}_{a}_{b}.parquet")
    return "exported database successfully"


def do_import(session, path):
    if session.catalog.nodes or session.catalog.rels:
        raise RunError("cannot import: the database isn't empty")
    for name in ("schema.cypher", "copy.cypher"):
        script = "\n".join(r[0] for r in session.spark.read.text(f"{path}/{name}", wholetext=True).collect())
        session.script(script.replace("{path}", path))
    return "imported database successfully"

