"""Logical types and their Spark types.

Unsigned and 128-bit integers take the next wider Spark type; INTERVAL is struct<months,days,micros>, for Spark's
own intervals can't be compared across units; UNION(a T, ..) is struct<tag,a,..> with one field set; UUID is a string;
fixed arrays are arrays whose length is checked when written.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from graphloom.errors import BindError

INTERVAL = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])
HUGE = T.DecimalType(38, 0)
SIMPLE = {
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "INT64": T.LongType(), "LONG": T.LongType(), "SERIAL": T.LongType(), "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0),
    "INT128": HUGE, "UINT128": HUGE, "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(),
    "BLOB": T.BinaryType(), "BYTEA": T.BinaryType(), "BYTES": T.BinaryType(), "UUID": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_SEC": T.TimestampNTZType(),
    "TIMESTAMP_MS": T.TimestampNTZType(), "TIMESTAMP_NS": T.TimestampNTZType(), "TIMESTAMP_TZ": T.TimestampType(), "INTERVAL": INTERVAL, "DURATION": INTERVAL, "JSON": T.StringType(), "ANY": T.NullType(),
}
BOUNDS = {"UINT8": (0, 2**8 - 1), "UINT16": (0, 2**16 - 1), "UINT32": (0, 2**32 - 1), "UINT64": (0, 2**64 - 1), "INT8": (-(2**7), 2**7 - 1), "INT16": (-(2**15), 2**15 - 1), "INT32": (-(2**31), 2**31 - 1), "INT64": (-(2**63), 2**63 - 1)}
KEYS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType, T.StringType, T.DateType, T.TimestampNTZType, T.TimestampType, T.BinaryType)


def split_fields(body: str) -> list[str]:
    """Parts of a type's argument list, cut at commas outside of brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(body[start:i].strip())
            start = i + 1
    return [*out, body[start:].strip()] if body.strip() else []


def parse_type(text: str, named: dict[str, str] | None = None) -> T.DataType:
    text = text.strip()
    if m := re.fullmatch(r"(.*)\[(\d*)\]", text, re.S):
        return T.ArrayType(parse_type(m[1], named))
    if m := re.fullmatch(r"(\w+)\s*\((.*)\)", text, re.S):
        word, body = m[1].upper(), split_fields(m[2])
        if word in ("DECIMAL", "NUMERIC"):
            p, s = (int(x) for x in (*body, "3")[:2]) if len(body) == 1 else (int(x) for x in body)
            if p > 38 or s > p:
                raise BindError(f"{text}: precision is 38 at most, and the scale no more than the precision")
            return T.DecimalType(p, s)
        if word == "STRUCT":
            return T.StructType([T.StructField(*_field(f, named)) for f in body])
        if word == "UNION":
            return T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(*_field(f, named)) for f in body)])
        if word == "MAP":
            return T.MapType(parse_type(body[0], named), parse_type(body[1], named))
    upper = text.upper()
    if upper in SIMPLE:
        return SIMPLE[upper]
    if upper in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(18, 3)
    for name, of in (named or {}).items():
        if name.upper() == upper:
            return parse_type(of, named)
    raise BindError(f"{text} is no type")


def _field(text: str, named: dict[str, str] | None) -> tuple[str, T.DataType]:
    name, _, kind = text.strip().partition(" ")
    return name.strip("`"), parse_type(kind, named)


NAMES = {T.BooleanType: "BOOL", T.ByteType: "INT8", T.ShortType: "INT16", T.IntegerType: "INT32", T.LongType: "INT64", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "STRING", T.BinaryType: "BLOB", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP_TZ", T.NullType: "ANY"}


def type_name(t: T.DataType) -> str:
    if is_interval(t):
        return "INTERVAL"
    if isinstance(t, T.DecimalType):
        return "INT128" if t == HUGE else "UINT64" if (t.precision, t.scale) == (20, 0) else f"DECIMAL({t.precision}, {t.scale})"
    if isinstance(t, T.ArrayType):
        return f"{type_name(t.elementType)}[]"
    if isinstance(t, T.MapType):
        return f"MAP({type_name(t.keyType)}, {type_name(t.valueType)})"
    if isinstance(t, T.StructType):
        names = t.fieldNames()
        if "_SRC" in names and "_DST" in names:
            return "REL"
        if "_ID" in names and "_LABEL" in names:
            return "NODE"
        if names[:2] == ["_NODES", "_RELS"]:
            return "RECURSIVE_REL"
        word = "UNION" if names[:1] == ["tag"] else "STRUCT"
        return f"{word}({', '.join(f'{f.name} {type_name(f.dataType)}' for f in t.fields[word == 'UNION':])})"
    return NAMES.get(type(t), t.simpleString().upper())


def is_interval(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == INTERVAL.fieldNames()


def is_int(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and t.scale == 0 and t.precision in (20, 38)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType))


def can_order(t: T.DataType) -> bool:
    return is_interval(t) or not isinstance(t, (T.ArrayType, T.StructType, T.MapType))
