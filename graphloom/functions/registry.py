"""Scalar functions as Spark columns.

A function gets its arguments' columns c, their Spark types t and, where an argument is a literal, its value v (else
MISSING), and gives a column. Unless noted a NULL argument gives NULL. All of them stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import BindError
from graphloom.types import HUGE, is_int, is_interval, is_time, type_name

MISSING = object()
SCALARS: dict[str, Callable] = {}


def scalar(*names: str):
    def put(f):
        for n in names:
            SCALARS[n] = f
        return f

    return put


def simple(names: str, f: Callable) -> None:
    for n in names.split():
        SCALARS[n] = lambda c, t, v, f=f: f(*c)


def null_if_any(out: Column, *c: Column) -> Column:
    """NULL where one of c is, for functions of Spark that skip NULLs."""
    test = c[0].isNull()
    for x in c[1:]:
        test = test | x.isNull()
    return F.when(~test, out)


def call(name: str, *c: Column) -> Column:
    return F.call_function(name, *c)


# ---- intervals


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(months).cast("int").alias("months"), col(days).cast("int").alias("days"), col(micros).cast("long").alias("micros"))


def interval_micros(i: Column) -> Column:
    """For comparisons: months count 30 days."""
    return (i["months"].cast("decimal(38,0)") * 30 + i["days"]) * 86_400_000_000 + i["micros"]


def plus_interval(at: Column, i: Column, sign: int = 1) -> Column:
    """A timestamp moved by months, then days, then microseconds."""
    ts = at.cast("timestamp_ntz")
    day = F.date_add(F.add_months(ts.cast("date"), i["months"] * sign), (i["days"] * sign).cast("int"))
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(ts.cast("date").cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + micros + i["micros"] * sign).cast("timestamp_ntz")


def parse_interval(s: Column) -> Column:
    """'3 days 2 hours', '1 year 00:01:02.5': sums of its parts."""
    low = F.lower(s)

    def part(words: str) -> Column:
        found = F.regexp_extract_all(low, F.lit(rf"(-?\d+)\s*(?:{words})(?![a-z])"), F.lit(1))
        return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    clock = F.regexp_extract(low, r"(-?\d+):(\d+):(\d+(?:\.\d+)?)", 0)
    at = lambda i: F.coalesce(F.regexp_extract(low, r"(-?\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast("double"), F.lit(0.0))
    micros = part("microseconds?|us|usec|usecs") + part("milliseconds?|ms|msec|msecs") * 1000 + part("seconds?|secs?|s") * 1_000_000 + part("minutes?|mins?|m") * 60_000_000 + part("hours?|hrs?|h") * 3_600_000_000
    micros = micros + F.when(clock != "", F.round((at(1) * 3600 + at(2) * 60 + at(3)) * 1_000_000).cast("long")).otherwise(0)
    months = part("years?|yrs?|y") * 12 + part("months?|mons?") + part("decades?") * 120 + part("centur(?:y|ies)") * 1200
    return F.when(s.isNotNull(), interval(months, part("days?|d") + part("weeks?|w") * 7, micros))


# ---- operators


def widest(*t: T.DataType) -> T.DataType:
    """The type that numbers of these types share."""
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if any(isinstance(x, T.DoubleType) for x in t):
        return T.DoubleType()
    if any(isinstance(x, T.FloatType) for x in t):
        return T.DoubleType() if any(isinstance(x, (T.LongType, T.DecimalType)) for x in t) else T.FloatType()
    if any(isinstance(x, T.DecimalType) for x in t):
        return next(x for x in t if isinstance(x, T.DecimalType))
    return max((x for x in t if type(x) in order), key=lambda x: order.index(type(x)), default=T.LongType())


@scalar("+", "add")
def plus(c, t, v):
    a, b = t
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return F.concat(*c)
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return F.concat(*(x.cast("string") for x in c))
    if is_interval(b) and (is_time(a) or isinstance(a, T.DateType)):
        moved = plus_interval(c[0], c[1])
        return moved.cast("date") if isinstance(a, T.DateType) else moved
    if is_interval(a) and (is_time(b) or isinstance(b, T.DateType)):
        return plus(c[::-1], t[::-1], v[::-1])
    if is_interval(a) and is_interval(b):
        return F.when(c[0].isNotNull() & c[1].isNotNull(), interval(c[0]["months"] + c[1]["months"], c[0]["days"] + c[1]["days"], c[0]["micros"] + c[1]["micros"]))
    if isinstance(a, T.DateType) and is_int(b):
        return F.date_add(c[0], c[1].cast("int"))
    if isinstance(b, T.DateType) and is_int(a):
        return F.date_add(c[1], c[0].cast("int"))
    return c[0] + c[1]


@scalar("-", "subtract")
def minus(c, t, v):
    a, b = t
    if isinstance(a, T.DateType) and isinstance(b, T.DateType):
        return F.datediff(*c).cast("long")
    if is_interval(b) and (is_time(a) or isinstance(a, T.DateType)):
        moved = plus_interval(c[0], c[1], -1)
        return moved.cast("date") if isinstance(a, T.DateType) else moved
    if is_time(a) and is_time(b):
        micros = F.unix_micros(c[0].cast("timestamp")) - F.unix_micros(c[1].cast("timestamp"))
        day = F.lit(86_400_000_000)
        return F.when(micros.isNotNull(), interval(0, call("div", micros, day), micros % day))
    if is_interval(a) and is_interval(b):
        return F.when(c[0].isNotNull() & c[1].isNotNull(), interval(c[0]["months"] - c[1]["months"], c[0]["days"] - c[1]["days"], c[0]["micros"] - c[1]["micros"]))
    if isinstance(a, T.DateType) and is_int(b):
        return F.date_sub(c[0], c[1].cast("int"))
    return c[0] - c[1]


@scalar("*", "multiply")
def times(c, t, v):
    if is_interval(t[0]):
        return F.when(c[0].isNotNull() & c[1].isNotNull(), interval(c[0]["months"] * c[1], c[0]["days"] * c[1], c[0]["micros"] * c[1]))
    return c[0] * c[1]


@scalar("/", "divide")
def divide(c, t, v):
    if is_interval(t[0]):
        d = lambda x: x / c[1]
        return F.when(c[0].isNotNull() & c[1].isNotNull(), interval(F.floor(d(c[0]["months"])), F.floor(d(c[0]["days"])), F.floor(d(c[0]["micros"]))))
    if is_int(t[0]) and is_int(t[1]):
        out = widest(*t)
        return call("div", c[0], c[1]).cast(out if isinstance(out, T.IntegralType) else HUGE)
    return c[0] / c[1]


simple("%", lambda a, b: a % b)
SCALARS["modulo"] = SCALARS["%"]
simple("^ pow power", lambda a, b: F.pow(a.cast("double"), b.cast("double")))
simple("& bitwise_and", lambda a, b: a.cast("long").bitwiseAND(b.cast("long")))
simple("| bitwise_or", lambda a, b: a.cast("long").bitwiseOR(b.cast("long")))
simple("bitwise_xor", lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")))
simple("<< bitshift_left", lambda a, b: call("shiftleft", a.cast("long"), b.cast("int")))
simple(">> bitshift_right", lambda a, b: call("shiftright", a.cast("long"), b.cast("int")))


@scalar("neg", "negate")
def negate(c, t, v):
    if is_interval(t[0]):
        return F.when(c[0].isNotNull(), interval(-c[0]["months"], -c[0]["days"], -c[0]["micros"]))
    return -c[0]


def _comparable(c, t):
    if is_interval(t[0]) or is_interval(t[1]):
        return tuple(interval_micros(x) if is_interval(k) else x for x, k in zip(c, t, strict=True))
    if any(isinstance(x, T.MapType) for x in t):
        return tuple(F.array_sort(F.map_entries(x)) for x in c)
    date = [isinstance(x, T.DateType) for x in t]
    text = [isinstance(x, T.StringType) for x in t]
    if any(text) and not all(text) and not any(isinstance(x, T.NullType) for x in t):
        other = t[0] if text[1] else t[1]
        if is_time(other) or any(date):
            return tuple(x.cast(other) for x in c)
    return c


def comparison(names: str, f: Callable) -> None:
    for n in names.split():
        SCALARS[n] = lambda c, t, v, f=f: f(*_comparable(c, t))


comparison("= equals", lambda a, b: a == b)
comparison("<> not_equals", lambda a, b: a != b)
comparison("< less_than", lambda a, b: a < b)
comparison("<= less_than_equals", lambda a, b: a <= b)
comparison("> greater_than", lambda a, b: a > b)
comparison(">= greater_than_equals", lambda a, b: a >= b)
simple("and", lambda a, b: a.cast("boolean") & b.cast("boolean"))
simple("or", lambda a, b: a.cast("boolean") | b.cast("boolean"))
simple("xor", lambda a, b: (a.cast("boolean") | b.cast("boolean")) & ~(a.cast("boolean") & b.cast("boolean")))
simple("not", lambda a: ~a.cast("boolean"))
simple("isnull", lambda a: a.isNull())
simple("isnotnull", lambda a: a.isNotNull())

# ---- arithmetic

for _n in "acos asin atan cbrt cos degrees radians sin tan sqrt".split():
    simple(_n, lambda a, n=_n: call(n, a.cast("double")))
simple("atan2", lambda a, b: F.atan2(a.cast("double"), b.cast("double")))
simple("cot", lambda a: F.cot(a.cast("double")))
SCALARS["abs"] = lambda c, t, v: F.abs(c[0])
SCALARS["ceil"] = SCALARS["ceiling"] = lambda c, t, v: F.ceil(c[0]).cast(t[0])
SCALARS["floor"] = lambda c, t, v: F.floor(c[0]).cast(t[0])


def _log(f):
    def run(a):
        x = a.cast("double")
        return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(f(x))

    return run


simple("ln", _log(F.ln))
simple("log log10", _log(F.log10))
simple("log2", _log(F.log2))
simple("pi", lambda: F.lit(math.pi))
simple("sign", lambda a: F.signum(a.cast("double")).cast("long"))
SCALARS["round"] = lambda c, t, v: call("round", c[0].cast("double"), c[1].cast("int") if len(c) > 1 else F.lit(0))
simple("even", lambda a: F.when(a >= 0, F.ceil(a.cast("double") / 2) * 2).otherwise(F.floor(a.cast("double") / 2) * 2).cast("double"))
simple("factorial", lambda a: F.factorial(a.cast("int")))
simple("random rand", lambda: F.rand())
simple("setseed", lambda a: F.when(a.isNotNull(), F.lit(None).cast("int")))

#: Lanczos coefficients, g = 7, n = 9. Fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _lgamma_positive(x: Column) -> Column:
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, k in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(k) / (z + i)
    w = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(w) - w + F.log(total)


def _lgamma(a):
    x = a.cast("double")
    return F.when(x < 0.5, F.log(F.lit(math.pi) / F.abs(F.sin(F.lit(math.pi) * x))) - _lgamma_positive(1 - x)).otherwise(_lgamma_positive(x))


simple("lgamma", _lgamma)
simple("gamma", lambda a: F.when(a.cast("double") < 0.5, F.lit(math.pi) / (F.sin(F.lit(math.pi) * a.cast("double")) * F.exp(_lgamma_positive(1 - a.cast("double"))))).otherwise(F.exp(_lgamma_positive(a.cast("double")))))

# ---- strings

simple("lower tolower lcase", F.lower)
simple("upper toupper ucase", F.upper)
simple("trim", lambda a: F.trim(a))
simple("ltrim", lambda a: F.ltrim(a))
simple("rtrim", lambda a: F.rtrim(a))
simple("reverse", lambda a: F.reverse(a))
simple("repeat", lambda a, n: call("repeat", a, n.cast("int")))
simple("replace", lambda a, b, d: F.replace(a, b, d))
simple("starts_with prefix", lambda a, b: F.startswith(a, b))
simple("ends_with suffix", lambda a, b: F.endswith(a, b))
simple("contains", lambda a, b: F.contains(a, b))
simple("lpad", lambda a, n, p: call("lpad", a, n.cast("int"), p))
simple("rpad", lambda a, n, p: call("rpad", a, n.cast("int"), p))
simple("left", lambda a, n: F.when(n >= 0, call("left", a, n.cast("int"))).otherwise(call("left", a, F.greatest(F.length(a) + n, F.lit(0)).cast("int"))))
simple("right", lambda a, n: F.when(n >= 0, call("right", a, n.cast("int"))).otherwise(call("right", a, F.greatest(F.length(a) + n, F.lit(0)).cast("int"))))
simple("initcap", lambda a: F.concat(F.upper(call("left", a, F.lit(1))), F.lower(call("substring", a, F.lit(2), F.length(a)))))
simple("levenshtein", lambda a, b: F.levenshtein(a, b).cast("long"))
simple("string_split str_split string_to_array", lambda a, b: F.when(b == "", F.array(a)).otherwise(F.split(a, F.concat(F.lit("\\Q"), b, F.lit("\\E")), -1)))
simple("split_part", lambda a, b, n: F.when(n > 0, call("split_part", a, b, F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.when(n.isNotNull() & a.isNotNull(), F.lit(""))))


@scalar("substr", "substring")
def substr(c, t, v):
    n = c[2] if len(c) > 2 else F.length(c[0])
    return F.when(c[1] >= 1, call("substring", c[0], c[1].cast("int"), n.cast("int"))).otherwise(null_if_any(F.lit(""), *c))


@scalar("concat")
def concat(c, t, v):
    """Skips NULLs; lists are joined."""
    if t and all(isinstance(x, T.ArrayType) for x in t):
        return F.concat(*c)
    return F.concat_ws("", *(x.cast("string") for x in c))


simple("concat_ws", lambda sep, *c: call("concat_ws", sep, *(x.cast("string") for x in c)))
simple("regexp_full_match =~", lambda a, b: F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))))
simple("regexp_matches", lambda a, b: F.rlike(a, b))
SCALARS["regexp_extract"] = lambda c, t, v: call("regexp_extract", c[0], c[1], c[2].cast("int") if len(c) > 2 else F.lit(0))
SCALARS["regexp_extract_all"] = lambda c, t, v: call("regexp_extract_all", c[0], c[1], c[2].cast("int") if len(c) > 2 else F.lit(0))
simple("regexp_split_to_array", lambda a, b: F.split(a, b, -1))


@scalar("regexp_replace")
def regexp_replace(c, t, v):
    """The first match, all with 'g'; backslash and digit name a group."""
    to = F.regexp_replace(c[2], r"\\(\d)", r"\$$1")
    if len(c) > 3 and v[3] is not MISSING and "g" in str(v[3]):
        return call("regexp_replace", c[0], c[1], to)
    at = call("regexp_instr", c[0], c[1])
    found = call("regexp_substr", c[0], c[1])
    one = F.concat(call("substring", c[0], F.lit(1), at - 1), call("regexp_replace", found, c[1], to), call("substring", c[0], at + F.length(found), F.length(c[0])))
    return F.when(at > 0, one).otherwise(null_if_any(c[0], *c))


# ---- lists and arrays


@scalar("range")
def range_(c, t, v):
    step = c[2] if len(c) > 2 else F.lit(1)
    step = step.cast("long")
    a, b = (x.cast("long") for x in c[:2])
    some = ((step > 0) & (a <= b)) | ((step < 0) & (a >= b))
    return F.when(some, F.sequence(a, b, step)).otherwise(null_if_any(F.array().cast("array<bigint>"), *c[:2]))


@scalar("size", "cardinality", "len")
def size(c, t, v):
    if isinstance(t[0], T.StringType):
        return F.length(c[0]).cast("long")
    return F.when(c[0].isNotNull(), F.size(c[0]).cast("long"))


def _from_end(n: Column, length: Column) -> Column:
    return F.when(n < 0, length + n + 1).otherwise(n)


@scalar("list_extract", "list_element", "array_extract")
def list_extract(c, t, v):
    if isinstance(t[0], T.StringType):
        at = _from_end(c[1], F.length(c[0]))
        return F.when((at >= 1) & (at <= F.length(c[0])), call("substring", c[0], at.cast("int"), F.lit(1))).otherwise(null_if_any(F.lit(""), *c))
    if isinstance(t[0], T.StructType) and isinstance(v[1], int):
        return c[0][t[0].fieldNames()[v[1] - 1]]
    return call("element_at", c[0], c[1].cast("int"))


@scalar("list_slice", "array_slice")
def list_slice(c, t, v):
    """1-based, both ends included; 0 stands for an open end."""
    text = isinstance(t[0], T.StringType)
    n = F.length(c[0]) if text else F.size(c[0])
    lo = F.greatest(F.when(c[1] == 0, F.lit(1)).otherwise(_from_end(c[1], n)), F.lit(1))
    hi = F.least(F.when(c[2] == 0, n).otherwise(_from_end(c[2], n)), n)
    count = F.greatest(hi - lo + 1, F.lit(0))
    if text:
        return call("substring", c[0], lo.cast("int"), count.cast("int"))
    return F.slice(c[0], lo.cast("int"), count.cast("int"))


simple("list_concat list_cat array_concat array_cat", lambda a, b: F.concat(a, b))
simple("list_append array_append array_push_back", lambda a, b: F.array_append(a, b))
simple("list_prepend array_prepend array_push_front", lambda a, b: F.array_prepend(a, b))
simple("list_position list_indexof array_position array_indexof", lambda a, b: F.array_position(a, b).cast("long"))


@scalar("list_contains", "list_has", "array_contains", "array_has")
def list_contains(c, t, v):
    if isinstance(t[1], T.NullType):
        return F.lit(None).cast("boolean")
    return F.when(c[1].isNotNull(), F.coalesce(F.array_contains(c[0], c[1]), F.when(c[0].isNotNull(), F.lit(False))))


simple("list_has_all array_has_all", lambda a, b: F.size(F.array_except(b, a)) == 0)


@scalar("list_sort")
def list_sort(c, t, v):
    down = len(v) > 1 and str(v[1]).upper() == "DESC"
    last = str(v[2]).upper() == "NULLS LAST" if len(v) > 2 else False
    found = F.sort_array(F.array_compact(c[0]), not down)
    nulls = F.filter(c[0], lambda x: x.isNull())
    return F.concat(found, nulls) if last else F.concat(nulls, found)


@scalar("list_reverse_sort")
def list_reverse_sort(c, t, v):
    return list_sort([c[0]], t[:1], [v[0], "DESC", v[1] if len(v) > 1 else "NULLS FIRST"])


def _summed(kind: T.ArrayType) -> T.DataType:
    """The type of a list's numbers; that of whole numbers for a list of nothing."""
    return T.LongType() if isinstance(kind.elementType, T.NullType) else kind.elementType


@scalar("list_sum")
def list_sum(c, t, v):
    e = _summed(t[0])
    return F.aggregate(F.array_compact(c[0]), F.lit(0).cast(e), lambda a, x: (a + x.cast(e)).cast(e))


@scalar("list_product")
def list_product(c, t, v):
    e = _summed(t[0])
    return F.aggregate(F.array_compact(c[0]), F.lit(1).cast(e), lambda a, x: (a * x.cast(e)).cast(e))


simple("list_distinct", lambda a: F.array_distinct(F.array_compact(a)))
simple("list_unique", lambda a: F.size(F.array_distinct(F.array_compact(a))).cast("long"))
simple("list_any_value", lambda a: F.get(F.array_compact(a), 0))
simple("list_reverse", lambda a: F.reverse(a))
simple("list_to_string array_to_string", lambda sep, a: call("array_join", F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit(""))), sep))


@scalar("list_creation", "array_value")
def list_creation(c, t, v):
    return F.array(*c) if c else F.array()


def _vector(c, f):
    """f over the products of equal places, for arrays of one length."""
    pairs = F.zip_with(c[0], c[1], f)
    sized = F.when(F.size(c[0]) == F.size(c[1]), pairs).otherwise(F.raise_error(F.lit("arrays must have one length")).cast("array<double>"))
    return F.aggregate(sized, F.lit(0.0), lambda a, x: a + x)


def vector(names: str, f: Callable) -> None:
    for n in names.split():

        def run(c, t, v, f=f):
            out = T.FloatType() if isinstance(t[0].elementType, T.FloatType) else T.DoubleType()
            wide = [x.cast("array<double>") for x in c]
            return F.when(c[0].isNotNull() & c[1].isNotNull(), f(wide)).cast(out)

        SCALARS[n] = run


vector("array_inner_product array_dot_product", lambda c: _vector(c, lambda a, b: a * b))
vector("array_squared_distance", lambda c: _vector(c, lambda a, b: (a - b) * (a - b)))
vector("array_distance", lambda c: F.sqrt(_vector(c, lambda a, b: (a - b) * (a - b))))
vector("array_cosine_similarity", lambda c: _vector(c, lambda a, b: a * b) / (F.sqrt(_vector([c[0], c[0]], lambda a, b: a * b)) * F.sqrt(_vector([c[1], c[1]], lambda a, b: a * b))))


@scalar("array_cross_product")
def array_cross_product(c, t, v):
    a, b = c
    g = lambda x, i: F.get(x, i % 3)
    return null_if_any(F.array(*(g(a, i + 1) * g(b, i + 2) - g(a, i + 2) * g(b, i + 1) for i in range(3))), *c)


# ---- casts


def cast(c: Column, t: T.DataType, to: T.DataType, name: str = "") -> Column:
    from graphloom.types import BOUNDS

    if is_interval(to):
        return c if is_interval(t) else parse_interval(c.cast("string"))
    if isinstance(to, T.StringType):
        return to_text(c, t)
    if isinstance(to, T.NumericType) and isinstance(t, (T.FloatType, T.DoubleType)) and is_int(to):
        c = F.bround(c.cast("double"))
    if isinstance(to, T.BinaryType) and isinstance(t, T.StringType):
        return F.encode(c, "UTF-8")
    if is_time(to) and isinstance(t, T.StringType):
        c = F.trim(c)
    out = c.cast(to)
    if name.upper() in BOUNDS and name.upper().startswith("U"):
        lo, hi = BOUNDS[name.upper()]
        wide = c.cast("decimal(38,0)")
        return F.when(wide.isNull() | (wide >= lo) & (wide <= F.lit(str(hi)).cast("decimal(38,0)")), out).otherwise(F.raise_error(F.concat(F.lit("out of range: "), c.cast("string"))).cast(to))
    return out


def to_text(c: Column, t: T.DataType) -> Column:
    """The printed form: True/False, [a,b], {k: v}."""
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), "nan").when(F.abs(c) == math.inf, F.when(c > 0, "inf").otherwise("-inf")).otherwise(F.format_string("%f", c.cast("double")))
    if isinstance(t, T.ArrayType):
        inner = F.transform(c, lambda x: F.coalesce(to_text(x, t.elementType), F.lit("")))
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")))
    if is_interval(t):
        return interval_text(c)
    if isinstance(t, T.MapType):
        inner = F.transform(F.map_entries(c), lambda e: F.concat(F.coalesce(to_text(e["key"], t.keyType), F.lit("")), F.lit("="), F.coalesce(to_text(e["value"], t.valueType), F.lit(""))))
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(inner, ", "), F.lit("}")))
    if isinstance(t, T.StructType):
        if t.fieldNames()[:1] == ["tag"]:
            return F.coalesce(*(to_text(c[f.name], f.dataType) for f in t.fields[1:]))
        parts = [F.concat(F.lit(f"{f.name}: "), F.coalesce(to_text(c[f.name], f.dataType), F.lit(""))) for f in t.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    return c.cast("string")


def interval_text(c: Column) -> Column:
    def part(n: Column, one: str) -> Column:
        return F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {one}"), F.when(F.abs(n) != 1, "s").otherwise("")))

    years = F.when(c["months"] >= 0, F.floor(c["months"] / 12)).otherwise(F.ceil(c["months"] / 12))
    seconds = call("div", F.abs(c["micros"]), F.lit(1_000_000))
    clock = F.concat(F.when(c["micros"] < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d", call("div", seconds, F.lit(3600)), call("div", seconds, F.lit(60)) % 60, seconds % 60), F.when(F.abs(c["micros"]) % 1_000_000 != 0, F.format_string(".%06d", F.abs(c["micros"]) % 1_000_000)).otherwise(""))
    text = F.concat_ws(" ", part(years, "year"), part(c["months"] - years * 12, "month"), part(c["days"], "day"), F.when(c["micros"] != 0, clock))
    return F.when(c.isNotNull(), F.when(text == "", "00:00:00").otherwise(text))


def _casts() -> None:
    from graphloom.types import SIMPLE

    for n in "DOUBLE FLOAT SERIAL INT64 INT32 INT16 INT8 UINT64 UINT32 UINT16 UINT8 INT128 UINT128 BOOL".split():
        SCALARS[f"to_{n.lower()}"] = lambda c, t, v, n=n: cast(c[0], t[0], SIMPLE[n], n)
    for names, n in (("to_date date", "DATE"), ("timestamp", "TIMESTAMP"), ("to_interval interval duration", "INTERVAL"), ("to_string string", "STRING"), ("to_blob blob", "BLOB"), ("to_uuid uuid", "UUID")):
        for name in names.split():
            SCALARS[name] = lambda c, t, v, n=n: cast(c[0], t[0], SIMPLE[n], n)


_casts()

# ---- dates and timestamps

PARTS = {"year": "YEAR", "years": "YEAR", "yr": "YEAR", "y": "YEAR", "month": "MONTH", "months": "MONTH", "mon": "MONTH", "day": "DAY", "days": "DAY", "d": "DAY", "dayofmonth": "DAY", "quarter": "QUARTER", "quarters": "QUARTER", "week": "WEEK", "weeks": "WEEK", "dow": "DOW", "dayofweek": "DOW", "weekday": "DOW", "doy": "DOY", "dayofyear": "DOY", "hour": "HOUR", "hours": "HOUR", "hr": "HOUR", "h": "HOUR", "minute": "MINUTE", "minutes": "MINUTE", "min": "MINUTE", "m": "MINUTE", "second": "SECOND", "seconds": "SECOND", "sec": "SECOND", "s": "SECOND"}


@scalar("date_part", "datepart")
def date_part(c, t, v):
    word, at = str(v[0]).lower(), c[1]
    if is_interval(t[1]):
        m, d, u = at["months"].cast("long"), at["days"].cast("long"), at["micros"]
        year = call("div", m, F.lit(12))
        found = {"YEAR": year, "MONTH": m % 12, "DAY": d, "QUARTER": call("div", m % 12, F.lit(3)) + 1, "HOUR": call("div", u, F.lit(3_600_000_000)), "MINUTE": call("div", u, F.lit(60_000_000)) % 60, "SECOND": call("div", u, F.lit(1_000_000)) % 60}
        out = found.get(PARTS.get(word, ""), {"decade": call("div", year, F.lit(10)), "century": call("div", year, F.lit(100)), "millennium": call("div", year, F.lit(1000)), "millisecond": call("div", u % 60_000_000, F.lit(1000)), "microsecond": u % 60_000_000}.get(word.removesuffix("s")))
        if out is None:
            raise BindError(f"{word} is no part of an interval")
        return out
    if isinstance(t[1], T.StringType):
        at = at.cast("timestamp_ntz")
    year = F.year(at)
    if word in PARTS:
        if PARTS[word] == "SECOND":
            return F.second(at).cast("long") if is_time(t[1]) or isinstance(t[1], T.StringType) else F.when(at.isNotNull(), F.lit(0).cast("long"))
        if PARTS[word] == "DOW":
            return (F.dayofweek(at) - 1).cast("long")
        return {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "QUARTER": F.quarter, "WEEK": F.weekofyear, "DOY": F.dayofyear, "HOUR": F.hour, "MINUTE": F.minute}[PARTS[word]](at.cast("timestamp_ntz")).cast("long")
    micros = F.unix_micros(at.cast("timestamp"))
    if word.startswith("millisec") or word in ("ms", "msec"):
        return call("div", micros % 60_000_000, F.lit(1000))
    if word.startswith("microsec") or word in ("us", "usec"):
        return micros % 60_000_000
    if word == "epoch":
        return call("div", micros, F.lit(1_000_000))
    if word.startswith("decade"):
        return F.floor(year / 10).cast("long")
    if word.startswith("centur"):
        return F.ceil(year / 100).cast("long")
    if word.startswith("millen"):
        return F.ceil(year / 1000).cast("long")
    raise BindError(f"{word} is no part of a date")


@scalar("date_trunc", "datetrunc")
def date_trunc(c, t, v):
    word = str(v[0]).lower()
    unit = PARTS.get(word, word.rstrip("s").upper())
    at = c[1].cast("timestamp_ntz") if isinstance(t[1], T.StringType) else c[1]
    if word.startswith(("decade", "centur", "millen")):
        span = 10 if word[0] == "d" else 100 if word[0] == "c" else 1000
        out = F.make_date((F.floor(F.year(at) / span) * span).cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    else:
        out = F.date_trunc(unit, at.cast("timestamp_ntz")).cast("timestamp_ntz")
    return out.cast("date") if isinstance(t[1], T.DateType) else out


simple("dayname", lambda a: F.date_format(a.cast("timestamp_ntz"), "EEEE"))
simple("monthname", lambda a: F.date_format(a.cast("timestamp_ntz"), "MMMM"))
simple("last_day", lambda a: F.last_day(a.cast("date")))
simple("greatest", lambda *c: null_if_any(F.greatest(*c), *c))
simple("least", lambda *c: null_if_any(F.least(*c), *c))
simple("make_date", lambda y, m, d: F.make_date(*(x.cast("int") for x in (y, m, d))))
simple("current_date", lambda: F.current_date())
simple("current_timestamp", lambda: F.current_timestamp())
simple("century", lambda a: F.ceil(F.year(a) / 100).cast("long"))
simple("epoch_ms", lambda a: F.timestamp_millis(a).cast("timestamp_ntz"))
simple("to_timestamp", lambda a: F.timestamp_micros(F.round(a.cast("double") * 1_000_000).cast("long")).cast("timestamp_ntz"))
simple("to_epoch_ms", lambda a: F.unix_millis(a.cast("timestamp")))
for _n, _m, _d, _u in (("years", 12, 0, 0), ("months", 1, 0, 0), ("days", 0, 1, 0), ("hours", 0, 0, 3_600_000_000), ("minutes", 0, 0, 60_000_000), ("seconds", 0, 0, 1_000_000), ("milliseconds", 0, 0, 1000), ("microseconds", 0, 0, 1)):
    simple(f"to_{_n}", lambda a, m=_m, d=_d, u=_u: F.when(a.isNotNull(), interval(a * m, a * d, a * u)))

# ---- blobs, hashes, structs, maps, unions, utilities

simple("octet_length", lambda a: F.octet_length(a).cast("long"))
simple("encode", lambda a: F.encode(a, "UTF-8"))
simple("decode", lambda a: F.decode(a, "UTF-8"))
simple("gen_random_uuid", lambda: call("uuid"))
simple("md5", lambda a: F.md5(a.cast("binary")))
simple("sha256", lambda a: F.sha2(a.cast("binary"), 256))
simple("hash", lambda a: F.when(a.isNotNull(), F.xxhash64(a).cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)"))


@scalar("struct_extract")
def struct_extract(c, t, v):
    names = t[0].fieldNames()
    return c[0][names[v[1] - 1] if isinstance(v[1], int) else next((n for n in names if n.lower() == str(v[1]).lower()), str(v[1]))]


SCALARS["map"] = lambda c, t, v: F.map_from_arrays(c[0], c[1])
simple("map_extract element_at", lambda m, k: F.when(F.map_contains_key(m, k), F.array(F.try_element_at(m, k))).otherwise(F.slice(F.map_values(m), 1, 0)))
simple("map_keys", F.map_keys)
simple("map_values", F.map_values)
simple("union_tag", lambda a: a["tag"])
SCALARS["union_extract"] = lambda c, t, v: c[0][str(v[1])]
simple("coalesce", lambda *c: F.coalesce(*c))
simple("ifnull", lambda a, b: F.coalesce(a, b))
simple("nullif", lambda a, b: F.nullif(a, b))
simple("constant_or_null", lambda a, *c: null_if_any(a, *c) if c else a)
SCALARS["count_if"] = lambda c, t, v: F.when(c[0].cast("boolean"), F.lit(1)).otherwise(F.when(c[0].isNotNull(), F.lit(0))).cast("short")
simple("error", lambda a: F.raise_error(a).cast("string"))
SCALARS["typeof"] = lambda c, t, v: F.lit(type_name(t[0]))
SCALARS["internal_id"] = lambda c, t, v: F.struct(c[0].cast("long").alias("table"), c[1].cast("long").alias("offset"))
SCALARS["offset"] = lambda c, t, v: c[0]["offset"]

# ---- json


@scalar("to_json", "cast_to_json", "array_to_json", "row_to_json", "json_quote")
def to_json(c, t, v):
    if isinstance(t[0], (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c[0])
    return F.regexp_extract(F.to_json(F.struct(c[0].alias("v"))), r'^\{"v":(.*)\}$', 1)


SCALARS["json_object"] = lambda c, t, v: F.to_json(F.struct(*(c[i + 1].alias(str(v[i])) for i in range(0, len(c), 2))))
SCALARS["json_array"] = lambda c, t, v: F.concat(F.lit("["), F.concat_ws(",", *(to_json([x], [k], [MISSING]) for x, k in zip(c, t, strict=True))), F.lit("]"))


def _path(v) -> str:
    p = str(v)
    return p if p.startswith("$") else "$" + "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in p.strip("/").replace("/", ".").split("."))


SCALARS["json_extract"] = lambda c, t, v: F.get_json_object(c[0], _path(v[1]))
simple("json_array_length", lambda a: F.json_array_length(a).cast("long"))
simple("json_keys", lambda a: F.json_object_keys(a))
simple("json_valid", lambda a: F.when(a.isNotNull(), F.try_parse_json(a).isNotNull()))
simple("json_type", lambda a: F.when(F.startswith(F.trim(a), F.lit("{")), "OBJECT").when(F.startswith(F.trim(a), F.lit("[")), "ARRAY").when(F.trim(a) == "null", "NULL").when(F.trim(a).isin("true", "false"), "BOOLEAN").when(F.rlike(F.trim(a), F.lit(r"^-?\d+$")), "BIGINT").when(F.rlike(F.trim(a), F.lit(r"^-?[\d.eE+-]+$")), "DOUBLE").when(a.isNotNull(), "VARCHAR"))
simple("json_structure", lambda a: call("schema_of_variant", F.parse_json(a)))
simple("json_contains", lambda a, b: F.contains(F.regexp_replace(a, r"\s", ""), F.regexp_replace(b, r"\s", "")))
