"""Versioned tables and commits.

A version of a table is a base frame, files of added rows, and files of removed keys, in the order in which they were
made. A change writes its own rows alone: CREATE and COPY a file of rows, DELETE a file of keys, SET one of each, with the
changed rows. Reading unites base and rows and drops, by one anti join, every row that a later file of keys names; files of
keys are small, so Spark broadcasts them as long as their size allows it. Versions are immutable: a reader keeps the one
it began with, and a snapshot of a catalogue costs nothing.

Sessions of one database (`GraphSession.connect`) change snapshots of their own and commit optimistically. If others have
committed since the snapshot was taken, what both changed is merged by rule:

* a table that only one side changed is taken from that side;
* rows of one table are merged if no key was added, set or deleted by both, else the later commit fails;
* an edge whose end the other side deleted fails the later commit, whichever side deleted;
* a change of a table's definition, or of a sequence, macro, type or index, conflicts with any other change of it.

A commit that leaves a table with over MOST_PARTS files folds them into one file of keys and one of rows, if no other
transaction is open; CHECKPOINT does so for all tables, and makes a new base of one whose changes outweigh it.
"""

from __future__ import annotations

import copy
import threading
from collections.abc import Iterator, MutableMapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import RunError
from graphloom.storage import staged

MOST_PARTS = 16
#: Keys that are sent with a scan as a filter; more are joined.
FEW = 1000
ROWS, GONE = "rows", "gone"


class Version:
    """parts: (kind, frame that reads written files); frames of removed keys have one column, __k."""

    def __init__(self, base: DataFrame | None, parts: tuple[tuple[str, DataFrame], ...] = ()):
        self.base, self.parts = base, parts
        self._frames: dict[str, DataFrame] = {}

    def plus(self, rows: DataFrame) -> Version:
        """With more rows, which are written already."""
        return Version(self.base, (*self.parts, (ROWS, rows)))

    def minus(self, keys: DataFrame) -> Version:
        return Version(self.base, (*self.parts, (GONE, keys)))

    def since(self, before: Version) -> tuple[tuple[str, DataFrame], ...] | None:
        """The parts that came after `before`, None if this version wasn't made from it by parts alone."""
        n = len(before.parts)
        same = self.base is before.base and len(self.parts) >= n and all(a[1] is b[1] for a, b in zip(self.parts, before.parts, strict=False))
        return self.parts[n:] if same else None

    def frame(self, key: str) -> DataFrame:
        if key not in self._frames:
            self._frames[key] = self._read(key, self.base, 0)
        return self._frames[key]

    def _read(self, key: str, base: DataFrame | None, start: int) -> DataFrame | None:
        """base and the parts from start on, as they stand now."""
        if not self.parts[start:]:
            return base
        at = F.col("__at")
        rows = [(-1, base)] if base is not None else []
        rows += [(i, f) for i, (kind, f) in enumerate(self.parts) if i >= start and kind == ROWS]
        gone = [f.select("__k", F.lit(i).alias("__until")) for i, (kind, f) in enumerate(self.parts) if i >= start and kind == GONE]
        if not rows:
            return None
        columns = [F.col(f"`{c}`") for c in rows[0][1].columns]
        if not gone:
            return reduce(DataFrame.unionByName, [f.select(*columns) for _, f in rows])
        every = reduce(DataFrame.unionByName, [f.select(*columns, F.lit(i).alias("__at")) for i, f in rows])
        k = F.col(f"`{key}`")
        return every.join(reduce(DataFrame.unionByName, gone), (k == F.col("__k")) & (at < F.col("__until")), "left_anti").drop("__at")

    def added(self, key: str, start: int) -> DataFrame | None:
        """The rows that the parts from start on have added, as they stand now."""
        return self._read(key, None, start)

    def folded(self, key: str) -> Version:
        """The same rows with two parts at most: keys that the base loses, rows that it gains."""
        added = self._read(key, None, 0)
        gone = [f for kind, f in self.parts if kind == GONE]
        parts = []
        if gone:
            parts.append((GONE, staged(reduce(DataFrame.unionByName, gone).distinct())))
        if added is not None:
            parts.append((ROWS, staged(added)))
        return Version(self.base, tuple(parts))

    def rebased(self, key: str) -> Version:
        return Version(staged(self.frame(key)))

    def changes(self) -> int:
        return sum(f.count() for _, f in self.parts)


class Frames(MutableMapping):
    """The frames of a rel table by (FROM, TO), each with its version."""

    def __init__(self, frames=()):
        self.versions: dict[tuple[str, str], Version] = {}
        if isinstance(frames, Frames):
            self.versions.update(frames.versions)
        else:
            self.update(dict(frames))

    def __getitem__(self, pair) -> DataFrame:
        return self.versions[pair].frame("_eid")

    def __setitem__(self, pair, value) -> None:
        if not isinstance(value, Version):
            value = Version(value if dict(value.dtypes)["_eid"] == "string" else value.withColumn("_eid", F.col("_eid").cast("string")))
        self.versions[pair] = value

    def __delitem__(self, pair) -> None:
        del self.versions[pair]

    def __iter__(self) -> Iterator:
        return iter(self.versions)

    def __len__(self) -> int:
        return len(self.versions)


def matching(frame: DataFrame, key: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of frame whose key is in keys (column __k). Few keys go to the scan as a filter, where file statistics can use them."""
    few = [r[0] for r in keys.limit(FEW + 1).collect()]
    column = F.col(f"`{key}`")
    if len(few) <= FEW and how == "left_semi":
        return frame.filter(column.isin([x for x in few if x is not None])) if few else frame.limit(0)
    return frame.join(keys.select("__k"), column == F.col("__k"), how)


class Shared:
    """What the sessions of a database share: the committed catalogue, and what each commit changed."""

    def __init__(self, catalog):
        self.catalog, self.lock = catalog, threading.RLock()
        self.version, self.log = 0, []
        self.open: set[int] = set()

    def commit(self, before, mine, owner: int) -> None:
        """before: the committed catalogue that `mine` began as a snapshot of."""
        with self.lock:
            merged = mine if self.catalog is before else merge(before, mine, self.catalog)
            self.open.discard(owner)
            self.version += 1
            self.log.append((self.version, changed(self.catalog, merged)))
            if not self.open:
                fold(merged, MOST_PARTS)
            self.catalog = merged


def copied(entry):
    """A copy of a catalogue's entry that shares only what is never changed in place."""
    out = copy.copy(entry)
    for k, v in vars(out).items() if hasattr(out, "__dict__") else ():
        if isinstance(v, (dict, list, set)):
            setattr(out, k, v.copy())
        elif isinstance(v, Frames):
            setattr(out, k, Frames(v))
    return out


def tables(catalog) -> Iterator[tuple[tuple, object, Version, str]]:
    """(name of a table and pair, table, version, key) of all tables."""
    for t in catalog.nodes.values():
        yield (t.name,), t, t.data, t.key
    for t in catalog.rels.values():
        for pair, v in t.frames.versions.items():
            yield (t.name, *pair), t, v, "_eid"


def put(table, name: tuple, version: Version) -> None:
    if len(name) == 1:
        table.data = version
    else:
        table.frames[name[1:]] = version


def fold(catalog, most: int) -> None:
    for name, table, version, key in list(tables(catalog)):
        if len(version.parts) > most:
            put(table, name, version.folded(key))


def checkpoint(catalog) -> None:
    """Folds all tables; one whose changes outweigh its base gets a new one."""
    for name, table, version, key in list(tables(catalog)):
        if version.parts:
            heavy = version.base is None or version.changes() >= version.base.count()
            put(table, name, version.rebased(key) if heavy else version.folded(key))


def changed(old, new) -> list[tuple[tuple, int, int]]:
    """(table, files of rows, files of keys) that a commit adds."""
    was = {name: v for name, _, v, _ in tables(old)}
    out = []
    for name, _, v, _ in tables(new):
        if was.get(name) is not v:
            own = (v.since(was[name]) if name in was else None) or v.parts
            out.append((name, sum(k == ROWS for k, _ in own), sum(k == GONE for k, _ in own)))
    return out


def _shape(entry):
    """An entry without its rows."""
    if isinstance(entry, dict):
        return {k: v for k, v in entry.items() if k != "data"}
    return {k: v for k, v in vars(entry).items() if k not in ("data", "frames")} if hasattr(entry, "__dict__") else entry


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if _shape(a) != _shape(b):
        return False
    if hasattr(a, "data"):
        return a.data is b.data
    return not hasattr(a, "frames") or a.frames.versions.keys() == b.frames.versions.keys() and all(v is b.frames.versions[p] for p, v in a.frames.versions.items())


def merge(before, mine, theirs):
    """theirs with what `mine` changed since `before`; an error if both changed the same."""
    out = theirs.snapshot()
    for group in ("nodes", "rels", "sequences", "macros", "types", "indexes", "graphs", "batches"):
        b, m, t = (getattr(x, group) for x in (before, mine, theirs))
        for name in dict.fromkeys([*b, *m, *t]):
            x, y, z = b.get(name), m.get(name), t.get(name)
            if _same(x, y):
                continue
            if not _same(x, z):
                if group not in ("nodes", "rels") or x is None or y is None or z is None or not _shape(x) == _shape(y) == _shape(z):
                    raise RunError(f"write-write conflict: another transaction has changed {name}")
                y = _merged(x, y, z)
            if y is None:
                getattr(out, group).pop(name, None)
            else:
                getattr(out, group)[name] = y
    _ends(before, mine, theirs)
    _ends(before, theirs, mine)
    return out


def _merged(before, mine, theirs):
    """A table that both changed."""
    out = copied(theirs)
    was = {n: v for n, _, v, _ in _versions(before)}
    now = {n: v for n, _, v, _ in _versions(theirs)}
    for name, _, version, key in _versions(mine):
        if version is was[name]:
            continue
        own, other = version.since(was[name]), now[name].since(was[name])
        if other == ():
            put(out, name, version)
            continue
        clash = own is None or other is None or not _keys(own, key).join(_keys(other, key), "__k", "left_semi").isEmpty()
        if clash:
            raise RunError(f"write-write conflict: another transaction has changed the same rows of {name[0]}")
        put(out, name, Version(now[name].base, (*now[name].parts, *own)))
    return out


def _versions(table) -> list:
    return [((table.name,), table, table.data, table.key)] if hasattr(table, "data") else [((table.name, *p), table, v, "_eid") for p, v in table.frames.versions.items()]


def _keys(parts: tuple, key: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(F.col(f"`{key}`").alias("__k")) if kind == ROWS else f for kind, f in parts])


def _ends(before, one, other) -> None:
    """Fails if `one` added an edge to a node that `other` deleted and didn't add anew."""
    deleted = {}
    for name, t in before.nodes.items():
        after = other.nodes.get(name)
        parts = after.data.since(t.data) if after is not None and after.data is not t.data else ()
        gone = [f for kind, f in parts or () if kind == GONE]
        if gone:
            keys = reduce(DataFrame.unionByName, gone)
            deleted[t.name] = keys.join(_keys(tuple(p for p in parts if p[0] == ROWS), t.key), "__k", "left_anti") if any(k == ROWS for k, _ in parts) else keys
    for name, t in before.rels.items():
        after = one.rels.get(name)
        for pair, v in after.frames.versions.items() if after is not None and deleted else ():
            was = t.frames.versions.get(pair)
            rows = [f for kind, f in (v.since(was) if was is not None else v.parts) or () if kind == ROWS]
            for end, of in zip(("_src", "_dst"), pair, strict=True):
                if rows and of in deleted and not reduce(DataFrame.unionByName, rows).join(deleted[of], F.col(end) == F.col("__k"), "left_semi").isEmpty():
                    raise RunError(f"write-write conflict: an edge of {name} has an end in {of} that another transaction has deleted")
