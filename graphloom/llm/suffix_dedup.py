"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every start of a LENGTH-byte string belongs to one anchor: the K-byte substring of the string with the least hash
(leftmost of equals). Equal strings choose equal anchors, so repeats meet when starts are dealt out by the hash of
their anchor, and an anchor's starts in a text are consecutive: one context of bytes holds them all.

1. Each text gives its contexts as (anchor, context hash, place); anchors of one context can't repeat and go.
2. Equal contexts are counted into one, with their multiplicity: copies in thousands cost one context each anchor.
3. A task takes anchors in runs of about BLOCK bytes, sorts the suffixes of their contexts to a depth beyond LENGTH,
   and has the Burrows-Wheeler transform. From the intervals of single bytes, breadth first, each interval of a string
   w is extended backward to those of cw; the end of a new interval whose common prefix is still open gets the length
   of w, so common prefixes come out in increasing order. At LENGTH it stops: what is open has a longer prefix.
4. Suffixes between two set bounds share LENGTH bytes. Those which start a string of their context count with its
   multiplicity, and from two on all are repeats. Starts go back to every place of the context and become spans.

An anchor with over HOT contexts isn't given to one task: its contexts are cut again by anchors of a length nearer to
LENGTH, and so on. An anchor of LENGTH bytes is the string itself, and its contexts are all equal, so one.

Defined cases: null text is empty; texts of under LENGTH bytes lose nothing; matches never cross rows; repeated rows
(same doc_id and text) count as occurrences each and lose the same bytes; a null doc_id is kept as null; very long
texts are read in overlapping chunks; an empty table gives an empty result; other columns are kept, one named `repeats`
as `repeats_in`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import as_bytes, free, mix, slices, small_batches, spare, staged, substring_hasher

LENGTH, K, CHUNK, BLOCK, HOT = 200, 40, 1 << 19, 400_000, 20_000
U64 = np.uint64


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def contexts(texts: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first start, bytes, anchor hash, context hash) of the contexts, some texts at a time."""
    parts, held = [], 0

    def flush() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(parts)), sizes)
        hash_ = substring_hasher(data)
        at = np.arange(len(data) - k + 1)
        grams = hash_(at, at + k)
        best = _least((grams & U64(0xFFFFFFFFFFE00000)) | at.astype(U64), length - k + 1)  # CHUNK and more fit in 21 bits
        place = (best & U64(0x1FFFFF)).astype(np.int64)
        start = np.arange(len(place))
        valid = start + length <= ends[of[: len(place)]]
        start, place = start[valid], place[valid]
        if not len(start):
            return (np.zeros(0, np.int64),) * 5
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))
        first, last = start[new], start[np.append(new[1:], len(start)) - 1]
        place, size = place[new], last - first + length
        own = hash_(first, first + size) ^ mix(size.astype(U64) << U64(20) | (place - first).astype(U64))
        text = np.array([t for t, _, _ in parts])[of[first]]
        base = np.array([b for _, b, _ in parts]) - (ends - sizes)
        return text, first + base[of[first]], size, grams[place], own

    for t, text in enumerate(texts):
        for c in range(0, max(1, len(text) - length + 1), CHUNK):
            part = text[c : c + CHUNK + length - 1]
            if len(part) < length:
                continue
            if held and held + len(part) > CHUNK + length:
                yield flush()
                parts, held = [], 0
            parts.append((t, c, part))
            held += len(part)
    if parts:
        yield flush()


# ---- the transform


def _sorted(key: np.ndarray, index: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """key and index in the order of key. Where both fit in one word, the words are sorted as they are."""
    if int(key.max()) >> (64 - bits):
        order = np.argsort(key)
        return key[order], index[order]
    packed = key << U64(bits) | index.astype(U64)
    packed.sort()
    return packed >> U64(bits), (packed & U64((1 << bits) - 1)).astype(np.int32)


#: The first of four 9-bit symbols.
FIRST = np.array([sum(511 << 9 * (3 - i) for i in range(k)) for k in range(5)], U64)


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their suffix, to `depth` symbols at least. Symbols are 1 and more, 0 closes a context: at the
    positions `ends`, each less than all symbols and ordered among each other. A suffix's rank is the first place of
    its group; each round doubles the symbols that ranks stand for and sorts only what is still tied."""
    n, m = len(text), len(ends)
    bits = n.bit_length()
    end = np.repeat(ends.astype(np.int32), np.diff(np.append(-1, ends)))
    symbols = np.zeros(n + 3, U64)
    symbols[:n] = text
    key = symbols[:n]
    for i in range(1, 4):
        key = key << U64(9) | symbols[i : n + i]
    at = np.arange(n, dtype=np.int32)
    key &= FIRST[np.minimum(end - at, 4)]
    order, rank = np.empty(n, np.int32), np.empty(n, np.int32)
    order[:m], rank[ends] = ends, at[:m]  # closing symbols are in their places from the start
    own = at[end > at]
    held, slots, h = key[own], at[m:], 4
    while len(slots):
        held, own = _sorted(held, own, bits)
        order[slots] = own
        first = np.empty(len(held), bool)
        first[0] = True
        np.not_equal(held[1:], held[:-1], out=first[1:])
        heads = np.flatnonzero(first)
        group = np.repeat(slots[heads], np.diff(np.append(heads, len(held))))
        rank[own] = group
        if h >= depth:
            break
        tied = ~first
        tied[:-1] |= ~first[1:]
        slots, own = slots[tied], own[tied]
        held = group[tied].astype(U64) << U64(bits) | rank[np.minimum(own + np.int32(h), end[own])].astype(U64)
        h *= 2
    return order


def open_bounds(bwt: np.ndarray, closers: int, stop: int) -> np.ndarray:
    """For each row of the sorted suffixes: whether it shares `stop` symbols or more with the row before.
    bwt 0 marks rows without a symbol before; the first `closers` rows start with a closing symbol."""
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    none = int((bwt == 0).sum())
    step = np.full(n, -1, np.int32)  # the row of the suffix one symbol longer
    step[by_symbol[none:]] = np.arange(closers, closers + n - none)
    unset = np.ones(n + 1, bool)
    unset[: closers + 1] = False
    unset[n] = False
    symbols = bwt[by_symbol[none:]]
    heads = closers + np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(symbols) else np.zeros(0, np.int64)
    unset[heads] = False
    head = np.zeros(n + 1, bool)
    head[heads] = True
    lo = np.concatenate([np.arange(closers), heads]).astype(np.int32)
    hi = np.concatenate([np.arange(closers), np.append(heads[1:], n) - 1 if len(heads) else heads]).astype(np.int32)
    whole = np.full(n, -1, np.int32)
    for _ in range(1, stop):
        if not len(lo):
            break
        sizes = hi - lo + 1
        owner = np.repeat(np.arange(len(lo), dtype=np.int32), sizes)
        rows = np.arange(len(owner), dtype=np.int32) + np.repeat(lo - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        to = step[rows]
        live = to >= 0
        owner, to = owner[live], to[live]
        if not len(to):
            break
        if 16 * len(to) > n:  # places in order by marking them
            whole[to] = owner
            to = np.flatnonzero(whole >= 0).astype(np.int32)
            owner = whole[to]
            whole[to] = -1
        else:
            order = np.argsort(to)
            to, owner = to[order], owner[order]
        cut = np.flatnonzero(np.append(True, (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | head[to[1:]]))
        lo, hi = to[cut], to[np.append(cut[1:], len(to)) - 1]
        fresh = unset[hi + 1]
        lo, hi = lo[fresh], hi[fresh]
        unset[hi + 1] = False
    return unset[:n]


def repeated_starts(strings: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """Of each context, whose starts are all but its last length - 1 positions: the repeated ones."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int16)
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    order = suffix_order(text, ends, length)
    bwt = text[order - 1]
    bwt[order == 0] = 0
    shared = open_bounds(bwt, len(ends), length)
    context = np.repeat(np.arange(len(ends)), sizes + 1)
    starts = np.arange(len(text)) + length <= ends[context]
    weight = np.where(starts, np.array(counts)[context], 0)
    group = np.cumsum(~shared)
    total = np.bincount(group, weight[order])
    again = np.zeros(len(text), bool)
    again[order] = total[group] >= 2
    again &= starts
    return [np.flatnonzero(again[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _ranges(starts: np.ndarray) -> bytes:
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.append(True, np.diff(starts) != 1))
    return np.column_stack([starts[cut], starts[np.append(cut[1:], len(starts)) - 1]]).astype("<u4").tobytes()


# ---- the operator


def _places(docs: DataFrame, length: int, k: int) -> DataFrame:
    """docs: doc, th, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column("doc").to_numpy(), batch.column("th").to_numpy()
            for text, first, size, anchor, own in contexts(as_bytes(batch.column("text")), length, k):
                if len(text):
                    yield pa.RecordBatch.from_pydict({"a": anchor.view(np.int64), "c": own.view(np.int64), "doc": doc[text], "th": th[text], "first": pa.array(first, pa.int64()), "size": pa.array(size, pa.int32())})

    return docs.select("doc", "th", "text").mapInArrow(run, "a long, c long, doc long, th long, first long, size int")


def _repeats(found: DataFrame, length: int) -> DataFrame:
    """(a, c, ranges) of contexts (a, c, n, body), dealt out by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def close() -> pa.RecordBatch:
            out = [(a, c, _ranges(s)) for (a, c, _, _), s in zip(rows, repeated_starts([r[3] for r in rows], [r[2] for r in rows], length), strict=True) if len(s)]
            a, c, ranges = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(ranges, pa.binary())], names=["a", "c", "ranges"])

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "n", "body")), strict=True):
                if held >= BLOCK and row[0] != rows[-1][0]:
                    yield close()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield close()

    return found.repartition("a").sortWithinPartitions("a").select("a", "c", "n", "body").mapInArrow(run, "a long, c long, ranges binary")


def _parts(found: DataFrame, length: int, k: int) -> DataFrame:
    """Contexts (a, c, n, body) cut into those of longer anchors: (a, c, n, body) of the part, and of = (a, c) of the
    whole and first, the part's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                bodies = as_bytes(some.column("body"))
                whole = {x: some.column(x).to_numpy() for x in ("a", "c", "n")}
                for text, first, size, anchor, own in contexts(bodies, length, k):
                    if len(text):
                        body = [bodies[t][f : f + n] for t, f, n in zip(text.tolist(), first.tolist(), size.tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict({"a": anchor.view(np.int64), "c": own.view(np.int64), "n": whole["n"][text], "body": pa.array(body, pa.binary()), "of_a": whole["a"][text], "of_c": whole["c"][text], "first": pa.array(first, pa.int64())})

    return found.select("a", "c", "n", "body").mapInArrow(run, "a long, c long, n long, body binary, of_a long, of_c long, first long")


@F.arrow_udf(T.BinaryType())
def _joined(parts: pa.Array) -> pa.Array:
    """The ranges of all parts, each moved by its part's place."""
    out = []
    for own in parts.to_pylist():
        moved = [np.frombuffer(p["ranges"], "<u4").reshape(-1, 2) + np.uint32(p["first"]) for p in own]
        out.append(np.concatenate(moved).astype("<u4").tobytes())
    return pa.array(out, pa.binary())


def _all_repeats(bodies: DataFrame, names: DataFrame, length: int, k: int, hot: int) -> DataFrame:
    """(a, c, ranges) of contexts (a, c, n, body), which names has once each. The contexts of an anchor that has over `hot` of them are dealt out
    by longer anchors, in the end by the strings themselves, of which equal ones are one context."""
    if k >= length:
        return _repeats(bodies, length)
    common = staged(names.groupBy("a").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > hot).select("a"))
    if common.isEmpty():
        return _repeats(bodies, length)
    bodies = staged(bodies)
    longer = min(length, k + max(1, (length - k + 1) // 2))
    parts = staged(_parts(bodies.join(common, "a", "left_semi"), length, longer))
    again = _all_repeats(parts.groupBy("a", "c").agg(F.sum("n").alias("n"), F.first("body").alias("body")), parts.select("a", "c").distinct(), length, longer, hot)
    back = parts.select("a", "c", "of_a", "of_c", "first").join(staged(again), ["a", "c"]).groupBy(F.col("of_a").alias("a"), F.col("of_c").alias("c"))
    back = back.agg(F.collect_list(F.struct("first", "ranges")).alias("parts")).select("a", "c", _joined("parts").alias("ranges"))  # at most a context's starts
    return _repeats(bodies.join(common, "a", "left_anti"), length).unionByName(back)


SPANS = T.StructType([T.StructField(f, T.LongType()) for f in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """docs with struct column `repeats`: n_bytes, n_removed, n_spans and kept, the bytes that stay."""
    docs = spare(docs, "repeats")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(text)
    keyed = docs.select(doc.alias("doc"), th.alias("th"), text.alias("text"))
    small_batches(docs.sparkSession)
    places = staged(_places(keyed, length, k))
    twice = staged(places.groupBy("a").agg(F.count(F.lit(1)).alias("t")).filter("t >= 2").select("a"))
    again = staged(places.join(twice, "a", "left_semi"))
    found = staged(again.groupBy("a", "c", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "first")).alias("at")))
    wanted = found.groupBy(F.col("at.doc").alias("doc"), F.col("at.th").alias("th")).agg(F.collect_list(F.struct("a", "c", "n", F.col("at.first").alias("first"), "size")).alias("wanted"))  # at most a document's contexts
    bodies = keyed.join(staged(wanted), ["doc", "th"]).select("text", F.explode("wanted").alias("w"))
    bodies = bodies.select("w.a", "w.c", "w.n", F.expr("substring(text, cast(w.first + 1 as int), w.size)").alias("body")).dropDuplicates(["a", "c"])
    repeats = staged(_all_repeats(bodies, found, length, k, hot))
    spans = staged(again.join(repeats, ["a", "c"]).groupBy("doc", "th").agg(F.collect_set(F.struct("first", "ranges")).alias("spans")))

    @F.arrow_udf(SPANS)
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for body, own in zip(as_bytes(text), spans.to_pylist(), strict=True):
            gone = np.zeros(len(body) + 1, np.int64)
            for s in own or ():
                pairs = np.frombuffer(s["ranges"], "<u4").astype(np.int64).reshape(-1, 2) + s["first"]
                np.add.at(gone, pairs[:, 0], 1)
                np.add.at(gone, pairs[:, 1] + length, -1)
            covered = np.cumsum(gone[:-1]) > 0
            n = int(covered.sum())
            runs = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
            rows.append((len(body), n, runs, np.frombuffer(body, np.uint8)[~covered].tobytes() if n else body))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=SPANS.fieldNames())

    own = free(docs, "doc", "th", "spans")
    spans = spans.withColumnsRenamed(dict(zip(("doc", "th", "spans"), own, strict=True)))
    joined = docs.withColumns({own[0]: doc, own[1]: th}).join(spans, own[:2], "left")
    return joined.withColumn("repeats", cut(text, F.col(own[2]))).select(*docs.columns, "repeats")
