"""Line dedup over a sharded minimal perfect hash.

1. Each document gives the 128-bit hashes of its distinct keys of MIN_CHARS code points and more. They are made
   distinct with their doc_id, so that a common line's documents spread over all tasks, and a map-side combined
   count gives each hash its documents and largest doc_id. Hashes of one document can never be dropped and stay
   out of the index.
2. Hashes are dealt to shards; each shard's minimal perfect hash (levels of bit arrays: a hash alone in its slot
   of a level stays there, the others go on; a slot's rank is its index) addresses three arrays: 64-bit
   fingerprints, counts, largest doc_ids.
3. Documents probe the arrays. While all shards are under `broadcast_bytes` they go to every executor and the
   documents are neither shuffled nor joined. Beyond it probes are packed by shard, each shard's packs meet its
   arrays, and hits go back by document: same result, memory bounded by a shard.

A key is the line with all of ``\\x20\\x09-\\x0D`` stripped at both ends and A-Z lower-cased.

Defined cases: null or empty text is one empty line, which no key covers; rows that share a doc_id count as one
document, and where it is the largest they all keep the line; rows without a doc_id don't count but lose the lines
that repeat in others; an empty table gives an empty result; other columns are kept, one named `lines` as `lines_in`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import as_bytes, free, mix, spare, staged

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS, BROADCAST_BYTES = 1 << 16, 48 << 20
CONTINUATION = bytes(range(0x80, 0xC0))
U64 = np.uint64


def line_key(line: bytes, min_chars: int) -> bytes | None:
    if len(line) < min_chars:
        return None
    key = line.strip().lower()
    return key if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.translate(None, CONTINUATION)) >= min_chars) else None


# ---- the perfect hash


def _slots(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(h + U64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % U64(size)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: level bit arrays and their ranks."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, base = levels, [], 0
        for bits in levels:
            ones = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(ones - bits + base)
            base += int(ones[-1]) if len(ones) else 0

    @classmethod
    def of(cls, h: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(h):
            size = max(8, int(1.6 * len(h)))
            at = _slots(h, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            h = h[~alone[at.astype(np.int64)]]
        return cls(levels)

    def index(self, h: np.ndarray) -> np.ndarray:
        """Each value's index, -1 where no level has it; a value outside the set may get any index."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, bits in enumerate(self.levels):
            at = _slots(h[left], level, len(bits)).astype(np.int64)
            here = bits[at] == 1
            out[left[here]] = self.ranks[level][at[here]]
            left = left[~here]
        return out


class Shard:
    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.hash, self.prints, self.counts, self.last = hash_, prints, counts, last

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Shard:
        made = PerfectHash.of(h1)
        at = made.index(h1)
        arrays = [np.zeros(len(h1), x.dtype) for x in (h2, counts, last)]
        for to, x in zip(arrays, (h2, counts, last), strict=True):
            to[at] = x
        return cls(made, *arrays)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.prints), len(self.hash.levels), *map(len, self.hash.levels)], "<u8")
        return b"".join([sizes.tobytes(), self.prints.astype("<u8").tobytes(), self.last.astype("<i8").tobytes(), self.counts.astype("<u4").tobytes(), *(np.packbits(x).tobytes() for x in self.hash.levels)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        n, count = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        sizes = np.frombuffer(raw, "<u8", count, 16).tolist()
        at, arrays = 16 + 8 * count, []
        for kind in ("<u8", "<i8", "<u4"):
            arrays.append(np.frombuffer(raw, kind, n, at))
            at += arrays[-1].nbytes
        levels = []
        for size in sizes:
            packed = np.frombuffer(raw, "u1", -(-size // 8), at)
            at += packed.nbytes
            levels.append(np.unpackbits(packed)[:size])
        prints, last, counts = arrays
        return cls(PerfectHash(levels), prints, counts, last)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's count, 0 where the shard hasn't got it, and largest doc_id."""
        at = self.hash.index(h1)
        safe = np.maximum(at, 0)
        if not len(self.prints):
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        return np.where((at >= 0) & (self.prints[safe] == h2), self.counts[safe], 0).astype(np.int64), self.last[safe]


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the upper 31 bits, which Spark can compute as well."""
    return (((h1 >> U64(33)) * U64(shards)) >> U64(31)).astype(np.int64)


# ---- the operator


def _hashes(texts: list[bytes], min_chars: int) -> tuple[list[list[bytes]], list[int], list[int], np.ndarray]:
    """Lines of each text; of every key its text, its line, and its two hashes."""
    lines, of, line, digests = [], [], [], []
    for i, text in enumerate(texts):
        lines.append(own := text.split(b"\n"))
        for j, x in enumerate(own):
            if key := line_key(x, min_chars):
                of.append(i)
                line.append(j)
                digests.append(xxhash.xxh3_128_digest(key))
    return lines, of, line, np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def repeated_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, n (distinct doc_ids), last (largest doc_id) of keys that at least two documents have."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            _, of, _, pairs = _hashes(as_bytes(batch.column(1)), min_chars)
            if not of:
                continue
            rows = np.column_stack([pairs, np.array(of, np.uint64)])
            rows = rows[np.lexsort(rows.T)]
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            yield pa.RecordBatch.from_pydict({"h1": rows[:, 0].view(np.int64).copy(), "h2": rows[:, 1].view(np.int64).copy(), "doc_id": pa.array([doc_ids[i] for i in rows[:, 2].tolist()], pa.int64())})

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null").mapInArrow(hashes, "h1 long, h2 long, doc_id long")
    found = found.distinct()  # spreads a common line's documents over all tasks
    return found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).filter("n >= 2")


def build_index(hashes: DataFrame, shards: int) -> DataFrame:
    """(shard, image), a shard of about SHARD_KEYS hashes a row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = -1

        def made() -> pa.RecordBatch:
            x = np.concatenate(held)
            image = Shard.of(x[:, 0].view(U64).copy(), x[:, 1].view(U64).copy(), np.minimum(x[:, 2], 2**32 - 1).astype(np.uint32), x[:, 3].copy()).to_bytes()
            return pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "image": pa.array([image], pa.binary())})

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            rows = np.column_stack([batch.column(c).to_numpy() for c in ("h1", "h2", "n", "last")])
            for s in np.unique(shard).tolist():
                if s != at and held:
                    yield made()
                    held = []
                at = s
                held.append(rows[shard == s])
        if held:
            yield made()

    placed = hashes.withColumn("shard", (F.shiftrightunsigned("h1", 33) * shards).bitwiseAND(F.lit(-1).cast("long")))
    placed = placed.withColumn("shard", F.shiftright("shard", 31).cast("int"))
    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, image binary")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with `text` rid of repeated lines, and struct column `lines`: n_lines before, n_dropped."""
    docs = spare(docs, "lines")
    hashes = staged(repeated_hashes(docs, min_chars))
    shards = max(1, math.ceil(hashes.count() / SHARD_KEYS))
    index = staged(build_index(hashes, shards))
    size = index.agg(F.sum(F.length("image"))).first()[0] or 0
    if size <= broadcast_bytes:
        return _probe_all(docs, index, shards, min_chars, min_docs)
    return _probe_by_shard(docs, index, shards, min_chars, min_docs)


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _result(rows: list[tuple]) -> pa.Array:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=RESULT.fieldNames())


def _without(lines: list[bytes], gone: set[int]) -> tuple:
    kept = [x for j, x in enumerate(lines) if j not in gone] if gone else lines
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)


def _put(docs: DataFrame, column) -> DataFrame:
    out = docs.withColumn("lines", column)
    out = out.withColumn("text", F.col("lines.text"))
    return out.withColumn("lines", F.struct("lines.n_lines", "lines.n_dropped"))


def _probe_all(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    images = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["image"]) for r in index.collect()})  # at most broadcast_bytes
    opened: dict[int, Shard] = {}

    @F.arrow_udf(RESULT)
    def drop(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        lines, of, line, pairs = _hashes(as_bytes(text), min_chars)
        ids = np.array([-(1 << 63) if x is None else x for x in doc_id.to_pylist()], np.int64)
        gone: dict[int, set[int]] = {}
        if of:
            of_, line_, shard = np.array(of), np.array(line), _shard_of(pairs[:, 0], shards)
            for s in np.unique(shard).tolist():
                if s not in images.value:
                    continue
                if s not in opened:
                    opened[s] = Shard.from_bytes(images.value[s])
                mine = np.flatnonzero(shard == s)
                n, last = opened[s].probe(pairs[mine, 0], pairs[mine, 1])
                for k in mine[(n >= min_docs) & (last != ids[of_[mine]])].tolist():
                    gone.setdefault(int(of_[k]), set()).add(int(line_[k]))
        return _result([_without(own, gone.get(i, set())) for i, own in enumerate(lines)])

    return _put(docs, drop(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _probe_by_shard(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([-(1 << 63) if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            _, of, _, pairs = _hashes(as_bytes(batch.column(1)), min_chars)
            if of:
                rows, shard = np.column_stack([pairs.view(np.int64), ids[np.array(of)]]), _shard_of(pairs[:, 0], shards)
                found = np.unique(shard)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(found, pa.int32()), "probes": pa.array([rows[shard == s].tobytes() for s in found], pa.binary())})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, probes in zip(batch.column("image").to_pylist(), batch.column("probes").to_pylist(), strict=True):
                rows = np.frombuffer(probes, "<i8").reshape(-1, 3)
                n, last = Shard.from_bytes(image).probe(rows[:, 0].view(U64), rows[:, 1].view(U64))
                hits = rows[(n >= min_docs) & (last != rows[:, 2])]
                yield pa.RecordBatch.from_pydict({"h1": hits[:, 0].copy(), "h2": hits[:, 1].copy(), "key": hits[:, 2].copy()})

    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hits = known.mapInArrow(packs, "shard int, probes binary").join(index, "shard").select("image", "probes").mapInArrow(probe, "h1 long, h2 long, key long")
    gone = hits.distinct().groupBy("key").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))  # at most a document's lines

    @F.arrow_udf(RESULT)
    def drop(text: pa.Array, gone: pa.Array) -> pa.Array:
        lines, of, line, pairs = _hashes(as_bytes(text), min_chars)
        out: dict[int, set[int]] = {}
        sets = [{(x["h1"], x["h2"]) for x in own or ()} for own in gone.to_pylist()]
        for i, j, (a, b) in zip(of, line, pairs.view(np.int64).tolist(), strict=True):
            if (a, b) in sets[i]:
                out.setdefault(i, set()).add(j)
        return _result([_without(own, out.get(i, set())) for i, own in enumerate(lines)])

    key, lost = free(docs, "key", "gone")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    joined = keyed.join(gone.withColumnsRenamed({"key": key, "gone": lost}), key, "left")
    return _put(joined, drop(F.col("text").cast("string"), F.col(lost))).select(*docs.columns, "lines")
