"""SimHash near-duplicates by a self-join of binary tries.

1. A text's fingerprint takes a majority over the 64-bit hashes of its word shingles, bit by bit. Equal fingerprints are
   one entry of the trie from here on, so copies cost nothing.
2. Two fingerprints within ERRORS bits differ in at most ERRORS // 2 bits of one half, so two tries are joined with
   themselves: one reads the halves in order, one swapped. Node pairs carry the differing bits of their prefixes; while
   they are in the first half the budget is ERRORS // 2, later ERRORS, and a pair over its budget goes with all below it.
3. The top of a trie is traversed by Spark: pairs of nodes with over CELL fingerprints are expanded by STEP bits, by joins
   with the counts of the next level, where the budget is part of the join's condition. Pairs with fewer become cells; a
   node of one fingerprint never grows, so this ends at any skew.
4. A cell's fingerprints meet in one task, which traverses the rest of both subtries, many node pairs at a time as arrays,
   in blocks of bounded size, down to nodes small enough to compare their fingerprints.
5. A cell gives a spanning forest of its links, so near copies in thousands never become all their pairs. Components
   follow the forests' edges.

Defined cases: words are split at ASCII white space and A-Z are lower-cased; with fewer words than the shingle's the
whole sequence is one shingle; null, empty or blank text has fingerprint zero, which links like any other; repeated rows
have the same fingerprint; a component's id is its least doc_id that isn't null, null if it has none; very long texts are
hashed in pieces; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.dist import ship
from graphloom.llm.common import as_bytes, release, settled, slices, small_batches, staged, texts
from graphloom.llm.ngram_join import components

WORDS, SEED, ERRORS = 3, 42, 3
#: Fingerprints of a node pair that one task joins, bits by which Spark expands larger ones, node pairs of a block.
CELL, STEP, BLOCK = 1 << 15, 2, 1 << 16
#: Shingles that are hashed and counted at once.
PIECE = 1 << 16
U64 = np.uint64


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included, some at a time."""
    found = text.lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts, ends = np.append(0, ends[:-1]), ends - 1
    n = max(1, len(found) - words + 1)
    stops = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        a, b = starts[i : min(n, i + PIECE)].tolist(), stops[i : i + PIECE].tolist()
        yield np.array([digest(joined[x:y], seed) for x, y in zip(a, b, strict=True)], U64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned; a bit is 1 if it is set in over half the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                f = np.array([fingerprint(t, words) for t in as_bytes(some.column("text"))], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(f)], names=["doc_id", "f"])
        release()

    return texts(docs).mapInArrow(run, "doc_id long, f long")


def budget(depth: int, errors: int) -> int:
    """Differing bits that a node pair may have at this depth."""
    return errors // 2 if depth <= 32 else errors


def split_at(keys: np.ndarray, zeros: dict[int, np.ndarray], depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the ranges [lo, hi) of sorted keys that share `depth` bits change in the next bit."""
    if depth not in zeros:
        zeros[depth] = np.append(0, np.cumsum((keys >> U64(63 - depth) & U64(1)) == 0))
    z = zeros[depth]
    return lo + z[hi] - z[lo]


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, block: int = BLOCK, leaf: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of links between the sorted fingerprints of two nodes of one depth, or within one node if right is None."""
    n = len(left)
    if not n or (right is not None and not len(right)):
        return
    keys = left if right is None else np.concatenate([left, right])
    differ = int(np.bitwise_count((left[0] ^ right[0]) >> U64(64 - depth))) if right is not None and depth else 0
    zeros: dict[int, np.ndarray] = {}
    pair = (0, n, 0, n) if right is None else (0, n, n, len(keys))
    stack = [(depth, np.array([[*pair, differ]], np.int64).T)]
    while stack:
        depth, nodes = stack.pop()
        a, b, c, d, e = nodes
        live = (e <= budget(depth, errors)) & (b > a) & (d > c) & ((a != c) | (b - a > 1))
        a, b, c, d, e = nodes[:, live]
        small = (b - a) * (d - c) <= leaf if depth < 64 else np.ones(len(a), bool)
        if small.any():
            yield from _compared(keys, *nodes[:4, live][:, small], errors, block)
        a, b, c, d, e = (x[~small] for x in (a, b, c, d, e))
        if not len(a):
            continue
        m, k = split_at(keys, zeros, depth, a, b), split_at(keys, zeros, depth, c, d)
        twins = a == c  # a node with itself: its children, and one pair of them
        other = ~twins
        grown = np.concatenate([np.stack([a, m, c, k, e]), np.stack([m, b, k, d, e]), np.stack([a, m, k, d, e + 1]), np.stack([m, b, c, k, e + 1])[:, other]], axis=1)
        for i in range(0, grown.shape[1], block):
            stack.append((depth + 1, grown[:, i : i + block]))


def _compared(keys: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, errors: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among all pairs of each node pair's fingerprints, about `block` pairs at a time; of equal ranges once."""
    size = (b - a) * (d - c)
    upto = np.cumsum(size)
    cuts = np.searchsorted(upto, np.arange(0, upto[-1], block), side="left")
    for i, j in zip(cuts, np.append(cuts[1:], len(size)), strict=True):
        own = size[i:j]
        if not len(own):
            continue
        of = np.repeat(np.arange(i, j), own)
        at = np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own)
        x, y = a[of] + at // (d - c)[of], c[of] + at % (d - c)[of]
        hit = (np.bitwise_count(keys[x] ^ keys[y]) <= errors) & (keys[x] != keys[y]) & ((a[of] != c[of]) | (x < y))
        yield keys[x[hit]], keys[y[hit]]


class Forest:
    """Union-find over fingerprints of a cell; keeps the links that join two trees."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.root = np.arange(len(self.keys))

    def add(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.searchsorted(self.keys, x), np.searchsorted(self.keys, y)
        kept = []
        at = np.flatnonzero(self._tops(i) != self._tops(j))
        for k, u, v in zip(at.tolist(), i[at].tolist(), j[at].tolist(), strict=True):
            u, v = self._top(u), self._top(v)
            if u != v:
                self.root[max(u, v)] = min(u, v)
                kept.append(k)
        return x[kept], y[kept]

    def _top(self, u: int) -> int:
        while (v := self.root[u]) != u:
            self.root[u] = u = self.root[v]
        return u

    def _tops(self, i: np.ndarray) -> np.ndarray:
        top = self.root[i]
        while not np.array_equal(up := self.root[top], top):
            top = up
        return top


def _bits(key: Column, depth: int) -> Column:
    """The first bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def _swapped(f: Column) -> Column:
    return F.shiftleft(f, 32).bitwiseOR(F.shiftrightunsigned(f, 32))


def cells(keys: DataFrame, errors: int, cell: int = CELL, step: int = STEP) -> DataFrame:
    """(u, v, depth): node pairs of at most `cell` fingerprints each in all that cover every link; u <= v. keys: one column, key,
    without repeats."""
    spark = keys.sparkSession
    total = keys.count()
    done = spark.createDataFrame([(0, 0, 0)] if total <= cell else [], "u long, v long, depth int")
    open_ = spark.createDataFrame([(0, 0, 0)] if total > cell else [], "u long, v long, e int")
    depth = 0
    while depth < 64 and not open_.isEmpty():
        depth = min(64, depth + step)
        whole = (1 << step) - 1
        # only nodes below an open pair are counted
        parents = open_.select(F.col("u").alias("p")).unionByName(open_.select(F.col("v").alias("p"))).distinct()
        nodes = keys.select(_bits(F.col("key"), depth).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.shiftrightunsigned("node", step))
        nodes = staged(nodes.join(parents, "p", "left_semi"))
        x, y = nodes.select(F.col("p").alias("u"), F.col("node").alias("cu"), F.col("n").alias("nu")), nodes.select(F.col("p").alias("v"), F.col("node").alias("cv"), F.col("n").alias("nv"))
        more = F.bit_count(F.col("cu").bitwiseXOR(F.col("cv")).bitwiseAND(F.lit(whole)))
        grown = open_.join(x, "u").join(y, "v").withColumn("e", F.col("e") + more).filter((F.col("e") <= budget(depth, errors)) & ((F.col("u") != F.col("v")) | (F.col("cu") <= F.col("cv"))))
        size = F.when(F.col("cu") == F.col("cv"), F.col("nu")).otherwise(F.col("nu") + F.col("nv"))
        grown = staged(grown.select(F.col("cu").alias("u"), F.col("cv").alias("v"), "e", size.alias("n")))
        fits = (F.col("n") <= cell) | F.lit(depth == 64)
        done = done.unionByName(grown.filter(fits & ((F.col("u") != F.col("v")) | (F.col("n") > 1))).select("u", "v", F.lit(depth).alias("depth")))
        open_ = grown.filter(~fits).select("u", "v", "e")
    return done


def _forests(keys: DataFrame, errors: int, cell: int) -> DataFrame:
    """(a, b): links of a spanning forest of each cell, as keys."""
    found = staged(cells(keys, errors, cell).select(F.xxhash64("u", "v", "depth").alias("cell"), "u", "v", "depth"))
    depths = [r[0] for r in found.select("depth").distinct().collect()]  # at most 64 / STEP + 1
    if not depths:
        return keys.sparkSession.createDataFrame([], "a long, b long")
    sides = found.select("cell", "depth", "u", "v", F.explode(F.when(F.col("u") == F.col("v"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("node", F.when(F.col("side") == 0, F.col("u")).otherwise(F.col("v")))
    at = keys.select("key", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _bits(F.col("key"), d).alias("node")) for d in depths))).alias("x")).select("key", "x.depth", "x.node")
    members = at.join(sides, ["depth", "node"]).select("cell", "depth", "side", (F.col("u") == F.col("v")).alias("twins"), "key")

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        key = part["key"].to_numpy().view(U64)
        side = part["side"].to_numpy()
        left, right = np.sort(key[side == 0]), np.sort(key[side == 1])
        forest = Forest(key)
        links = [forest.add(x, y) for x, y in trie_links(left, None if part["twins"].iloc[0] else right, int(part["depth"].iloc[0]), errors)]
        if not links:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return pd.DataFrame({"a": np.concatenate([x for x, _ in links]).view(np.int64), "b": np.concatenate([y for _, y in links]).view(np.int64)})

    return members.groupBy("cell").applyInPandas(joined, "a long, b long")


def near_copies(docs: DataFrame, words: int = WORDS, errors: int = ERRORS, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs; the fingerprint as 16 hexadecimal digits."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    rows = staged(_fingerprints(docs, words))
    known = staged(rows.groupBy("f").agg(F.min("doc_id").alias("least")))

    def links() -> DataFrame:
        ahead = _forests(known.select(F.col("f").alias("key")), errors, cell)
        swapped = _forests(known.select(_swapped(F.col("f")).alias("key")), errors, cell).select(_swapped(F.col("a")).alias("a"), _swapped(F.col("b")).alias("b"))
        return ahead.unionByName(swapped).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    found = settled(links)
    labelled = staged(known.join(components(found).withColumnRenamed("c", "f"), "f", "left").withColumn("label", F.coalesce("label", "f")))
    first = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = labelled.join(first, "label").select("f", "component_id")
    return rows.join(ids, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
