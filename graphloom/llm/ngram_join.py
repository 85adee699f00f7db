"""Set similarity join of documents by vertical partitioning of their word n-grams.

Two documents link when their n-gram sets A, B have 100 |A and B| >= threshold |A or B|; components follow links.

1. Documents of one set are one class, known by a 64-bit hash of the set; all further work is on classes.
2. Global order: n-grams ascend by frequency, taken from CELLS counters of all n-grams of all documents (added up by
   partition, one byte a counter when sent), then by hash. Any order gives the same links; rare ones first gives few
   candidates.
3. Candidates: linked sets share an n-gram among the first |A| - ceil(threshold |A|) + 1 of each. The place of the
   first that they share bounds the size of their overlap, and so the size of the other set. The members of such a
   group (n-gram, size band) aren't paired with each other: in rounds each meets one member alone, unless they are in
   one component already, as long as a round links one in a hundred, ROUNDS times at most. Only groups that the links
   found so far leave in several components are paired, only across components, and only where sizes, places and
   parity sketches of the sets, which bound their difference from below, allow a link.
4. Verification: the global order is cut at FRAGMENTS - 1 pivots of equal weight. Each fragment counts the overlap of
   a pair's segments there, and the counts are summed by pair.
5. Components by alternating large-star and small-star steps; every step's edges are a written table. Up to REST links
   are left to one task.

Odds: two of N different sets share their class hash with N^2 / 2^65.

Defined cases: null or empty text, or white space alone, has the empty set and links with nothing; with fewer words
than n the whole sequence is the one n-gram; repeated rows are one class; a component's id is its least doc_id that
isn't null, null if it has none; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, mix, release, settled, slices, small_batches, staged, substring_hasher, texts

CELLS, CHUNKS, FRAGMENTS, MOST_BROADCAST = 1 << 20, 64, 4, 2_000_000
#: 64-bit words of a set's parity sketch, and the most rounds in which groups meet one member each.
SKETCH, ROUNDS = 8, 4
#: Links whose components one task finds; pairs of a class that meet in one task.
REST, SHARE = 1 << 18, 1000
U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)


#: Bytes whose words are hashed at once: little enough for a core's cache.
CHUNK = 1 << 18
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
CUT = re.compile(rb"[\x20\x09-\x0d]")


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of each text's words, in order. Texts are hashed together, long ones in pieces cut at white space."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    pieces: list[bytes] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        data = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
        space = SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.append(0, edge)
        starts, ends = edge[::2], edge[1::2]
        h = substring_hasher(data)(starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in pieces]))
        for owner, lo, hi in zip(owners, np.append(0, bounds[:-1]).tolist(), bounds.tolist(), strict=True):
            out[owner].append(h[lo:hi])

    for i, text in enumerate(texts):
        text, at = text.lower(), 0
        while at < len(text):
            cut = CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            piece = text[at : cut.start() if cut else len(text)]
            at += len(piece) + 1
            if held and held + len(piece) > CHUNK:
                flush()
                pieces.clear()
                owners.clear()
                held = 0
            pieces.append(piece)
            owners.append(i)
            held += len(piece) + 1
    if pieces:
        flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, U64) for x in out]


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams."""
    out = []
    for h in word_hashes(texts):
        if not len(h):
            out.append(h)
            continue
        span = min(words, len(h))
        total = h[: len(h) - span + 1] + U64(span)
        for j in range(1, span):
            total = total * ODD + h[j : len(h) - span + 1 + j]
        total = np.sort(mix(total))
        out.append(total[np.append(True, total[1:] != total[:-1])])
    return out


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch)
    release()


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the n-grams in 64 SKETCH cells. Two sketches differ in no more bits than their sets in n-grams."""
    odd = np.bincount((tokens & U64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Order:
    """The global order as 64-bit keys: rank of the n-gram's counter, then its hash; and the pivots that cut it."""

    def __init__(self, counts: np.ndarray):
        self.rank = np.minimum(255, 12 * np.log2(1 + counts)).astype(np.uint8)
        mass = np.bincount(self.rank, counts, 256)
        before = np.cumsum(mass) - mass
        self.pivots = []
        for i in range(1, FRAGMENTS):
            goal = mass.sum() * i / FRAGMENTS
            r = min(255, int(np.searchsorted(np.cumsum(mass), goal)))
            inside = (goal - before[r]) / mass[r] if mass[r] else 0.0
            self.pivots.append((r << 56) + int(min(max(inside, 0.0), 1.0) * ((1 << 56) - 1)))
        self.pivots = np.array(self.pivots, U64)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        return self.rank[(tokens >> U64(44)).astype(np.int64)].astype(U64) << U64(56) | tokens >> U64(8)


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents (doc_id, n, c, sketch), and of counters (chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in few(batches):
            sets = shingle_sets(as_bytes(batch.column("text")), words)
            if sets:
                counts += np.bincount((np.concatenate(sets) >> U64(44)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "c": pa.array([class_of(s) for s in sets], pa.int64()), "sketch": pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), "chunk": pa.nulls(len(sets), pa.int32()), "counts": pa.nulls(len(sets), pa.binary())})
        parts = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(counts.reshape(CHUNKS, -1)) if p.any()]
        if parts:
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "c": none, "sketch": pa.nulls(len(parts), pa.list_(pa.int64())), "chunk": pa.array([i for i, _ in parts], pa.int32()), "counts": pa.array([p for _, p in parts], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n long, c long, sketch array<long>, chunk int, counts binary")


def _order(survey: DataFrame) -> Order:
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64)
                sums[i] = sums[i] + own if i in sums else own
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    total = np.zeros((CHUNKS, CELLS // CHUNKS), np.int64)
    parts = survey.filter("chunk is not null").select("chunk", "counts").repartition(16, "chunk").mapInArrow(added, "chunk int, counts binary")
    for r in parts.toLocalIterator():  # CHUNKS rows
        total[r["chunk"]] += np.frombuffer(r["counts"], np.int64)
    return Order(total.ravel())


def _postings(docs: DataFrame, words: int, threshold: int, order) -> DataFrame:
    """(t, n, most, c): each class and the first n-grams of its set; a class of copies may come more than once. A set
    of over `most` n-grams can't link with this one if t is the first n-gram that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            seen, first, most, sizes, classes = set(), [], [], [], []
            for tokens in shingle_sets(as_bytes(batch.column("text")), words):
                if not len(tokens) or (c := class_of(tokens)) in seen:
                    continue
                seen.add(c)
                n = len(tokens)
                p = prefix(n, threshold)
                keys = order.value.keys(tokens)
                at = np.argpartition(keys, p - 1)[:p] if p < n else np.arange(n)
                before = np.searchsorted(np.sort(keys[at]), keys[at])  # n-grams of the set that come earlier
                first.append(tokens[at])
                most.append((100 + threshold) * (n - before) // threshold - n)
                sizes.append(n)
                classes.append(c)
            if first:
                each = [len(x) for x in first]
                yield pa.RecordBatch.from_pydict({"t": np.concatenate(first).view(np.int64), "n": np.repeat(np.array(sizes, np.int32), each), "most": np.concatenate(most).astype(np.int32), "c": np.repeat(np.array(classes, np.int64), each)})

    return docs.select("text").mapInArrow(run, "t long, n int, most int, c long")


def _segments(docs: DataFrame, words: int, order, leads: bool) -> DataFrame:
    """(a, salt, f, c, tokens): the n-grams of class c that are in fragment f, for its pairs of least class a: of a itself
    if leads, once for each of its salts, else of each other member of its pairs. docs: text, and the wanted c, salts,
    partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = []
            for tokens, c, salts, partners in zip(shingle_sets(as_bytes(batch.column("text")), words), *(batch.column(x).to_pylist() for x in ("c", "salts", "partners")), strict=True):
                if class_of(tokens) != c:  # another text of the same doc_id
                    continue
                at = np.searchsorted(order.value.pivots, order.value.keys(tokens), side="right")
                for f in np.unique(at).tolist():
                    own = tokens[at == f].view(np.int64)
                    rows += [(c, s, f, c, own) for s in range(salts)] if leads else [(p["a"], p["salt"], f, c, own) for p in partners]
                    if len(rows) >= 2000:
                        yield from made(rows)
                        rows = []
            yield from made(rows)

    def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 2000):
            a, s, f, c, own = zip(*rows[i : i + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(f, pa.int32()), pa.array(c, pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["a", "salt", "f", "c", "tokens"])

    chosen = docs.filter("salts is not null") if leads else docs.filter("partners is not null")
    return chosen.select("text", "c", "salts", "partners").mapInArrow(run, "a long, salt long, f int, c long, tokens array<long>")


class Join:
    def __init__(self, docs: DataFrame, words: int, threshold: int):
        self.words, self.threshold = words, threshold
        self.docs = texts(docs)
        survey = staged(_survey(self.docs, words))
        self.sets = survey.filter("n is not null").select("doc_id", "n", "c")
        self.sketches = survey.filter("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("c", "n", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)))
        self.order = docs.sparkSession.sparkContext.broadcast(_order(survey))  # a megabyte

    def meeting(self, members: DataFrame, by: list[str]) -> DataFrame:
        """Members of the groups that hold several labels, without those that none of their group may link with."""
        group = members.groupBy(*by).agg(F.min("n").alias("least"), F.max("most").alias("largest"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
        return members.join(group, by).filter("most >= least and n <= largest").drop("least", "largest", "x", "y")

    def groups(self) -> DataFrame:
        """(t, b, n, most, c, label): members of the groups, n-gram and size band; each class has its own label."""
        rows = staged(_postings(self.docs, self.words, self.threshold, self.order))
        twice = rows.groupBy("t").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").select("t")
        rows = staged(rows.join(twice, "t", "left_semi").dropDuplicates(["t", "c"]))
        band = F.floor(F.log(F.col("n").cast("double")) / -math.log(self.threshold / 100)) if self.threshold < 100 else F.col("n")
        bands = F.array(band.cast("int"), band.cast("int") + 1) if self.threshold < 100 else F.array(band)
        members = self.meeting(rows.withColumn("label", F.col("c")), ["t"]).withColumn("b", F.explode(bands))
        return self.meeting(members, ["t", "b"]).select("t", "b", "n", "most", "c", "label")

    def fitting(self, a: str, b: str) -> Column:
        """Whether sizes and places allow a link, between components."""
        return (F.col(f"{a}.label") != F.col(f"{b}.label")) & (F.col(f"{a}.n") <= F.col(f"{b}.most")) & (F.col(f"{b}.n") <= F.col(f"{a}.most"))

    def near(self, a: str, b: str) -> Column:
        """Whether sketches allow a link: linked sets of n and m n-grams differ in (n + m) (100 - threshold) /
        (100 + threshold) at most, and their sketches in no more bits."""
        bits = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
        return bits * (100 + self.threshold) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - self.threshold)

    def stars(self, members: DataFrame, seed: int) -> DataFrame:
        """Candidates (a, b): each member with one of its group, the least by a hash of the round, if they may link."""
        lead = members.groupBy("t", "b").agg(F.min(F.struct(F.xxhash64("c", F.lit(seed)).alias("h"), "c", "label", "n", "most")).alias("lead"))
        lead = lead.select("t", "b", "lead.c", "lead.label", "lead.n", "lead.most").alias("y")
        same = (F.col("x.t") == F.col("y.t")) & (F.col("x.b") == F.col("y.b"))
        pairs = members.alias("x").join(lead, same & self.fitting("x", "y")).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
        x, y = self.sketches.alias("x"), self.sketches.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.c")).join(y, F.col("b") == F.col("y.c")).filter(self.near("x", "y")).select("a", "b")

    def across(self, members: DataFrame) -> DataFrame:
        """Candidates (a, b): members of one group that are in different components so far. The tests are part of the
        join, so pairs that can't link are never made."""
        members = staged(members.join(self.sketches.drop("n"), "c"))
        same = (F.col("x.t") == F.col("y.t")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.c") < F.col("y.c"))
        pairs = members.alias("x").join(members.alias("y"), same & self.fitting("x", "y") & self.near("x", "y"))
        return pairs.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()

    def relabelled(self, members: DataFrame, links: DataFrame) -> DataFrame:
        known = members.drop("label").join(components(links), "c", "left").withColumn("label", F.coalesce("label", "c"))
        return self.meeting(known, ["t", "b"])

    def links(self, pairs: DataFrame, many: bool) -> DataFrame:
        """Those of the pairs whose overlaps, counted fragment by fragment, sum to a link. The segments of b go to the
        fragments of a at once: a text's n-grams are shuffled once for each of its pairs, and never written besides. A
        class a of many pairs is cut by salts of b, SHARE pairs to a salt, so its fragments spread over tasks; if a class b
        may have many (not in rounds, where its n-grams bound them), so are its partners."""
        cut = lambda n: F.ceil(n / F.lit(SHARE))
        heads = staged(pairs.groupBy("a").agg(cut(F.count(F.lit(1))).alias("salts")))
        salted = pairs.join(heads, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts")).drop("salts")
        own = [F.col("b").alias("c")]
        if many:
            salted = salted.join(pairs.groupBy("b").agg(cut(F.count(F.lit(1))).alias("k")), "b")
            own.append(F.pmod(F.xxhash64("a"), "k").alias("k"))
        partners = salted.groupBy(*own).agg(F.collect_list(F.struct("a", "salt")).alias("partners")).select("c", F.lit(None).cast("long").alias("salts"), "partners")
        both = partners.unionByName(heads.select(F.col("a").alias("c"), "salts", F.lit(None).cast("array<struct<a:long,salt:long>>").alias("partners")))
        wanted = staged(self.sets.groupBy("c", "n").agg(F.min("doc_id").alias("_id")).join(both, "c"))
        side = wanted.select("_id", "c", "salts", "partners")
        size = wanted.agg(F.sum(F.lit(4) + F.coalesce(F.size("partners") * 2, F.lit(0)))).first()[0] or 0
        side = F.broadcast(side) if size <= MOST_BROADCAST else side
        chosen = self.docs.join(side, F.col("doc_id").eqNullSafe(F.col("_id")))
        left = _segments(chosen, self.words, self.order, True).select("a", "salt", "f", F.col("tokens").alias("a_tokens"))
        right = _segments(chosen, self.words, self.order, False).select("a", "salt", "f", F.col("c").alias("b"), F.col("tokens").alias("b_tokens"))
        partial = left.join(right, ["a", "salt", "f"]).select("a", "salt", "b", "f", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("k"))
        total = partial.groupBy("a", "salt", "b", "f").agg(F.max("k").alias("k")).groupBy("a", "b").agg(F.sum("k").alias("k"))
        sizes = wanted.select("c", "n").distinct()
        total = total.join(sizes.withColumnsRenamed({"c": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"c": "b", "n": "nb"}), "b")
        return total.filter(F.col("k") * 100 >= (F.col("na") + F.col("nb") - F.col("k")) * self.threshold).select("a", "b")

    def fresh(self, pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
        return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")

    def run(self) -> DataFrame:
        members = settled(self.groups)
        self.sketches = staged(self.sketches.join(members.select("c").distinct(), "c"))
        links = tried = None
        paired = members.isEmpty()
        seed = 0
        while not paired:
            paired = seed == ROUNDS
            pairs = settled(lambda: self.fresh(self.across(members) if paired else self.stars(members, seed), tried))  # noqa: B023
            tried = pairs if tried is None else tried.unionByName(pairs)
            new = settled(lambda: self.links(pairs, paired))  # noqa: B023
            links = new if links is None else links.unionByName(new)
            if not paired:
                waiting = members.agg(F.approx_count_distinct("c")).first()[0]
                members = settled(lambda: self.relabelled(members, links))  # noqa: B023
                paired = members.isEmpty()
                seed = seed + 1 if new.count() * 100 > waiting else ROUNDS
        labelled = self.sets.filter("n > 0").withColumn("label", F.col("c"))
        if links is not None:
            labelled = labelled.drop("label").join(components(links), "c", "left").withColumn("label", F.coalesce("label", "c"))
        least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        whole = labelled.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return whole.unionByName(self.sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), sorted, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[u], top[v]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return nodes, nodes[top]
        x, y = x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := top[top], top):
            top = up


def components(links: DataFrame, rest: int = REST) -> DataFrame:
    """(c, label) of every linked class; label is the least class of its component. Up to `rest` links, a bounded few
    megabytes, are read by one task; more are contracted by steps of stars."""
    if links.count() <= rest:

        def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))], names=["c", "label"])

        return links.select("a", "b").coalesce(1).mapInArrow(labelled, "c long, label long")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = near.join(least, "u")
        if large:
            return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    edges, before = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct()), None
    while True:
        edges = staged(star(star(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("label")).distinct())
        before = now


def similar(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    small_batches(docs.sparkSession)
    return Join(docs, words, threshold).run()
