"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the query set; it is taken in blocks of BLOCK_ITEMS items, each against all documents:

1. A text is read once into the stream of its words that the block's items use (ids and gaps, a few bytes a word).
2. Passages are windows of words. Their term counts over all documents give the idf; terms in over COMMON of the
   passages are left out of the vectors unless they are among the KEY_TERMS rarest of an item.
3. Randomised SVD of the TF-IDF matrix of all passages and, weighted, the items: each
   partition sums its share of A'(A Omega), the shares are added by term, and a second pass with the orthonormal
   basis gives the projected Gram matrix, whose eigenvectors are the right singular vectors.
4. Candidates are retrieved in the latent space: a window is compared with all items there, and its (window, item)
   goes on if their cosine, times the window's length, reaches the least that a leak of step 5 can have. That least is
   of each item: the lightest of its words that are enough for a leak, less what the item's part outside of the latent
   space can make up; items weigh so much in the SVD that this part is small. So no leak is lost. Windows whose terms
   can't reach any item's least aren't projected. Windows are twice the longest item and overlap by half, so every
   item-long stretch of words lies in one. The cosine is given with each leak as well.
5. A candidate's words around the item's rare terms are checked: the longest common subsequence in words over the
   item's length, and how many of the item's answer terms, its rarest words, are there. It is a leak if the
   subsequence covers SURE of the item, or LIKELY of it with ANSWERS of the answer terms. Where a window has no answer
   term, the words around all of the item's words are checked.

Defined cases: null or empty texts match nothing; null or empty items are left out; items without three words are
left out as well, for their words prove nothing; repeated items each report; rows with one doc_id report as one; a
null doc_id is reported as null; an empty table on either side gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Memo, staged, texts

BLOCK_ITEMS, COMMON, KEY_TERMS, SEED = 256, 0.01, 8, 11
SURE, LIKELY, ANSWERS, EXTRA_RANK = 0.8, 0.5, 0.6, 24
#: So many times the weight of all passages have the items in the SVD: they lie in the latent space but for a small part.
ITEM_WEIGHT = 10_000.0
MARKS = string.punctuation + "“”‘’«»…–—¿¡"
NONE = 0xFFFFFFFF
SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answers double, at long"


def normal(word: str) -> str:
    return word.strip(MARKS).lower()


def _many(x: float, sums: np.ndarray) -> int:
    """The least number that is x or more, as an index of sums."""
    return min(max(0, int(np.ceil(x - 1e-6))), len(sums) - 1)


class Block:
    """Items of a block, their vocabulary, and the model once it is fitted."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words) for i, t in items if len(words := [w for x in t.split() if (w := normal(x))]) >= 3]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in self.items for w in words))}
        self.stride = max((len(w) for _, w in self.items), default=1)
        self.idf = self.basis = self.latent = self.inside = self.outside = None

    def weigh(self, counts: dict[int, int], passages: int) -> None:
        size = len(self.vocabulary)
        found = np.array([counts.get(k, 0) for k in range(size)], float)
        idf = np.log((passages + 1) / (found + 1)) + 0.1
        use = found <= COMMON * passages
        self.seqs = [np.array([self.vocabulary[w] for w in words]) for _, words in self.items]
        self.counts = [np.unique(q, return_counts=True) for q in self.seqs]
        self.answers = []
        for q, (terms, needed) in zip(self.seqs, self.counts, strict=True):
            rarest = sorted(terms.tolist(), key=lambda k: (-idf[k], k))
            self.answers.append(rarest[: max(3, len(rarest) // 5)])
            # so many that neither way to be a leak can do without all of them
            held = np.cumsum(needed[np.searchsorted(terms, rarest)])
            enough = 1 + int(np.searchsorted(held, (1 - SURE) * len(q) + 1e-9, "right"))
            use[rarest[: max(KEY_TERMS, enough, 1 + int((1 - ANSWERS) * len(self.answers[-1]) + 1e-9))]] = True
        self.idf = np.where(use, idf, 0.0)
        self.post()

    def post(self) -> None:
        """Of each item the least product with a window that holds enough of it for a leak; of each term the most that
        one occurrence adds to any item's product, and how often it counts."""
        size = len(self.vocabulary)
        self.least, self.upper, self.most = np.zeros(len(self.items)), np.zeros(size), np.zeros(size)
        for i, (terms, needed) in enumerate(self.counts):
            kept = self.idf[terms] > 0
            length = max(float(np.linalg.norm(needed * self.idf[terms])), 1e-12)
            value = needed * self.idf[terms] ** 2 / length  # of one occurrence
            free = len(self.seqs[i]) - int(needed[kept].sum())
            words = np.append(0.0, np.cumsum(np.sort(np.repeat(value[kept], needed[kept]))))
            answers = np.append(0.0, np.cumsum(np.sort(value[np.isin(terms, self.answers[i]) & kept])))
            wide = int((self.idf[self.answers[i]] == 0).sum())
            asked = ANSWERS * len(self.answers[i]) - wide
            sure, likely = (words[_many(share * len(self.seqs[i]) - free, words)] for share in (SURE, LIKELY))
            self.least[i] = min(sure, max(likely, answers[_many(asked, answers)]))
            self.upper[terms] = np.maximum(self.upper[terms], value)
            self.most[terms] = np.maximum(self.most[terms], needed)

    def item_rows(self) -> np.ndarray:
        a = np.zeros((len(self.items), len(self.vocabulary)))
        for r, q in enumerate(self.seqs):
            for k, n in Counter(q.tolist()).items():
                a[r, k] = n * self.idf[k]
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)


#: Rounding of single precision.
SLACK = 1e-3

#: Cells whose rows of the basis are held at once: little enough for a core's cache.
STEP = 1 << 11


def _cells(block: Block, streams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Cells (passage, term, count times idf) of passages of `stride` words, sorted by passage, and each passage's
    document and number in it. Counts are not damped, so passages in a row add up to windows."""
    docs, wins, terms = [], [], []
    for d, (ids, at) in enumerate(streams):
        rare = block.idf[ids] > 0
        terms.append(ids[rare])
        wins.append(at[rare] // block.stride)
        docs.append(np.full(len(terms[-1]), d))
    doc, win, term = (np.concatenate(x) if x else np.zeros(0, int) for x in (docs, wins, terms))
    if not len(doc):
        return (np.zeros(0, int),) * 5
    key = (doc << 40 | win) * len(block.vocabulary) + term if len(block.vocabulary) < 1 << 16 else None
    order = np.argsort(key) if key is not None else np.lexsort((term, win, doc))
    doc, win, term = doc[order], win[order], term[order]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (win[1:] != win[:-1]))
    start = np.flatnonzero(fresh | np.append(True, term[1:] != term[:-1]))
    count = np.diff(np.append(start, len(doc)))
    row = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    return row[start], term[start], (count * block.idf[term[start]]).astype(np.float32), doc[first], win[first]


def _normal(row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of passages of length 1."""
    return (weight / np.sqrt(np.bincount(row, weight.astype(np.float64) ** 2))[row]).astype(np.float32) if len(row) else weight


def _project(row: np.ndarray, term: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of A times basis."""
    out = np.zeros((int(row[-1]) + 1 if len(row) else 0, basis.shape[1]), np.float32)
    for i in range(0, len(row), STEP):
        r = row[i : i + STEP]
        start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[start]] += np.add.reduceat(weight[i : i + STEP, None] * basis[term[i : i + STEP]], start, axis=0)
    return out


def _transposed(row: np.ndarray, term: np.ndarray, weight: np.ndarray, y: np.ndarray, total: np.ndarray) -> None:
    """total += A' y."""
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    for i in range(0, len(row), STEP):
        t = term[i : i + STEP]
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        total[t[start]] += np.add.reduceat(weight[i : i + STEP, None] * y[row[i : i + STEP]], start, axis=0)


#: Windows that are compared with the items at once.
WINDOWS = 1 << 12


def _candidates(block: Block, row: np.ndarray, term: np.ndarray, weight: np.ndarray, doc: np.ndarray, win: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first passage, item), sorted, of all windows of two passages that come near enough to an item in the
    latent space: projections of passages add up to windows."""
    count = np.minimum(np.rint(weight / block.idf[term]), block.most[term])
    weight = (count * block.idf[term]).astype(np.float32)
    many = len(doc)
    reach = np.append(np.bincount(row, count * block.upper[term], many), 0.0)
    length = np.append(np.sqrt(np.bincount(row, weight.astype(np.float64) ** 2, many)), 0.0)
    span = int(win.max()) + 2
    place = doc * span + win
    start = np.unique(np.concatenate([place, place[win > 0] - 1]))
    first, second = (np.minimum(np.searchsorted(place, x), many - 1) for x in (start, start + 1))
    first, second = np.where(place[first] == start, first, many), np.where(place[second] == start + 1, second, many)
    near = reach[first] + reach[second] >= block.least.min() * (1 - SLACK)
    start, first, second = start[near], first[near], second[near]
    used = np.zeros(many + 1, bool)
    used[first] = used[second] = True
    used[many] = False
    kept, new = used[row], np.cumsum(used) - 1
    z = _project(new[row[kept]], term[kept], weight[kept], block.basis)
    z = np.concatenate([z, np.zeros((1, block.basis.shape[1]), np.float32)])
    new[many] = len(z) - 1
    windows, items = [], []
    for i in range(0, len(start), WINDOWS):
        a, b = first[i : i + WINDOWS], second[i : i + WINDOWS]
        cosine_times_length = (z[new[a]] + z[new[b]]) @ block.inside.T
        least = block.least * (1 - SLACK) - (length[a] + length[b])[:, None] * block.outside
        w, item = np.nonzero(cosine_times_length >= least)
        windows.append(start[i + w])
        items.append(item)
    at, item = (np.concatenate(x) if x else np.zeros(0, int) for x in (windows, items))
    return at // span, at % span, item


def _cosines(block: Block, row: np.ndarray, term: np.ndarray, weight: np.ndarray, doc: np.ndarray, win: np.ndarray, leaks: list[tuple[int, int, int]]) -> list[float]:
    """Latent cosines of (document, first passage, item): passages are projected and added to windows."""
    place = {x: r for r, x in enumerate(zip(doc.tolist(), win.tolist(), strict=True))}
    used = np.zeros(len(doc), bool)
    pairs = [[r for r in (place.get((d, w)), place.get((d, w + 1))) if r is not None] for d, w, _ in leaks]
    used[[r for p in pairs for r in p]] = True
    kept = used[row]
    z = _project((np.cumsum(used) - 1)[row[kept]], term[kept], weight[kept], block.basis)
    new = np.cumsum(used) - 1
    out = []
    for p, (_, _, item) in zip(pairs, leaks, strict=True):
        v = z[new[p]].sum(axis=0)
        out.append(float(v @ block.latent[item] / max(float(np.linalg.norm(v)), 1e-12)))
    return out


def word_streams(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, ids, gaps): of each text the words that the block uses; a gap is the count of words since the last."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(block.vocabulary)  # words of at most BLOCK_ITEMS items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        memo = Memo(lambda w: known.get(normal(w), NONE).to_bytes(4, "little"))
        for batch in batches:
            ids, gaps = [], []
            for text in batch.column("text").to_pylist():
                stream = np.frombuffer(b"".join([memo[w] for w in text.split()]), "<u4")
                at = np.flatnonzero(stream != NONE)
                ids.append(stream[at].astype("<u2" if len(known) < 1 << 16 else "<u4").tobytes())
                gap = np.diff(at, prepend=0)
                gaps.append(gap.astype("<u2" if not len(gap) or gap.max() < 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "gaps": pa.array(gaps, pa.binary())})

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, gaps binary")


def _streams(batch: pa.RecordBatch, block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    kind = "<u2" if len(block.vocabulary) < 1 << 16 else "<u4"
    out = []
    for i, g in zip(batch.column("ids").to_pylist(), batch.column("gaps").to_pylist(), strict=True):
        ids = np.frombuffer(i, kind).astype(np.int64)
        out.append((ids, np.cumsum(np.frombuffer(g, "<u4" if len(g) == 4 * len(ids) else "<u2"), dtype=np.int64)))
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _counts(streams: DataFrame, block: Block) -> tuple[dict[int, int], int]:
    """Passages that hold each term, and all passages that hold any; passages don't overlap here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(block.vocabulary)
        total = np.zeros(size + 1, np.int64)
        for batch in _slices(batches):
            own = _streams(batch, block)
            span = [(a // block.stride)[-1] + 1 if len(a) else 0 for _, a in own]
            base = np.cumsum([0, *span])
            key = np.concatenate([(a // block.stride + b) * size + i for (i, a), b in zip(own, base.tolist(), strict=False)]) if own else np.zeros(0, np.int64)
            total[:size] += np.bincount(np.unique(key) % size, minlength=size) if len(key) else 0
            total[size] += int(base[-1])
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(size + 1), pa.int32()), "n": pa.array(total)})

    summed = streams.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in summed.collect()}  # a row for each word of the block
    return found, found.pop(len(block.vocabulary), 0)


def _gram_times(streams: DataFrame, block: Block, basis: np.ndarray, passages: int) -> np.ndarray:
    """A'A basis, of all passages and the weighted items."""
    sent = streams.sparkSession.sparkContext.broadcast(basis.astype(np.float32))  # words of the block x (items + EXTRA_RANK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sent.value.shape)
        for batch in _slices(batches):
            row, term, weight, _, _ = _cells(block, _streams(batch, block))
            if len(row):
                weight = _normal(row, weight)
                _transposed(row, term, weight, _project(row, term, weight, sent.value), total)
        full = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_pydict({"term": pa.array(full, pa.int32()), "sums": pa.array(list(total[full].astype(np.float32)), pa.list_(pa.float32()))})

    def added(table: pa.Table) -> pa.Table:
        sums = np.asarray(table.column("sums").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"term": pa.array([table.column("term")[0].as_py()], pa.int32()), "sums": pa.array([sums.astype(np.float32)], pa.list_(pa.float32()))})

    schema = "term int, sums array<float>"
    total = np.zeros(basis.shape)
    for r in streams.mapInArrow(run, schema).groupBy("term").applyInArrow(added, schema).toLocalIterator():  # one row for each word of the block
        total[r["term"]] = r["sums"]
    items = block.item_rows()
    return total + ITEM_WEIGHT * max(1.0, passages / len(items)) * (items.T @ (items @ basis))


def fit(streams: DataFrame, block: Block) -> Block:
    """idf, the right singular vectors and the items' latent vectors."""
    counts, passages = _counts(streams, block)
    block.weigh(counts, passages)
    rank = min(len(block.vocabulary), len(block.items) + EXTRA_RANK)
    draw = np.random.default_rng(SEED).standard_normal((len(block.vocabulary), rank))
    q, _ = np.linalg.qr(_gram_times(streams, block, draw * (block.idf > 0)[:, None], passages))
    _, turn = np.linalg.eigh(q.T @ _gram_times(streams, block, q, passages))
    block.basis = (q @ turn[:, ::-1]).astype(np.float32)
    rows = block.item_rows()
    latent = rows @ block.basis
    block.inside, block.outside = latent.astype(np.float32), np.linalg.norm(rows - latent @ block.basis.T, axis=1)
    block.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return block


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest one, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for x in b:
        if m := masks.get(x):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def leaks_by(lcs: float, answers: float) -> bool:
    return lcs >= SURE or lcs >= LIKELY and answers >= ANSWERS


def _check(block: Block, item: int, ids: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[float, float, int]:
    """Best cover of the item near its rare words in the window, its answer terms there, and the word it begins at.
    Windows that lack the words for either way to be a leak are left at once."""
    seq, answers, (words, needed) = block.seqs[item], block.answers[item], block.counts[item]
    n = len(seq)
    cover, share = int(np.minimum(counts[words], needed).sum()) / n, float((counts[answers] > 0).mean())
    if cover < SURE and (cover < LIKELY or share < ANSWERS):
        return 0.0, 0.0, 0
    own = np.isin(ids, seq)
    ids, at = ids[own], at[own]
    marks = at[np.isin(ids, answers)]
    if not len(marks):
        marks = at
    best = (0.0, 0.0, 0)
    reach = n + n // 2
    for centre in np.unique(marks // max(1, n // 2)) * max(1, n // 2):
        a, b = np.searchsorted(at, (centre - n // 2 - reach // 2, centre + n // 2 + reach // 2))
        part = ids[a:b].tolist()
        found = (common_subsequence(seq.tolist(), part) / n, len(set(answers) & set(part)) / len(answers), int(at[a]) if a < len(at) else 0)
        best = max(best, found, key=lambda x: (leaks_by(*x[:2]), x))
    return best


def search(streams: DataFrame, block: Block) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answers, at): the best leak of each document and item."""
    sent = streams.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_ITEMS items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in _slices(batches):
            own = _streams(batch, block)
            row, term, weight, doc, win = _cells(block, own)
            if not len(row):
                continue
            out, where, last = [], [], None
            for d, w, item in zip(*(x.tolist() for x in _candidates(block, row, term, weight, doc, win)), strict=True):
                if (d, w) != last:
                    ids, at = own[d]
                    lo, hi = np.searchsorted(at, (w * block.stride, (w + 2) * block.stride))
                    ids, at, last = ids[lo:hi], at[lo:hi], (d, w)
                    counts = np.bincount(ids, minlength=len(block.vocabulary))
                lcs, answers, start = _check(block, item, ids, at, counts)
                if leaks_by(lcs, answers):
                    out.append([d, block.items[item][0], 0.0, lcs, answers, start])
                    where.append((d, w, item))
            for found, cosine in zip(out, _cosines(block, row, term, weight, doc, win, where) if out else (), strict=True):
                found[2] = cosine
            if out:
                doc_ids = batch.column("doc_id").to_pylist()
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([doc_ids[d] for d in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:5]), pa.array(columns[5], pa.int64())], names=["doc_id", "item_id", "cosine", "lcs", "answers", "at"])

    found = streams.mapInArrow(run, SCHEMA)
    best = F.max(F.struct("lcs", "answers", "cosine", (-F.col("at")).alias("at"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs", "best.answers", (-F.col("best.at")).alias("at"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that leaks into it."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").orderBy("item_id", "text")
    found, held = [], []

    def close() -> None:
        block = Block(held)
        if block.items:
            streams = staged(word_streams(docs, block))
            found.append(search(streams, fit(streams, block)))

    for r in items.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == BLOCK_ITEMS:
            close()
            held = []
    if held:
        close()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


#: So many doc_ids (8 bytes each) may be broadcast; beyond it the join shuffles.
MOST_BROADCAST = 2_000_000


def without(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """docs but for those rows whose doc_id is in doc_ids."""
    gone = staged(doc_ids.select(F.col("doc_id").cast("long").alias("_gone")).filter("_gone is not null").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
