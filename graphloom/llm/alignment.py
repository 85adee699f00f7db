"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

The state is the side that leads and the bytes of its last token that the other side hasn't matched. The next token of
the side behind takes them up: they shrink, or the token reaches beyond them and its own side leads, or nothing dangles
and a group closes. Each step links the two tokens that it compares. Transitions are memoised by state and token.

A text is read in units, which end where both tokenizers always end a token: before a space or line break that follows
something else. So a unit begins and ends with nothing dangling, its alignment is the same wherever it stands, and the
transducer runs once for each distinct unit that a worker's table holds; texts are sums over their units.

1. One pass over the texts writes a row for each: counts, the digest of its groups, and its distinct linked id pairs with
   how often each occurs.
2. The pairs' counts over all documents are a grouped sum, combined before the shuffle; each B id's highest is another.
3. The counts go back to the rows: as a broadcast while there are at most MOST_BROADCAST pairs (17 bytes each), beyond
   that by joining the rows' pairs with them and summing by row. Both give the same.

Defined cases: null, empty and undecodable texts, and those that a tokenizer doesn't give back byte for byte (such as a
text with U+2581), have no tokens: zeros and an empty digest; special tokens' strings are plain text; repeated rows
count each; doc_id may be null or repeated; very long texts are read in pieces that end with a unit; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.dist import ship
from graphloom.llm.common import as_bytes, release, slices, small_batches, staged, texts

#: Characters of text that are aligned at once; bytes of groups and transitions that a worker's tables hold; pairs that are broadcast.
CHUNK, TABLE_BYTES, TRANSITIONS, MOST_BROADCAST = 1 << 19, 1 << 27, 1 << 18, 2_000_000
#: From a unit's start to the last character before the next cut.
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
CUT = re.compile(r"(?<=\S)[ \n]")
ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Transducer:
    """Walks two streams of tokens, whose bytes a[id] and b[id] are. States are numbered as they are met: who leads and the
    residual; 0 is the state in which nothing dangles."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.of = (a, b)
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.numbers = {(0, b""): 0}
        self.behind = np.zeros(1 << 10, bool)  # by state: whether B is the side behind
        self.keys, self.next = np.zeros(0, np.int64), np.zeros(0, np.int64)  # (state, token), sorted, and the state after it
        self.known: dict[int, int] = {}

    def after(self, state: int, token: int) -> int:
        """The state after the next token of the side behind, or of A in state 0; -1 if bytes differ."""
        lead, residual = self.states[state]
        if not residual:
            found = (0, self.of[0][token])
        else:
            own = self.of[1 - lead][token]
            if residual.startswith(own):
                found = (lead, residual[len(own) :])
            elif own.startswith(residual):
                found = (1 - lead, own[len(residual) :])
            else:
                return -1
        if not found[1]:
            return 0
        if found not in self.numbers:
            n = self.numbers[found] = len(self.states)
            self.states.append(found)
            self.behind = grown(self.behind, n + 1)
            self.behind[n] = found[0] == 0
        return self.numbers[found]

    def steps(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The states after a token of each, from the memo; transitions that it lacks are made once."""
        key = states << 20 | tokens
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != key) if len(self.keys) else np.arange(len(key))
        if len(new):
            fresh = np.unique(key[new])
            made = np.array([self.after(k >> 20, k & 0xFFFFF) for k in fresh.tolist()], np.int64)
            place = np.searchsorted(self.keys, fresh)
            self.keys, self.next = np.insert(self.keys, place, fresh), np.insert(self.next, place, made)
            at = np.searchsorted(self.keys, key)
        return self.next[at]

    def walk(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """All units in step, unit u being a[a_ends[u - 1] : a_ends[u]] and b[b_ends[u - 1] : b_ends[u]]: which end with
        nothing dangling, the tokens of A and of B that close a group, and the links (unit, A's token, B's token)."""
        i, j = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
        good, state = np.ones(len(i), bool), np.zeros(len(i), np.int64)
        closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        links = [(np.zeros(0, np.int64),) * 3]
        if len(self.keys) > TRANSITIONS:
            self.forget()
        live = np.arange(len(i))
        while len(live):
            s = state[live]
            from_b = self.behind[s]
            no_a, no_b = i[live] >= a_ends[live], j[live] >= b_ends[live]
            stuck = np.where(from_b, no_b, no_a)
            good[live[stuck & ~((s == 0) & no_a & no_b)]] = False
            live, s, from_b = live[~stuck], s[~stuck], from_b[~stuck]
            x, y = live[~from_b], live[from_b]
            tokens = np.empty(len(live), np.int64)
            tokens[~from_b], tokens[from_b] = a[i[x]], b[j[y]]
            i[x] += 1
            j[y] += 1
            linked = live[s > 0]
            links.append((linked, a[i[linked] - 1], b[j[linked] - 1]))
            state[live] = after = self.steps(s, tokens)
            good[live[after < 0]] = False
            closed = live[after == 0]
            closes_a[i[closed] - 1] = closes_b[j[closed] - 1] = True
            live = live[after >= 0]
        return good, closes_a, closes_b, *(np.concatenate(x) for x in zip(*links, strict=True))


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n rows."""
    return x if n <= len(x) else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])


def upto(sizes) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


class Aligner:
    """Both tokenizers of a worker, and the alignments of the units met."""

    def __init__(self, a_path: str, b_path: str, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.transducer = Transducer(self._a_bytes(), self._b_bytes())
        self.a_sizes = np.array([len(x) for x in self.transducer.of[0]])
        #: An id of A with a comma, or a bar at the end of its group; of B with a comma or a semicolon.
        self.words = [f"{i}{mark}".encode() for i in range(len(self.a_sizes)) for mark in ",|"]
        self.b_words = len(self.words)
        self.words += [f"{i}{mark}".encode() for i in range(self.b.get_piece_size()) for mark in ",;"]
        self.table_bytes = table_bytes
        self.lead = len(self.b.encode("."))
        self.clear()

    def _a_bytes(self) -> list[bytes]:
        """Bytes of the byte-level vocabulary: visible characters stand for themselves, the others from U+0100 on."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return out

    def _b_bytes(self) -> list[bytes]:
        out = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if not self.b.is_byte(i) and ("\n" in piece[1:] or "▁" in piece.lstrip("▁")):
                raise ValueError(f"texts can't be cut before white space: there is a piece {piece!r}")
            out.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        return out

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.stats = np.zeros((1 << 12, 5), np.int32)  # tokens of A, of B, groups, links; whether bytes agree
        self.upto = np.zeros(1 << 12, np.int64)  # where a unit's linked pairs end
        self.held = np.zeros(1 << 14, np.int32)  # their numbers
        self.numbers: dict[int, int] = {}
        self.codes = np.zeros(1 << 12, np.int64)
        self.size = 0

    def add(self, units: list[str]) -> None:
        """Aligns new units; those of many tokens a few at a time."""
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = [x[self.lead :] for x in self.b.encode(["." + u for u in units], num_threads=1)]
        a_ends, b_ends = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n[-1])) for x, n in ((a, a_ends), (b, b_ends)))
        good, closes_a, closes_b, unit, u, v = self.transducer.walk(a, a_ends, b, b_ends)
        raw = [x.encode() for x in units]
        whole = b"".join(map(self.transducer.of[0].__getitem__, a.tolist()))
        ends = upto(self.a_sizes[a])[a_ends]
        if whole != b"".join(raw) or not np.array_equal(ends, np.cumsum([len(x) for x in raw])):
            good &= [whole[x:y] == z for x, y, z in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), raw, strict=True)]
        # only what is good is kept
        a_of, b_of = np.repeat(np.arange(len(units)), np.diff(a_ends, prepend=0)), np.repeat(np.arange(len(units)), np.diff(b_ends, prepend=0))
        a, closes_a, a_of = (x[good[a_of]] for x in (a, closes_a, a_of))
        b, closes_b, b_of = (x[good[b_of]] for x in (b, closes_b, b_of))
        unit, u, v = (x[good[unit]] for x in (unit, u, v))
        texts = self._texts(a, closes_a, b, closes_b, np.bincount(a_of, minlength=len(units)) + np.bincount(b_of, minlength=len(units)))
        first = len(self.groups)
        self.places.update(zip(units, range(first, first + len(units)), strict=True))
        self.groups += texts
        last = first + len(units)
        self.stats, self.upto = grown(self.stats, last), grown(self.upto, last)
        counts = (a_of, b_of, a_of[closes_a], unit)
        for k, of in enumerate(counts):
            self.stats[first:last, k] = np.bincount(of, minlength=len(units))
        self.stats[first:last, 4] = good
        start = int(self.upto[first - 1]) if first else 0
        self.upto[first:last] = start + np.cumsum(self.stats[first:last, 3])
        self.held = grown(self.held, start + len(unit))
        codes, back = np.unique(u << 32 | v, return_inverse=True)
        new = [c for c in codes.tolist() if c not in self.numbers]
        n = len(self.numbers)
        self.codes = grown(self.codes, n + len(new))
        self.codes[n : n + len(new)] = new
        self.numbers.update(zip(new, range(n, n + len(new)), strict=True))
        numbers = np.array([self.numbers[c] for c in codes.tolist()], np.int32)
        self.held[start : start + len(unit)] = numbers[back[np.argsort(unit, kind="stable")]]
        self.size += sum(map(len, texts)) + 2 * len(whole) + 4 * len(unit) + 200 * len(units)

    def _texts(self, a: np.ndarray, closes_a: np.ndarray, b: np.ndarray, closes_b: np.ndarray, each: np.ndarray) -> list[bytes]:
        """Each unit's groups as written in the digest, from all units' tokens in a row; each: how many tokens a unit has."""
        a_group, b_group = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        a_upto, b_upto = np.cumsum(np.bincount(a_group)), np.append(0, np.cumsum(np.bincount(b_group)))
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + b_upto[a_group]] = 2 * a + closes_a
        words[np.arange(len(b)) + a_upto[b_group]] = self.b_words + 2 * b + closes_b
        words = [self.words[w] for w in words.tolist()]
        ends = upto([len(w) for w in words])[np.cumsum(each)]
        text = b"".join(words)
        return [text[x : y - 1] for x, y in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    def aligned(self, pieces: list[str]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
        """For each piece its sums of stats (the last: units whose bytes agree, less all), groups, linked pairs and their times."""
        if self.size > self.table_bytes:
            self.clear()
        units = [UNIT.findall(p) for p in pieces]
        new = {u for some in units for u in some if u not in self.places}
        if new:
            self.add(list(new))
        place = self.places.__getitem__
        each = np.array([len(some) for some in units])
        at = np.fromiter((place(u) for some in units for u in some), np.int64, int(each.sum()))
        ends = np.cumsum(each)
        sums = np.zeros((len(at) + 1, 5), np.int64)
        np.cumsum(self.stats[at], axis=0, out=sums[1:])
        sums = sums[ends] - sums[ends - each]
        sums[:, 4] -= each
        # distinct units of each piece, then their pairs
        n = len(self.groups)
        key, times = np.unique(np.repeat(np.arange(len(pieces)), each) * n + at, return_counts=True)
        unit = key % n
        stop = self.upto[unit]
        size = stop - np.where(unit > 0, self.upto[unit - 1], 0)
        total = np.cumsum(size)
        flat = self.held[np.repeat(stop - total, size) + np.arange(total[-1] if len(total) else 0)]
        m = max(1, len(self.numbers))
        pair, back = np.unique(np.repeat(key // n, size) * m + flat, return_inverse=True)
        weight = np.bincount(back, np.repeat(times, size), len(pair)).astype(np.int64)
        bounds = np.searchsorted(pair, np.arange(len(pieces) + 1) * m)
        codes = self.codes[pair % m]
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            yield sums[i], b";".join([self.groups[j] for j in at[ends[i] - each[i] : ends[i]].tolist()]), codes[lo:hi], weight[lo:hi]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker, so tasks of a worker share its table."""
    return Aligner(a_path, b_path)


class Row:
    """What a text adds up to while its pieces are read."""

    def __init__(self, text: str | None):
        self.text, self.sums, self.digest, self.parts = text, np.zeros(5, np.int64), None, []

    def add(self, sums: np.ndarray, groups: bytes, codes: np.ndarray, times: np.ndarray) -> None:
        self.sums += sums
        if self.digest is None:
            self.digest = hashlib.sha256(groups)
        else:
            self.digest.update(b";" + groups)
        self.parts.append((codes, times))

    def result(self) -> tuple:
        if self.digest is None or self.sums[4]:
            return (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
        codes, times = self.parts[0]
        if len(self.parts) > 1:
            codes, back = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
            times = np.bincount(back, np.concatenate([t for _, t in self.parts]), len(codes))
        return (*self.sums[:4].tolist(), self.digest.hexdigest(), codes, times.astype(np.int32))


def decoded(raw: bytes) -> str | None:
    try:
        return " " + raw.decode() if raw else None
    except UnicodeDecodeError:
        return None


def results(own: Aligner, raw: list[bytes], chunk: int = CHUNK) -> list[tuple]:
    """The columns of ROW after doc_id for each text."""
    rows = [Row(decoded(x)) for x in raw]
    pieces: list[str] = []
    owners: list[Row] = []
    held = 0

    def flush() -> None:
        for owner, found in zip(owners, own.aligned(pieces), strict=True):
            owner.add(*found)
        pieces.clear()
        owners.clear()

    for row in rows:
        text, at = row.text or "", 0
        row.text = None
        while at < len(text):
            cut = CUT.search(text, at + chunk) if len(text) - at > chunk else None
            piece = text[at : cut.start() if cut else len(text)]
            at += len(piece)
            if held and held + len(piece) > chunk:
                flush()
                held = 0
            pieces.append(piece)
            owners.append(row)
            held += len(piece)
    if pieces:
        flush()
    return [row.result() for row in rows]


def _aligned(docs: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = [*(pa.int64(),) * 6, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in slices(batch, 500):
                columns = list(zip(*results(own, as_bytes(some.column("text")), chunk), strict=True))
                arrays = [pa.array(range(row, row + some.num_rows), pa.int64()), some.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(columns, kinds[2:], strict=True))]
                row += some.num_rows
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        release()

    return texts(docs).mapInArrow(run, ROW)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): the links of each id pair (A's id in the upper 32 bits), and whether no pair of its B id has more."""
    pairs = rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    pairs = staged(pairs)
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return staged(pairs.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links")


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts as a broadcast."""
    found = counts.orderBy("pair").toArrow()
    table = rows.sparkSession.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("pair", "n", "best")))
    kinds = ", ".join(f"{c} long" for c in OUT) + ", n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            ends = np.cumsum(pairs.value_lengths().to_numpy())
            starts = np.append(0, ends[:-1])
            sums = []
            for x in (times * best[at], times * n[at]):
                upto = np.append(0, np.cumsum(x))
                sums.append(pa.array(upto[ends] - upto[starts], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in OUT), *sums, batch.column("groups_sha256")], names=[*OUT, "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, kinds)


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts by a shuffle of all rows' pairs."""
    pairs = rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")))
    times = F.col("times").cast("long")
    sums = pairs.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(*OUT, F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def alignment(docs: DataFrame, a_path: str, b_path: str, most_broadcast: int = MOST_BROADCAST, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """A row for each document, and the counts of id pairs over all. a_path: a byte-level vocabulary of the tokenizers
    library; b_path: a sentencepiece model that adds a space in front."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    rows = staged(_aligned(docs, a_path, b_path, chunk))
    counts = pair_counts(rows)
    few = counts.count() <= most_broadcast
    return (_looked_up if few else _joined)(rows, counts), counts
