"""Quality scores by random Fourier features of document statistics, ridge regression and isotonic calibration.

1. One pass gives each document STATS, figures of its whole text.
2. cos(xW + b) with fixed random W approximates a Gaussian kernel over the standardised figures.
3. Every partition of labelled rows sums its share of the normal equations; the shares are added row by row of the
   matrix, and the driver solves the one DIM x DIM system.
4. Raw scores of the labelled rows left out of the fit (a quarter) are counted in BINS bins; pooling adjacent
   violators over the bins gives the calibration, which is interpolated between blocks.

Nothing here is sampled: figures, sums and bins cover all rows, and what the driver gets has a fixed size.

Defined cases: null text is empty, whose figures are 0, and is scored like any other; null or repeated doc_ids are
scored row by row; a doc_id with several labels counts once with their mean; labels without a document or value are
left out; with no label at all every score is 0.5; an empty table gives an empty result; other columns are
kept, those named `score` and `predicted` as `score_in` and `predicted_in`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, free, spare, staged
from graphloom.llm.quality_rules import CLOSING, CONTINUATION, SEPARATORS, repeated_words, symbols

STATS = ("log_words", "word_len", "symbol_rate", "separator_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "punct_rate", "closed_rate", "line_words", "distinct_rate", "long_rate", "top_rate", "high_rate", "symbol_word_rate")
DIM, WIDTH, RIDGE, BINS, SEED = 256, 3.0, 1e-2, 2048, 7
DIGITS, UPPER, PUNCT, HIGH = b"0123456789", bytes(range(65, 91)), b".,;:!?'\"()-", bytes(range(0xC0, 0x100))


def figures(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    n, joined = len(words), b"".join(words)
    chars = len(joined.translate(None, CONTINUATION))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda some: (len(joined) - len(joined.translate(None, some))) / chars
    found = Counter(words)
    return [
        math.log1p(n),
        math.log1p(chars / n),
        symbols(text) / chars,
        sum(found[w] for w in SEPARATORS) / n,
        1 - len(set(lines)) / len(lines),
        repeated_words(words) / n,
        share(UPPER),
        share(DIGITS),
        share(PUNCT),
        sum(x.rstrip().endswith(CLOSING) for x in lines) / len(lines),
        math.log1p(n / len(lines)),
        len(found) / n,
        sum(k for w, k in found.items() if len(w) > 16) / n,
        max(found.values()) / n,
        share(HIGH),
        sum(k for w, k in found.items() if w[-1:] in b"#*$%&|<>") / n,
    ]


def with_figures(docs: DataFrame, name: str) -> DataFrame:
    @F.arrow_udf("array<float>")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([figures(x) for x in as_bytes(text)], pa.list_(pa.float32()))

    return docs.withColumn(name, run(F.col("text").cast("string")))


class Model:
    def __init__(self, mean: np.ndarray, std: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.maximum(std, 1e-3)
        self.w = draw.standard_normal((len(STATS), DIM)) / WIDTH
        self.b = draw.uniform(0, 2 * np.pi, DIM)
        self.weights = np.zeros(DIM + 1)
        self.at, self.to = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6) @ self.w + self.b
        return np.hstack([np.cos(z) * math.sqrt(2 / DIM), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if self.at[0] == 0 and (self.to == 0.5).all():
            return np.full(len(x), 0.5)
        # a thousandth of the raw order tells apart what one isotonic block calibrates alike
        return np.clip(0.999 * np.interp(raw, self.at, self.to) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; centres and values of the blocks."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at.tolist(), mean.tolist(), weight.tolist(), strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([x / w for x, _, w in blocks]), np.array([y / w for _, y, w in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(STATS))


def fit(rows: DataFrame) -> Model:
    """rows: figures array<float>, y double, of all rows to learn from."""
    first = rows.agg(*[f(F.col("figures")[i]).alias(f"{n}{i}") for i in range(len(STATS)) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n")).first()
    if not first["n"]:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    model = Model(np.array([first[f"m{i}"] for i in range(len(STATS))]), np.array([first[f"s{i}"] for i in range(len(STATS))]))
    size = DIM + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column("figures")))
                total += z.T @ np.column_stack([z, batch.column("y").to_numpy()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def added(table: pa.Table) -> pa.Table:
        total = np.asarray(table.column("sums").combine_chunks().flatten()).reshape(-1, size + 1).sum(axis=0)
        return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})

    split = F.pmod(F.xxhash64(F.col("figures")), F.lit(4)) == 0
    schema = "i int, sums array<double>"
    total = np.zeros((size, size + 1))
    for r in rows.filter(~split).select("figures", "y").mapInArrow(sums, schema).groupBy("i").applyInArrow(added, schema).collect():  # DIM + 1 rows
        total[r["i"]] = r["sums"]
    n = max(total[-1, size - 1], 1.0)
    model.weights = np.linalg.solve(total[:, :size] + RIDGE * max(1.0, n / 1000) * np.eye(size), total[:, size])

    @F.arrow_udf("double")
    def raw(x: pa.Array) -> pa.Array:
        return pa.array(model.raw(_matrix(x)))

    left = rows.filter(split).withColumn("raw", raw("figures"))
    binned = left.groupBy(F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # BINS rows at most
    if binned:
        columns = [np.array([r[c] for r in binned], float) for c in ("x", "y", "n")]
        model.at, model.to = isotonic(*columns)
        if len(model.at) == 1:  # no order among the rows left out: the raw score as it is
            model.at, model.to = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        model.at, model.to = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def learned(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, Model]:
    """Staged (doc_id, _figures) of all docs, and the model of those labelled rows for whose doc_id `learn` holds."""
    figured = staged(with_figures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "_figures").select("doc_id", "_figures"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).filter(learn)
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    return figured, fit(staged(figured.join(known, "doc_id").select(F.col("_figures").alias("figures"), "y")))


def scored(figured: DataFrame, model: Model, name: str = "_figures") -> DataFrame:
    """`score` and `predicted` from the column of figures, which goes."""
    sent = figured.sparkSession.sparkContext.broadcast(model)  # DIM x 16 numbers

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(_matrix(x)))

    return figured.withColumn("score", score(name)).drop(name).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """docs with `score` and `predicted`; texts are read once for the model and once for the scores, never shuffled."""
    docs = spare(docs, "score", "predicted")
    (name,) = free(docs, "figures")
    return scored(with_figures(docs, name), learned(docs, labels, learn)[1], name)
