import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm.line_dedup import PerfectHash, Shard, dedup_lines
from graphloom.llm.quality_classifier import figures, isotonic, score_quality
from graphloom.llm.quality_rules import apply_rules, judge, repeated_words


def brute_lines(rows, chars=40, least=5):
    keys = lambda t: [x.strip(b" \t\n\r\x0b\x0c").lower() for x in (t or "").encode().split(b"\n")]
    held = {}
    for i, (_, t) in enumerate(rows):
        for k in set(keys(t)):
            if len(k.decode()) >= chars:
                held.setdefault(k, []).append(i)
    out = []
    for d, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = []
        for line, k in zip(lines, keys(t), strict=True):
            ids = [rows[i][0] for i in held.get(k, ()) if rows[i][0] is not None]
            if len(held.get(k, ())) < least or not ids or d == max(ids):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    pool = [("Shared Line number %d " % i) * 3 for i in range(8)] + ["é" * 39, "é" * 40, "short", ""]
    docs = []
    for i in range(60):
        lines = [r.choice(pool).upper() if r.random() < 0.3 else f"  {r.choice(pool)}\t" for _ in range(r.randint(0, 9))] + [f"own {i} " * 8]
        docs.append((i if i % 11 else None, "\n".join(lines)))
    return [*docs, (None, None), (70, ""), (71, docs[1][1]), (71, docs[1][1])]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_line_dedup(frame, rows, broadcast):
    order = lambda x: sorted(x, key=repr)
    df = frame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, h1 int, shard int")
    got = dedup_lines(df, broadcast_bytes=broadcast)
    assert got.columns == ["doc_id", "text", "h1", "shard", "lines"]
    assert order([(r["doc_id"], r["lines"]["n_lines"], r["lines"]["n_dropped"], r["text"]) for r in got.collect()]) == order(brute_lines(rows))
    assert dedup_lines(frame([]), broadcast_bytes=broadcast).count() == 0


def test_perfect_hash():
    h = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, np.uint64))
    assert sorted(PerfectHash.of(h).index(h).tolist()) == list(range(len(h)))
    counts = np.arange(len(h), dtype=np.uint32)
    shard = Shard.from_bytes(Shard.of(h, h ^ np.uint64(5), counts, counts.astype(np.int64)).to_bytes())
    n, last = shard.probe(h, h ^ np.uint64(5))
    assert (n == counts).all() and (last == counts).all() and not shard.probe(h + np.uint64(1), h)[0].any()
    assert PerfectHash.of(h[:0]).index(h[:3]).tolist() == [-1] * 3


def test_rules():
    prose = "The quick brown fox jumps over one lazy dog, and then {} rests for a while.\n"
    clean = "".join(prose.format(f"number{i}") for i in range(12))
    n, chars, sym, dup, rep, lost, lost_chars, failed, kept, text = judge(clean.encode())
    assert (n, sym, dup) == (192, 0, 0) and failed and not kept and rep > 90 and lost == lost_chars == 0 and chars and text == clean
    words = [w.encode() for w in "a b c a b c d".split()]
    assert repeated_words(words) == 6 and repeated_words(words[:2]) == 0
    different = " ".join(f"word{i}" for i in range(60)) + "."
    assert judge(different.encode())[8] is True
    assert judge((different + "\n" + " | ".join(f"menu{i}" for i in range(40))).encode())[8] is False
    noisy = " ".join(f"w{i}***" for i in range(60)) + "."
    assert judge(noisy.encode())[8] is False and judge(noisy.encode())[7] is False
    assert judge((different + "\nAll rights reserved.").encode())[9] == different
    assert judge(b"")[7:9] == (True, False)


def test_rules_frame(frame):
    df = apply_rules(frame([(1, "x y", 3), (None, None, 4)], "doc_id long, text string, kept int"))
    assert [(r["kept"], r["quality"]["n_words"]) for r in df.collect()] == [(3, 2), (4, 0)]
    assert apply_rules(frame([])).count() == 0


def test_isotonic():
    at, to = isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(to) > 0).all() and to.tolist() == [0, 0.5, 1.0] or to.tolist()[0] == 0


def test_classifier_held_out(frame, spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    good = lambda: ". ".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(6)) + "."
    bad = lambda: " | ".join(r.choice(words) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), 0) for i in range(400)] + [(None, None, 0), (401, "", 0), (3, bad(), 0)]
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(400)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = score_quality(frame(rows, "doc_id long, text string, y int"), labels, F.col("doc_id") % 2 == 0)
    found = got.collect()
    held = [x for x in found if x["doc_id"] is not None and x["doc_id"] < 400 and x["doc_id"] % 2]
    assert sum(x["predicted"] == int(bool(x["doc_id"] % 3)) for x in held) > 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 for x in found) and len(found) == len(rows) and got.columns == ["doc_id", "text", "y", "score", "predicted"]
    none = score_quality(frame(rows[:3], "doc_id long, text string, y int"), labels.limit(0), F.lit(True)).collect()
    assert [x["score"] for x in none] == [0.5] * 3
    assert figures(b"") == [0.0] * 16
