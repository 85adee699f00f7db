import random

import numpy as np
import pytest

from graphloom.llm import decontaminate
from graphloom.llm.decontaminate import common_subsequence, leaks, without


def test_common_subsequence_against_table():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_subsequence(a, b) == t[-1][-1]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    syllables = "an be co da en fo gi ha in jo ka lu me no or pa qu ra st tu un ve wi xy yo za".split()
    word = lambda: r.choice("the of and to in a".split()) if r.random() < 0.4 else "".join(r.choice(syllables) for _ in range(3))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.randint(15, 50)).capitalize() + ".") for i in range(30)]
    rows, want = [], set()
    for d in range(300):
        text = prose(r.randint(30, 400))
        if d % 10 == 0:
            i = r.randrange(30)
            words = items[i][1].split()
            if d % 20:  # a paraphrase: one word of eight is another, case and marks differ
                words = [word() if k % 8 == 5 else w.upper() + "," for k, w in enumerate(words)]
            text = f"{prose(60)} {' '.join(words)}\n{text}"
            want.add((d, i))
        rows.append((d, text))
    return rows, items, want


def test_leaks(frame, spark, corpus, monkeypatch):
    rows, items, want = corpus
    benchmark = spark.createDataFrame([*items, (99, None), (98, ""), (97, "of the")], "item_id long, text string")
    docs = frame([(d, t, 0) for d, t in [*rows, (None, items[3][1]), (500, None), (501, ""), (10, rows[10][1])]], "doc_id long, text string, at int")
    found = {(r["doc_id"], r["item_id"]) for r in leaks(docs, benchmark).collect()}
    assert found == want | {(None, 3)}
    assert without(docs, leaks(docs, benchmark)).count() == docs.count() - len(want) - 1
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 13)
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, benchmark).collect()} == found


def test_leaks_dense_and_mixed(frame, spark, corpus):
    """Items one after another, and short ones between long ones: none is lost, and the candidates lose no window that
    the check would take."""
    r = random.Random(8)
    words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(1500)] + "the of and to in a".split() * 100
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((15, 18, 20, 47, 59))))) for i in range(40)]
    short, long = ([x for x in items if (len(x[1].split()) > 20) == k] for k in (False, True))
    rows, want = [], set()
    for d in range(60):
        held = r.sample(items, 8) if d % 2 else [r.choice(long), r.choice(short), r.choice(long)]
        rows.append((d, " ".join(t for _, t in held)))
        want |= {(d, i) for i, _ in held}
    rows += [(1000 + d, " ".join(r.choice(words) for _ in range(r.randint(5, 300)))) for d in range(200)]
    found = {(x["doc_id"], x["item_id"]) for x in leaks(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= found
    block = decontaminate.Block(items)
    decontaminate.fit(decontaminate.word_streams(frame(rows), block), block)
    every = set()
    for d, text in rows:
        known = [(block.vocabulary[w], k) for k, w in enumerate(map(decontaminate.normal, text.split())) if w in block.vocabulary]
        ids, at = (np.array([x[k] for x in known], int) for k in (0, 1))
        for w in range(len(text.split()) // block.stride + 1):
            lo, hi = np.searchsorted(at, (w * block.stride, (w + 2) * block.stride))
            counts = np.bincount(ids[lo:hi], minlength=len(block.vocabulary))
            for k, (i, _) in enumerate(block.items):
                lcs, answers, _ = decontaminate._check(block, k, ids[lo:hi], at[lo:hi], counts)
                if lcs >= decontaminate.SURE or lcs >= decontaminate.LIKELY and answers >= decontaminate.ANSWERS:
                    every.add((d, i))
    assert found == every


def test_candidates_come_from_the_latent_space(frame, corpus):
    rows, items, want = corpus
    block = decontaminate.Block(items)
    streams = decontaminate.word_streams(frame(rows), block).persist()
    decontaminate.fit(streams, block)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.search(streams, block).collect()} == want
    block.basis, block.latent = block.basis * 0, block.latent * 0
    block.inside, block.outside = block.latent, np.zeros(len(items))
    assert decontaminate.search(streams, block).count() == 0
    streams.unpersist()


def test_leaks_empty(frame, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(frame([(1, "x y z")]), none).count() == 0
    assert leaks(frame([]), spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage's decisions take effect on the next one's documents."""
    import corpus_pipeline

    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: ". ".join(" ".join(r.choice(words) for _ in range(9)).capitalize() for _ in range(n)) + "."
    line = "This very line repeats in many documents of the corpus."
    item = prose(4)
    texts = [prose(12) for _ in range(120)] + [" | ".join(r.choice(words) for _ in range(80)) for _ in range(60)]
    for i in range(6):
        texts[i] += f"\n{line}"
    texts[40] = texts[20]
    texts[50] = prose(5) + " " + item + " " + prose(5)
    sources = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(sources, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({x[0] for x in docs.select("doc_id").collect()})
    good = set(range(120))
    assert left[0] == left[1] == good and left[2] in (good - {20}, good - {40}) and left[3] == left[4] == left[2] - {50}
    kept = spark.read.parquet(f"{tmp_path}/line dedup").filter(f"text like '%{line}%'").collect()
    assert [x["doc_id"] for x in kept] == [5] and all(x["n_chars"] == len(x["text"]) for x in kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 118


def test_stages_judge_rows_not_doc_ids(spark, tmp_path):
    """Repeated rows, rows that share a doc_id, and rows without one."""
    from graphloom.llm import stages

    r = random.Random(4)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("alo", "emi", "oru", "ina")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    a, b, c, d = (prose(80) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (2, a + " end"), (None, b + " end"), (None, c), (None, c), (3, d), (4, None), (4, None), (5, " ")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _row string")
    left = [tuple(x) for x in stages.near_duplicates(spark, docs, "").collect()]
    texts = [t for _, t, _ in left]
    assert len(left) == 7 and sum(t in (a, a + " end") for t in texts) == sum(t in (b, b + " end") for t in texts) == texts.count(c) == 1
    assert (3, d, "x") in left and texts.count(None) == 2 and texts.count(" ") == 1
    spark.createDataFrame([(1, " ".join(c.split()[10:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [tuple(x)[1] for x in stages.benchmark(spark, docs, str(tmp_path)).collect()]
    assert c not in left and len(left) == len(rows) - 2
