"""The trie join against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm.simhash_join import Forest, cells, fingerprint, near_copies, trie_links

U64 = np.uint64


def reference(text):
    words = [w for w in "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(items, linked):
    """Each item's least linked item, by all pairs."""
    label = {x: x for x in items}
    for x in items:
        for y in items:
            if label[x] != label[y] and linked(x, y):
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \t\n\x0b\x0c\r\x1c\x85éÉ", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text.encode()) == reference(text)


near = st.builds(lambda base, flips: base ^ sum(1 << b for b in set(flips)), st.sampled_from([0, 1 << 63, (1 << 64) - 1, 0x0123456789ABCDEF, 0x0123456789ABCDEF ^ 0b11111]), st.lists(st.integers(0, 63), max_size=5))


@settings(max_examples=200, deadline=None)
@given(st.sets(near, max_size=40), st.integers(0, 3), st.sampled_from([1, 16, 1000]), st.sampled_from([4, 1 << 16]))
def test_links(found, errors, leaf, block):
    keys = np.array(sorted(found), U64)
    want = {(x, y) for x in found for y in found if x < y and (x ^ y).bit_count() <= errors}
    swap = lambda a: (a << U64(32)) | (a >> U64(32))
    got = [(int(a), int(b)) for x, y in trie_links(keys, None, 0, errors, block, leaf) for a, b in zip(x, y, strict=True)]
    for x, y in trie_links(np.sort(swap(keys)), None, 0, errors, block, leaf):
        got += [tuple(sorted((int(a), int(b)))) for a, b in zip(swap(x), swap(y), strict=True)]
    assert set(got) == want
    forest = Forest(keys)
    pairs = np.array(sorted(want), U64).reshape(-1, 2)
    x, y = forest.add(pairs[:, 0], pairs[:, 1])
    assert roots(found, lambda a, b: (a, b) in want or (b, a) in want) == roots(found, lambda a, b: (min(a, b), max(a, b)) in set(zip(x.tolist(), y.tolist(), strict=True)))


@pytest.mark.parametrize("cell", [7, 10_000])
def test_cells_cover_links(spark, cell):
    r = random.Random(cell)
    keys = {0, (1 << 64) - 1}
    for _ in range(12):
        base = r.getrandbits(64) if r.random() < 0.5 else r.getrandbits(8)
        keys |= {base ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 2))) for _ in range(8)}
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in keys], "key long")
    found = [(u % (1 << 64), v % (1 << 64), d) for u, v, d in cells(frame, 3, cell).collect()]
    for u, v, d in found:
        assert sum(1 for x in keys if x >> 64 - d in (u, v)) <= max(cell, 2)
    for x in keys:
        for y in keys:
            if x < y and (x ^ y).bit_count() <= 3 and (x >> 32 ^ y >> 32).bit_count() <= 1:
                assert sum({x >> 64 - d, y >> 64 - d} == {u, v} for u, v, d in found) == 1


def test_near_copies(frame):
    r = random.Random(4)
    word = lambda: r.choice(["alpha", "beta", "gamma", "Delta", "eps", "zeta", "eta", "theta", "é"]) + str(r.randrange(40))
    base = [[word() for _ in range(r.randint(60, 400))] for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), r.choice([" ", "\n", " \t"]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE\t"), (505, "one two"), (505, "one two"), (None, "one two"), (None, "alone but for nothing"), (506, "x " * 100_000), (499, "x x x x")]
    prints = [reference(t) for _, t in rows]
    label = roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, _), f in zip(rows, prints, strict=True):
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    want = sorted(((d, f"{f:016x}", least.get(label[f])) for (d, _), f in zip(rows, prints, strict=True)), key=repr)
    docs = frame(rows).select("*", *(F.lit(1).alias(n) for n in ("f", "key", "component_id", "fingerprint", "u", "v")))
    for cell in (40, 1 << 15):
        got = near_copies(docs, cell=cell)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len(set(label.values())) < len(set(prints)) < len(rows)


def test_empty(frame):
    assert near_copies(frame([])).count() == 0
