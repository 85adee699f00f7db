import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import ngram_join
from graphloom.llm.ngram_join import class_of, components, least_of, shingle_sets, similar
from graphloom.llm.suffix_dedup import remove_repeats, repeated_starts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=30), st.integers(1, 2)), min_size=1, max_size=8), st.integers(1, 6))
def test_starts_against_counting(contexts, length):
    strings, counts = [c for c, _ in contexts], [n for _, n in contexts]
    found = Counter()
    for s, n in contexts:
        for i in range(len(s) - length + 1):
            found[s[i : i + length]] += n
    want = [[i for i in range(len(s) - length + 1) if found[s[i : i + length]] >= 2] for s in strings]
    assert [x.tolist() for x in repeated_starts(strings, counts, length)] == want


def brute_spans(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    found = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if found[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    rows = [(i, prose(r.randint(0, 80)) + " " + r.choice([*passages, ""]) + " " + prose(r.randint(0, 40))) for i in range(80)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (None, passages[0]), (None, None), (102, ""), (103, "x" * 900), (104, prose(2000) + passages[1] + passages[1][:150])]
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_remove_repeats(frame, texts, hot):
    order = lambda x: sorted(x, key=repr)
    df = remove_repeats(frame([(d, t, 1) for d, t in texts], "doc_id long, text string, a int"), hot=hot)
    assert df.columns == ["doc_id", "text", "a", "repeats"]
    got = [(r["doc_id"], r["repeats"]["n_bytes"], r["repeats"]["n_removed"], r["repeats"]["n_spans"], bytes(r["repeats"]["kept"])) for r in df.collect()]
    assert order(got) == order(brute_spans(texts, 200))


def test_remove_repeats_empty(frame):
    assert remove_repeats(frame([])).count() == 0


def brute_components(rows, words, threshold):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= threshold * (len(sets[i]) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("words", "threshold"), [(3, 90), (5, 80), (2, 100)])
def test_similar(frame, words, threshold):
    r = random.Random(words)
    vocabulary = [f"W{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([8, 40, 150]))] for _ in range(12)]
    rows = []
    for i in range(150):
        own = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        rows.append((i * 3, " ".join(own)))
    common = " ".join(r.choice(vocabulary) for _ in range(50))
    rows += [(1000 + i, f"{common} " + " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(40)]
    rows += [(5, None), (7, ""), (8, " \n"), (None, rows[0][1]), (9, "one"), (10, "ONE"), (11, "one two"), (11, "one two"), (None, "only null"), (3, "same id, another text of its own")]
    got = similar(frame([(d, t, 0) for d, t in rows], "doc_id long, text string, c int"), words, threshold)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_components(rows, words, threshold)


def test_long_text_in_pieces(monkeypatch):
    from graphloom.llm import ngram_join

    texts = [b"a bb  ccc\td " * 50, b"", b"x", b"  lead and trail  " * 9]
    whole = shingle_sets(texts, 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 40)
    assert all((a == b).all() for a, b in zip(whole, shingle_sets(texts, 3), strict=True))
    assert [len(x) for x in shingle_sets([b"a b c a b c", b"a b"], 3)] == [3, 1] and class_of(whole[0]) != class_of(whole[2])


def test_similar_empty(frame):
    assert similar(frame([])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    for rest in (0, 10, 1000):
        assert dict(map(tuple, components(links, rest).collect())) == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102), 100)
    assert components(links.limit(0)).count() == 0


@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=40))
def test_least_of(edges):
    label = {x: x for e in edges for x in e}
    for _ in edges:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    u, v = (np.array(x) for x in zip(*edges, strict=True))
    assert dict(zip(*(x.tolist() for x in least_of(u, v)), strict=True)) == label


def test_a_star_of_near_copies(frame, monkeypatch):
    """One text and 5,000 near copies of it, each with a change of its own, with few pairs to a salt."""
    monkeypatch.setattr(ngram_join, "SHARE", 100)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 5001):
        at = i % 150
        rows.append((i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])))
    rows += [(9000 + i, " ".join(f"y{i}_{j}" for j in range(20))) for i in range(50)]
    for rounds in (4, 0):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        some = rows if rounds else rows[:300] + rows[-50:]
        got = similar(frame(some), words=3, threshold=90)
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: 0 if d < 9000 else d for d, _ in some}
