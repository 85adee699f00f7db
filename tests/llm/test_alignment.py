"""Alignment of whole texts against byte offsets and counters in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm.alignment import Aligner, Transducer, alignment, results
from graphloom.llm.word_ids import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return Aligner(A, B)


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(of[i]), i))
        at += len(of[i])
    return out


def whole(own, text):
    """(groups, links) from the tokens of the whole text at once, by offsets; None without tokens."""
    if not text:
        return None
    a_of, b_of = own.transducer.of
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(a_of[i] for i in a) != raw or b"".join(b_of[i] for i in b) != raw:
        return None
    x, y = spans(a, a_of), spans(b, b_of)
    ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
    groups, start = [], 0
    for e in ends:
        groups.append(tuple([i for s, t, i in side if s >= start and t <= e] for side in (x, y)))
        start = e
    links, j = [], 0
    for s, t, i in x:
        while y[j][1] <= s:
            j += 1
        k = j
        while k < len(y) and y[k][0] < t:
            links.append((i, y[k][2]))
            k += 1
    return groups, links


def digest(groups):
    return hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()).hexdigest()


def row(found):
    if found is None:
        return (0, 0, 0, 0, "", {})
    groups, links = found
    return (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), digest(groups), dict(Counter(a << 32 | b for a, b in links)))


pieces = st.sampled_from([" ", "  ", "\n", "\n\n", "\r\n", "\t", " ", "　", "\x85", "\x1c", "a", "the", "Hello", "it's", "don't", "123", "12,345.67", "$%&*", "…", "é", "é", "ﬁ", "日本語", "👩‍👩‍👧", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "▁", "​", "\x00", "==", ";", ".", "x" * 40, "Straße", "Zażółć", "//"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(pieces, max_size=14).map("".join), min_size=1, max_size=4), st.sampled_from([3, 1 << 19]))
def test_units_give_whole_texts(texts, chunk):
    own = SHARED
    got = [(*r[:5], dict(zip(r[5].tolist(), r[6].tolist(), strict=True))) for r in results(own, [t.encode() for t in texts], chunk)]
    assert got == [row(whole(own, t)) for t in texts]


SHARED = Aligner(A, B, table_bytes=20_000)


streams = st.lists(st.sampled_from([b"a", b"b", b"ab", b"ba", b"aab"]), max_size=8)


@given(st.lists(st.tuples(streams, streams), min_size=1, max_size=5))
def test_transducer(pairs):
    tokens = [b"a", b"b", b"ab", b"ba", b"aab"]
    t = Transducer(tokens, tokens)
    flat = [np.array([tokens.index(w) for pair in pairs for w in pair[k]], np.int64) for k in (0, 1)]
    ends = [np.cumsum([len(pair[k]) for pair in pairs]) for k in (0, 1)]
    good, closes_a, closes_b, unit, u, v = t.walk(flat[0], ends[0], flat[1], ends[1])
    at = [0, 0]
    for i, (x, y) in enumerate(pairs):
        assert good[i] == (b"".join(x) == b"".join(y))
        stop = [at[0] + len(x), at[1] + len(y)]
        if good[i]:
            offsets = [np.cumsum([len(w) for w in z]).tolist() for z in (x, y)]
            common = set(offsets[0]) & set(offsets[1])
            assert [o in common for o in offsets[0]] == closes_a[at[0] : stop[0]].tolist() and [o in common for o in offsets[1]] == closes_b[at[1] : stop[1]].tolist()
            spans = [[(e - len(w), e, w) for e, w in zip(o, z, strict=True)] for o, z in zip(offsets, (x, y), strict=True)]
            want = sorted((p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1])
            assert sorted((tokens[m], tokens[n]) for m, n in zip(u[unit == i].tolist(), v[unit == i].tolist(), strict=True)) == want
        at = stop


def documents():
    r = random.Random(3)
    words = ["the", "cat", "sat", "Überraschung", "foo_bar(baz);", "1234", "naïve", "日本", "http://x.y/z?q=1", "— dash", "it's"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(r.randint(1, 120)))) for i in range(60)]
    return [*rows, (70, None), (71, ""), (72, " "), (73, "a▁b"), (74, "<|endoftext|> </s>"), (75, rows[0][1]), (75, rows[0][1]), (None, "the cat"), (76, "x" * 30_000), (77, "the cat sat " * 100_000)]


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_counts_over_all_documents(own, frame, most):
    rows = documents()
    found = [(d, whole(own, t) if d != 77 else None) for d, t in rows]
    found[-1] = (77, repeated(own, "the cat sat ", 100_000))
    counts = Counter(p for _, f in found if f for p in f[1])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    want = []
    for d, f in found:
        a, b, g, n, sha, _ = row(f)
        links = f[1] if f else []
        want.append((d, a, b, g, n, sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha))
    docs = frame(rows).select("*", *(F.lit(1).alias(c) for c in ("row", "pairs", "times", "n_a", "groups_sha256")))
    got, pairs = alignment(docs, A, B, most_broadcast=most, chunk=5000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): r["n"] for r in pairs.collect()} == counts


def repeated(own, unit, times):
    """As whole(own, unit * times) for a text whose repeats all tokenize alike but the last."""
    one, two = whole(own, unit * 2), whole(own, unit * 3)
    middle = two[0][len(one[0]) - 1 : -1]
    head, tail = one[0][:-1], one[0][-1:]
    size = len(whole(own, unit * 3)[1]) - len(one[1])
    assert head + middle + tail == two[0]
    tails = sum(len(a) + len(b) - 1 for a, b in tail)
    inner = two[1][len(one[1]) - tails : len(one[1]) - tails + size]
    return head + middle * (times - 2) + tail, one[1][: len(one[1]) - tails] + inner * (times - 2) + one[1][len(one[1]) - tails :]


def test_empty(frame):
    assert alignment(frame([]), A, B)[0].count() == 0
