"""The audit against a replay in plain Python."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from graphloom.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(220))
TEXTS = [LONG, LONG, LONG.upper(), "w " * 300, "w " * 300, "a | b", None, "", " \t\n\x0b", "É" * 30 + "A", "\x0bx\x0cx ", LONG + " #", "word " * 50_000]


def fails(text: str) -> set[str]:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": re.search(r"[#$%&*|]", text)}
    return {k for k, v in tests.items() if v}


def brute(rows, labels):
    out = Counter()
    parts = {p or "" for _, _, p in rows}
    for o in permutations("ABCDE"):
        o = "".join(o)
        for d, t, p in rows:
            failed = fails(t or "") | ({"E"} if d is not None and any(e is not None and e < d and (u or "") == (t or "") for e, u, _ in rows) else set())
            marks = [x for x in labels if d is not None and x[0] == d]
            reached = True
            for s, f in enumerate(o, 1):
                key = (p or "", o, s)
                bad = f in failed
                out[(*key, "kept" if reached and not bad else "removed" if reached else "redundant" if bad else "none")] += 1
                out[(*key, "unique_fails")] += failed == {f}
                if reached and bad:
                    out[(*key, "good_lost")] += any(q == 1 for _, q, _ in marks)
                    out[(*key, "toxic_lost")] += any(x == 1 for _, _, x in marks)
                    out[(p or "", f)] += 1
                reached = reached and not bad
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, "".join(o), s, *(out[p, "".join(o), s, n] for n in names), out[p, o[s - 1]]) for p in parts for o in permutations("ABCDE") for s in range(1, 6))


@pytest.mark.parametrize("shift", [0, 3])
def test_against_replay(frame, shift):
    rows = [((i + shift) % len(TEXTS), t, (None, "", "x", "y")[i % 4]) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, LONG, "x"), (1, "another text of a doc_id", "y")]
    labels = [(d, d % 2, d % 3 % 2) for d in range(0, 10)] + [(2, None, 1), (2, 1, None), (None, 1, 1)]
    docs = frame(rows, "doc_id long, text string, source string").select("*", *(F.lit(1).alias(n) for n in ("part", "fails", "good", "toxic", "first", "digest", "bits", "step")))
    got = filter_audit.audit(docs, frame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(False)))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_empty_tables(frame):
    empty = frame([], "doc_id long, text string, source string")
    labels = frame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    one = filter_audit.audit(empty.unionByName(frame([(1, "a", "s")], "doc_id long, text string, source string")), labels)
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120


def test_own_filters(frame):
    docs = frame([(1, "a"), (2, "b"), (3, "ab"), (4, "")])
    flags = filter_audit.flagged(docs.withColumn("source", F.lit("s")), lambda t: {"X": t.contains("a"), "Y": t.contains("b")}, repeats=None).withColumns({"good": F.lit(True), "toxic": F.lit(False)})
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.replay(flags, "XY").collect()}
    assert got == {("XY", 1): (2, 2, 0, 1, 3), ("XY", 2): (1, 1, 1, 1, 3), ("YX", 1): (2, 2, 0, 1, 3), ("YX", 2): (1, 1, 1, 1, 3)}
    with pytest.raises(ValueError, match="6 filters"):
        filter_audit.replay(flags, "ABCDEFG")
