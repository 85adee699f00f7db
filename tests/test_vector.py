import numpy as np
import pytest

from graphloom.operators import vector


def brute(queries, rows, k, metric):
    out = []
    for q, a in queries:
        if not a or None in a:
            continue
        found = []
        for i, b in rows:
            if i is None or not b or None in b or len(b) != len(a):
                continue
            x, y = np.array(a, float), np.array(b, float)
            if metric == "cosine":
                n = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
                if n == 0:
                    continue
                d = 1 - (x * y).sum() / n
            else:
                d = {"l2": np.sqrt(((x - y) ** 2).sum()), "l2sq": ((x - y) ** 2).sum(), "dot": -(x * y).sum()}[metric]
            found.append((d, i))
        out += [(q, r + 1, i, round(float(d), 9)) for r, (d, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "l2sq", "cosine", "dot"])
def test_nearest_of_all(spark, monkeypatch, metric):
    """Blocks of a few queries, ties, repeated vectors, nulls, and vectors of another length, against all pairs."""
    monkeypatch.setattr(vector, "BLOCK_BYTES", 8 * 4 * 3)
    monkeypatch.setattr(vector, "ROWS", 7)
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows += [(100, [1.0, 2.0]), (101, [3.0, 1.0]), (102, None), (103, []), (104, [1.0, None, 2.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (105, [0.0] * 4)]
    schema = "id long, v array<double>, distance double"
    frame = spark.createDataFrame([(*x, 0.5) for x in rows], schema)
    got = vector.nearest_of_all(frame.filter("id % 5 = 0 or id > 99"), frame, "id", "v", 4, metric)
    assert sorted((x["query"], x["rank"], x["neighbor"], round(x["distance"], 9)) for x in got.collect()) == brute([x for x in rows if x[0] is not None and (x[0] % 5 == 0 or x[0] > 99)], rows, 4, metric)
    assert vector.nearest_of_all(frame.limit(0), frame, "id", "v", 4, metric).count() == 0


def test_staged_tables_can_be_cleared(spark):
    from graphloom import storage

    df = storage.staged(spark.range(5))
    assert df.count() == 5 and storage.own_dir(spark) in df.inputFiles()[0]
    storage.clear(spark)
    assert storage.staged(spark.range(3)).count() == 3
