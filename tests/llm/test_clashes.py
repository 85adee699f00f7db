"""Extra columns named like an operator's own, and operators called on frames that no registered query made."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_extract, license_scan, line_dedup, packing, quality_classifier, quality_rules, suffix_dedup
from graphloom.llm.decontaminate import leaks
from graphloom.llm.ngram_join import similar
from graphloom.llm.word_ids import vocabulary

NAMES = ("doc", "th", "text_", "_doc", "_th", "_text", "_spans", "_row", "spans", "key", "gone", "_key", "_gone", "_figures", "figures", "lines", "quality", "licenses", "score", "predicted", "page", "repeats", "c", "n", "t", "h", "a")


@pytest.fixture
def docs(spark):
    line = "a line of more than forty characters that repeats in documents"
    rows = [(i, f"{line}\nown words {i} " + "and more of them " * i) for i in range(6)] + [(None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(7).alias(n) for n in NAMES))


@pytest.mark.parametrize(
    ("run", "made"),
    [
        (lambda d: html_extract.extract(d, html="text"), ("page",)),
        (license_scan.scan, ("licenses",)),
        (lambda d: suffix_dedup.remove_repeats(d), ("repeats",)),
        (lambda d: line_dedup.dedup_lines(d), ("lines",)),
        (lambda d: line_dedup.dedup_lines(d, broadcast_bytes=0), ("lines",)),
        (quality_rules.apply_rules, ("quality",)),
        (lambda d: quality_classifier.score_quality(d, d.select("doc_id", F.lit(1).alias("quality")), F.lit(True)), ("score", "predicted")),
    ],
)
def test_columns_are_kept(docs, run, made):
    out = run(docs)
    assert sorted(out.columns) == sorted([f"{c}_in" if c in made else c for c in docs.columns] + list(made))
    rows = out.collect()
    assert len(rows) == 7 and all(r[f"{n}_in" if n in made else n] == 7 for r in rows for n in NAMES)


def test_operators_that_return_their_own_rows(docs):
    assert similar(docs).count() == 7
    assert packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0).select("doc_id").distinct().count() == 7
    assert leaks(docs, docs.select(F.lit(1).alias("item_id"), "text")).count() >= 1


def test_lines_count_distinct_documents(spark):
    line = "b" * 50
    docs = spark.createDataFrame([(1, line)] * 3 + [(2, line)] * 2, "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).agg(F.sum("lines.n_dropped")).first()[0] == 0
    more = docs.unionByName(spark.createDataFrame([(3, line), (4, line), (5, line), (None, line)], "doc_id long, text string"))
    for limit in (0, 1 << 20):
        out = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(more, broadcast_bytes=limit).collect()}
        assert out == {(1, ""), (2, ""), (3, ""), (4, ""), (5, line), (None, "")}
