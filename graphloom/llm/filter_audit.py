"""Audit of how filters interact, by direct relational replay.

1. One pass over the texts gives each document's part, digest and flags, one bit for each filter that it fails. The
   flags are a written table of a few bytes a row; texts are not read again.
2. The filter for repeats compares the whole table: of each digest the least doc_id, summed up before it is shuffled,
   joins back by digest and doc_id together, so a group of copies of any size never meets in one task.
3. The documents' flags are crossed with all orders of the filters, a broadcast table of 120 rows for five filters
   (its size is fixed by the number of filters, never by the data). The first failing place is computed by row, the
   steps are exploded, and counts are conditional sums by (part, order, step), combined before the shuffle. What is
   shuffled is a row for each part, order, step and task.
4. A filter's Shapley count adds up the result rows of one part and letter, 120 at most.

Defined cases: null text is empty; a null part is the empty string; a repeat is a row whose text is identical to that of
a row with a smaller doc_id, so repeated rows (same doc_id and text) are none of each other, and a row without doc_id
neither is nor makes one; several labels of one doc_id count as one with each mark that any of them has; an empty table
gives no rows; texts are taken whole, however long; other columns are not read. Texts are compared by SHA-256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.dist import ship
from graphloom.llm.common import staged

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Orders grow with the factorial of the filters; so many are replayed at most.
MOST_FILTERS = 6


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that isn't null: few words, few distinct words, many capitals, symbols."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        "C": F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(2) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, filters=text_filters, repeats: str | None = "E", part: str = "source") -> DataFrame:
    """(doc_id, part, fails): fails has bit i set for the i-th filter, the one for repeats last, if it isn't None."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conditions = list(filters(F.col("text")).values())
    fails = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    if repeats is None:
        return rows.select("doc_id", "part", fails.alias("fails"))
    rows = staged(rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), fails.alias("fails")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("digest", "doc_id", F.lit(True).alias("first"))
    judged = rows.join(first, ["digest", "doc_id"], "left")
    again = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return judged.select("doc_id", "part", (F.col("fails") + F.when(again, 1 << len(conditions)).otherwise(0)).alias("fails"))


def replay(flags: DataFrame, letters: str) -> DataFrame:
    """Counts by (part, filter_order, step) of flags: part, fails (bits in the order of letters), good, toxic."""
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be replayed in all orders")
    spark = flags.sparkSession
    places = range(len(letters))
    orders = spark.createDataFrame([("".join(letters[i] for i in p), [1 << i for i in p]) for p in permutations(places)], "filter_order string, bits array<int>")
    crossed = flags.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(orders))
    first = F.coalesce(*(F.when(F.col("fails").bitwiseAND(F.col("bits")[i]) != 0, i + 1) for i in places), F.lit(len(letters) + 1))
    replayed = crossed.select("part", "filter_order", "fails", "good", "toxic", "bits", first.alias("first"))
    steps = replayed.select("part", "filter_order", "fails", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    removed = F.col("step") == F.col("first")
    counts = {
        "kept": F.col("step") < F.col("first"),
        "removed": removed,
        "redundant": (F.col("step") > F.col("first")) & (F.col("fails").bitwiseAND(F.col("bit")) != 0),
        "unique_fails": F.col("fails") == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    table = steps.groupBy("part", "filter_order", "step").agg(*(F.sum(F.when(c, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias(k) for k, c in counts.items()))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shapley = table.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    out = table.withColumn("letter", letter).join(shapley, ["part", "letter"])
    return out.select("part", "filter_order", "step", *counts, "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters, letters: str = "ABCDE") -> DataFrame:
    """Every order of the filters over docs (doc_id, text, source), with the labels (doc_id, quality, toxic) that each loses.
    filters(text) gives the failure conditions of all letters but the last, which is for repeats."""
    ship(docs.sparkSession)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    flags = flagged(docs, filters).join(marks, "doc_id", "left").select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return replay(flags, letters)
