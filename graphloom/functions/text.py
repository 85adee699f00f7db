"""An inverted index of node properties as written tables, words, and BM25, with DataFrame operations alone.

Only the names of the text search functions are public for us; tokenising, stemming and scores are of this module:
words are runs of letters and digits in lower case, a light suffix stemmer, BM25 with k = 1.2 and b = 0.75.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import staged
from graphloom.versions import GONE, Version

#: Segments beyond which an index is made anew.
MOST_SEGMENTS = 8
K, B = 1.2, 0.75
STOPS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def stem_column(word: Column) -> Column:
    """The word without a plural or verb ending, if at least three letters stay."""
    w = F.lower(word)
    for ending, to in (("sses$", "ss"), ("(?<=.{3})ies$", "y"), ("(?<=[^s].{1})s$", ""), ("(?<=.{3})ing$", ""), ("(?<=.{3})edly$", ""), ("(?<=.{3})ed$", ""), ("(?<=.{3})ly$", "")):
        w = F.regexp_replace(w, ending, to)
    return w


def words(text: Column, stops: tuple[str, ...] = STOPS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(F.filter(found, lambda x: ~x.isin(*stops)), stem_column)


def lengths(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(k, w, n) of every row: its words and their number."""
    text = F.concat_ws(" ", *(F.col(f"`{c}`") for c in columns))
    return frame.select(F.col(f"`{key}`").alias("k"), words(text).alias("w")).withColumn("n", F.size("w"))


def asked_words(spark, query: str) -> list[str]:
    return [r[0] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(words(F.col("q")))).distinct().collect()]  # the query's own words


class Segment:
    """Postings (word, k, n, tf), sorted by word and key in files whose statistics lead to a word; lengths (k, n); and the
    keys whose rows in earlier segments are gone, if any."""

    def __init__(self, rows: DataFrame, gone: DataFrame | None = None):
        rows = staged(rows)
        found = rows.select("k", "n", F.explode("w").alias("word")).groupBy("k", "n", "word").agg(F.count(F.lit(1)).alias("tf"))
        self.postings = staged(found.select("word", "k", "n", "tf").repartitionByRange("word", "k").sortWithinPartitions("word", "k"))
        self.lengths = rows.select("k", "n")
        self.gone = gone


class InvertedIndex:
    """Segments of a version of a table. What a later version adds or removes becomes a segment of its own; a table that was
    rewritten is indexed anew, and so is one of over MOST_SEGMENTS. Immutable."""

    def __init__(self, columns: list[str], version: Version, segments: tuple[Segment, ...]):
        self.columns, self.version, self.segments = columns, version, segments
        self.docs, self.words = self.live("lengths").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    @classmethod
    def of(cls, version: Version, key: str, columns: list[str]) -> InvertedIndex:
        return cls(columns, version, (Segment(lengths(version.frame(key), key, columns)),))

    def at(self, version: Version, key: str) -> InvertedIndex:
        """The index of another version of the table."""
        if version is self.version:
            return self
        own = version.since(self.version)
        if own is None or len(self.segments) >= MOST_SEGMENTS:
            return InvertedIndex.of(version, key, self.columns)
        gone = [f for kind, f in own if kind == GONE]
        added = version.added(key, len(self.version.parts))
        keys = reduce(DataFrame.unionByName, gone).select(F.col("__k").alias("k")) if gone else None
        new = Segment(lengths(added, key, self.columns) if added is not None else self.segments[0].lengths.limit(0).select("k", F.array().cast("array<string>").alias("w"), "n"), keys)
        return InvertedIndex(self.columns, version, (*self.segments, new))

    def live(self, what: str, test: Column | None = None) -> DataFrame:
        """Postings or lengths of the rows that are there, of those alone that pass a test, which reaches the files."""
        out = []
        for i, segment in enumerate(self.segments):
            df = getattr(segment, what)
            df = df if test is None else df.filter(test)
            gone = [s.gone for s in self.segments[i + 1 :] if s.gone is not None]
            out.append(df.join(reduce(DataFrame.unionByName, gone), "k", "left_anti") if gone else df)
        return reduce(DataFrame.unionByName, out)

    def search(self, query: str, conjunctive: bool = False, k: float = K, b: float = B) -> DataFrame:
        """(k, score) of rows that hold a word of the query, or all of them. Only the asked words' postings are read."""
        asked = asked_words(self.segments[0].lengths.sparkSession, query)
        hits = self.live("postings", F.col("word").isin(*asked) if asked else F.lit(False))
        df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        scored = hits.join(F.broadcast(df), "word")  # a row for each word of the query
        docs, mean = F.lit(float(self.docs)), F.lit(float(self.words) / max(1, self.docs))
        idf = F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        one = idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("n") / mean))
        out = scored.groupBy("k").agg(F.sum(one).alias("score"), F.count(F.lit(1)).alias("found"))
        return (out.filter(F.col("found") == len(asked)) if conjunctive else out).select("k", "score")
