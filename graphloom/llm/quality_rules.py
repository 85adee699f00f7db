"""Line-first cleaning: each line is judged by punctuation, navigation and boilerplate rules, failing
lines go, and documents that lose too much of their text are rejected.

Base figures of a whole text (words are runs without ASCII white space, lines are split at \\n):
word_chars, n_symbols, n_dup_lines, n_repeat_words, as the query's contract states them.

A line with a word fails where one of these holds:
* navigation: at least 3 words are bare separators and they are a fifth of the line's words or more;
* punctuation: over 12 of 100 code points of its words are symbols out of ``#*$%&|<>``;
* stub: at most 3 words and no closing punctuation as its last character;
* boilerplate: it holds one of BOILERPLATE, ASCII letters compared without case.

Defined cases: null or empty text has no words and fails the base rules; a null doc_id stays null; repeated
rows are judged alike, each for itself; an empty table gives an empty result; other columns are left as they are, one
named `quality` as `quality_in`.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import as_bytes, spare

SYMBOLS = b"#*$%&|<>"
SEPARATORS = frozenset((b"|", b">", b"<", b"/", b"*", b"-"))
CLOSING = tuple(x.encode() for x in ".!?:;,\"')]…”’»")
BOILERPLATE = (
    b"all rights reserved",
    b"enable javascript",
    b"cookie policy",
    b"privacy policy",
    b"terms of use",
    b"terms of service",
    b"subscribe to our newsletter",
    b"click here to",
    b"lorem ipsum",
)
MIN_WORDS, MOST_REPEATED, MOST_LOST, MOST_SYMBOLS, STUB_WORDS = 50, 50, 30, 12, 3
CONTINUATION = bytes(range(0x80, 0xC0))
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_lines", "lost_chars")
SCHEMA = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())])


def chars(words: list[bytes]) -> int:
    return len(b"".join(words).translate(None, CONTINUATION))


def symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def repeated_words(words: list[bytes]) -> int:
    """Positions covered by a 3-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, covered = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def line_fails(line: bytes, words: list[bytes]) -> bool:
    n = len(words)
    if n <= STUB_WORDS and not words[-1].endswith(CLOSING):
        return True
    if (marks := symbols(line)) and 100 * marks > MOST_SYMBOLS * chars(words):
        return True
    if (bars := sum(w in SEPARATORS for w in words)) >= 3 and 5 * bars >= n:
        return True
    low = line.lower()
    return any(x in low for x in BOILERPLATE)


def judge(text: bytes) -> tuple:
    words = text.split()
    lines = text.split(b"\n")
    filled = [(line, w) for line in lines if (w := line.split())]
    n, n_chars = len(words), chars(words)
    repeats = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeats > MOST_REPEATED * n
    lost = [(line, w) for line, w in filled if line_fails(line, w)]
    lost_chars = sum(chars(w) for _, w in lost)
    gone = {line for line, _ in lost}
    clean = b"\n".join(line for line in lines if line not in gone) if gone else text
    kept = not base_failed and 100 * lost_chars <= MOST_LOST * n_chars
    return n, n_chars, symbols(text), len(filled) - len({line for line, _ in filled}), repeats, len(lost), lost_chars, base_failed, kept, clean.decode()


def apply_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column `quality`: FIELDS, base_failed, kept and clean_text (the text without failing lines)."""
    @F.arrow_udf(SCHEMA)
    def rules(column: pa.Array) -> pa.Array:
        rows = [judge(x) for x in as_bytes(column)]
        kinds = [pa.int64()] * len(FIELDS) + [pa.bool_(), pa.bool_(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=SCHEMA.fieldNames())

    return spare(docs, "quality").withColumn("quality", rules(F.col(text).cast("string")))
