"""Licence scans: stretches of a text against licence templates by the Dice coefficient of word bigrams.

Normal form: words are runs of letters and digits (inner points stay), in lower case; marks
go. A text is cut into units at line feeds and sentence ends. Every stretch of whole units is compared as a set of
distinct bigrams to every template, but for those that can't be the best where they lie: a stretch begins with a unit
that has a bigram of the template (of its own or with the next word), ends with one that adds such a bigram, and is left
once it has more bigrams out of the template than Dice allows (2 |B| (1 - t) / t) or its first units lower its Dice, so
that the stretch without them is better. 2 |A and B| / (|A| + |B|) >= t asks for |A and B| of at least |B| t / (2 - t):
templates of which the text has fewer bigrams are pruned. Of overlapping matches the best stays (longest of equals).

Defined cases: null or empty text has no match and gives an empty list; a unit of one word has no bigram of its own; a text's repeated notices are reported each; ids aren't read; other columns are kept, one named
`licenses` as `licenses_in`; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Memo, spare
from graphloom.llm.license_templates import TEMPLATES

#: Bigrams of a text that are looked through at once.
DICE, BLOCK = 0.8, 64
UNIT = re.compile(r"\n|(?<=[.!?;:])\s+")
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
MATCH = "array<struct<license:string,dice:double,first_unit:int,units:int,words:int>>"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, str], dice: float):
        self.dice = dice
        own = {name: words(text) for name, text in templates.items()}
        self.vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for x in own.values() for w in x))}
        self.size = len(self.vocabulary) + 1
        self.sets = {name: self.bigrams([self.vocabulary[w] for w in x]) for name, x in own.items()}
        self.sizes = sorted((len(s), name) for name, s in self.sets.items())
        self.known = np.zeros(self.size * self.size, bool)
        self.known[list(set().union(*self.sets.values()))] = True
        self.codes = {name: np.array(sorted(found), np.int64) for name, found in self.sets.items()}
        self.most = int(max((n for n, _ in self.sizes), default=0) * (2 - dice) / dice)
        self.homes: dict[int, list[str]] = {}
        for name, found in self.sets.items():
            for code in found:
                self.homes.setdefault(code, []).append(name)
        self.by_size = [[name for m, name in self.sizes if 2 * min(n, m) >= dice * (n + m)] for n in range(self.most + 1)]
        self.memo = Memo(lambda w: tuple(self.vocabulary.get(x, 0) for x in words(w)))

    def bigrams(self, ids: list[int]) -> set[int]:
        return {a * self.size + b for a, b in zip(ids, ids[1:], strict=False)}

    def near(self, n: int) -> list[str]:
        """Templates that a set of n bigrams can match."""
        return self.by_size[n] if n <= self.most else []

    def scan(self, text: str) -> list[dict]:
        memo = self.memo
        ids = np.array([i for w in text.split() for i in memo[w]], np.int64)
        names = self.likely(ids)
        if not names:
            return []
        others: dict[str, int] = {}  # a word out of the templates has an id of its own in each text
        units = [[self.vocabulary.get(x) or others.setdefault(x, self.size + len(others)) for x in words(part)] for part in UNIT.split(text)]
        ids = np.array([i for u in units for i in u], np.int64)
        starts = np.cumsum([0, *map(len, units)])
        left, right = ids[:-1], ids[1:]
        _, code = np.unique(left * (self.size + len(others)) + right, return_inverse=True)
        order = np.argsort(code, kind="stable")
        same = np.flatnonzero(code[order][1:] == code[order][:-1])
        before = np.full(len(code), -1)  # where a bigram was last
        before[order[same + 1]] = order[same]
        final = np.ones(len(code), bool)
        final[order[same]] = False
        both = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        found: list[tuple] = []
        for name in names:
            found += self.stretches(name, np.isin(both, self.codes[name]), before, final, starts)
        found.sort(key=lambda m: (-m[1], -m[4], m[2], m[0]))
        taken, out = set(), []
        for name, dice, first, count, n in found:
            if taken.isdisjoint(range(first, first + count)):
                taken.update(range(first, first + count))
                out.append({"license": name, "dice": dice, "first_unit": first, "units": count, "words": n})
        return sorted(out, key=lambda m: m["first_unit"])

    def likely(self, ids: np.ndarray) -> list[str]:
        """Templates of which the text has as many distinct bigrams as the least match."""
        hit = (ids[:-1] > 0) & (ids[1:] > 0)
        codes = (ids[:-1] * self.size + ids[1:])[hit]
        common: dict[str, int] = {}
        for code in np.unique(codes[self.known[codes]]).tolist():
            for name in self.homes[code]:
                common[name] = common.get(name, 0) + 1
        return [name for n, name in self.sizes if common.get(name, 0) >= max(1, n * self.dice / (2 - self.dice) - 1e-9)]

    def stretches(self, name: str, inside: np.ndarray, before: np.ndarray, final: np.ndarray, starts: np.ndarray) -> list[tuple]:
        """Matches of one template. Of each bigram of the text: whether the template has it, where it was before, and
        whether it is its last; bigram p is of words p and p + 1. `starts` has each unit's first word, and the end."""
        out, size = [], len(self.sets[name])
        excess = 2 * size * (1 - self.dice) / self.dice + 1e-9
        hits = np.unique(np.searchsorted(starts, np.flatnonzero(inside), "right") - 1)
        oldest = np.minimum.reduceat(before, np.arange(0, len(before), BLOCK))
        finals = np.append(0, np.cumsum(final))
        closes = np.zeros(len(inside), bool)
        closes[starts[starts >= 2] - 2] = True
        for i in hits.tolist():
            s = int(starts[i])
            # blocks in which a bigram is met that the stretch hasn't had; nothing changes in the others
            blocks = np.flatnonzero(oldest[s // BLOCK :] < s) + s // BLOCK
            reach = 1
            while True:
                at = (blocks[:reach, None] * BLOCK + np.arange(BLOCK)).ravel()
                at = at[(at >= s) & (at < len(inside))]
                whole = reach >= len(blocks)
                fresh = before[at] < s
                own = np.cumsum(fresh)
                common = np.cumsum(fresh & inside[at])
                # ends of units: where their last bigram is
                last = np.flatnonzero(closes[at])
                ends = at[last] + 2
                c, n = common[last], own[last]
                # what the units up to an end alone have, with the bigram to the next word
                past = np.minimum(np.searchsorted(at, ends - 1), len(own) - 1)
                poor = common[past] < self.dice / 2 * (finals[at[past] + 1] - finals[s]) - 1e-9
                over = (n - c > excess) | np.append(False, (poor | (c == size))[:-1])
                stop = int(np.argmax(over)) if over.any() else len(ends)
                if stop < len(ends) or whole or (len(ends) and bool(poor[-1] | (c[-1] == size))) or int(own[-1] - common[-1]) > excess + 1:
                    break
                reach *= 2
            dice = 2 * c / (n + size)
            grown = np.diff(c, prepend=0) > 0
            for k in np.flatnonzero((dice >= self.dice) & grown & (np.arange(len(ends)) < stop)).tolist():
                j = int(np.searchsorted(starts, ends[k], "left"))  # the first unit that ends there
                out.append((name, float(dice[k]), i, j - i, int(ends[k]) - s))
        return out


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """docs with array column `licenses`: license, dice, first_unit, units, words of each match."""
    known, held = templates or TEMPLATES, []

    @F.arrow_udf(MATCH)
    def run(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Scanner(known, dice))
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_unit", pa.int32()), ("units", pa.int32()), ("words", pa.int32())]))
        return pa.array([held[0].scan(x or "") for x in column.to_pylist()], kind)

    return spare(docs, "licenses").withColumn("licenses", run(F.col(text).cast("string")))
