"""Token ids of whole texts by the tokenizers library, one BPE call per unit never seen before.

The two vocabularies that are known here split a text into words first and encode each on its own, so a text's ids are
the ids of its units in a row, where a unit may end wherever both pre-tokenizers always cut: before white space that
follows something else, and between a letter and ASCII punctuation. A batch's texts are cut into units and hashed as
one array; a direct-mapped table of SLOTS units gives the place of a unit's ids, so that only its misses are encoded.
The table's memory is fixed and its ids are dropped beyond ARENA of them. Two units of one table share a 64-bit hash
with odds of 10^-7. Any other tokenizer file, and texts that may hold its special tokens, are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

SLOT_BITS, ARENA, CHUNK = 20, 1 << 22, 1 << 19
SEPARATOR = "\ue000"
#: The pre-tokenizers and normalizers for which units are cut as above.
SPACED = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
LOWERED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
#: Where a long text may be cut into pieces.
CUT = re.compile(rb"(?<=[!-~])(?=[ \n])")
U64 = np.uint64
SPACE, SOLID, LETTER, MARK = 1, 2, 4, 8


def _kinds() -> bytes:
    """The flags of each byte."""
    kinds = bytearray(256)
    for b in range(33, 127):
        kinds[b] = SOLID | (LETTER if chr(b).isalpha() else 0 if chr(b).isdigit() else MARK)
    for b in b" \n\t\r":
        kinds[b] = SPACE
    return bytes(kinds)


KINDS = _kinds()
LOWER = bytes(range(256)).lower()
#: The first n bytes of a little-endian word.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def kinds_of(raw: bytes) -> np.ndarray:
    """The flags of each byte of a text in UTF-8. Bytes that may end white space beyond ASCII aren't solid."""
    kinds = np.frombuffer(raw.translate(KINDS), np.uint8)
    if not raw.isascii():
        kinds, data = kinds.copy(), np.frombuffer(raw, np.uint8)
        lead = np.flatnonzero(data >= 0xC3)
        lead = lead[: np.searchsorted(lead, len(raw) - 1)]
        byte, after = data[lead], data[lead + 1]
        kinds[lead[byte <= 0xDF] + 1] = SOLID
        latin = lead[(byte == 0xC3) & (after != 0x97) & (after != 0xB7)]
        kinds[latin] = LETTER
        kinds[latin + 1] = SOLID | LETTER
        three = lead[(byte >= 0xE4) & (byte <= 0xEF)] + 2
        kinds[three[three < len(raw)]] = SOLID
    return kinds


def unit_starts(kinds: np.ndarray) -> np.ndarray:
    starts = np.empty(len(kinds), np.uint8)
    starts[1:] = (kinds[1:] & (kinds[:-1] >> 1) & SPACE) | (kinds[1:] & (kinds[:-1] << 1) & MARK) >> 3
    starts[:1] = 1
    return starts.view(bool)


def unit_hashes(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of substrings, eight bytes at a step."""
    padded = raw + bytes(8)
    words = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    h = sizes.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019)
    h = (h ^ (words[starts] & MASKS[np.minimum(sizes, 8)])) * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    at, long = 8, np.flatnonzero(sizes > 8)
    while len(long):
        left = sizes[long] - at
        own = (h[long] ^ (words[starts[long] + at] & MASKS[np.minimum(left, 8)])) * U64(0x94D049BB133111EB)
        h[long] = own ^ (own >> U64(29))
        at, long = at + 8, long[left > 8]
    h *= U64(0x9E3779B97F4A7C15)
    return np.maximum(h ^ (h >> U64(32)), U64(1))


class WordIds:
    """ids(texts) -> an array of little-endian unsigned 32-bit ids for each text, given as UTF-8."""

    def __init__(self, path: str, slot_bits: int = SLOT_BITS, arena: int = ARENA):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = (file["normalizer"], file["pre_tokenizer"])
        self.spaced = kind == SPACED
        self.cuts = kind in (SPACED, LOWERED) and file["model"]["type"] == "BPE" and all(t["content"].startswith("<|") for t in file["added_tokens"])
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        shown = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}
        self.shown = np.array([shown[b] for b in range(256)], "<u4")
        # The model alone cuts plain units, shown as the byte-level pre-tokenizer shows them, at separators.
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(SEPARATOR)
        self.model._resize_cache(0)
        heads = np.zeros(max(file["model"]["vocab"].values()) + 1, bool)
        for token, i in file["model"]["vocab"].items():
            heads[i] = token.startswith("\u0120") if self.spaced else token.endswith("</w>")
        self.heads = heads  # in a unit of one pre-token and a space, the one id that holds the space or the end
        self.shift, self.arena = U64(64 - slot_bits), arena
        self.keys = np.zeros(1 << slot_bits, U64)
        self.place, self.count = np.zeros(1 << slot_bits, np.uint32), np.zeros(1 << slot_bits, np.uint32)
        self.held, self.used = np.zeros(1 << 16, "<u4"), 0

    def _plain(self, joined: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in a row, each letters only and closed by a 0, and how many of each. Units that hold their space
        start with it."""
        if not self.spaced:
            joined = np.frombuffer(joined.tobytes().translate(LOWER), np.uint8).copy()
            joined[1:] += ((joined[:-1] == 0xC3) & (joined[1:] < 0x9F)).astype(np.uint8) << 5
        shown = self.shown[joined]
        shown[joined == 0] = ord(SEPARATOR)
        ids = np.array(self.bare.encode_batch_fast([shown[:-1].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
        marks = np.flatnonzero(self.heads[ids])
        if len(marks) != units:
            raise ValueError("the vocabulary doesn't mark each unit")
        return ids, np.diff(np.append(marks, len(ids))) if self.spaced else np.diff(np.append(-1, marks))

    def _add(self, hashes: np.ndarray, data: np.ndarray, kinds: np.ndarray, first: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and count of the ids of new units, which are data[first:stops]."""
        sizes = stops - first + 1
        heads = np.cumsum(sizes) - sizes
        at = np.repeat(first - heads, sizes)
        at += np.arange(len(at))
        body = np.append(data, np.uint8(0))[at]
        letters = np.append(kinds, np.uint8(0))[at] & LETTER
        if self.spaced:
            letters[heads] = np.where((body[heads] == 0x20) & (sizes > 2), LETTER, 0)
        body[heads + sizes - 1] = 0
        letters[heads + sizes - 1] = LETTER
        plain = (np.bitwise_and.reduceat(letters, heads) == LETTER) & (sizes > 1)
        other = np.flatnonzero(~plain)
        found = [self.tokenizer.encode(body[a:b].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(heads[other].tolist(), (heads + sizes - 1)[other].tolist(), strict=True)]
        count = np.zeros(len(sizes), np.int64)
        count[other] = [len(x) for x in found]
        ids, count[plain] = self._plain(body[np.repeat(plain, sizes)], int(plain.sum())) if plain.any() else (np.zeros(0, "<u4"), [])
        own = np.array([i for x in found for i in x], "<u4")
        end = self.used + len(ids) + len(own)
        if end > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(end - len(self.held), len(self.held)), "<u4")])
        self.held[self.used : self.used + len(ids)] = ids
        self.held[self.used + len(ids) : end] = own
        place = np.zeros(len(sizes), np.uint32)
        place[plain] = self.used + np.cumsum(count[plain]) - count[plain]
        place[other] = self.used + len(ids) + np.cumsum(count[other]) - count[other]
        self.used = end
        slot = (hashes >> self.shift).astype(np.int64)
        slot ^= (self.keys[slot] != 0) & (self.keys[slot ^ 1] == 0)
        self.keys[slot] = hashes
        kept = np.flatnonzero(self.keys[slot] == hashes)  # of two new units for one slot one is kept, whole
        self.place[slot[kept]], self.count[slot[kept]] = place[kept], count[kept]
        return place, count.astype(np.uint32)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each piece's end."""
        if self.used > self.arena:
            self.keys[:] = 0
            self.held, self.used = np.zeros(1 << 16, "<u4"), 0
        raw = b"".join(pieces)
        data, kinds = np.frombuffer(raw, np.uint8), kinds_of(raw)
        ends = np.cumsum([len(p) for p in pieces])
        begins = unit_starts(kinds)
        begins[ends[:-1]] = True
        starts = np.flatnonzero(begins)
        first, stops = starts, np.append(starts[1:], len(raw))
        if not self.spaced:
            first = starts + (data[starts] == 0x20) + (data[starts] == 0x0A)
            if raw.isascii() or data.max() < 0xCC:
                raw = raw.translate(LOWER)
            else:  # a mark that follows may combine with the letter
                lower = (kinds & LETTER > 0) & (data >= 0x41) & (data < 0x60)
                lower[:-1] &= (data[1:] < 0x80) | (data[1:] == 0xC3)
                raw = (data + (lower.astype(np.uint8) << 5)).tobytes()
            data = np.frombuffer(raw, np.uint8)
        h = unit_hashes(raw, first, stops - first)
        slot = (h >> self.shift).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != h)
        slot[new] ^= 1
        place, count = self.place[slot], self.count[slot]
        new = new[self.keys[slot[new]] != h[new]]
        if len(new):
            hashes, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            own = self._add(hashes, data, kinds, first[new[one]], stops[new[one]])
            place[new], count[new] = own[0][back], own[1][back]
        total = np.cumsum(count, dtype=np.int64)
        gather = np.repeat(place - (total - count), count)
        gather += np.arange(len(gather))
        upto = np.append(0, total)[np.searchsorted(starts, ends)]
        return self.held[gather], upto

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        pieces: list[bytes] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            ids, upto = self._encode(pieces)
            at = 0
            for owner, end in zip(owners, upto.tolist(), strict=True):
                out[owner].append(ids[at:end])
                at = end

        for i, text in enumerate(texts):
            if not self.cuts or b"<|" in text:
                out[i].append(np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4"))
                continue
            at = 0
            while at < len(text):
                cut = CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
                piece = text[at : cut.start() if cut else len(text)]
                at += len(piece)
                if held and held + len(piece) > CHUNK:
                    flush()
                    pieces, owners, held = [], [], 0
                pieces.append(piece)
                owners.append(i)
                held += len(piece)
        if pieces:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, "<u4") for x in out]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One per Python worker and vocabulary, so tasks of a worker share its table."""
    return WordIds(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
