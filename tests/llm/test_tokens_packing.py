import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from graphloom.llm import word_ids
from graphloom.llm.packing import differencing, near_equal, pack_documents
from graphloom.llm.token_binary import from_image, pack, read_tokens, to_image, unpack, write_tokens
from graphloom.llm.word_ids import WordIds, vocabulary

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
TEXTS = ["", "a", "  a  b ", "\n\n x", "a\tb", "x\r\ny", " a", "a ", "it's don't 12345 ab12c", "<|endoftext|> a", "ab,  cd.\n\nef\n gh \n", "Été naïve ß ﬁ İ 日本 ​  z", "x " * 300, "a|b, c!d\ne;"]


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("slot_bits, arena, chunk", [(21, 1 << 23, 1 << 19), (3, 10, 16)])
def test_ids_equal_the_library(file, slot_bits, arena, chunk, monkeypatch):
    """Whole texts at once; with a table of 8 places, ids dropped after each flush and texts cut into pieces."""
    monkeypatch.setattr(word_ids, "CHUNK", chunk)
    w, t = WordIds(vocabulary(file), slot_bits, arena), Tokenizer.from_file(vocabulary(file))
    for _ in range(2):
        for x, ids in zip(TEXTS, w.ids([x.encode() for x in TEXTS]), strict=True):
            assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_other_tokenizers_encode_whole_texts(tmp_path):
    t = Tokenizer.from_file(vocabulary(FILES[1]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.save(f"{tmp_path}/other.json")
    w = WordIds(f"{tmp_path}/other.json")
    assert not w.cuts
    for x, ids in zip(TEXTS, w.ids([x.encode() for x in TEXTS]), strict=True):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abH Zé.É,'\n\t\r1<|ΣŸ\u0331\u0301\u0307\u3000\u00a0\u2003’日😀\x1c", max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    for file in FILES:
        w = _WORDS.setdefault(file, WordIds(vocabulary(file)))
        for x, ids in zip(texts, w.ids([x.encode() for x in texts]), strict=True):
            assert ids.tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids


_WORDS: dict = {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**32 - 1), st.integers(2**30, 2**60 - 1)), max_size=2500))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, first = pack(x)
    assert unpack(words, first, len(x)).tolist() == ids


def test_image_round_trip():
    ids = np.arange(5000) % 7
    doc_ids, lengths, back = from_image(to_image([None, 3], [1000, 4000], ids))
    assert doc_ids == [None, 3] and lengths.tolist() == [1000, 4000] and (back == ids).all()


def test_file_set(frame, spark, tmp_path):
    rows = [(5, "Hello world"), (None, "x"), (2, None), (5, "again"), (-3, "long " * 3000)]
    write_tokens(frame(rows), f"{tmp_path}/t", vocabulary(FILES[0]), 2)
    got = sorted(read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -3, 2, 5, 5]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    t = Tokenizer.from_file(vocabulary(FILES[0]))
    want = {x or "": np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, x in rows}
    assert sorted(r["ids"] for r in got) == sorted(map(bytearray, want.values())) and all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in got)
    write_tokens(frame([]), f"{tmp_path}/e", vocabulary(FILES[0]), 2)
    assert read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_differencing_sums_and_parts():
    sums, windows = differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sums.tolist()) == [14, 16] and sorted(i for w in windows for i in w) == list(range(5))
    for sizes in ([1024], [1, 1], [256] * 9, [1000, 30, 20, 10]):
        windows = near_equal(sizes, 1024)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 1024 for w in windows)


def test_packing(frame):
    rows = [(i, "word " * (37 * i % 900)) for i in range(300)] + [(None, None), (7, "twice"), (1000, "long text, " * 4000)]
    got = pack_documents(frame(rows), vocabulary(FILES[1]), 0).toPandas()
    t = Tokenizer.from_file(vocabulary(FILES[1]))
    assert got.length.sum() == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 1024 and (1024 * len(sums) - sums.sum()) / sums.sum() < 0.03
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1].tolist()]
    whole = got[got.doc_id == 1000].sort_values("start")
    assert b"".join(whole.ids) == np.array([*t.encode(rows[-1][1], add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert pack_documents(frame([]), vocabulary(FILES[1]), 0).count() == 0
