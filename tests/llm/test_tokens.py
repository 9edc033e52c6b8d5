"""BPE against the tokenizers library, packing against its definition and against an exhaustive search."""

import random
import unicodedata
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def ours():
    return bpe.WordBPE(PATH)


def test_random_text_as_the_library(library, ours):
    r = random.Random(2)
    letters = [*map(chr, range(32, 127)), *"éßÄÖñçãÀ×÷ÿŠšΣσςΩя中文ＡＢ  ́​\n\t\r\x1c\x85'’½²٣😀", "<|endoftext|>", "<|startoftext|>", "'s", "'LL"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 60))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in ours.ids_bytes_of(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ours.decode(g) for g in got[:300]] == library.decode_batch(got[:300], skip_special_tokens=False)


def test_code_points_of_any_unicode_version(library, ours):
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    points = [*(c for c in range(0x250, 0x110000, 37) if not 0xD800 <= c < 0xE000), *marks, 0x1C89, 0xA7CB, 0x10D50, 0x11DE0, 0x16FF4, 0x88F, 0x323B0]
    texts = [f(chr(c)) for c in points for f in (lambda c: f"a{c}b", lambda c: f"!{c}{c}1", lambda c: f"á{c}\u0323\u0301")]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids_bytes_of(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_words_and_full_tables(library, ours, monkeypatch):
    r = random.Random(3)
    texts = ["a" * 700 + " " + "ab" * 400, "".join(r.choice("etaoin") for _ in range(3000)), *(" ".join("".join(r.choice("etaoinshr") for _ in range(7)) for _ in range(400)) for _ in range(8))]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ours.encode(t) for t in texts] == want
    monkeypatch.setattr(bpe, "CACHE_IDS", 100)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 500)
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids_bytes_of(texts * 2)] == want * 2


def test_encode_decode_of_odd_texts(make_docs, odd_texts, library):
    got = {r["doc_id"]: r for r in bpe.encode_decode(make_docs(odd_texts), PATH).collect()}
    for i, t in enumerate(odd_texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(make_docs([]), PATH).count() == 0


def cost_of(ends, places, penalties, length):
    own, total, at = dict(zip(places.tolist(), penalties.tolist())), 0, 0
    for e in ends:
        n = e - at
        assert 0 < n <= length
        total += own[e] + (0 if n & (n - 1) == 0 else length - n)
        at = e
    return total


def test_cuts_cost_least():
    r = random.Random(1)
    for _ in range(150):
        length = r.choice([8, 16])
        places = np.array(sorted(r.sample(range(1, 40), r.randrange(6, 11))))
        if max(np.diff(places, prepend=0)) > length:
            continue
        penalties = np.array([r.choice([0, 4, 9]) for _ in places])
        best = None
        for k in range(len(places)):
            for some in combinations(places[:-1].tolist(), k):
                ends = [*some, int(places[-1])]
                if all(b - a <= length for a, b in zip([0, *ends], ends)):
                    c = cost_of(ends, places, penalties, length)
                    best = c if best is None else min(best, c)
        assert cost_of(packing.cut(places, penalties, length), places, penalties, length) == best


@pytest.mark.parametrize("block", [64, 1 << 19])
def test_pieces_of_odd_texts(make_docs, odd_texts, library, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    out = packing.pack(make_docs(odd_texts).coalesce(1), PATH, length=64).toPandas()
    for i, t in enumerate(odd_texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = out[out.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        assert b"".join(own.ids) == ids.tobytes() and zlib.crc32(own.ids.iloc[0]) == zlib.crc32(ids[: own.length.iloc[0]].tobytes())
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert out.sort_values(["sequence_id", "offset"]).doc_id.is_monotonic_increasing
    assert packing.pack(make_docs([]), PATH).count() == 0
