"""Texts that a polynomial modulo a power of two takes for one another, and candidates that don't link."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm import bpe, hashing, ngram_join, packing, suffix_dedup

PATH = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


SIZES = [1024, 4096, 65536]


@pytest.fixture(scope="module")
def pairs():
    """Texts with nothing in common but the hash."""
    return [thue_morse(n, *x) for n in SIZES for x in ("ab", "ba")] + [thue_morse(2048, "yes, so it is ", "no, it is not ")[:-1], thue_morse(2048, "no, it is not ", "yes, so it is ")[:-1]]


def test_hashes_of_segments():
    r = np.random.default_rng(0)
    data = r.integers(0, 3, 1 << 16).astype(np.uint8)
    data[: 1 << 13], data[1 << 13 : 1 << 14] = (np.frombuffer(thue_morse(1 << 13, *x).encode(), np.uint8) for x in ("ab", "ba"))
    starts = np.concatenate([r.integers(0, len(data) - 70, 5000), [0, 1 << 13]])
    stops = starts + np.concatenate([r.integers(0, 70, 5000), [1 << 13, 1 << 13]])
    by_bytes = {}
    for a, b, h in zip(starts.tolist(), stops.tolist(), hashing.segment_hashes(data, starts, stops).tolist()):
        assert by_bytes.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)
    assert hashing.segment_hashes(data[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_bpe_and_packing(make_docs, pairs):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = [library.encode(t, add_special_tokens=False).ids for t in pairs]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode_decode(make_docs(pairs).coalesce(1), PATH).collect()}
    assert [got[i] for i in range(len(pairs))] == want
    pieces = {}
    for r in sorted(packing.pack(make_docs(pairs).coalesce(1), PATH).collect(), key=lambda r: (r["doc_id"], r["start"])):
        pieces.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert [pieces[i] for i in range(len(pairs))] == [[*ids, 1] for ids in want]


@pytest.mark.parametrize("calls", [1, 2, 3])
def test_bpe_with_equal_hashes(make_docs, odd_texts, monkeypatch, calls):
    """Every hash equal, from the nth call on: bytes decide."""
    real, done = hashing.segment_hashes, []

    def same(data, starts, stops, by=0):
        done.append(1)
        return real(data, starts, stops) if len(done) < calls else np.zeros(len(starts), np.uint64)

    ours = bpe.WordBPE(PATH)
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    monkeypatch.setattr(bpe, "segment_hashes", same)
    texts = [t or "" for t in odd_texts]
    for part in (texts[:12], texts[12:], texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids_bytes_of(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_similarity(make_docs, pairs):
    rows = ngram_join.jaccard_components(make_docs([*pairs[:6], pairs[3]])).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {**{i: i for i in range(6)}, 6: 3}


def test_repeats(make_docs, pairs):
    texts = [p[:4096] for p in pairs[2:4]] + ["x" + pairs[2]]
    seen, want = set(), []
    for t in texts:
        raw, gone = t.encode(), set()
        for s in range(len(raw) - 99):
            k = raw[s : s + 100]
            gone |= set(range(s, s + 100)) if k in seen else set()
            seen.add(k)
        want.append(bytes(c for i, c in enumerate(raw) if i not in gone))
    assert [bytes(r["text"]) for r in suffix_dedup.deduplicate(make_docs(texts)).orderBy("doc_id").collect()] == want


def test_repeats_of_the_smallest_id(spark):
    r = random.Random(3)
    once = "".join(r.choice("abcdef") for _ in range(150))
    own = ["".join(r.choice("ghij") for _ in range(120)) for _ in range(3)]
    for ids in ([-(1 << 63), 7, 9], [None, -(1 << 63), 9]):
        docs = spark.createDataFrame([(i, o + once) for i, o in zip(ids, own)], "doc_id long, text string")
        got = {r["doc_id"]: (r["n_removed"], hashlib.sha256(r["text"]).hexdigest()) for r in suffix_dedup.deduplicate(docs).collect()}
        assert [got[i][0] for i in ids] == [0, 150, 150]


def test_pipeline_keeps_both(spark, pairs):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(pairs[:6])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_near(spark, docs, "").collect()) == list(range(6))


def test_chains_of_candidates_are_verified_by_pairs(spark, monkeypatch):
    """Texts of four of the same 60 sentences in random order: candidates make long chains, few texts link."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    sentences = [" ".join(words[10 * i : 10 * i + 10]) for i in range(60)]
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    compared = []
    for n in (400, 800):
        texts = [" ".join(r.sample(sentences, 4)) for _ in range(n)]
        texts += [t + " more" for t in texts[::40]]  # these do link
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        seen = []
        real = ngram_join.components
        monkeypatch.setattr(ngram_join, "components", lambda links, name, seen=seen: (seen.append((name, links.count())), real(links, name))[1])
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(rows).collect()}
        monkeypatch.setattr(ngram_join, "components", real)
        sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
        first = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    a, b = sorted((first[i], first[j]))
                    first = [a if x == b else x for x in first]
        assert [got[i] for i in range(len(texts))] == first
        compared.append(dict(seen))
    assert compared[1]["parts"] <= 3 * max(1, compared[0]["parts"])
