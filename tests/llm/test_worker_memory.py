"""What a worker holds at a time: blocks are small beside an executor's memory."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import hashing, ngram_join, suffix_dedup

MB = 1 << 20


@pytest.fixture
def text(monkeypatch):
    """Text of four MB in lines, in a worker that has hashed nothing yet."""
    monkeypatch.setattr(hashing, "_powers", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    monkeypatch.setattr(hashing, "_prime_powers", {})
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(5000)]
    return [" ".join(r.choices(words, k=400)) for _ in range(4 * MB // 2600)]


def peak(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def blocks(text, size):
    some = []
    for t in text:
        some.append(t)
        if sum(map(len, some)) >= size:
            yield some
            some = []


def test_blocks_of_shingles(text):
    assert peak(lambda: [ngram_join.shingle_sets(b, 5) and None for b in blocks(text, ngram_join.TEXT_BLOCK)]) < 32


def test_blocks_of_phrases(text):
    assert peak(lambda: [suffix_dedup.parse([t.encode() for t in b], 100, 24) and None for b in blocks(text, suffix_dedup.BLOCK_BYTES)]) < 40


def test_powers_are_held_in_32_bits_and_no_further_than_asked_for(text):
    n = hashing.LEAST + 100_000
    held = hashing.prime_powers(hashing.BASES[0], n)
    assert sum(p.nbytes for p in hashing._prime_powers.values()) <= 4 * (n + 65536)
    for i in (0, 1, hashing.LEAST, n - 1):
        assert int(held[i]) == pow(hashing.BASES[0], i, hashing.PRIME)


def test_shared_shingles_are_counted_in_place():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300_000, 100_000, dtype=np.uint64)) for _ in range(20)]
    shingle, count = np.unique(np.concatenate(sets), return_counts=True)
    got = []
    # most of these shingles are shared and so returned, too
    assert peak(lambda: got.extend(ngram_join.several(sets))) < 2.2 * (20 * 100_000 * 8 / MB) and not sets
    assert np.array_equal(got[0], shingle[count > 1]) and np.array_equal(got[1], count[count > 1])
    for odd in ([], [5], [5, 5], [1, 5, 5, 5], [1, 1, 5]):
        assert [x.tolist() for x in ngram_join.several([np.array(odd, np.uint64)])] == [x.tolist() for x in (lambda v, n: (v[n > 1], n[n > 1]))(*np.unique(np.array(odd, np.uint64), return_counts=True))]


def test_phrases_of_many_bytes_and_few_windows_are_not_sorted_in_one_task(spark, monkeypatch):
    r = random.Random(6)
    line = "a common line that stands in many texts"
    # each text is hardly longer than a window: 3 windows of 50 bytes, and over WIDE * HOT bytes with the same trigger
    texts = ["".join(r.choice("abc ") for _ in range(6)) + line + "".join(r.choice("abc ") for _ in range(7)) for _ in range(60)]
    monkeypatch.setattr(suffix_dedup, "HOT", 200)
    sorted_bytes, hot = [], []
    written = suffix_dedup.written

    def seen(df, name):
        out = written(df, name)
        if name == "dictionary":
            sorted_bytes.extend(x["n"] for x in out.where("not hot").groupBy("trigger").agg(F.sum(F.length("bytes")).alias("n")).collect())
            hot.append(out.where("hot").count())
        return out

    monkeypatch.setattr(suffix_dedup, "written", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: bytes(x["text"]) for x in suffix_dedup.deduplicate(docs, 50, 12).collect()}
    assert max(sorted_bytes, default=0) <= 8 * 200 and hot[0]
    known, left = set(), []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for s in range(len(t) - 49):
            cover[s : s + 50] |= t[s : s + 50] in known
            known.add(t[s : s + 50])
        left.append("".join(c for c, k in zip(t, cover) if not k).encode())
    assert [got[i] for i in range(len(texts))] == left
