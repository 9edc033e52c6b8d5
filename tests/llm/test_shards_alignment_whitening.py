"""Sharding, cross-tokenizer alignment and whitening against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from llm import queries, sharding, token_alignment, whitening


# -- sharding ------------------------------------------------------------------------------
def sums_of(sizes, labels, k):
    out = [0] * k
    for s, b in zip(sizes, labels):
        out[b] += s
    return out


def plain_differencing(sizes, k):
    """Spread by the definition: partial partitions as lists, combined oppositely ordered."""
    parts = [(sorted([s] + [0] * (k - 1), reverse=True), i) for i, s in enumerate(sizes)]
    n = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
        (x, _), (y, _) = parts[:2]
        z = sorted((a + b for a, b in zip(x, y[::-1])), reverse=True)
        parts = [*parts[2:], (z, n)]
        n += 1
    return parts[0][0][0] - parts[0][0][-1] if parts else 0


@pytest.mark.parametrize("k", [1, 2, 3, 24])
def test_differencing_by_its_definition(k):
    r = random.Random(k)
    for n in (0, 1, 2, 5, 40):
        sizes = [r.choice([0, 7, r.randrange(1, 1000)]) for _ in range(n)]
        got = sums_of(sizes, sharding.differencing(sizes, k), k)
        assert sum(got) == sum(sizes)
        assert max(got) - min(got) == plain_differencing(sizes, k)


def test_differencing_against_all_partitions():
    r = random.Random(1)
    assert max(sums_of([8, 7, 6, 5, 4], sharding.differencing([8, 7, 6, 5, 4], 2), 2)) == 16
    for _ in range(20):
        sizes = [r.randrange(1, 60) for _ in range(8)]
        best = min(max(sums_of(sizes, p, 3)) for p in itertools.product(range(3), repeat=8))
        assert best <= max(sums_of(sizes, sharding.differencing(sizes, 3), 3)) <= best * 7 / 6


def check_shards(rows, texts, k):
    by_text, slots = defaultdict(set), defaultdict(list)
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        by_text[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(k))
    return [sum(r["size"] for r in rows if r["shard"] == s) for s in range(k)]


def test_shards_of_odd_texts(make_docs, odd_texts):
    for k in (1, 5, 24, 100):
        check_shards(sharding.shard(make_docs(odd_texts), k).collect(), odd_texts, k)


def test_shards_are_near_equal_beside_a_third_of_copies(make_docs):
    r = random.Random(3)
    texts = ["copy " * 20] * 700 + ["x" * r.randrange(0, 400) + str(i) for i in range(1400)]
    sums = check_shards(sharding.shard(make_docs(texts), 24).collect(), texts, 24)
    group = 700 * 108
    assert max(sums) == group  # alone in its shard
    others = sorted(sums)[:-1]
    assert others[-1] - others[0] <= 0.002 * others[0]  # a unit is 0.07 to 3 percent of a shard


def test_bundles_of_small_groups(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE", 16)
    monkeypatch.setattr(sharding, "BUNDLES", 32)
    monkeypatch.setattr(sharding, "CLASSES", 5)
    monkeypatch.setattr(sharding, "BLOCKS", 3)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    r = random.Random(5)
    texts = ["y" * r.randrange(0, 90) + str(i % 1100) for i in range(1500)] + ["z" * 9000, None]
    sums = check_shards(sharding.shard(make_docs(texts), 6).collect(), texts, 6)
    assert max(sums) - min(sums) <= sum(sums) / 300


def test_shards_of_no_rows_null_ids_and_repeated_rows(spark, make_docs):
    assert sharding.shard(make_docs([]), 24).collect() == []
    docs = spark.createDataFrame([(None, "a", 1)] * 3 + [(1, "a", 1)] * 2 + [(1, None, 2)], "doc_id long, text string, shard int")
    rows = sharding.shard(docs, 2, keep=["shard"]).collect()
    assert len({r["shard"] for r in rows if r["size"] == 9}) == 1
    assert sorted((r["size"], r["slot"], r["rest"]["shard"]) for r in rows) == [(8, 0, 2), *((9, i, 1) for i in range(5))]


# -- alignment -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def brute_tokens(libraries, text):
    """Ids and bytes of both, token by token; none where they don't spell the space and the text."""
    a, b = libraries
    if not text:
        return [], []
    letters = token_alignment.byte_letters()
    of_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (of_a, of_b) if b"".join(x for _, x in of_a) == whole == b"".join(x for _, x in of_b) else ([], [])


def brute(libraries, text):
    of_a, of_b = brute_tokens(libraries, text)
    ends_a, ends_b = (list(itertools.accumulate(len(x) for _, x in t)) for t in (of_a, of_b))
    links = [(of_a[i][0], of_b[j][0]) for i, x in enumerate(ends_a) for j in [k for k, y in enumerate(ends_b) if y == x]]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(str(t) for t, _ in of_a[i:x]) + "|" + ",".join(str(t) for t, _ in of_b[j:y]))
        i, j = x, y
    return len(of_a), len(of_b), ";".join(groups), links


def odd_strings():
    r = random.Random(7)
    letters = [*" \n\t　\xa0 \x85\x1c᠎​﻿'", *"abcXYZ019.,!?é▁ñ中😀\x00", "'s", "'ll", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "the ", " and", "�"]
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 25))) for _ in range(400)]


def test_alignment_against_brute_force(make_docs, odd_texts, libraries):
    texts = odd_texts[:30] + odd_strings() + odd_strings()[:50] + [" ", "  ", " a ", "a  b", "<|endoftext|> <s>"]
    want = [brute(libraries, t) for t in texts]
    count = Counter(x for w in want for x in w[3])
    highest = defaultdict(int)
    for (_, b), c in count.items():
        highest[b] = max(highest[b], c)
    for frequent in (1 << 19, 5, 0):
        got = {r["doc_id"]: r for r in token_alignment.counted(make_docs(texts), queries.BYTE_BPE, queries.PIECES, frequent=frequent).collect()}
        assert len(got) == len(texts)
        for i, (n_a, n_b, groups, links) in enumerate(want):
            r = got[i]
            sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (n_a, n_b, len(groups.split(";")) if groups else 0, len(links), sha), texts[i]
            assert r["count_sum"] == sum(count[x] for x in links)
            assert r["n_best"] == sum(count[x] == highest[x[1]] for x in links)


def test_overlaps_and_long_texts(make_docs, odd_texts, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_CHARS", 500)
    monkeypatch.setattr(token_alignment, "BUNDLE_BYTES", 40)
    texts = [odd_texts[-5], odd_texts[-4], odd_texts[-3], "naïve co-operation  isn't 10,000", "a▁b", "", None]
    both = token_alignment.Aligner(queries.BYTE_BPE, queries.PIECES)
    apart = [both.align_apart([(t or "").encode()])[0] for t in texts for _ in (0, 1)][::2]
    for r, t, x in zip(token_alignment.align(make_docs(texts), queries.BYTE_BPE, queries.PIECES, whole=True).orderBy("doc_id").collect(), texts, apart):
        of_a, of_b = brute_tokens(libraries, t)
        own_a, own_b = ([i for i, (_, x) in enumerate(tokens) for _ in x] for tokens in (of_a, of_b))
        assert [tuple(o) for o in r["overlaps"]] == [(*k, len(list(g))) for k, g in itertools.groupby(zip(own_a, own_b))]
        assert r["groups"] == x["groups"] == brute(libraries, t)[2]
        assert (r["pairs"], r["times"]) == (x["pairs"].tolist(), x["times"].tolist())


def test_alignment_of_no_rows_and_repeated_rows(spark, make_docs):
    assert token_alignment.counted(make_docs([]), queries.BYTE_BPE, queries.PIECES).collect() == []
    docs = spark.createDataFrame([(None, "one two", 1)] * 3 + [(1, None, 1)], "doc_id long, text string, pairs int")
    rows = token_alignment.counted(docs, queries.BYTE_BPE, queries.PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"], r["n_best"], r["count_sum"]) for r in rows) == [(0, 2, 2, 6)] * 3 + [(1, 0, 0, 0)]


# -- whitening -----------------------------------------------------------------------------
def brute_model(x):
    """Exact covariance of distinct whole vectors, as fractions, and its eigenvectors."""
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    cov = np.array([[float(Fraction(n * sum(v[i] * v[j] for v in x) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    return n, sums, e[::-1], v[:, ::-1].T, np.trace(cov)


def check_whitening(rows, vectors, components):
    whole = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors]
    fit = sorted({tuple(x) for _, x in whole})
    n, sums, e, v, trace = brute_model(fit)
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r
    assert len(rows) == len(whole) * components
    for c in range(components):
        sign = np.sign(sum(got[i][c + 1]["whitened"] * sum((a - s / n) * b for a, s, b in zip(x, sums, v[c])) for i, x in whole))
        for i, x in whole:
            r = got[i][c + 1]
            assert (r["n"], r["deviation"]) == (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)))
            assert r["explained"] == pytest.approx(e[c] / trace, rel=1e-9)
            assert r["whitened"] == pytest.approx(sign * sum((a - s / n) * b for a, s, b in zip(x, sums, v[c])) / math.sqrt(e[c]), abs=1e-7)
            assert 0 <= r["identity_error"] < 1e-6


def embeddings(spark, rows, parts=7):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int").repartition(parts)


def test_whitening_against_exact_covariance(spark):
    r = random.Random(2)
    for d, n, offset in ((6, 90, 0.0), (3, 3, 0.5), (12, 8, 3.0), (5, 200, 30000.0)):
        vectors = [(i, np.array([r.gauss(0, 1 + j) + offset for j in range(d)], np.float32).tolist()) for i in range(n)]
        copies = [(1000 + i, vectors[0][1]) for i in range(n // 2)]  # a third are copies
        bad = [(5000, None), (5001, [1.0, None] + [0.0] * (d - 2)), (5002, [float("nan")] * d), (5003, [float("-inf")] * d), (5004, [1.0]), (5005, [])]
        rows = whitening.whiten(embeddings(spark, [(i, v, 1) for i, v in vectors + copies + bad])).collect()
        check_whitening(rows, vectors + copies, min(4, d, n - 1))


def test_merging_loses_nothing():
    r = np.random.default_rng(1)
    x = r.integers(-400, 400, (500, 9)) + 10**9
    one = whitening.summary_of(x)
    for cuts in ([1], [100, 101, 102], range(1, 60), [250]):
        parts = [whitening.summary_of(p) for p in np.split(x, list(cuts))]
        while len(parts) > 1:
            parts = [a.merged(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
        assert (parts[0].n, parts[0].sums) == (one.n, one.sums)
        np.testing.assert_allclose(parts[0].factor.T @ parts[0].factor, one.factor.T @ one.factor, rtol=1e-9, atol=1e-3)


def test_whitening_of_flat_single_and_no_rows(spark):
    assert whitening.whiten(embeddings(spark, [])).collect() == []
    assert whitening.whiten(embeddings(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    assert whitening.whiten(embeddings(spark, [(i, [0.5, 1.5], 1) for i in range(5)])).collect() == []
    rows = whitening.whiten(embeddings(spark, [(None, [0.0, float(i % 2)], 1) for i in range(6)])).collect()
    assert [(r["component"], r["n"], round(abs(r["whitened"]), 9), r["deviation"]) for r in rows] == [(1, 2, 1.0, 65536)] * 6


def test_deviations_beyond_a_double_and_a_long():
    m = whitening.Model(3, [3 * 10**9, 1], np.eye(2), np.ones(2), 2.0)
    assert m.deviations(np.array([[0, 0], [10**9 + 7, 1]])) == [9 * 10**18 + 1, 21 * 21 + 4]
    assert whitening.Model(10, [10**10], np.eye(1), np.ones(1), 1.0).deviations(np.array([[-(10**9)]])) == [None]


# -- queries -------------------------------------------------------------------------------
def test_queries_are_registered():
    assert {"op11_sharding", "op12_token_alignment", "op13_whitening"} <= set(queries.queries())
