"""Repeated strings, fingerprints and similarity joins against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import components, fingerprints, ngram_join, suffix_dedup


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = True
            seen.add(w)
        out.append((bytes(np.frombuffer(b, np.uint8)[~cover]), int(cover.sum())))
    return out


@pytest.mark.parametrize("hot", [1 << 17, 60])
@pytest.mark.parametrize("length,gram", [(30, 8), (100, 24)])
def test_repeated_strings(make_docs, odd_texts, monkeypatch, hot, length, gram):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(8)
    line = "a common line that stands in many texts"
    texts = [*odd_texts, *("".join(r.choice("abc ") for _ in range(60)) + line + "".join(r.choice("abc ") for _ in range(60)) for _ in range(12)), "abcabcabc" * 40, "z" * 300]
    got = {r["doc_id"]: (bytes(r["text"]), r["n_removed"]) for r in suffix_dedup.deduplicate(make_docs(texts).repartition(3), length, gram).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_repeated_strings_of_empty_and_repeated_rows(make_docs, spark):
    assert suffix_dedup.deduplicate(make_docs([])).count() == 0
    text = "some words that are long enough to be found " * 2
    once = brute_repeats([text], 30)[0][1]
    assert once > 0
    docs = make_docs([text, text]).withColumn("doc_id", F.lit(5).cast("long"))
    assert [r["n_removed"] for r in suffix_dedup.deduplicate(docs, 30, 10).collect()] == [once, once]
    null = spark.createDataFrame([(None, text), (1, text)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.deduplicate(null, 80, 10).collect()}[1] == len(text)


def test_rows_with_one_id_are_cut_by_their_own_text(spark):
    r = random.Random(12)
    own = ["".join(r.choice("abcdefgh ") for _ in range(200)) for _ in range(4)]
    passage = "".join(r.choice("abcdefgh ") for _ in range(60))
    rows = [(5, own[0] + passage), (5, own[1][:50] + passage + own[1]), (None, own[2] + passage), (None, own[3]), (7, own[3] + own[1]), (2, None)]
    for hot in (1 << 17, 10):
        suffix_dedup.HOT = hot
        got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40, 10).collect()
        cut = {(x["doc_id"], bytes(x["text"]).decode()) for x in got}
        # nulls come first; the second beginning of own[1] repeats the first; 7 is after all
        assert cut == {(None, own[2] + passage), (None, own[3]), (5, own[0]), (5, own[1]), (7, ""), (2, "")}
    suffix_dedup.HOT = 1 << 17


def test_whole_characters_stay():
    text = "aé".encode() * 3
    left, spans = suffix_dedup.uncovered(text, [2, 3], 3, whole_characters=True)
    assert left.decode() and spans == [(3, 4)]


def brute_components(texts, n, percent):
    upper = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = re.findall("[^ \t-\r]+", (t or "").translate(upper))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("bucket,block", [(64, 256), (2, 8)])
@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_similarity_components(make_docs, odd_texts, monkeypatch, bucket, block, n, percent):
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    near = []
    for _ in range(60):  # a large group of near copies, many of which link only through others
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        near.append(" ".join(w))
    texts = [*odd_texts, *near, " ".join(base), " ".join(base).upper()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(make_docs(texts).repartition(3), n, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, n, percent)


def test_similarity_of_repeated_and_null_ids(spark):
    r = random.Random(3)
    a, b = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (3, a + " x"), (9, b), (2, b + " y"), (20, a), (None, b), (None, "p q r s t"), (None, "p q r s t"), (7, None)]
    for key_bits in (64, 2):  # with 2 bits, many sets share half of their hash
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), key_bits=key_bits).collect()
        assert sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"] or 0) for x in got) == sorted([(5, 38, 3), (5, 38, 2), (3, 39, 3), (9, 38, 2), (2, 39, 2), (20, 38, 3), (0, 38, 2), (0, 3, 0), (0, 3, 0), (7, 0, 7)])


def test_unlinked_texts_with_a_common_passage_do_not_meet(spark, monkeypatch):
    """Texts of eleven common words and one of their own: no links, and no group."""
    asked = []
    monkeypatch.setattr(ngram_join, "components", lambda links, name: asked.append((name, links.distinct().count())) or components.components(links, name))
    line = " ".join(f"w{i}" for i in range(11))
    for n in (300, 5000):
        texts = [f"{line} own{i}" for i in range(n)] + [f"own{i} {line}" for i in range(n)]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        assert ngram_join.jaccard_components(docs).where("doc_id <> component_id").count() == 0
    assert dict(asked)["candidates"] == 0
    linked = docs.unionByName(spark.createDataFrame([(-1, line)], "doc_id long, text string"))  # nine of ten shingles of each
    assert ngram_join.jaccard_components(linked).where("component_id = -1").count() == 2 * 5000 + 1


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_ties_hold_all_that_may_link(spark, percent):
    r = random.Random(percent)
    rows = [(1, i, n, min(n - 1, r.choice([0, 0, 1, 2, 5, n // 10]))) for i, n in enumerate([*range(1, 60), *(r.randrange(1, 900) for _ in range(150))])]
    found = ngram_join.ties(spark.createDataFrame(rows, "shingle long, key long, n int, place int"), percent)
    root = {x["node"]: x["root"] for x in components.components(found, "ties").collect()}
    for _, i, n, p in rows:
        for _, j, m, q in rows:
            if i != j and 100 * min(n - p, m - q) >= percent * (n + m - min(n - p, m - q)):
                assert root.get(i, i) == root.get(j, j)


def test_similarity_of_no_rows(make_docs):
    assert ngram_join.jaccard_components(make_docs([])).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == {x: m for x, m in root.items() if any(x in (a, b) and a != b for a, b in links)}


def test_fingerprints(make_docs, odd_texts, spark):
    k, window = fingerprints.K, fingerprints.WINDOW
    out = fingerprints.edited_fingerprints(make_docs(odd_texts).repartition(3)).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == len(odd_texts)
    hashed = {}
    for i, t in enumerate(odd_texts):
        t = t or ""
        following = (odd_texts[i - 1] if i else odd_texts[-1]) or ""
        row = by_id[i]
        assert row["n_chars"] == len(t) and row["edited"] == t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        places = [x["position"] for x in row["fingerprint"]]
        hashed.setdefault(t, row["fingerprint"])
        assert places == sorted(set(places)) and row["fingerprint"] == hashed[t]
        assert all(b - a <= window for a, b in zip(places, places[1:])) and (not places or places[0] < window)
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert fingerprints.edited_fingerprints(make_docs([])).count() == 0
    twice = make_docs(["p q r s", "p q r s"]).withColumn("doc_id", F.lit(0).cast("long"))
    assert fingerprints.edited_fingerprints(twice).count() == 2


def brute_likeness(a, b, k, window):
    """By sets of k-grams of words themselves, with the operator's order of hashes."""
    def chosen(words, rank):
        grams = [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        out = set()
        for i in range(max(1, len(grams) - window + 1) if grams else 0):
            some = grams[i : i + window]
            out.add(min(some, key=lambda g: rank[g]))
        return out

    return lambda rank: (lambda x, y: len(x & y) / len(x | y) if x | y else float(a == b))(chosen(a, rank), chosen(b, rank))


def test_likeness_against_brute_force(make_docs, spark):
    r = random.Random(20)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 60))) for _ in range(30)]
    texts += [texts[3], texts[3], "w1", "w1 w2", ""]
    k, window = fingerprints.K, fingerprints.WINDOW
    out = {x["doc_id"]: x for x in fingerprints.edited_fingerprints(make_docs(texts)).collect()}
    every = sorted({tuple(t.split()[i : i + k]) for x in out.values() for t in (texts[x["doc_id"]], x["edited"]) for i in range(max(1, len(t.split()) - k + 1))} - {()})
    df = fingerprints.fingerprint(spark.createDataFrame([(" ".join(g),) for g in every], "text string"), "text", "fp", k, window)
    rank = {tuple(x["text"].split()): (x["fp"][0]["hash"] & (2**64 - 1)) >> 32 for x in df.collect()}
    for i, t in enumerate(texts):
        edited, following = out[i]["edited"].split(), texts[i - 1].split() if i else texts[-1].split()
        assert out[i]["near_edited"] == pytest.approx(brute_likeness(t.split(), edited, k, window)(rank))
        assert out[i]["near_next"] == pytest.approx(brute_likeness(t.split(), following, k, window)(rank))


def test_windows_choose_the_rightmost_least(spark):
    text = " ".join(["a b c d e f g"] * 6)
    df = fingerprints.fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "fp", 3, 4)
    got = [(x["hash"] & (2**64 - 1), x["position"]) for x in df.first()["fp"]]
    every = fingerprints.fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "fp", 3, 1)
    grams = [x["hash"] & (2**64 - 1) for x in every.first()["fp"]]
    tokens = [x & (2**64 - 1) for (x,) in spark.createDataFrame([(w,) for w in text.split()], "w string").select(F.xxhash64("w")).collect()]

    def turned(x, by):
        return (x << by | x >> (64 - by)) & (2**64 - 1)

    rolled = turned(tokens[0], 2) ^ turned(tokens[1], 1) ^ tokens[2]
    for i in range(len(grams)):
        assert grams[i] == rolled
        if i + 3 < len(tokens):
            rolled = turned(rolled, 1) ^ turned(tokens[i], 3) ^ tokens[i + 3]
    want = []
    for i in range(len(grams) - 3):
        least = min(grams[i : i + 4])
        place = max(j for j in range(i, i + 4) if grams[j] == least)
        if (least, place) not in want:
            want.append((least, place))
    assert got == want


def test_shared_words_are_found(make_docs):
    shared = " ".join(f"s{i}" for i in range(fingerprints.K + fingerprints.WINDOW - 1))
    rows = fingerprints.edited_fingerprints(make_docs([f"a b c d e f g {shared} h i j", f"k l m {shared} n o p q r s t u"])).collect()
    assert all(r["near_next"] > 0 for r in rows)
