"""Byte-pair encoding and decoding with a contiguous rank array (operator 7).

A short word is a row of two contiguous arrays (all words of a like length are done
together): its parts (the ids between part boundaries) and the merge rank of every adjacent pair.  The smallest rank is found by
scanning, its boundary is deleted, and only the two neighbouring ranks are refreshed.
Words of more than ``LONG_WORD`` parts keep the same order of merges with a heap, so a
degenerate word of n bytes costs n log n and not n squared.

Reads the JSON of a public tokenizer with the parts: NFC, ``\\s+`` to one space, lower
case; a splitting pattern; byte-level alphabet; BPE with an end-of-word suffix; added
tokens that are found in the raw text.  Results equal those of the tokenizers library, whose Unicode
tables (normal form, lower case, letters and numbers) are asked for text beyond Latin letters, as Python's
are of other versions; splitting, merging and decoding are done here.
Blocks of text are worked off as arrays: stretches between white space are found by a
64-bit hash, each distinct one is split and merged once, and its ids are
remembered, with its bytes, in a table of bounded size.  Bytes are compared wherever a hash is; a block in which
two stretches share one goes without.

Null text is the empty text (no ids, empty decoding); any other column of the input is
kept out of the result; repeated rows give repeated rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from llm.hashing import segment_hashes

LONG_WORD = 128
#: Ids held in a worker's table of stretches, which then starts anew (a cache, results don't depend on it).
CACHE_IDS = 1 << 22
_ONIG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: White space beyond the six common characters, or a mark of an added token.
_RARE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Kinds of bytes: an ASCII letter, an ASCII sign, the first and the second byte of a letter of Latin-1, others.
LETTER, SIGN, LEAD, TAIL, OTHER = range(5)
KINDS = np.full(256, SIGN, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[[*range(48, 58), 39]] = OTHER
KINDS[0xC3] = LEAD
KINDS[0x80:0xC0] = TAIL
KINDS[0xC0:0xC3] = KINDS[0xC4:] = OTHER
#: Text below this code point is split by a pattern with its letters and digits spelt out.
LATIN_END = 0x250
_BEYOND_LATIN = re.compile("[^\0-\u024f]")
BLOCK_WORDS, BLOCK_CHARS = 1 << 14, 1 << 20
#: Bytes of ids and decoded text handed to the JVM at a time.
OUT_BYTES = 1 << 23
NONE, NO_RANK = 1 << 62, 1 << 30


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte, as byte-level vocabularies spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def alike(a: np.ndarray, starts: np.ndarray, stops: np.ndarray, b: np.ndarray, others: np.ndarray, ends: np.ndarray) -> bool:
    """Whether each a[start:stop] has the bytes of its b[other:end]."""
    size = stops - starts
    if not np.array_equal(size, ends - others):
        return False
    return np.array_equal(a[runs(starts, size)], b[runs(others, size)])


class LibraryTables:
    """The tokenizers library's Unicode tables, beside those of the ``regex`` module."""

    def __init__(self, pattern: str):
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        #: Characters that the two take for different kinds.
        self.unlike: set[str] = set()
        for kind, sample in (("L", "a"), ("N", "1")):
            named = regex.compile(f"\\p{{{kind}}}").findall("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
            could = dict.fromkeys([*named, *(c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == kind)])
            # runs of the kind and of others take turns, the sample's run first
            parts = pre_tokenizers.Split(Regex(f"\\p{{{kind}}}+"), "isolated").pre_tokenize_str(sample + "".join(could))
            own = set("".join(p for p, _ in parts[::2])[1:]) | {sample}
            extra, missing = set(named) - own, own - set(named)
            self.unlike |= extra | missing
            named_only = f"--[{''.join(sorted(extra))}]" if extra else ""
            pattern = pattern.replace(f"\\p{{{kind}}}", f"[[\\p{{{kind}}}{named_only}]{''.join(sorted(missing))}]")
        self.exact = regex.compile("(?V1)" + pattern + "|\n")


class WordBPE:
    """Encoder and decoder of one vocabulary file; made once in each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        #: (left id, right id) as one integer -> (rank, merged id) as one integer; ranks order the integers.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        keys = np.fromiter(self.merges.keys(), np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], NONE)
        self.pair_ranks = np.append(order, NO_RANK).astype(np.int32)  # merges are listed by rank
        self.merged = (np.fromiter(self.merges.values(), np.int64, len(self.merges)) & 0xFFFFF).astype(np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern + "|\n")
        below = [chr(c) for c in range(LATIN_END)]
        kinds = {k: "".join(c for c in below if unicodedata.category(c)[0] == k) for k in "LN"}
        plain = pattern.replace("[\\p{L}]", "[LL]").replace("[\\p{N}]", "[NN]").replace("\\p{L}", "LL").replace("\\p{N}", "NN").replace("[^\\s", r"[^ \t-\r\x85\xa0")
        #: The same pattern for text below LATIN_END, for Python's own faster matcher.
        self.latin = re.compile(plain.replace("LL", kinds["L"]).replace("NN", kinds["N"]) + "|\n") if "\\p" not in plain else self.pieces
        self.pattern, self.tables = pattern, None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self._forget()

    # -- words ------------------------------------------------------------------------------
    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NO_RANK where the pair doesn't merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NO_RANK)

    def _short(self, parts: np.ndarray, n: np.ndarray) -> None:
        """Merges a block of words in place: parts is words x longest, n the parts in use of each word.

        Every round scans each word's rank array for its leftmost minimum, deletes that boundary
        and refreshes the two neighbouring ranks; words without a rank left drop out.
        """
        width = parts.shape[1]
        column = np.arange(width)
        ranks = np.full(parts.shape, NO_RANK, np.int32)
        used = column[None, 1:] < n[:, None]
        ranks[:, :-1][used] = self._ranks(parts[:, :-1][used], parts[:, 1:][used])
        live = np.arange(len(parts))
        while len(live):
            block = ranks[live]
            at = block.argmin(axis=1)
            best = block[np.arange(len(live)), at]
            going = best != NO_RANK
            live, at, best, block = live[going], at[going], best[going], block[going]
            if not len(live):
                return
            # delete the boundary after part `at`: what lies right of it moves one place to the left
            source = column[None, :] + (column[None, :] > at[:, None])
            source[:, -1] = width - 1
            rows = parts[live]
            moved = np.take_along_axis(rows, source, 1)
            source = column[None, :] + (column[None, :] >= at[:, None])
            source = np.minimum(source, width - 1)
            block = np.take_along_axis(block, source, 1)
            block[:, -1] = NO_RANK
            here = np.arange(len(live))
            merged = self.merged[best]
            moved[here, at] = merged
            n[live] -= 1
            left = at > 0
            block[here[left], at[left] - 1] = self._ranks(moved[here[left], at[left] - 1], merged[left])
            right = at + 1 < n[live]
            block[here[right], at[right]] = self._ranks(merged[right], moved[here[right], at[right] + 1])
            block[here[~right], at[~right]] = NO_RANK
            parts[live], ranks[live] = moved, block

    def _long(self, parts: list[int]) -> list[int]:
        look, n = self.merges.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := look(parts[i] << 20 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or look(parts[i] << 20 | parts[j], NONE) != rank:
                continue
            parts[i], parts[j] = rank & 0xFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := look(parts[i] << 20 | parts[k], NONE)) != NONE:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := look(parts[h] << 20 | parts[i], NONE)) != NONE:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    # -- stretches of text between white space ----------------------------------------------
    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of stretches of text, any of them, by the splitting pattern."""
        text = "\n".join(chunks)
        if _BEYOND_LATIN.search(text):
            if self.tables is None:  # made when first needed
                self.tables = LibraryTables(self.pattern)
            text = self.tables.normal(text)
            matcher = self.pieces if self.tables.unlike.isdisjoint(text) else self.tables.exact
        else:
            text, matcher = text.lower(), self.latin
        pieces = matcher.findall(text)
        distinct = list(dict.fromkeys(w for w in pieces if w != "\n"))
        known = dict(zip(distinct, self._words_of(distinct)))
        known["\n"] = b"\n"
        pieces.append("\n")
        out, at = [], 0
        for _ in chunks:
            end = pieces.index("\n", at)
            out.append(b"".join(map(known.__getitem__, pieces[at:end])))
            at = end + 1
        return out

    def _words_of(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        flat = np.frombuffer("\n".join(words).encode() + b"\n", np.uint8)
        stops = np.flatnonzero(flat == 10)
        ids, n = self._encode_words(flat, np.append(0, stops[:-1] + 1), stops)
        data, cuts = ids.tobytes(), (4 * np.cumsum(n)).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _encode_words(self, flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and their number in each: words of the pattern, in lower case, as bytes."""
        size = stops - starts
        n = np.zeros(len(size), np.int64)
        by = np.argsort(size, kind="stable")
        in_order = size[by]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(by) and in_order[at] <= LONG_WORD:
            width = int(in_order[at] + 3) // 4 * 4
            stop = min(int(np.searchsorted(in_order, width, side="right")), at + BLOCK_WORDS)
            some = by[at:stop]
            used = size[some]
            column = np.arange(width)
            parts = self.inner[flat[np.minimum(starts[some][:, None] + column[None, :], len(flat) - 1)]]
            parts[np.arange(len(some)), used - 1] = self.last[flat[stops[some] - 1]]
            self._short(parts, used)
            n[some] = used
            found.append((some, parts[column[None, :] < used[:, None]]))
            at = stop
        for i in by[at:].tolist():
            data = flat[starts[i] : stops[i]]
            one = np.array(self._long([*self.inner[data[:-1]].tolist(), int(self.last[data[-1]])]), np.int32)
            n[i] = len(one)
            found.append((np.array([i]), one))
        ids = np.zeros(int(n.sum()), np.int32)
        begin = np.cumsum(n) - n
        for some, own in found:
            ids[runs(begin[some], n[some])] = own
        return ids, n

    def _learn(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stretches (places in a block's bytes), one after the other, and their number in each.

        Stretches of plain letters and signs are split and encoded as arrays; what has digits,
        apostrophes or letters beyond two Latin blocks goes through the pattern."""
        size = stops - starts
        flat = data[runs(starts, size)]
        begin = np.cumsum(size) - size
        kind = KINDS[flat]
        after = np.append(np.uint8(0), flat[:-1])
        after[begin] = 0
        pair = kind == LEAD
        tail = after == 0xC3
        # a byte from 0x80 on must follow 0xC3 and make a letter (not the multiplication or division sign)
        bad = (kind == OTHER) | (tail & ((flat < 0x80) | (flat > 0xBF) | (flat == 0x97) | (flat == 0xB7))) | ((kind == TAIL) & ~tail)
        lone = np.zeros(len(flat), bool)
        lone[begin + size - 1] = pair[begin + size - 1]
        hard = np.bitwise_or.reduceat(bad | lone, begin)
        # lower case
        low = flat.copy()
        low[(flat >= 65) & (flat <= 90)] += 32
        low[tail & (flat >= 0x80) & (flat <= 0x9E)] += 32
        # words: runs of letters, runs of signs
        letter = kind != SIGN
        first = np.ones(len(flat), bool)
        first[1:] = letter[1:] != letter[:-1]
        first[begin] = True
        owner = np.repeat(np.arange(len(size)), size)
        easy = ~hard[owner]
        heads = np.flatnonzero(first)
        ends = np.append(heads[1:], len(flat))
        keep = easy[heads]
        heads, ends = heads[keep], ends[keep]
        _, one, which = np.unique(segment_hashes(low, heads, ends), return_index=True, return_inverse=True)
        if not alike(low, heads, ends, low, heads[one][which], ends[one][which]):
            hard[:], heads, ends, one, which = True, heads[:0], ends[:0], one[:0], which[:0]  # all by the pattern, which needs no hashes
        ids, n = self._encode_words(low, heads[one], ends[one])
        place = np.cumsum(n) - n
        count = np.zeros(len(size), np.int64)
        np.add.at(count, owner[heads], n[which])
        slow = np.flatnonzero(hard)
        if len(slow):
            raw = flat.tobytes()
            more = self._ids_of([raw[a : a + b].decode("utf-8", "surrogatepass") for a, b in zip(begin[slow].tolist(), size[slow].tolist())])
            count[slow] = [len(x) // 4 for x in more]
        out = np.zeros(int(count.sum()), np.int32)
        base = np.cumsum(count) - count
        if len(heads):
            out[runs(base[~hard], count[~hard])] = ids[runs(place[which], n[which])]
        if len(slow):
            out[runs(base[slow], count[slow])] = np.frombuffer(b"".join(more), "<u4").astype(np.int32)
        return out, count

    # -- texts ------------------------------------------------------------------------------
    def ids_bytes_of(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; about a MB of text at a time."""
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size > BLOCK_CHARS:
                yield from self._block(some)
                some, size = [], 0
        yield from self._block(some)

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        plain = [not _RARE.search(t) for t in texts]
        done = self._plain_block([t for t, p in zip(texts, plain) if p])
        for t, p in zip(texts, plain):
            yield next(done) if p else b"".join(self._ids_of([x])[0] if x not in self.added else struct.pack("<I", self.added[x]) for x in self._stretches(t))

    def _stretches(self, text: str) -> list[str]:
        """What stands between white space and added tokens; an added token is a stretch of its own."""
        if self.split_added is not None and "<|" in text and self.split_added.search(text):
            return [c for x in self.split_added.split(text) for c in ([x] if x in self.added else self._stretches(x))]
        return [x for x in _ONIG_SPACE.split(text) if x]

    def _plain_block(self, texts: list[str]) -> Iterator[bytes]:
        """Texts whose white space is the common one and that have no added token."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
        space = SPACES[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
        distinct, one, which = np.unique(segment_hashes(data, starts, stops), return_index=True, return_inverse=True)
        if not alike(data, starts, stops, data, starts[one][which], stops[one][which]):
            yield from self._exact(texts)
            return
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        old = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        new = ~old
        if len(self.pool) > CACHE_IDS:
            self._forget()
            old, new = np.zeros(len(distinct), bool), np.ones(len(distinct), bool)
        first, size = self.first[at[old]], self.size[at[old]]
        if not alike(data, starts[one[old]], stops[one[old]], self.bytes, first, first + size):
            yield from self._exact(texts)
            return
        if new.any():
            ids, count = self._learn(data, starts[one[new]], stops[one[new]])
            self._keep(distinct[new], ids, count, data, starts[one[new]], stops[one[new]])
            at = np.searchsorted(self.known, distinct)
        n, where = self.count[at], self.place[at]
        ids = self.pool[runs(where[which], n[which])].astype("<u4").tobytes()
        upto = np.append(0, np.cumsum(n[which]))
        ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
        cuts = (4 * upto[ends]).tolist()
        for a, b in zip([0, *cuts], cuts):
            yield ids[a:b]

    def _exact(self, texts: list[str]) -> Iterator[bytes]:
        """Texts without added tokens in which two stretches have the same hash, without any."""
        for t in texts:
            yield b"".join(self._ids_of(self._stretches(t)))

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.count, self.place, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.size, self.first, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        place, size = len(self.pool) + np.cumsum(count) - count, stops - starts
        first = len(self.bytes) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, ids])
        self.bytes = np.concatenate([self.bytes, data[runs(starts, size)]])
        into = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, into, hashes)
        self.count, self.place = np.insert(self.count, into, count), np.insert(self.place, into, place)
        self.size, self.first = np.insert(self.size, into, size), np.insert(self.first, into, first)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.ids_bytes_of([text])), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary file names no decoder: tokens are joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


_made: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """The worker's encoder of this file."""
    if path not in _made:
        _made[path] = WordBPE(path)
    return _made[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ids (binary, little-endian unsigned 32-bit), decoded (string).

    No shuffle; some MB of text at a time in a worker's memory.  Null text and the empty text
    have no ids and decode to the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        spelt = bpe.tokens.__getitem__
        for batch in batches:
            key, first, size, ids, decoded = batch.column(0), 0, 0, [], []
            for i, data in enumerate(bpe.ids_bytes_of(v.as_py() for v in batch.column(1))):
                ids.append(data)
                decoded.append(" ".join(map(spelt, np.frombuffer(data, "<u4").tolist())))
                size += len(data) + len(decoded[-1])
                if size > OUT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([key[first : i + 1], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])
                    first, size, ids, decoded = i + 1, 0, [], []

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
