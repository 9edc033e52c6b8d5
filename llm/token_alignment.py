"""Alignment of two tokenizers by byte-owner arrays (operator 12).

Text is encoded by a byte-level BPE (A: a JSON of the tokenizers library; it is given a
space and the text) and by a sentence-piece model (B, which adds that space itself), both
without special tokens.  Both cover the same bytes.  For each byte the number of its token
is written down once for A and once for B (``np.repeat`` of token numbers by token lengths):

* consecutive distinct pairs of owners are the overlaps of A with B tokens,
* where both owners change at once the texts of both are cut into groups,
* the A and B tokens that end at such a cut are linked.

Many texts are worked off as one long array; as the ends of texts are cuts, no group crosses
texts.

*Stretches.*  No token of A or B goes on across a space that follows something other than
white space, unless it is the text's last character (A's pattern and B's pieces, which are
looked at, have none).  So a text is split there into stretches, the space going to the later one; each distinct
stretch is aligned once and remembered in a table of bounded size, and a text's results are put together
from those of its stretches.  They equal those of the whole text.

*Counts over the corpus.*  A text's links are held as distinct pairs of ids with the times
they occur, so that a very frequent pair is one row a text.  Pairs are summed with partial
sums.  Looking a pair's count up again, the frequent pairs (at most ``FREQUENT``) are
broadcast, and the rare ones, none of which has many rows, are joined by shuffle.  The
highest count of each B id is broadcast too; a vocabulary bounds it.

Texts that are null, empty, or whose joined token bytes of A or B aren't the space and the
text (as where B's normal form changes them) have no tokens: zeros and an empty string.
Repeated rows and rows with equal or null ids count each.  An empty table gives an empty
result.  Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from llm.tables import written

FREQUENT = 1 << 19
#: Bytes of text that a worker aligns at a time (a longer text is taken alone).
BLOCK_BYTES = 1 << 20
#: Characters of stretches that a worker remembers; the table then starts anew (results don't depend on it).
CACHE_CHARS = 1 << 23
#: Bytes of new stretches that are encoded as one text.
BUNDLE_BYTES = 1 << 15
#: A pair of ids as one number.
PAIR = 1 << 32
_LOOSE = re.compile("[\\s\u180e\u200b\ufeff]")
_STRETCH = re.compile("(?<=[^\\s\u180e\u200b\ufeff]) (?=.)", re.DOTALL)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Owned(NamedTuple):
    """Of stretches: numbers of tokens and groups, groups spelt out; pairs of all links; owners of bytes, last
    bytes of overlaps; and where the stretches end in bytes and tokens."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    own_a: np.ndarray
    own_b: np.ndarray
    edge: np.ndarray
    ends: np.ndarray
    upto_a: np.ndarray
    upto_b: np.ndarray


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        # stretches are told apart only where A splits by its usual pattern and no piece of B has a space after something else
        splitter = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        self.splits = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self._forget()
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # ids in decimal, with what follows them in a group, after its A tokens, and after its B tokens
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.spelt = [np.array([f"{i}{sign}" for i in range(most)], object) for sign in ",|;"]

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B; none where the tokens' bytes aren't those of the space and the text."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in plain], add_special_tokens=False)]
        ids_b = self.b.encode(plain, num_threads=1)
        for i, t in enumerate(texts):
            whole = b" " + t
            if not t or b"".join(map(self.bytes_a.__getitem__, ids_a[i])) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b[i])) != whole:
                ids_a[i], ids_b[i] = [], []
        return ids_a, ids_b

    def _owned(self, ids_a: list[list[int]], ids_b: list[list[int]], sizes: np.ndarray) -> Owned:
        """Tokens of consecutive stretches of bytes (sizes; those without tokens have 0), whose ends are ends of tokens of both."""
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        # owners of bytes: numbers of tokens
        own_a = np.repeat(np.arange(len(a)), self.length_a[a])
        own_b = np.repeat(np.arange(len(b)), self.length_b[b])
        last_a, last_b = (np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool) for own in (own_a, own_b))
        cut = np.flatnonzero(last_a & last_b)  # last bytes of groups
        link_a, link_b = own_a[cut], own_b[cut]
        # groups spelt out: all tokens in one array, by group, A before B
        group_a, group_b = (np.searchsorted(link, np.arange(len(x))) for link, x in ((link_a, a), (link_b, b)))
        before_b = np.append(0, link_b + 1)
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + before_b[group_a]] = self.spelt[0][a]
        words[np.arange(len(b)) + link_a[group_b] + 1] = self.spelt[0][b]
        words[link_a + before_b[:-1]] = self.spelt[1][a[link_a]]
        words[link_a + link_b + 1] = self.spelt[2][b[link_b]]
        ends = np.append(0, np.cumsum(sizes))
        upto = np.searchsorted(cut, ends)
        upto_a, upto_b = (np.append(0, link + 1)[upto] for link in (link_a, link_b))
        listed = words.tolist()
        groups = ["".join(listed[i:j])[:-1] for i, j in pairwise((upto_a + upto_b).tolist())]
        return Owned(np.diff(upto_a), np.diff(upto_b), np.diff(upto), groups, a[link_a] * PAIR + b[link_b], own_a, own_b, np.flatnonzero(last_a | last_b), ends, upto_a, upto_b)

    def align(self, texts: list[bytes]) -> list[dict]:
        """Of each text: n_a, n_b, n_groups, groups (spelt), pairs (distinct), times, and overlaps (number of the A token, of the B token, bytes)."""
        ids_a, ids_b = self.encode(texts)
        o = self._owned(ids_a, ids_b, np.array([len(t) + 1 if x else 0 for t, x in zip(texts, ids_a)], np.int64))
        upto, upto_edge = np.append(0, np.cumsum(o.n_groups)), np.searchsorted(o.edge, o.ends)
        out = []
        for i in range(len(texts)):
            e = o.edge[upto_edge[i] : upto_edge[i + 1]]
            overlaps = list(zip((o.own_a[e] - o.upto_a[i]).tolist(), (o.own_b[e] - o.upto_b[i]).tolist(), np.diff(e, prepend=o.ends[i] - 1).tolist()))
            pairs, times = np.unique(o.pairs[upto[i] : upto[i + 1]], return_counts=True)
            out.append({"n_a": int(o.n_a[i]), "n_b": int(o.n_b[i]), "n_groups": int(o.n_groups[i]), "groups": o.groups[i], "pairs": pairs, "times": times, "overlaps": overlaps})
        return out

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 3), np.int64)  # n_a, n_b, n_groups
        self.pairs = np.zeros(0, np.int64)
        self.chars = 0

    def _learn(self, stretches: list[str]) -> None:
        """Aligns new stretches, some thousand bytes as one text: they don't change each other."""
        raw = [s.encode() for s in stretches]
        bundles: list[list[int]] = []
        size = BUNDLE_BYTES
        for i, s in enumerate(stretches):
            if size >= BUNDLE_BYTES or not self.splits:
                bundles.append([])
                size = 0
            bundles[-1].append(i)
            size = BUNDLE_BYTES if _LOOSE.search(s[-1:]) else size + len(raw[i])
        ids_a, ids_b = self.encode([b" ".join([raw[i] for i in x]) for x in bundles])
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        for x, of_a, of_b in zip(bundles, ids_a, ids_b):
            if not of_a:  # one of them isn't kept by A or B: each by itself
                alone_a, alone_b = self.encode([raw[i] for i in x])
                sizes[[i for i, k in zip(x, alone_a) if not k]] = 0
                of_a += chain.from_iterable(alone_a)
                of_b += chain.from_iterable(alone_b)
        o = self._owned(ids_a, ids_b, sizes)
        self.number |= zip(stretches, range(len(self.groups), len(self.groups) + len(stretches)))
        self.groups += o.groups
        self.counts = np.concatenate([self.counts, np.stack([o.n_a, o.n_b, o.n_groups], axis=1)])
        self.pairs = np.concatenate([self.pairs, o.pairs])
        self.chars += sum(map(len, stretches)) + 16 * len(stretches)

    def align_apart(self, texts: list[bytes]) -> list[dict]:
        """As align(), without overlaps, by stretches."""
        parts: list[list[str]] = []
        for t in texts:
            plain = t.decode("utf-8", "replace")
            parts.append((_STRETCH.split(plain) if self.splits else [plain]) if t and ("\ufffd" not in plain or plain.encode() == t) else [])
        if self.chars > CACHE_CHARS:
            self._forget()
        if new := set().union(*parts) - self.number.keys():
            self._learn(list(new))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64)
        upto = np.append(0, np.cumsum([len(x) for x in parts]))
        sums = np.append(np.zeros((1, 3), np.int64), np.cumsum(self.counts[flat], axis=0), axis=0)
        own = sums[upto[1:]] - sums[upto[:-1]]
        lost = np.append(0, np.cumsum(self.counts[flat, 0] == 0))
        lost = lost[upto[1:]] > lost[upto[:-1]]  # texts with a stretch without tokens
        own[lost] = 0
        # links: those of the stretches, counted in each text
        text, n = np.repeat(np.arange(len(texts)), np.diff(upto)), self.counts[flat, 2]
        use = ~lost[text]
        begin = (np.cumsum(self.counts[:, 2]) - self.counts[:, 2])[flat[use]]
        n = n[use]
        place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        distinct, which = np.unique(self.pairs[place], return_inverse=True)
        key, times = np.unique(np.repeat(text[use], n) * len(distinct) + which, return_counts=True)
        pairs = distinct[key % max(1, len(distinct))]
        ends = np.searchsorted(key, np.arange(len(texts) + 1) * len(distinct))
        listed, at, out = flat.tolist(), upto.tolist(), []
        for i, (n_a, n_b, n_groups) in enumerate(own.tolist()):
            groups = ";".join(map(self.groups.__getitem__, listed[at[i] : at[i + 1]])) if n_a else ""
            out.append({"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups": groups, "pairs": pairs[ends[i] : ends[i + 1]], "times": times[ends[i] : ends[i + 1]]})
        return out


_made: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of these files."""
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Aligner(path_a, path_b)
    return _made[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, groups_sha256, pairs (distinct links: A id times 2**32 plus B id) and
    times; with ``whole`` also groups (spelt out) and overlaps.  No shuffle."""
    kind = docs.schema[id_col].dataType
    overlap = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
    if whole:
        types, names = [*types, pa.string(), pa.list_(overlap)], [*names, "groups", "overlaps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            texts, first, size = [], 0, 0
            for i, v in enumerate(batch.column(1)):
                texts.append(v.as_py() or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES or i + 1 == batch.num_rows:
                    done = both.align_apart(texts)
                    columns = [batch.column(0).slice(first, i + 1 - first), *([d[k] for d in done] for k in ("n_a", "n_b", "n_groups"))]
                    columns.append([hashlib.sha256(d["groups"].encode()).hexdigest() if d["groups"] else "" for d in done])
                    columns += [[d["pairs"] for d in done], [d["times"] for d in done]]
                    if whole:
                        columns += [[d["groups"] for d in done], [[{"a": a, "b": b, "bytes": n} for a, b, n in d["overlaps"]] for d in both.align(texts)]]
                    yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(c, t) for c, t in zip(columns[1:], types[1:]))], names)
                    texts, first, size = [], i + 1, 0

    sql = f"id {kind.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
    sql += ", groups string, overlaps array<struct<a:int,b:int,bytes:int>>" if whole else ""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, sql).withColumnRenamed("id", id_col)


def counted(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, with counts over all texts of docs."""
    aligned = align(docs, path_a, path_b, id_col, text_col).withColumnRenamed(id_col, "id").withColumn("row", F.monotonically_increasing_id())
    aligned = written(aligned, "aligned")  # encoded once; and rows keep their numbers
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    counts = written(links.groupBy("pair").agg(F.sum("times").alias("count")), "pairs").withColumn("b", F.col("pair").bitwiseAND(PAIR - 1))
    highest = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("highest")))  # at most B's vocabulary
    counts = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    by_power = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()  # 63 rows at most
    least, held = 63, 0
    for r in sorted(by_power, key=lambda r: -r["power"]):
        held += r["n"]
        if held > frequent:
            break
        least = r["power"]
    counts = counts.withColumn("power", F.floor(F.log2("count")).cast("int"))
    seen = links.join(F.broadcast(counts.where(F.col("power") >= least)), "pair", "left")
    sums = seen.groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"))
    if held > frequent:
        rare = links.join(F.broadcast(counts.where(F.col("power") >= least).select("pair")), "pair", "left_anti").join(counts.where(F.col("power") < least), "pair")
        rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"))
        sums = sums.unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    n_links = F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y)
    out = aligned.select("row", F.col("id").alias(id_col), "n_a", "n_b", "n_groups", n_links.alias("n_links"), "groups_sha256").join(sums, "row", "left")
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
