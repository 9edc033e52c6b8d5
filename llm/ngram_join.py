"""Exact Jaccard self-join on word n-grams with adaptive multi-match prefixes (operator 8).

Two documents link when percent% or more of the union of their shingle sets is shared.

*Classes.*  Documents with equal sets are one class, found by a 128-bit hash of the set; everything
below is between classes, so copies never become pairs.  Half of the hash names a class; a half that two sets
share is found by the other half, and then that names them.

*Order.*  Prefixes need one order of all shingles, rare ones first.  Blocks of documents count
their shingles and hand on those that they hold twice or more: by the pigeonhole principle no
shingle in more documents than there are blocks is missed.  The ``FREQUENT`` most common ones,
a table of bounded size, come last by count, all others first by hash.  The order only decides
the amount of work, never the result.

*Prefixes.*  A set of n shingles shares at least ceil(n * percent / 100) of them with any
partner, so its first n - ceil(...) + l shingles share at least l with the partner's.  Each
class takes the l of 1 to ``MATCHES`` that has the least estimated cost: the postings that the
longer prefix meets, plus the verification of the candidates that are then left (each
further match asked for is taken to leave one in ``DECAY``).  A pair is
a candidate if it shares min(l, l') prefix shingles or more.

*Frequent prefix shingles.*  A shingle that over ``BUCKET`` classes have in their prefixes makes no
pairs.  Let r be what a set has left from it on, in the order: a pair of which it is the first shared shingle shares min(r, r')
at most, and so can only link if each set's size is in the range of sizes that the other's r allows.
Sizes are rounded to bands; the classes of two bands that allow each other are tied to one of them, all
others aren't: texts that share a passage and differ in rarer words
never meet.  A pair's frequent shingles may then be missing from its count, so that as many fewer are asked for.

*Verification.*  Components of candidates and ties are groups; one of more than ``BLOCK`` classes may be a chain
of pairs that don't link, so it is taken apart into what its ties alone hold together, and its pairs that the search
leaves in two parts are then verified one by one.  In a group,
the set of a class is read once, and breadth-first search over an inverted
list finds the links: each class found is taken out of the lists, so near copies by the
thousand cost about as much as their text.  A group of more than ``BLOCK`` classes is dealt into
blocks; then the best connected classes of the parts found are held together; and what
isn't in the group's largest part is held against all its blocks.  No link is lost.

Null text and text without words: an empty set, linked with nothing.  Fewer words than n:
the whole sequence is the one shingle.  Each row is a document of its own: rows with the same id or none each get a result row, by
their own text; the smallest id passes over nulls, and is null only if there is no other.  An empty table gives an empty result; other
columns don't matter.  Shingle identity is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.components import components
from llm.hashing import MIX2, mixed, segment_hashes
from llm.tables import broadcast_if_small, written

FREQUENT, COUNT_BLOCK, MATCHES, BUCKET, BLOCK, REPRESENTATIVES = 1 << 21, 1 << 22, 4, 64, 256, 4
#: Cost of reading a posting and of verifying a candidate, for each shingle of the set.
POSTING_COST, VERIFY_COST = 1.0, 0.05
#: Characters of text that a worker hashes at a time; arrays of a word or more for each make up most of its memory.
TEXT_BLOCK = 1 << 18
#: What another prefix shingle asked for leaves of the candidates, and what a shingle that isn't frequent is taken to meet.
DECAY, RARE = 8.0, 0.25
C2, C3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words of the block are hashed at once, from their bytes."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = LOWER[np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)]
    space = SPACES[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = segment_hashes(data, starts, stops)
    rolled = np.zeros(0, np.uint64)
    if len(words) >= n:
        rolled = words[: len(words) - n + 1].copy()
        for i in range(1, n):
            rolled = mixed(rolled * C2 + words[i : len(words) - n + 1 + i], MIX2)
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])).tolist()
    out = []
    for a, b in zip([0, *ends[:-1]], ends):
        if b - a >= n:
            own = np.sort(rolled[a : b - n + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif b > a:
            whole = words[a : a + 1] + np.uint64(b - a)
            for i in range(a + 1, b):
                whole = mixed(whole * C3 + words[i : i + 1])
            out.append(mixed(whole))
        else:
            out.append(words[:0])
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit hashes of each set."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        out[i] = mixed(s ^ C3).sum(dtype=np.uint64), mixed(s + C2, MIX2).sum(dtype=np.uint64)
    out[:, 0] += np.array([len(s) for s in sets], np.uint64) * C2
    out[:, 0], out[:, 1] = mixed(out[:, 0].copy()), mixed(out[:, 1] ^ C3)
    return out.view(np.int64)


def named(sets: list[np.ndarray], shared: frozenset[int], bits: int) -> np.ndarray:
    """The name of each set's class: half of its hash (``bits`` of it: fewer in tests), or the other half where that is shared."""
    keys = set_keys(sets)
    first = keys[:, 0] >> np.int64(64 - bits)
    return np.where(np.isin(first, np.array(sorted(shared), np.int64)), keys[:, 1], first) if shared else first


def several(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two or more of the sets have, and how many; empties the list and sorts in place, as these are most of a worker's memory."""
    every = np.concatenate(sets)
    sets.clear()
    every.sort()
    same = every[1:] == every[:-1]
    begins, ends = same.copy(), same.copy()
    begins[1:] &= ~same[:-1]
    ends[:-1] &= ~same[1:]
    first = np.flatnonzero(begins)
    return every[first], np.flatnonzero(ends) - first + 2


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        values, first, size = [], 0, 0
        for i, v in enumerate(batch.column(text)):
            values.append(v.as_py())
            size += len(values[-1] or "")
            if size >= TEXT_BLOCK or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first), values
                values, first, size = [], i + 1, 0


def needed(n: np.ndarray | int, percent: int):
    """Least number of shared shingles of a set of n with any partner."""
    return -(-n * percent // 100)


class Order:
    """The order of shingles: those that aren't frequent first, by hash, then the frequent ones by count."""

    def __init__(self, common: np.ndarray, counts: np.ndarray):
        self.common, self.counts = common, counts
        self.maybe = np.zeros(1 << 24, bool)  # by upper bits, so that most look-ups end here
        self.maybe[(common >> np.uint64(40)).astype(np.int64)] = True

    def count(self, s: np.ndarray) -> np.ndarray:
        """How often a frequent shingle was counted, 0 for the others."""
        out = np.zeros(len(s), np.int64)
        look = np.flatnonzero(self.maybe[(s >> np.uint64(40)).astype(np.int64)])
        at = np.searchsorted(self.common, s[look])
        at[at == len(self.common)] = 0
        hit = self.common[at] == s[look] if len(self.common) else np.zeros(len(look), bool)
        out[look[hit]] = self.counts[at[hit]]
        return out

    def prefix(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """The prefix of a set in its order, and the number of matches that it asks for."""
        n = len(s)
        count = self.count(s)
        length = n - int(needed(n, percent)) + 1
        most = min(n, length + MATCHES - 1)
        rare = np.flatnonzero(count == 0)
        by = rare[:most]
        if len(rare) < most:
            rest = np.flatnonzero(count)
            by = np.concatenate([rare, rest[np.lexsort((s[rest], count[rest]))[: most - len(rare)]]])
        postings = np.cumsum(np.maximum(count[by] - 1.0, RARE))
        costs = [(POSTING_COST + VERIFY_COST * n / DECAY ** (l - 1)) * postings[length + l - 2] for l in range(1, most - length + 2)]
        l = int(np.argmin(costs)) + 1
        return s[by[: length + l - 1]], l


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def band(n: Column) -> Column:
    """Of a size: exact up to 40, then of a width of 2 percent."""
    return F.when(n <= 40, n).otherwise(40 + F.floor(F.log(n / 40.0) / float(np.log(1.02)))).cast("int")


def ties(hot: DataFrame, percent: int) -> DataFrame:
    """hot: shingle, key, n, place (in the prefix).  Links (a, b) that hold together all classes that may link with the shingle as the first they share.

    Sets of n and m shingles link if they share (n + m) * percent / (100 + percent) or more; left from the shingle on are r = n - place."""
    share = percent / (100.0 + percent)
    n, r = F.col("n"), F.col("n") - F.col("place")
    low = F.greatest(F.lit(1), F.floor(n * (percent / 100.0) - 1e-6).cast("int"))
    high = F.floor(r / share - n + 1e-6).cast("int")
    reach = hot.withColumn("own", band(n)).withColumn("other", F.explode(F.when(high >= low, F.sequence(band(low), band(high))).otherwise(F.array().cast("array<int>"))))
    sides = reach.select("shingle", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).alias("side"))
    lots = ["shingle", "x", "y"]
    both = sides.groupBy(*lots).agg(F.min("key").alias("hub"), F.max("key").alias("last"), F.min("side").alias("first_side"), F.max("side").alias("last_side"))
    both = both.where((F.col("hub") < F.col("last")) & ((F.col("x") == F.col("y")) | (F.col("first_side") < F.col("last_side")))).select(*lots, "hub")
    both = broadcast_if_small(written(both, "lots"))  # a lot with very many classes then isn't one task's
    return sides.join(both, lots).where(F.col("key") != F.col("hub")).select(F.col("key").alias("a"), F.col("hub").alias("b"))


def linked_parts(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first search among sets: the part of each (number of one of its members), links that were found of each."""
    m = len(sets)
    part, degree = np.full(m, -1, np.int64), np.zeros(m, np.int64)
    n = np.array([len(s) for s in sets], np.int64)
    shingles, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    begin = np.cumsum(n) - n

    def lists(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = left[owner]
        by = np.argsort(flat[keep], kind="stable")
        return np.searchsorted(flat[keep][by], np.arange(len(shingles) + 1)), owner[keep][by]

    left = np.ones(m, bool)
    at, docs = lists(left)
    held = m
    for first in range(m):
        if not left[first]:
            continue
        left[first] = False
        part[first] = first
        queue = [first]
        while queue:
            x = queue.pop()
            own = flat[begin[x] : begin[x] + n[x]]
            a, size = at[own], at[own + 1] - at[own]
            total = int(size.sum())
            if not total:
                continue
            place = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(total)
            shared = np.bincount(docs[place], minlength=m)
            found = np.flatnonzero(left & (100 * shared >= percent * (n[x] + n - shared)))
            if len(found):
                left[found] = False
                part[found] = first
                degree[x] += len(found)
                degree[found] += 1
                queue += found.tolist()
                if 2 * left.sum() < held:
                    held = int(left.sum())
                    at, docs = lists(left)
    return part, degree


def cross_links(few: list[tuple], many: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links (label, label) between rows (key, label, set) of different labels, one for each pair of labels."""
    sets = [r[2] for r in many]
    shingles, flat = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(s) for s in sets], np.int64)
    by = np.argsort(flat, kind="stable")
    docs, at = np.repeat(np.arange(len(sets)), n)[by], np.searchsorted(flat[by], np.arange(len(shingles) + 1))
    labels = np.array([r[1] for r in many], np.int64)
    out = set()
    for _, label, s in few:
        own = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
        own = own[shingles[own] == s]
        size = at[own + 1] - at[own]
        place = np.repeat(at[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        shared = np.bincount(docs[place], minlength=len(sets))
        hit = (labels != label) & (100 * shared >= percent * (len(s) + n - shared))
        out |= {(label, int(x)) for x in np.unique(labels[hit])}
    return sorted(out)


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, detail: bool = False) -> DataFrame:
    """id, n_shingles, component_id: the smallest id that the document reaches by links.

    With ``detail`` also row, ``row_hash`` of the document, and component, a number that the documents of one component share and
    no others (ids may be null or occur twice)."""
    spark = docs.sparkSession
    id_sql = docs.schema[id_col].dataType.simpleString()
    # a row is known by the hash of id and text; what is looked up by it is checked by the set's key
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", row_hash("id", "text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _blocks(batches, 1):
            sets = shingle_sets(values, n)
            keys = set_keys(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys[:, 0] >> np.int64(64 - key_bits)), pa.array(keys[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64())], ["id", "row", "key", "other", "n_shingles"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
            shingle, count = several(held)
            return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(count)], ["shingle", "n"])

        held: list[np.ndarray] = []
        size = 0
        for _, values in _blocks(batches, 0):
            held += shingle_sets(values, n)
            size += sum(map(len, held[-len(values) :]))
            if size >= COUNT_BLOCK:
                yield batch_of(held)
                size = 0
        if held:
            yield batch_of(held)

    hashed = written(texts.mapInArrow(keyed, f"id {id_sql}, row long, key long, other long, n_shingles long"), "set-keys")
    # of m sets about m * m / 2**65 share half of the hash: none up to a billion, some hundreds of a hundred billion
    twice = hashed.groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a < b").select("key")
    common_keys = frozenset(r["key"] for r in twice.collect())
    keys = hashed.withColumn("key", F.when(F.col("key").isin(*common_keys), F.col("other")).otherwise(F.col("key"))) if common_keys else hashed
    keys = keys.drop("other")
    totals = written(texts.select("text").mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "shingle-counts")
    least, held = 2, 0
    for row in totals.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("shingles")).orderBy(F.desc("n")).collect():
        if held + row["shingles"] > FREQUENT:
            least = row["n"] + 1
            break
        held += row["shingles"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(0), np.int64).tobytes()]), pa.array([np.asarray(batch.column(1), np.int64).tobytes()])], ["shingles", "counts"])

    rows = totals.where(F.col("n") >= least).select("shingle", "n").mapInArrow(packed, "shingles binary, counts binary").collect()  # FREQUENT shingles at most
    common = np.frombuffer(b"".join(r["shingles"] for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    order = np.argsort(common)
    frequent = spark.sparkContext.broadcast((common[order], np.minimum(counts[order], 1 << 30).astype(np.int32)))
    del rows, common, counts, order

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Order(*frequent.value)
        for _, values in _blocks(batches, 0):
            sets = [s for s in shingle_sets(values, n) if len(s)]
            chosen = [known.prefix(s, percent) for s in sets]
            size = [len(p) for p, _ in chosen]
            columns = [np.concatenate([p for p, _ in chosen] or [np.zeros(0, np.uint64)]).view(np.int64), np.repeat(named(sets, common_keys, key_bits), size), np.repeat(np.array([len(s) for s in sets], np.int32), size), np.repeat(np.array([l for _, l in chosen], np.int32), size), np.concatenate([np.arange(k, dtype=np.int32) for k in size] or [np.zeros(0, np.int32)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "key", "n", "l", "place"])

    postings = texts.select("text").mapInArrow(prefixes, "shingle long, key long, n int, l int, place int")
    buckets = postings.groupBy("shingle").agg(F.count("*").alias("size"), F.min("key").alias("hub"), F.max("key").alias("other")).where("hub < other").select("shingle", "size")
    shared = written(postings.join(buckets, "shingle").distinct(), "postings")
    hot = shared.where(F.col("size") > BUCKET)
    # a shingle that few rows have makes pairs; the others of a class that a pair may share stay out of its count
    hidden = broadcast_if_small(written(hot.groupBy("key").agg(F.count("*").cast("int").alias("hidden")), "hidden"))
    few = shared.where(F.col("size") <= BUCKET).join(hidden, "key", "left").select("shingle", "key", "n", "l", F.coalesce("hidden", F.lit(0)).alias("hidden"))
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.key") < F.col("b.key")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")))
    asked = F.least("a.l", "b.l") - F.least("a.hidden", "b.hidden")
    pairs = pairs.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), asked.alias("l")).groupBy("a", "b").agg(F.count("*").alias("matches"), F.min("l").alias("l")).where("matches >= l")
    pairs, tied = written(pairs.select("a", "b"), "pairs"), written(ties(hot, percent).distinct(), "ties")
    groups = components(pairs.unionByName(tied), "candidates").withColumnRenamed("root", "grp")

    # only large groups have blocks; their sizes are few rows, so that no group's classes are brought together to learn them
    sizes = groups.groupBy("grp").agg(F.count("*").alias("classes")).where(F.col("classes") > BLOCK)
    sizes = broadcast_if_small(written(sizes, "large-groups"))
    # large groups are held together by their ties alone; their pairs are verified one by one
    groups = groups.join(sizes, "grp", "left")
    in_large = groups.where("classes is not null").select("node")
    cores = components(tied.join(in_large, F.col("a") == F.col("node"), "left_semi"), "cores").withColumnRenamed("root", "core")
    groups = groups.join(cores, "node", "left").select("node", F.when(F.col("classes").isNull(), F.col("grp")).otherwise(F.coalesce("core", "node")).alias("grp"), F.col("classes").isNotNull().alias("large"))
    sizes = groups.where("large").groupBy("grp").agg(F.count("*").alias("classes")).where(F.col("classes") > BLOCK)
    sizes = broadcast_if_small(written(sizes, "large-cores"))
    first_of = keys.groupBy("key").agg(F.min("row").alias("row"), F.min("id").alias("id"))
    blocks = F.coalesce(F.ceil(F.col("classes") / BLOCK), F.lit(1))
    members = groups.join(sizes, "grp", "left").join(first_of, F.col("node") == F.col("key")).select("row", "key", "grp", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), "large")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # of repeated rows a task sends one
        for batch, values in _blocks(batches, 0):
            sets = shingle_sets(values, n)
            keep = []
            for i, (own, key) in enumerate(zip(named(sets, common_keys, key_bits).tolist(), batch.column(1).to_pylist())):
                if own == key and key not in sent:
                    sent.add(key)
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (1, 2, 3, 4)] + [pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["key", "grp", "block", "large", "shingles"])

    held = texts.join(members, "row").select("text", "key", "grp", "block", "large").mapInArrow(sets_of, "key long, grp long, block int, large boolean, shingles binary")

    def groupwise(work, out_names):
        """Runs ``work`` on the rows of each (grp, block), which stand together."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[dict] = []
            done: list[tuple] = []
            for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
                for row in batch.to_pylist():
                    if rows and (row["grp"], row["block"]) != (rows[-1]["grp"], rows[-1]["block"]):
                        done += work(rows)
                        rows = []
                    rows.append(row)
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), out_names.values())], list(out_names))
                    done = []
            if rows and (done := work(rows)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), out_names.values())], list(out_names))

        return run

    def own_sets(rows: list[dict]) -> list[np.ndarray]:
        return [np.frombuffer(r["shingles"], np.uint64) for r in rows]

    def search(rows: list[dict]) -> list[tuple]:
        rows = [r for i, r in enumerate(rows) if not i or r["key"] != rows[i - 1]["key"]]  # a repeated row
        if len(rows) == 1 and not rows[0]["large"]:
            return []
        part, degree = linked_parts(own_sets(rows), percent)
        size = np.bincount(part, minlength=len(rows))
        label = {}
        for r, p in zip(rows, part.tolist()):
            label[p] = min(label.get(p, r["key"]), r["key"])
        rank = np.empty(len(rows), np.int64)
        by = np.lexsort((-degree, part))
        rank[by] = np.arange(len(rows)) - np.searchsorted(part[by], part[by])
        return [(r["key"], label[p], r["grp"], r["block"], r["large"], bool(size[p] > 1 and k < REPRESENTATIVES), r["shingles"] if r["large"] else None) for r, p, k in zip(rows, part.tolist(), rank.tolist())]

    arrow = {"key": pa.int64(), "label": pa.int64(), "grp": pa.int64(), "block": pa.int32(), "large": pa.bool_(), "leads": pa.bool_(), "shingles": pa.binary()}
    dealt = held.repartition("grp", "block").sortWithinPartitions("grp", "block", "key")
    parts = written(dealt.mapInArrow(groupwise(search, arrow), "key long, label long, grp long, block int, large boolean, leads boolean, shingles binary"), "parts")
    large = parts.where("large").drop("large")

    # the parts of a large group: first those that a few well connected classes join
    def join_leads(rows: list[dict]) -> list[tuple]:
        part, _ = linked_parts(own_sets(rows), percent)
        return [(r["label"], rows[p]["label"]) for r, p in zip(rows, part.tolist()) if r["label"] != rows[p]["label"]]

    two = {"a": pa.int64(), "b": pa.int64()}
    lots = large.where("leads").withColumn("block", F.pmod(F.xxhash64("label"), F.lit(1 << 20)).cast("int"))
    lots = lots.join(lots.groupBy("grp").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("n_lots")), "grp").withColumn("block", F.pmod("block", "n_lots"))
    joined = broadcast_if_small(components(lots.repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(groupwise(join_leads, two), "a long, b long"), "leads"))
    told = large.join(joined, large["label"] == joined["node"], "left").select("key", F.coalesce("root", "label").alias("label"), "grp", "block", "shingles")
    told = written(told, "named")
    # then what isn't in a group's largest part, against all its blocks
    parts_of = told.groupBy("grp", "label").agg(F.count("*").alias("n"))
    largest = parts_of.groupBy("grp").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("parts"), F.sum("n").alias("classes")).where("parts > 1")
    open_groups = told.join(largest, "grp")
    n_blocks = F.ceil(F.col("classes") / BLOCK).cast("int")
    minor = open_groups.where("label <> main")
    minor_blocks = minor.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_minor"))
    minor = minor.join(minor_blocks, "grp").withColumn("m", F.pmod(F.xxhash64("key", F.lit(1)), F.col("n_minor")).cast("int"))
    minor = minor.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_blocks - 1))).select("grp", "m", "chunk", F.lit(0).alias("side"), "key", "label", "shingles")
    major = open_groups.join(minor_blocks, "grp").withColumn("m", F.explode(F.sequence(F.lit(0), F.col("n_minor") - 1))).select("grp", "m", F.col("block").alias("chunk"), F.lit(1).alias("side"), "key", "label", "shingles")

    def against(rows: list[dict]) -> list[tuple]:
        sides: tuple[list, list] = ([], [])
        for r in rows:
            sides[r["side"]].append((r["key"], r["label"], np.frombuffer(r["shingles"], np.uint64)))
        return cross_links(*sides, percent) if all(sides) else []

    facing = minor.unionByName(major).withColumn("block", F.xxhash64("m", "chunk")).repartition("grp", "block").sortWithinPartitions("grp", "block")
    last = broadcast_if_small(components(facing.mapInArrow(groupwise(against, two), "a long, b long"), "parts"))
    told = told.join(last, told["label"] == last["node"], "left").select("key", F.coalesce("root", "label").alias("label"), "shingles")

    # the pairs of large groups whose classes aren't in one part yet, one by one
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (list(map(lambda v: np.frombuffer(v.as_py(), np.uint64), batch.column(c))) for c in (2, 3))
            shared = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)]
            links = [100 * c >= percent * (len(s) + len(t) - c) for c, s, t in zip(shared, x, y)]
            yield batch.select([0, 1]).filter(pa.array(links, pa.bool_()))

    labels = told.select("key", "label")
    apart = pairs.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b").where("label_a <> label_b")
    apart = apart.join(told.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(told.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    linked = components(apart.select("label_a", "label_b", "x", "y").mapInArrow(verified, "label_a long, label_b long").toDF("a", "b"), "pairwise")
    labels = labels.join(broadcast_if_small(linked), labels["label"] == linked["node"], "left").select("key", F.coalesce("root", "label").alias("label"))
    final = parts.where("not large").select("key", "label").unionByName(labels)

    # smallest id of each component, by class
    rooted = first_of.drop("row").join(final, "key", "left").select("key", F.coalesce("label", "key").alias("label"), "id")
    smallest = rooted.groupBy("label").agg(F.min("id").alias("component"))
    by_class = rooted.join(smallest, "label").select("key", "component", "label")
    out = keys.select("id", "row", "key", "n_shingles").join(by_class, "key", "left")
    more = [F.col("row"), F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("row")).alias("component")] if detail else []
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"), *more)
