"""Sharding by bytes with Karmarkar-Karp differencing (operator 11).

Rows with equal texts are one indivisible group (null is the empty text): a group goes into
one shard whole, and the shards' bytes are as near to each other as that allows.  A row's
size is the UTF-8 length of its text plus ``overhead``.

*Differencing* (``differencing``).  Each unit starts as a partial partition: its size in one
of k bins, nothing in the others.  The two partial partitions with the largest spread
(largest less smallest bin) are combined, the largest bin of one with the smallest of the
other, until one is left.  Its bins are the shards.

*Units.*  A group with a share of at least 1 / ``LARGE`` of all bytes is a unit by itself: so
there are at most LARGE of them, and a group with more than a shard's share is alone in its
shard while the others level out.  The smaller groups are bundled by their hash, into
``CLASSES`` classes of ``BUNDLES`` bundles, each class with half the bytes of the one before: the fine
bundles fill what the coarse ones leave.  So the driver's list has at most LARGE + CLASSES *
BUNDLES units, however many groups there are, and a shard's bytes are off by about a
2**-22nd of all.  Few groups (a small table) are all units by themselves.

*Slots.*  Rows are numbered from 0 within their shard without bringing a shard to one task:
a row is of one of many blocks, blocks are counted, and a row's slot is the number of rows
in earlier blocks of its shard and its place in its own.

Rows with null id, repeated rows and ties are rows like any others; each gets its own slot.
An empty table gives an empty result; with fewer groups than shards some shards stay empty.
Columns beside id and text don't matter; with ``keep`` they return in the struct ``rest``.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.tables import broadcast_if_small, written

LARGE, CLASSES, BUNDLES = 1 << 13, 13, 512
#: Blocks of rows: this many at least, and one for so many rows.
BLOCKS, BLOCK_ROWS = 512, 1 << 16


def differencing(sizes: list[int], k: int) -> list[int]:
    """The bin of each unit, 0 to k - 1; bins are numbered by falling size."""
    n = len(sizes)
    if not n:
        return []
    # a partial partition: its bins by falling size, less the smallest
    heap = [(-s if k > 1 else 0, i, [s, *[0] * (k - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        z = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=z.__getitem__, reverse=True)
        least = z[order[-1]]
        bins = [z[i] - least for i in order]
        heapq.heappush(heap, (-bins[0], n + len(merges), bins))
        merges.append((a, b, order))
    # from the last partition back: which shard each bin became
    shard_of: list[list[int]] = [[0] * k for _ in range(n + len(merges))]
    shard_of[-1] = list(range(k))
    for t in range(len(merges) - 1, -1, -1):
        a, b, order = merges[t]
        for i, shard in zip(order, shard_of[n + t]):
            shard_of[a][i] = shard_of[b][k - 1 - i] = shard
    return [shard_of[i][0] for i in range(n)]


def _bundle(group: Column) -> Column:
    """Class by trailing zeros of the hash, so that each has half of the one before; then a hash within it."""
    zeros = F.least(F.bit_count(group.bitwiseAND(-group) - 1), F.lit(CLASSES - 1))
    return (zeros * BUNDLES + F.pmod(F.xxhash64(group), F.lit(BUNDLES))).cast("int")


def shard(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, size, text_crc32, shard, slot, and with ``keep`` rest (a struct of those columns)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest")] if keep else []
    size = F.octet_length(text).cast("long") + overhead
    # written, so that a row keeps its place when a task is run again; the text is read this once
    rows = written(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("place"), *rest), "sized")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, n_rows = groups.agg(F.sum("bytes"), F.sum("n")).first()
    total, n_rows = total or 0, n_rows or 0

    is_large = F.col("bytes").cast("decimal(38,0)") * LARGE >= total
    large = [(r["group"], r["bytes"]) for r in groups.where(is_large).select("group", "bytes").collect()]  # at most LARGE
    bundles = [(r["bundle"], r["bytes"]) for r in groups.where(~is_large).groupBy(_bundle(F.col("group")).alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()]
    units = sorted([(-b, 0, key) for key, b in large] + [(-b, 1, key) for key, b in bundles])
    labels = differencing([-u[0] for u in units], shards)
    by_kind = [[(key, s) for (_, kind, key), s in zip(units, labels) if kind == which] for which in (0, 1)]
    of_group = F.broadcast(spark.createDataFrame(by_kind[0], "group long, own int"))
    of_bundle = F.broadcast(spark.createDataFrame(by_kind[1], "bundle int, bundled int"))

    blocks = max(BLOCKS, n_rows // BLOCK_ROWS)
    placed = rows.join(of_group, "group", "left").withColumn("bundle", _bundle(F.col("group"))).join(of_bundle, "bundle", "left")
    placed = placed.withColumn("shard", F.coalesce("own", "bundled")).withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = broadcast_if_small(written(counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("before")), "offsets"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("place")).alias("number")
    numbered = placed.select("id", "size", "text_crc32", "shard", "block", number, *(["rest"] if keep else []))
    out = numbered.join(offsets, ["shard", "block"]).withColumn("slot", (F.col("number") - 1 + F.col("before")).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", *(["rest"] if keep else []))


def spread(sizes: list[int], labels: list[int], k: int) -> int:
    """Largest less smallest bin."""
    sums = np.bincount(labels, weights=sizes, minlength=k) if sizes else np.zeros(k)
    return int(sums.max() - sums.min())
