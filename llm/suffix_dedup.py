"""Exact removal of repeated byte strings by prefix-free parsing (operator 10).

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a
row with a smaller id, or before it in the same text.  Strings don't cross texts, and all
of them are judged on the input.

*Parsing.*  Every window of ``length`` bytes has a trigger: the smallest rolling hash of its
``gram``-byte strings.  The windows of a text that follow each other and have the same
trigger make a phrase; consecutive phrases overlap by length - 1 bytes, so each window lies
in one phrase only, and equal windows, wherever they are, lie in phrases of the same
trigger.  Triggers that occur once in the corpus rule out their windows.

*Dictionary and parse.*  Of the phrases with the same bytes the first in the corpus stands
for all; the windows of the others are repeats.  Where a trigger has several phrases, their
suffixes are sorted by their first ``length`` bytes (prefix doubling), and in each class of
equal ones the parse's positions give the corpus order: all but the first are repeats.

*Skew.*  A trigger whose phrases have over ``HOT`` windows, or ``WIDE`` times as many bytes (a short common line in ever new surroundings),
isn't sorted in one task; its suffixes are brought together by their first ``length`` bytes by Spark's own
sorts and aggregations, over all tasks, with the first position of equal ones found before the shuffle: the same order, the same classes
and the same result.  All other steps are joins and aggregations
with partial sums.  No list is longer than a text.

Null text is the empty text.  Rows with the same id are one document: a string starts earlier in another of them if its start is
smaller, and equal starts don't remove each other, so that repeated rows return the same result each; each row is cut by its own text.
A null id comes before all others.  An empty table gives an empty result.  Columns beside id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from llm.hashing import MIX2, mixed, powers, prefix_sums, segment_hashes
from llm.tables import broadcast_if_small, written

GRAM = 24
HOT, WIDE = 1 << 17, 8
#: What a null id stands for in a place: the number below all ids.
NO_ID = "-9223372036854775809"
#: Bytes that a worker parses or sorts at a time (a longer text is taken alone).
BLOCK_BYTES = 1 << 18


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def parse(texts: list[bytes], length: int, gram: int, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """Phrases of the texts: number of the text, first window, number of windows, trigger, hash of the
    phrase's bytes (if ``hashed``), whether the trigger may occur twice in the phrase (as in text with a short period)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    sums, inverse = prefix_sums(data), powers(len(data))[1]
    grams = mixed((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    trigger = sliding_min(grams, length - gram + 1)
    breaks = np.ones(len(trigger) + 1, bool)
    breaks[1:-1] = trigger[1:] != trigger[:-1]
    breaks[(ends - sizes)[ends - sizes <= len(trigger)]] = True
    last = ends - length + 1  # one past a text's last window
    breaks[np.clip(last, ends - sizes, len(trigger))] = True
    at = np.flatnonzero(breaks)
    first, stop = at[:-1], at[1:]
    text = np.searchsorted(ends, first, side="right")
    whole = stop <= last[np.minimum(text, len(texts) - 1)]
    first, stop, text = first[whole], stop[whole], text[whole]
    phrase = segment_hashes(data, first, stop + length - 1, MIX2) if hashed else np.zeros(0, np.uint64)
    width = length - gram + 1
    most = ~sliding_min(np.concatenate([np.full(width - 1, ~np.uint64(0)), ~trigger, np.full(width - 1, ~np.uint64(0))]), width)
    minimal = grams[np.flatnonzero(most == grams)]  # a gram that is smallest in one of its windows
    twice = np.unique(minimal[1:][minimal[1:] == minimal[:-1]])
    own = trigger[first]
    return text, first - (ends - sizes)[text], stop - first, own, phrase, np.isin(own, twice)


def repeats(phrases: list[bytes], order: np.ndarray, starts: np.ndarray, length: int) -> list[list[int]]:
    """For each phrase of a dictionary the runs [from, to, from, to, ...) of its windows that also start earlier.

    order: rank of the phrase's text among the ids; starts: where the phrase starts there."""
    data = np.frombuffer(b"".join(phrases) + bytes(length), np.uint8)
    sizes = np.array([len(p) for p in phrases], np.int64)
    ends = np.cumsum(sizes)
    n = len(data) - length
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key |= data[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
    rank, size = np.unique(key, return_inverse=True)[1], 8
    while size < length:  # ranks of the suffixes by twice as many bytes
        step = min(size, length - size)
        further = np.zeros(n, np.int64)
        further[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + further, return_inverse=True)[1]
        size += step
    window = np.concatenate([np.arange(a, b) for a, b in zip((ends - sizes).tolist(), (ends - length + 1).tolist())])
    owner = np.repeat(np.arange(len(phrases)), sizes - length + 1)
    rank, at = rank[window], starts[owner] + window - (ends - sizes)[owner]
    by = np.lexsort((at, order[owner], rank))
    later = np.zeros(len(window), bool)
    later[by[1:]] = rank[by[1:]] == rank[by[:-1]]
    edge = np.zeros(len(window) + 1, bool)
    edge[1:-1] = (later[1:] != later[:-1]) | (owner[1:] != owner[:-1])
    edge[[0, -1]] = True
    cuts = np.flatnonzero(edge)
    out: list[list[int]] = [[] for _ in phrases]
    base = np.cumsum(sizes - length + 1) - (sizes - length + 1)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if later[a]:
            o = owner[a]
            out[o] += [a - int(base[o]), b - int(base[o])]
    return out


def uncovered(text: bytes, runs: list[int], length: int, whole_characters: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its removed spans; runs: of windows, as pairs in any order.

    whole_characters: of a UTF-8 character that is covered in part, all bytes stay."""
    spans: list[list[int]] = []
    for a, b in sorted(zip(runs[::2], runs[1::2])):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + length - 1)
        else:
            spans.append([a, b + length - 1])
    if whole_characters:
        for s in spans:
            while s[0] < s[1] and text[s[0]] & 0xC0 == 0x80:
                s[0] += 1
            while s[1] > s[0] and s[1] < len(text) and text[s[1]] & 0xC0 == 0x80:
                s[1] -= 1
        spans = [s for s in spans if s[0] < s[1]]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), [(a, b) for a, b in spans]


def _blocks(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches again, in slices of about BLOCK_BYTES, with the texts' bytes."""
    for batch in batches:
        values, first, size = [], 0, 0
        for i, v in enumerate(batch.column(text).cast(pa.binary())):
            values.append(v.as_py() or b"")
            size += len(values[-1])
            if size >= BLOCK_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first), values
                values, first, size = [], i + 1, 0


def _first(df: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Of the rows of a key the first id and start, and the number of rows; by hash aggregation."""
    return df.groupBy(*keys).agg(F.min(_position()).alias("at"), F.count("*").alias("n"), *more)


def _step() -> Column:
    """Room for a start, and for the hash of a row, in a place."""
    return F.lit(1 << 31).cast("decimal(11,0)")


def _position() -> Column:
    """Place in the corpus (id and start) and, below it, the row's hash, as one number, which a hash aggregation can hold; a null id is below all."""
    number = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)"))
    return ((number * _step() + F.col("start")).cast("decimal(30,0)") * _step() + F.col("row")).cast("decimal(38,0)")


def _later() -> Column:
    """Whether ``own`` is a later place than ``at``, whichever rows they are of."""
    return F.col("own") - F.col("row") > F.col("at") - F.pmod("at", _step())


def deduplicate(docs: DataFrame, length: int = 100, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """id, text (what is left, as binary: a cut may part a character), n_bytes, n_removed, removed (spans of
    bytes), rest (a struct of the other columns).  With ``whole_characters`` no cut parts a character."""
    kind = docs.schema[id_col].dataType
    id_type, id_sql = to_arrow_type(kind), kind.simpleString()
    # a row is known by its id and the hash of its text; what is looked up by them is checked by its bytes
    row = F.xxhash64(text_col).bitwiseAND((1 << 31) - 1).cast("int").alias("row")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _blocks(batches):
            text, start, n, trigger, phrase, twice = parse(values, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice), batch.column(2).take(pa.array(text))], ["trigger", "phrase", "id", "start", "windows", "twice", "row"])

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in _blocks(batches):
            *_, trigger, _, twice = parse(values, length, gram, hashed=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([trigger, trigger[twice]]).view(np.int64))], ["trigger"])

    common = written(texts.mapInArrow(triggers, "trigger long").groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1").select("trigger"), "triggers")
    phrases = texts.mapInArrow(parsed, f"trigger long, phrase long, id {id_sql}, start int, windows int, twice boolean, row int").join(common, "trigger", "left_semi")
    phrases = written(phrases, "phrases")

    dictionary = written(_first(phrases, "trigger", "phrase", more=(F.max("twice").alias("twice"), F.max("windows").alias("windows"))), "first-phrases")
    # written too, so that the join with it is one that Spark may split where a trigger has very many phrases
    several = dictionary.groupBy("trigger").agg(F.count("*").alias("n_phrases"), F.sum("windows").alias("n_windows"), F.max("twice").alias("again")).where("n_phrases > 1 or again")
    several = written(several.select("trigger", ((F.col("n_windows") > HOT) | (F.col("n_windows") + F.col("n_phrases") * (length - 1) > WIDE * HOT)).alias("hot")), "several")
    above = F.floor(F.col("at") / _step()).cast("decimal(32,0)")
    start = F.pmod(above, _step())
    number = ((above - start) / _step()).cast("decimal(20,0)")
    id_again = F.when(number != F.lit(NO_ID).cast("decimal(20,0)"), number).cast(kind)
    firsts = dictionary.join(several, "trigger").select("trigger", "phrase", id_again.alias("id"), F.pmod("at", _step()).cast("int").alias("row"), start.cast("int").alias("start"), "windows", "hot")
    wanted = firsts.groupBy("id", "row").agg(F.collect_list(F.struct("trigger", "phrase", "start", "windows", "hot")).alias("wanted"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _blocks(batches):
            data = b"".join(values)
            sizes = np.array([len(t) for t in values], np.int64)
            asked = [(i, w) for i, ws in enumerate(batch.column(2).to_pylist()) for w in ws]
            own = np.array([i for i, _ in asked], np.int64)
            ends = np.cumsum(sizes)[own]
            starts = np.minimum(ends - sizes[own] + np.array([w["start"] for _, w in asked], np.int64), ends)
            stops = np.minimum(starts + np.array([w["windows"] for _, w in asked], np.int64) + length - 1, ends)
            hashes = segment_hashes(np.frombuffer(data, np.uint8), starts, stops, MIX2).view(np.int64).tolist()
            rows = [(*w.values(), i, data[x:y]) for (i, w), x, y, h in zip(asked, starts.tolist(), stops.tolist(), hashes) if h == w["phrase"]]
            c = [list(x) for x in zip(*rows)] or [[] for _ in range(7)]
            at = pa.array(c[5], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), batch.column(0).take(at), pa.array(c[2], pa.int32()), pa.array(c[4], pa.bool_()), pa.array(c[6], pa.binary()), batch.column(3).take(at)], ["trigger", "phrase", "id", "start", "hot", "bytes", "row"])

    cut = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["row"] == wanted["row"])).select(texts["id"], "text", "wanted", texts["row"])
    cut = written(cut.mapInArrow(cut_out, f"trigger long, phrase long, id {id_sql}, start int, hot boolean, bytes binary, row int"), "dictionary")

    def sorted_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list[tuple]) -> pa.RecordBatch:
            ids = {x: i for i, x in enumerate(sorted({r[2] for r in rows if r[2] is not None}))}
            runs = repeats([r[4] for r in rows], np.array([ids.get(r[2], -1) for r in rows]), np.array([r[3] for r in rows], np.int64), length)
            kept = [(r[0], r[1], x) for r, x in zip(rows, runs) if x]
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["trigger", "phrase", "runs"])

        rows: list[tuple] = []
        size = 0
        for batch in batches:  # sorted by trigger and phrase
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if rows and row[:2] == rows[-1][:2]:
                    continue  # of a repeated row
                if size > BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield result(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield result(rows)

    usual = cut.where("not hot").select("trigger", "phrase", "id", "start", "bytes").repartition("trigger").sortWithinPartitions("trigger", "phrase").mapInArrow(sorted_suffixes, "trigger long, phrase long, runs array<int>")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _blocks(batches, 4):
            data = np.frombuffer(b"".join(values) + bytes(length), np.uint8)
            n = np.array([len(v) - length + 1 for v in values], np.int64)
            owner = np.repeat(np.arange(len(values)), n)
            base = np.cumsum(n + length - 1) - (n + length - 1)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            every = np.lib.stride_tricks.sliding_window_view(data, length)
            for a in range(0, len(owner), 1 << 15):
                own, off = owner[a : a + (1 << 15)], offset[a : a + (1 << 15)]
                flat = pa.py_buffer(np.ascontiguousarray(every[base[own] + off]).tobytes())
                window = pa.Array.from_buffers(pa.binary(length), len(own), [None, flat]).cast(pa.binary())
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([window, batch.column(0).take(at), batch.column(1).take(at), pa.array(off.astype(np.int32)), batch.column(2).take(at), pa.array((np.array(batch.column(3), np.int64)[own] + off).astype(np.int32)), batch.column(6).take(at)], ["bytes", "trigger", "phrase", "window", "id", "start", "row"])

    spread = cut.where("hot").dropDuplicates(["trigger", "phrase"]).select("trigger", "phrase", "id", "start", "bytes", "hot", "row").mapInArrow(suffixes, f"bytes binary, trigger long, phrase long, window int, id {id_sql}, start int, row int")
    classes = spread.groupBy("trigger", "bytes").agg(F.min(_position()).alias("at"), F.count("*").alias("n")).where("n > 1")
    classes = broadcast_if_small(written(classes.drop("n"), "classes"))  # then a class with very many suffixes isn't one task's
    again = spread.withColumn("own", _position()).join(classes, ["trigger", "bytes"]).where(_later())
    hot = again.groupBy("trigger", "phrase").agg(F.flatten(F.collect_list(F.array("window", F.col("window") + 1))).alias("runs"))

    known = dictionary.select("trigger", "phrase", "at").join(usual.unionByName(hot), ["trigger", "phrase"], "left")
    every = phrases.withColumn("own", _position()).join(known, ["trigger", "phrase"])
    runs = F.when(_later(), F.array("start", F.col("start") + F.col("windows"))).otherwise(F.transform("runs", lambda x: x + F.col("start")))
    removed = written(every.select("id", "row", runs.alias("runs")).where("runs is not null").groupBy("id", "row").agg(F.flatten(F.collect_list("runs")).alias("runs")), "removed")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _blocks(batches):
            done = [uncovered(t, r or [], length, whole_characters) for t, r in zip(values, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in done], pa.binary()), pa.array([len(t) for t in values], pa.int64()), pa.array([len(t) - len(k) for t, (k, _) in zip(values, done)], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column(3)], ["id", "text", "n_bytes", "n_removed", "removed", "rest"])

    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] or [F.lit(None).cast("int").alias("none")]
    full = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*others).alias("rest"), row)
    out = full.join(removed, full["id"].eqNullSafe(removed["id"]) & (full["row"] == removed["row"]), "left").select(full["id"], "text", "runs", "rest")
    return out.mapInArrow(cleaned, f"id {id_sql}, text binary, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, rest {full.schema['rest'].dataType.simpleString()}").withColumnRenamed("id", id_col)
