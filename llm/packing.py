"""Order-preserving packing of documents into sequences (operator 1).

Documents keep the order of their rows within an input partition (sort or range-partition
the input first for another order).  A partition is read as one long run of tokens, each
document ending in ``end_id``, and is cut into windows of at most ``length`` tokens by
dynamic programming over the places where a cut is allowed: ends of documents (free), ends
of sentences (``sentence_penalty``) and, where those are too far apart, any place
(``cut_penalty``).  With c the places in order and f the least cost up to a place,

    f[i] = penalty[i] + min over j with c[i] - c[j] <= length of f[j] + padding(c[i] - c[j])

where padding(n) is length - n, or 0 at a power of two, which needs no padding.  The first
kind of transition is the minimum of f[j] + c[j] over a sliding window, held in a monotone
queue; the second looks at one place for each power of two.  So a place costs O(log length).

A partition is worked off in blocks: the last windows of a block wait for the next one, so
only the end of a partition can be padded for want of documents.  There is no shuffle, and
a lost partition is made again from its input alone, with the same ids.

Null text is the empty text (a document of ``end_id`` only); repeated rows are packed each;
other columns of the input don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bpe import encoder

#: Tokens after which a block is cut.
BLOCK_TOKENS = 1 << 19


def cut(places: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Ends of the windows that cost least.  places: ascending, at most ``length`` apart, the last is the end; a window starts at 0."""
    n = len(places)
    if not n:
        return []
    c = [0, *places.tolist()]
    pen = [0, *penalties.tolist()]
    exact: dict[int, list[int]] = {}
    whole = np.concatenate([[0], places])
    size = 1
    while size <= length:
        at = np.searchsorted(whole, whole - size)
        hit = np.flatnonzero((whole[at] == whole - size) & (whole >= size))
        for i, j in zip(hit.tolist(), at[hit].tolist()):
            exact.setdefault(i, []).append(j)
        size *= 2
    f, back = [0] * (n + 1), [0] * (n + 1)
    queue: list[int] = [0] * (n + 1)  # of j, f[j] + c[j] ascending, from head to tail
    worth: list[int] = [0] * (n + 1)
    head = tail = 0
    for i in range(1, n + 1):
        here = c[i]
        low = here - length
        while c[queue[head]] < low:
            head += 1
        j = queue[head]
        best = worth[head] - low
        if i in exact:
            for e in exact[i]:
                if f[e] < best:
                    best, j = f[e], e
        f[i] = best = best + pen[i]
        back[i] = j
        best += here
        while tail >= head and worth[tail] >= best:
            tail -= 1
        tail += 1
        worth[tail] = best
        queue[tail] = i
    ends, i = [], n
    while i:
        ends.append(c[i])
        i = back[i]
    return ends[::-1]


def allowed(ids: np.ndarray, doc_ends: np.ndarray, sentence_ids: np.ndarray, length: int, sentence_penalty: int, cut_penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut is allowed in a run of tokens, and their penalties."""
    is_end = np.zeros(len(ids) + 1, bool)
    is_end[doc_ends] = True
    after = np.zeros(len(ids) + 1, bool)  # after a sentence, but not just before a document's end_id
    after[1:-1] = sentence_ids[ids[:-1]] & ~is_end[2:]
    places = np.flatnonzero(after | is_end)
    gaps = np.diff(places, prepend=0)
    wide = np.flatnonzero(gaps > length // 4)
    if len(wide):
        more = [np.arange(e - g + length // 8, e, length // 8) for e, g in zip(places[wide].tolist(), gaps[wide].tolist())]
        places = np.sort(np.concatenate([places, *more]))
    penalties = np.where(after[places], sentence_penalty, cut_penalty)
    penalties[is_end[places]] = 0
    return places, penalties


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, sentence_penalty: int = 4, cut_penalty: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: id, start and length within the document's ids, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset within the sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        sentence_ids = np.zeros(1 << 16, bool)
        sentence_ids[[i for t, i in ((t, i) for i, t in bpe.tokens.items()) if t.endswith("</w>") and t[:-4].strip(")\"'") and t[:-4].strip(")\"'")[-1] in ".!?"]] = True
        next_sequence = TaskContext.get().partitionId() << 32
        waiting: list[list] = []  # id, bytes of ids, tokens of it that are out already
        size = 0

        def pieces(last: bool) -> pa.RecordBatch:
            nonlocal waiting, size, next_sequence
            rest = [np.frombuffer(d, "<u4")[s:] for _, d, s in waiting]
            ids = np.concatenate(rest)
            doc_ends = np.cumsum([len(r) for r in rest])
            ends = cut(*allowed(ids, doc_ends, sentence_ids, length, sentence_penalty, cut_penalty), length)
            if not last:
                ends = [e for e in ends if e <= size - 8 * length] or ends[:1]
            out: list[list] = [[] for _ in range(7)]
            k, at = 0, 0  # document, place
            for e in ends:
                offset = 0
                while at < e:
                    doc, data, start = waiting[k]
                    n = min(e, int(doc_ends[k])) - at
                    for column, x in zip(out, (doc, start, n, data[4 * start : 4 * (start + n)], len(data) // 4, next_sequence, offset)):
                        column.append(x)
                    at, offset = at + n, offset + n
                    waiting[k][2] += n
                    k += at == doc_ends[k]
                next_sequence += 1
            waiting, size = waiting[k:], size - at
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

        types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            keys = batch.column(0)
            for i, data in enumerate(bpe.ids_bytes_of(v.as_py() for v in batch.column(1))):
                waiting.append([keys[i].as_py(), data + end, 0])
                size += len(data) // 4 + 1
                if size >= BLOCK_TOKENS:
                    yield pieces(False)
        while waiting:
            yield pieces(True)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
