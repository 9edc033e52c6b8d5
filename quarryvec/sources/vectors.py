"""Vector files as a data source, and their writers.

Formats: ``fvecs`` and ``ivecs`` (each row: uint32 length, then elements), ``fbin`` and ``ibin``
(int32 rows, int32 length, then all elements) and ``raw`` (elements only; option ``dim``).
All little-endian.  Rows are of one length, so a file is read in ranges of rows.  A path is a file or a folder of part
files, whose rows follow each other in the order of their names; both may be on any store that pyarrow's file systems
reach by its address (a local path, file, hdfs, s3, gs), by the driver and by tasks alike.

    spark.dataSource.register(VectorFiles)
    spark.read.format("vectors").option("kind", "fvecs").load("/data/base.fvecs")
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"float32": ("<f4", "float", pa.float32()), "int32": ("<i4", "int", pa.int32()), "uint32": ("<u4", "long", pa.int64())}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path  # as Hadoop writes it
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Rows(InputPartition):
    """Rows first to stop of a file, whose first row has the number ``before``."""

    def __init__(self, path: str, before: int, first: int, stop: int):
        super().__init__((path, first, stop))
        self.path, self.before, self.first, self.stop = path, before, first, stop


class VectorFiles(DataSource):
    """Options: path, kind, dtype (float32, int32 or uint32; by kind), dim (raw), start and count (rows), rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return f"id long, embedding array<{KINDS[_dtype(self.options)][1]}>"

    def reader(self, schema) -> "VectorReader":
        return VectorReader(dict(self.options))


def _dtype(options) -> str:
    return options.get("dtype") or ("uint32" if options.get("kind", "fvecs") in ("ivecs", "ibin") else "float32")


class VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.dtype = options["path"], options.get("kind", "fvecs"), _dtype(options)
        self.own_length = self.kind in ("fvecs", "ivecs")
        store, at = _store(self.path)
        info = store.get_file_info(at)
        files = [info] if info.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.base_name)
        start = int(options.get("start", 0))
        stop = start + int(options["count"]) if "count" in options else None
        chunk = int(options.get("rows_per_task", 1 << 18))
        self.parts, before, self.dim = [], 0, int(options.get("dim", 0))
        for f in files:
            n = self._rows(store, f)
            first, end = max(0, start - before), n if stop is None else min(n, stop - before)
            self.parts += [Rows(f.path, before, a, min(end, a + chunk)) for a in range(first, end, chunk)]
            before += n

    def _rows(self, store: fs.FileSystem, f: fs.FileInfo) -> int:
        with store.open_input_file(f.path) as file:
            head = file.read(8)
        self.offset = 0
        if self.own_length:
            self.dim = struct.unpack("<I", head[:4])[0] if f.size else self.dim
            self.stride = 4 * (self.dim + 1)
        else:
            if self.kind in ("fbin", "ibin"):
                _, self.dim = struct.unpack("<ii", head)
                self.offset = 8
            self.stride = 4 * self.dim
        return (f.size - self.offset) // self.stride

    def partitions(self) -> list[Rows]:
        return self.parts or [Rows("", 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.first >= part.stop:
            return
        dtype, _, kind = KINDS[self.dtype]
        with _store(self.path)[0].open_input_file(part.path) as f:
            for a in range(part.first, part.stop, 8192):
                n = min(8192, part.stop - a)
                flat = np.frombuffer(f.read_at(n * self.stride, self.offset + a * self.stride), dtype).reshape(n, -1)
                flat = flat[:, 1:] if self.own_length else flat
                values = pa.array(np.ascontiguousarray(flat).reshape(-1).astype(kind.to_pandas_dtype()), kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.before + a, part.before + a + n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.dim), values)], ["id", "embedding"])


def read_vectors(spark, path: str, kind: str = "fvecs", **options) -> DataFrame:
    spark.dataSource.register(VectorFiles)
    return spark.read.format("vectors").option("kind", kind).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_vectors(df: DataFrame, path: str, kind: str = "fvecs", column: str = "embedding", order: str = "id") -> int:
    """Writes the rows in order to one file on the driver's machine, row by row; returns their number."""
    dtype = "<u4" if kind in ("ivecs", "ibin") else "<f4"
    n = dim = 0
    with open(path, "wb") as f:
        if kind in ("fbin", "ibin"):
            f.write(struct.pack("<ii", 0, 0))
        for row in df.select(order, column).orderBy(order).toLocalIterator():
            v = np.asarray(row[1]).astype(dtype)
            f.write((struct.pack("<I", len(v)) if kind in ("fvecs", "ivecs") else b"") + v.tobytes())
            n, dim = n + 1, len(v)
        if kind in ("fbin", "ibin"):
            f.seek(0)
            f.write(struct.pack("<ii", n, dim))
    return n


def write_parts(df: DataFrame, path: str, kind: str = "fvecs", column: str = "embedding", order: str = "id") -> int:
    """Writes the rows in order as a folder of part files, each by its task, and returns their number.

    A task's attempt writes a file of its own; only those of the attempts that succeed get their names, so that a task may be run again."""
    dtype = "<u4" if kind in ("ivecs", "ibin") else "<f4"
    run_id = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = _store(path)
        store.create_dir(at, recursive=True)
        name = f"{at}/_{run_id}-{task.partitionId():06d}-{task.taskAttemptId()}"
        pieces, n, dim = [], 0, 0
        with store.open_output_stream(name) as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = np.asarray(batch.column(0).flatten()).astype(dtype).reshape(batch.num_rows, -1)
                dim = flat.shape[1]
                if kind in ("fvecs", "ivecs"):
                    size = np.full((len(flat), 1), dim, "<u4").view(dtype)
                    flat = np.concatenate([size, flat], axis=1)
                n += len(flat)
                if kind in ("fbin", "ibin"):  # the head holds the number of rows
                    pieces.append(flat.tobytes())
                else:
                    out.write(flat.tobytes())
            if n and pieces:
                out.write(struct.pack("<ii", n, dim) + b"".join(pieces))
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([n])], ["part", "name", "n"])

    done = df.select(order, column).repartitionByRange(order).sortWithinPartitions(order).select(column).mapInArrow(write, "part int, name string, n long").collect()  # a row a task
    store, at = _store(path)
    for row in done:
        if row["n"]:
            store.move(row["name"], f"{at}/part-{row['part']:06d}")
        else:
            store.delete_file(row["name"])
    return sum(row["n"] for row in done)


def write_ranges(bounds: DataFrame, path: str, dims: int, integer: bool = False) -> None:
    """bounds: qid, l_i, u_i (or lo and hi, of ids).  All lower bounds, then all upper bounds, as bounds_rows() reads them; a row a query, on the driver."""
    names = ("lo", "hi") if integer else ("l_", "u_")
    sides = [[c] if integer else [f"{c}{i}" for i in range(dims)] for c in names]
    held = bounds.select("qid", *sides[0], *sides[1]).orderBy("qid").toArrow()
    store, at = _store(path)
    with store.open_output_stream(at) as out:
        for side in sides:
            out.write(np.stack([np.asarray(held.column(c)) for c in side], axis=1).astype("<i4" if integer else "<f4").tobytes())


def truth_rows(stored: DataFrame) -> DataFrame:
    """ivecs rows of neighbours as (qid, rank, id)."""
    return stored.select(F.col("id").alias("qid"), F.posexplode("embedding").alias("rank", "neighbor")).select("qid", (F.col("rank") + 1).alias("rank"), F.col("neighbor").cast("long").alias("id"))


def attributes(stored: DataFrame, dims: int) -> DataFrame:
    """Attribute rows as one column each, so that a scan can prune and filter them."""
    return stored.select("id", *[F.col("embedding")[i].alias(f"attr_{i}") for i in range(dims)])


def bounds_rows(spark, path: str, queries: int, dims: int, integer: bool = False) -> DataFrame:
    """Bound files: all lower bounds, then all upper bounds; one row a query with l_i and u_i."""
    blocks = read_vectors(spark, path, "raw", dim=dims, dtype="int32" if integer else "float32")
    low = blocks.where(F.col("id") < queries).select(F.col("id").alias("qid"), *[F.col("embedding")[i].alias(f"l_{i}") for i in range(dims)])
    high = blocks.where(F.col("id") >= queries).select((F.col("id") - queries).alias("qid"), *[F.col("embedding")[i].alias(f"u_{i}") for i in range(dims)])
    return low.join(high, "qid")


def write_parquet(base: DataFrame, attrs: DataFrame, path: str) -> None:
    base.join(attrs, "id").write.parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_join(F.transform("embedding", lambda v: v.cast("string")), " ").alias("text"))


def query_texts(bounds: DataFrame, attrs: list[str], template: str = "{a} >= {l} AND {a} <= {u}") -> DataFrame:
    """One predicate text a query, for other engines."""
    parts = []
    for i, a in enumerate(attrs):
        text = template.replace("{a}", a).replace("{l}", "%s").replace("{u}", "%s")
        parts.append(F.format_string(text, F.col(f"l_{i}").cast("string"), F.col(f"u_{i}").cast("string")))
    return bounds.select("qid", F.concat_ws(" AND ", *parts).alias("predicate"))
