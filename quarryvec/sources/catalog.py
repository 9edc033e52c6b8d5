"""Datasets by name: what a table of vectors has, and where its files are."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryvec.sources.vectors import attributes, read_vectors, truth_rows


@dataclass(frozen=True)
class Dataset:
    name: str
    base: str
    queries: str
    truth: str | None = None
    attrs: str | None = None
    attr_dims: int = 0
    kind: str = "fvecs"
    attr_kind: str = "raw"
    labels: str | None = None
    query_labels: str | None = None

    def load(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Base with its attributes, queries (qid, q), truth."""
        base = read_vectors(spark, self.base, self.kind)
        if self.attrs:
            base = base.join(attributes(read_vectors(spark, self.attrs, self.attr_kind, dim=self.attr_dims), self.attr_dims), "id")
        queries = read_vectors(spark, self.queries, self.kind).withColumnsRenamed({"id": "qid", "embedding": "q"})
        return base, queries, truth_rows(read_vectors(spark, self.truth, "ivecs")) if self.truth else None


    def load_labels(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Base with label and queries with q_label, from files of one int32 a row (headed by its length)."""
        base, queries, _ = self.load(spark)
        one = lambda path: read_vectors(spark, path, "ivecs", dtype="int32").select("id", F.col("embedding")[0].alias("label"))
        return base.join(one(self.labels), "id"), queries.join(one(self.query_labels).withColumnsRenamed({"id": "qid", "label": "q_label"}), "qid")


#: Names, rows, queries and dimensions of the public sets that filtered search is measured on.
SETS = {
    "sift-dedup": (985_462, 10_000, 128), "audio-dedup": (1_000_000, 10_000, 128), "gist-dedup": (982_694, 1_000, 960), "video-dedup": (1_000_000, 10_000, 1024), "glove100": (1_183_514, 10_000, 100),
    "crawl": (1_989_995, 10_000, 300), "flickr": (4_203_901, 29_999, 512), "deep10m": (10_000_000, 10_000, 96), "siftsmall": (10_000, 100, 128), "word2vec": (1_000_000, 1_000, 300),
}


def known(root: str, name: str, attr_dims: int = 0, workload: str = "") -> Dataset:
    """A set of SETS by name, with its files under a folder; truth by attributes or workload."""
    if name not in SETS:
        raise KeyError(f"no set {name}; there are {', '.join(sorted(SETS))}")
    at = f"{root}/{name}/{name}"
    kind = workload or (str(attr_dims) if attr_dims else "")
    return Dataset(name, f"{at}_base.fvecs", f"{at}_query.fvecs", f"{at}_groundtruth{'_' + kind if kind else ''}.ivecs", f"{at}_attributes_{kind}.raw" if kind else None, attr_dims)


def grid(**choices: list) -> list[dict]:
    """Every combination of parameters of a sweep."""
    return [dict(zip(choices, values)) for values in product(*choices.values())]


def artefact(root: str, dataset: str, method: str, **parameters) -> str:
    """Path of an experiment's file."""
    return "/".join([root, dataset, method, "_".join(f"{k}={parameters[k]}" for k in sorted(parameters))])
