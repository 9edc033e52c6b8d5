"""Tables that are built once and searched many times: an index by its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryvec.operators import hybrid, ivf, layout
from quarryvec.sources.tables import scratch

_paths: dict[tuple[str, str], str] = {}


def _path_for(spark: SparkSession, name: str, save: Callable[[str], None]) -> str:
    """Where the thing of this name lies: written the first time in an application, deleted when it ends."""
    key = spark.sparkContext.applicationId, name
    if key not in _paths:
        path = scratch(spark, "index")
        save(path)
        _paths[key] = path
    return _paths[key]


def index_for(spark: SparkSession, name: str, make: Callable[[], hybrid.Index]) -> hybrid.Index:
    return hybrid.load(spark, _path_for(spark, name, lambda path: hybrid.save(make(), path, "attr_0")))


def clusters_for(spark: SparkSession, name: str, train: Callable[[], DataFrame], assign: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows with their clusters, and the centroids."""

    def save(path: str) -> None:
        train().write.parquet(f"{path}/centroids")
        ivf.write_index(assign(spark.read.parquet(f"{path}/centroids")), f"{path}/base", "attr_0")

    path = _path_for(spark, name, save)
    return spark.read.parquet(f"{path}/base"), spark.read.parquet(f"{path}/centroids")


def layout_for(spark: SparkSession, name: str, make: Callable[[str], layout.Layout]) -> layout.Layout:
    """make: writes the layout at a path."""
    return layout.load(spark, _path_for(spark, f"layout:{name}", lambda path: make(path)))
