"""Trainers beside k-means: medoids, and medoids with their own dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryvec.functions.distances import l2sq
from quarryvec.operators.ivf import assign, proclus_assign


def medoid_step(assigned: DataFrame) -> DataFrame:
    """cluster, id: the row of each cluster with the least sum of distances to its cluster's rows.

    The sum of squared distances to a set follows from its size, sum and sum of squares, so one
    aggregate for each cluster replaces a join of the cluster with itself."""
    cells = assigned.select("cluster", F.posexplode("embedding").alias("i", "v"))
    sums = cells.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("n"))
    sums = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda c: c["s"]).alias("s"), F.max("n").alias("n"))
    # n |x|^2 - 2 x.s, which differs from the sum of distances by the same amount for all rows of a cluster
    scored = assigned.join(sums, "cluster").select("cluster", "id", (F.col("n") * F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) - 2 * F.aggregate(F.zip_with("embedding", "s", lambda v, s: v.cast("double") * s), F.lit(0.0), lambda a, v: a + v)).alias("cost"))
    return scored.groupBy("cluster").agg(F.min(F.struct(F.round("cost", 6).alias("cost"), "id"))["id"].alias("id"))


def first_medoids(base: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k rows by the hash of their ids."""
    few = base.where("embedding is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)
    return few.select((F.row_number().over(Window.orderBy("id")) - 1).alias("cluster"), F.col("embedding").cast("array<double>").alias("centroid"))


def kmedoids(base: DataFrame, k: int, rounds: int = 5, seed: int = 1) -> DataFrame:
    """Centroids (cluster, centroid) that are rows of the base."""
    centroids = first_medoids(base, k, seed)
    for _ in range(rounds):
        chosen = medoid_step(assign(base, centroids))
        now = chosen.join(base.select("id", F.col("embedding").cast("array<double>").alias("centroid")), "id").select("cluster", "centroid")
        rows = now.collect()  # k rows
        centroids = base.sparkSession.createDataFrame(rows, now.schema)
    return centroids


def subspace_variance(assigned: DataFrame) -> DataFrame:
    """cluster, dim, variance."""
    return assigned.select("cluster", F.posexplode("embedding").alias("dim", "v")).groupBy("cluster", "dim").agg(F.var_pop(F.col("v").cast("double")).alias("variance"))


def subspaces(assigned: DataFrame, l: int) -> DataFrame:
    """cluster, mask: 1 for the l dimensions of least variance in each cluster."""
    ranked = subspace_variance(assigned).withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("variance", "dim")))
    bits = F.array_sort(F.collect_list(F.struct("dim", (F.col("r") <= l).cast("int").alias("used"))))
    return ranked.groupBy("cluster").agg(F.transform(bits, lambda c: c["used"]).alias("mask"))


def proclus(base: DataFrame, k: int, l: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Medoids with masks, and the assignment by them."""
    centroids = kmedoids(base, k, 2, seed)
    medoids = centroids.join(subspaces(assign(base, centroids), l), "cluster")
    return medoids, proclus_assign(base, medoids)


def transplant(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """The same rows under other centroids."""
    return assign(assigned.drop("cluster", "cluster_dist"), centroids)


def quantisation_error(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    return assigned.join(centroids, "cluster").agg(F.avg(l2sq(F.col("embedding"), F.col("centroid"))).alias("error"))
