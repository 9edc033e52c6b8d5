"""Attributes and predicate workloads, from hashes of ids: the same on every rerun and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Parts into which the values of an attribute are cut for ranges.
STEPS = 1000


def unit(seed: int, key: str = "id") -> Column:
    """Uniform in (0, 1)."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))


def uniform(base: DataFrame, dims: int = 1, low: float = 0.0, high: float = 10_000.0, seed: int = 0) -> DataFrame:
    return base.select("*", *[(F.lit(low) + (high - low) * unit(seed + i)).cast("float").alias(f"attr_{i}") for i in range(dims)])


def labels(base: DataFrame, cardinality: int, seed: int = 0) -> DataFrame:
    return base.withColumn("label", F.floor(unit(seed) * cardinality).cast("int"))


def zipf(base: DataFrame, exponent: float = 2.0, most: int = 1000, seed: int = 0) -> DataFrame:
    """skewed: 1 to most with probability in proportion to value ** -exponent, by the inverse of the continuous tail."""
    tail = F.pow(1 - unit(seed) * (1 - float(most + 1) ** (1 - exponent)), 1 / (1 - exponent))
    return base.withColumn("skewed", F.least(F.lit(most), F.floor(tail)).cast("int"))


def correlated(base: DataFrame, rho: float = 0.5, sigma: float = 10.0, seed: int = 0, names: tuple[str, str] = ("correlated1", "correlated2")) -> DataFrame:
    """Two normal attributes with correlation rho (negative: anticorrelated)."""
    r = F.sqrt(-2 * F.log(unit(seed)))
    a, b = r * F.cos(2 * math.pi * unit(seed + 1)), r * F.sin(2 * math.pi * unit(seed + 1))
    return base.select("*", (sigma * a).cast("float").alias(names[0]), (sigma * (rho * a + math.sqrt(1 - rho * rho) * b)).cast("float").alias(names[1]))


def _points(base: DataFrame, attr: str) -> DataFrame:
    """n and the thousandths of an attribute, from a mergeable sketch: one row."""
    return base.where(F.col(attr).isNotNull()).agg(F.count("*").alias("n"), F.percentile_approx(attr, [i / STEPS for i in range(STEPS + 1)], 100 * STEPS).alias("p"))


def ranges(queries: DataFrame, base: DataFrame, attr: str, least: int = 100, seed: int = 0) -> DataFrame:
    """qid, low, high: closed ranges of the attribute from a random rank on, that ``least`` rows pass (or all).

    Bounds are thousandths, taken a step wider than the ranks ask for, which is more than the sketch can err."""
    met = queries.crossJoin(F.broadcast(_points(base, attr)))
    start = F.floor(unit(seed, "qid") * F.greatest(F.col("n") - least, F.lit(1)))
    low = F.greatest(F.floor(start * STEPS / F.col("n")) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil((start + least) * STEPS / F.col("n")) + 1, F.lit(STEPS)).cast("int")
    return met.select("qid", F.col("p")[low].alias("low"), F.col("p")[high].alias("high"))


def values(queries: DataFrame, base: DataFrame, attr: str, seed: int = 0) -> DataFrame:
    """qid, v: for each query a value that the attribute has, frequent ones more often."""
    met = queries.crossJoin(F.broadcast(_points(base, attr)))
    return met.select("qid", F.col("p")[F.floor(unit(seed, "qid") * (STEPS + 1)).cast("int")].alias("v"))


def packed_ranges(queries: DataFrame, n: int, percent: int, seed: int = 0) -> DataFrame:
    """qid, lo, hi: id ranges of n * percent / 100 rows with a random start."""
    length = n * percent // 100
    return queries.select("qid", F.floor(unit(seed, "qid") * (n - length + 1)).cast("long").alias("lo")).withColumn("hi", F.col("lo") + length - 1)


def quantile_ranges(base: DataFrame, queries: DataFrame, attr: str, share: float, seed: int = 0) -> DataFrame:
    """qid, low, high: from a quantile up to 90 percent, over ``share`` of the rows."""
    points = base.agg(F.percentile_approx(attr, [i / 100 for i in range(101)], 10_000).alias("p"))
    start = F.floor(unit(seed, "qid") * 90 * (1 - share)).cast("int")
    return queries.crossJoin(F.broadcast(points)).select("qid", F.col("p")[start].alias("low"), F.col("p")[start + int(100 * share)].alias("high"))
