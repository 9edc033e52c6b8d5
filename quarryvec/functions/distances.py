"""Distances between array columns, as expressions.

All fold from left to right in double, so that equal inputs give equal bits on any engine that
folds in this order; ties are then broken by id.  A null array has a null distance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]


def _fold(x: Column, q: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(x, q, lambda a, b: term(a.cast("double"), b.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def l2sq(x: Column, q: Column) -> Column:
    """Squared Euclidean distance, without a root."""
    return _fold(x, q, lambda a, b: (a - b) * (a - b))


def inner_product(x: Column, q: Column) -> Column:
    return _fold(x, q, lambda a, b: a * b)


def ip_distance(x: Column, q: Column) -> Column:
    return F.lit(1.0) - inner_product(x, q)


def l1(x: Column, q: Column) -> Column:
    return _fold(x, q, lambda a, b: F.abs(a - b))


@dataclass(frozen=True)
class masked_l1:
    """L1 over the dimensions whose mask is not 0."""

    mask: Column

    def __call__(self, x: Column, q: Column) -> Column:
        gaps = F.zip_with(x, q, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
        return F.aggregate(F.zip_with(gaps, self.mask, lambda g, m: F.when(m != 0, g).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)

    def kept(self, x: Column) -> Column:
        """The vector with 0 where the mask is 0: L1 between such vectors is this distance, if all rows have the same mask."""
        return F.zip_with(x, self.mask, lambda v, m: F.when(m != 0, v.cast("double")).otherwise(0.0))


DISTANCES: dict[str, Distance] = {"l2sq": l2sq, "ip": ip_distance, "l1": l1}


def folded_distance(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of matching rows with the fold's bits."""
    x, q = x.astype(float), q.astype(float)
    if metric == "l2sq":
        return np.cumsum((x - q) * (x - q), axis=1)[:, -1]
    if metric == "ip":
        return 1.0 - np.cumsum(x * q, axis=1)[:, -1]
    return np.cumsum(np.abs(x - q), axis=1)[:, -1]
