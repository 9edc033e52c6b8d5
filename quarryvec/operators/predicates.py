"""Predicates over attributes: shared by all queries, or different for each.

A predicate gives a Column for a table that has the attributes and, if it differs by query, the
query's columns too (as a join condition).  Bounds are closed.  A null attribute never passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    """tree: of a predicate that differs by query, its parts where all are known: ("compare", attribute, operator, query's column), ("shared", name, predicate),
    ("and" or "or", tree, tree), ("not", tree)."""

    condition: Callable[[], Column]
    per_query: bool = False
    tree: tuple | None = None

    def column(self) -> Column:
        return F.coalesce(self.condition(), F.lit(False)) if self.per_query else self.condition()

    def __and__(self, other: "Predicate") -> "Predicate":
        return Predicate(lambda: self.condition() & other.condition(), self.per_query or other.per_query, _both("and", self, other))

    def __or__(self, other: "Predicate") -> "Predicate":
        return Predicate(lambda: self.condition() | other.condition(), self.per_query or other.per_query, _both("or", self, other))

    def __invert__(self) -> "Predicate":
        return Predicate(lambda: ~self.condition(), self.per_query, self.tree and ("not", self.tree))


def _both(how: str, a: Predicate, b: Predicate) -> tuple | None:
    if not (a.per_query or b.per_query):
        return None
    trees = [p.tree if p.per_query else ("shared", "", p) for p in (a, b)]
    return None if None in trees else (how, *trees)


def compared(tree: tuple | None) -> list[tuple[str, str]]:
    """Attributes of the rows, and the query's columns that they are compared with."""
    if tree is None or tree[0] == "shared":
        return []
    return [(tree[1], tree[3])] if tree[0] == "compare" else [pair for part in tree[1:] for pair in compared(part)]


def shared_parts(tree: tuple) -> tuple[tuple, dict[str, Predicate]]:
    """The tree with names for its shared parts, without the predicates, and these by name."""
    parts: dict[str, Predicate] = {}

    def named(node: tuple) -> tuple:
        if node[0] == "shared":
            name = f"shared {len(parts)}"
            parts[name] = node[2]
            return "shared", name
        return node if node[0] == "compare" else (node[0], *map(named, node[1:]))

    return named(tree), parts


def between(attr: str, low, high) -> Predicate:
    return Predicate(lambda: F.col(attr).between(low, high))


def box(bounds: dict[str, tuple]) -> Predicate:
    """Conjunction of closed ranges."""
    return reduce(Predicate.__and__, (between(a, *b) for a, b in bounds.items()))


def any_of(*predicates: Predicate) -> Predicate:
    return reduce(Predicate.__or__, predicates)


def at_least(attr: str, value) -> Predicate:
    return Predicate(lambda: F.col(attr) >= value)


def equals(attr: str, value) -> Predicate:
    return Predicate(lambda: F.col(attr) == value)


def differs(attr: str, value) -> Predicate:
    return Predicate(lambda: F.col(attr) != value)


def matches(attr: str, pattern: str) -> Predicate:
    return Predicate(lambda: F.col(attr).rlike(pattern))


def sql(text: str) -> Predicate:
    """A condition as text, such as ``attr_0 >= 1 and attr_0 <= 4``."""
    return Predicate(lambda: F.expr(text))


def query_box(bounds: dict[str, tuple[str, str]]) -> Predicate:
    """For each attribute the query's columns with its bounds."""
    return reduce(Predicate.__and__, (query_compare(a, ">=", l) & query_compare(a, "<=", u) for a, (l, u) in bounds.items()))


def query_compare(attr: str, op: str, value: str) -> Predicate:
    """op: >=, <=, = or != between an attribute and a column of the query."""
    how = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}[op]
    return Predicate(lambda: how(F.col(attr), F.col(value)), True, ("compare", attr, op, value))


def packed(low: str, high: str, rest: Predicate | None = None) -> Predicate:
    """The row's id in the query's range, and whatever else."""
    ids = query_compare("id", ">=", low) & query_compare("id", "<=", high)
    return ids & rest if rest else ids


def selectivity(base: DataFrame, predicate: Predicate) -> DataFrame:
    """n, n_pass, selectivity of a shared predicate."""
    out = base.agg(F.count("*").alias("n"), F.count_if(predicate.column()).alias("n_pass"))
    return out.withColumn("selectivity", F.col("n_pass") / F.when(F.col("n") > 0, F.col("n")))


def selectivity_by_query(base: DataFrame, queries: DataFrame, predicate: Predicate) -> DataFrame:
    """qid, n_pass of every query, also of those that nothing passes."""
    passing = queries.join(base, predicate.column(), "left")
    return passing.groupBy("qid").agg(F.count("id").alias("n_pass"))
