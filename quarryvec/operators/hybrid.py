"""Cooperative search: graph shards and clusters answer together, and a planner chooses.

All strategies return (qid, rank, id, dist), and only rows that pass, whatever the predicate.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryvec.operators import exact, graph, ivf, layout, metrics
from quarryvec.operators.predicates import Predicate
from quarryvec.sources.tables import written

#: How a strategy takes clusters during a walk (graph.GraphOptions.pull).
PULL = {"graph": "never", "cooperative": "sparse", "alternate": "always", "race": "race", "graph_first": "late", "frontier": "dead_end", "relational": "only", "tree": "tree"}


@dataclass(frozen=True)
class SearchOptions:
    """strategy: auto, planned (see ``plan``), exact, clusters (whole clusters over all shards, nearest first), or, inside the shards: graph, cooperative,
    alternate, race, graph_first, frontier, relational (clusters alone).  efs rows are gathered, by the clusters strategy at least ``share`` of all that pass,
    and nprobe clusters; exact_rows: up to so many passing rows the planner searches exactly, at any number by default,
    so that the result's kind doesn't turn on the size of the input.  For planned: the recall that a strategy must reach in the trial, and what a
    distance of a walk costs beside one of a scan."""

    strategy: str = "auto"
    k: int = 10
    efs: int = 100
    nprobe: int = 1
    share: float = 0.0
    exact_rows: int | None = None
    sparse: float = 0.05
    walk: graph.GraphOptions = field(default_factory=graph.GraphOptions)
    recall: float = 0.9
    walk_cost: float = 1.0


@dataclass(frozen=True)
class Index:
    """A base with its cluster column, centroids, and shards."""

    assigned: DataFrame
    centroids: DataFrame
    shards: DataFrame


def build(base: DataFrame, nlist: int, shards: int | None = None, m: int = 16, centroids: DataFrame | None = None, assigned: DataFrame | None = None) -> Index:
    """assigned: the base with its clusters, if centroids have been assigned before."""
    centroids = ivf.train(base, nlist) if centroids is None else centroids
    assigned = ivf.assign(base, centroids) if assigned is None else assigned
    return Index(assigned, centroids, graph.build_shards(assigned, shards, m))


def build_cells(base: DataFrame, attrs: list[str], bits: int = 3, shards: int | None = None, m: int = 16) -> Index:
    """An index whose clusters are the cells of a box layout over attributes, for the strategy tree; centroids are the cells' means."""
    assigned = layout.with_cells(base, attrs, bits).withColumn("cluster", F.col("cluster").cast("int"))
    means = assigned.where("embedding is not null").select("cluster", F.posexplode("embedding")).groupBy("cluster", "pos").agg(F.avg("col").alias("mean"))
    centroids = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m")).select("cluster", F.col("m.mean").alias("centroid"))
    return Index(assigned, centroids, graph.build_shards(assigned, shards, m))


def save(index: Index, path: str, sort_by: str = "id") -> None:
    ivf.write_index(index.assigned, f"{path}/base", sort_by)
    index.centroids.write.parquet(f"{path}/centroids")
    index.shards.write.parquet(f"{path}/shards")


def load(spark, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("base", "centroids", "shards")))


#: Of the trial: rows for the share that passes, queries, shards, and the strategies that are tried.
SAMPLE_ROWS, TRIAL_QUERIES, TRIAL_SHARDS = 20_000, 16, 2
TRIED = ("graph", "cooperative", "relational")
#: Of strategies that compute equally many distances, as where each scores the few rows that pass, the earlier is taken.
WALKS = ("exact", "relational", "cooperative", "graph")


@dataclass(frozen=True)
class Plan:
    """strategy; share of rows that pass, as the sample has it, and its error at 95 percent; of each strategy the distances that a query needs over
    all shards, and its recall in the trial."""

    strategy: str
    share: float
    error: float
    costs: dict[str, float]
    recalls: dict[str, float]


def _pass_share(index: Index, queries: DataFrame, predicate: Predicate | None, n: int) -> tuple[float, float]:
    if predicate is None:
        return 1.0, 0.0
    lots = max(1, n // SAMPLE_ROWS)
    sample = index.assigned.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(lots)) == 0).drop("embedding")
    if predicate.per_query:
        some = F.broadcast(queries.drop("q"))
        m, hit = sample.count(), sample.join(some, predicate.column()).count()
        tests = m * max(1, queries.count())
    else:
        m, hit = sample.agg(F.count("*"), F.count_if(predicate.column())).first()
        tests = m
    share = hit / tests if tests else 0.0
    return share, 1.96 * (share * (1 - share) / m) ** 0.5 + 1 / m if m else 1.0


def plan(index: Index, queries: DataFrame, options: SearchOptions, predicate: Predicate | None = None) -> Plan:
    """The strategy with the least distances computed among those that reach ``options.recall``, by trial.

    Exact search computes a distance for each row that passes: their share comes from a sample of rows of bounded size, its error
    counted in.  The strategies inside the shards are run for ``TRIAL_QUERIES`` queries in ``TRIAL_SHARDS`` shards, where their
    distances are counted and their results compared with exact search over the same shards' rows; a search of all shards takes so
    many times as much.  Exact search is always a candidate."""
    n, n_shards = index.shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("shards"), F.lit(1))).first()
    asked = written(queries.where(F.col("q").isNotNull()).orderBy(F.xxhash64("qid"), "qid").limit(TRIAL_QUERIES), "trial")
    share, error = _pass_share(index, asked, predicate, n)
    costs, recalls = {"exact": min(1.0, share + error) * n}, {"exact": 1.0}
    tried = index.shards.where(F.col("shard") < TRIAL_SHARDS)
    size, shards = tried.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if size and asked.limit(1).count():
        rows = written(graph.with_shards(index.assigned, n_shards).where(F.col("shard") < TRIAL_SHARDS).drop("shard"), "trial-rows")
        truth = written(exact.filtered_knn(rows, asked, options.k, predicate), "trial-truth")
        part = Index(rows, index.centroids, tried)
        for how in TRIED:
            found = written(walked(part, asked, replace(options, strategy=how), predicate), "trial-walk")
            work = graph.comparisons(found).agg(F.sum("walked").alias("w"), F.sum("scanned").alias("s"), F.count("*").alias("q")).first()
            if work["q"]:
                costs[how] = (options.walk_cost * work["w"] + work["s"]) / work["q"] * n / size
                recalls[how] = metrics.recall(graph.nearest(found, options.k), truth, options.k).agg(F.avg("recall")).first()[0] or 0.0
    able = [how for how in costs if recalls[how] >= options.recall]
    return Plan(min(able, key=lambda how: (costs[how], WALKS.index(how))), share, error, costs, recalls)


def choose(base: DataFrame, predicate: Predicate | None, options: SearchOptions) -> str:
    """exact without a bound or if few rows pass, clusters if a small share does, cooperative otherwise."""
    if options.strategy != "auto":
        return options.strategy
    if predicate and predicate.per_query:
        return "cooperative"
    if options.exact_rows is None:
        return "exact"
    row = base.agg(F.count("*").alias("n"), F.count_if(predicate.column() if predicate else F.lit(True)).alias("n_pass")).first()
    if row["n_pass"] <= options.exact_rows:
        return "exact"
    return "clusters" if row["n_pass"] < options.sparse * row["n"] else "cooperative"


def walked(index: Index, queries: DataFrame, options: SearchOptions, predicate: Predicate | None = None, members: DataFrame | None = None) -> DataFrame:
    """What graph.walk() returns under a strategy that runs inside the shards: graph.nearest() and graph.comparisons() read it."""
    o = replace(options.walk, pull=PULL[options.strategy], efs=options.efs, sparse=options.sparse)
    base = None if predicate is None and members is None else index.assigned
    return graph.walk(base, index.shards, queries, options.k, predicate, o, index.centroids, members)


def search(index: Index, queries: DataFrame, options: SearchOptions = SearchOptions(), predicate: Predicate | None = None, members: DataFrame | None = None) -> DataFrame:
    """members: instead of a predicate, (qid, id) of what passes for each query (strategies inside the shards)."""
    if members is not None:
        how = options.strategy if options.strategy in PULL else "cooperative"
        return graph.nearest(walked(index, queries, replace(options, strategy=how), None, members), options.k)
    how = plan(index, queries, options, predicate).strategy if options.strategy == "planned" else choose(index.assigned, predicate, options)
    if how == "exact":
        return exact.filtered_knn(index.assigned, queries, options.k, predicate)
    if how == "clusters":
        probes = ivf.wave_probes(index.assigned, queries, index.centroids, options.efs, predicate, options.nprobe, options.share)
        return ivf.probe_search(index.assigned, queries, probes, options.k, predicate)
    return graph.nearest(walked(index, queries, replace(options, strategy=how), predicate), options.k)
