"""Quality of results, and summaries of runs and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryvec.sources.tables import written

TOLERANCE = 1e-3


def recall(result: DataFrame, truth: DataFrame, k: int, ties: bool = True) -> DataFrame:
    """qid, tp, n_truth, n_result, recall, precision.

    A row counts if the truth has its id or, with ``ties``, if it is no farther than the truth's
    farthest row and the tolerance."""
    truth = truth.where(F.col("rank") <= k)
    per_query = truth.groupBy("qid").agg(F.count("*").alias("n_truth"), F.max("dist").alias("farthest"))
    rows = result.where(F.col("rank") <= k).dropDuplicates(["qid", "id"]).join(truth.select("qid", "id", F.lit(True).alias("hit")), ["qid", "id"], "left").join(per_query.select("qid", "farthest"), "qid")
    good = F.col("hit") | (F.col("dist") <= F.col("farthest") + TOLERANCE) if ties else F.col("hit")
    counts = rows.groupBy("qid").agg(F.count_if(F.coalesce(good, F.lit(False))).alias("tp"), F.count("*").alias("n_result"))
    out = per_query.join(counts, "qid", "left").na.fill(0, ["tp", "n_result"])
    return out.select("qid", "tp", "n_truth", "n_result", (F.col("tp") / F.col("n_truth")).alias("recall"), (F.col("tp") / F.when(F.col("n_result") > 0, F.col("n_result"))).alias("precision"))


def truth_of(stored: DataFrame, k: int) -> DataFrame:
    """The first k rows of a stored truth; an error if a query has fewer."""
    out = stored.where(F.col("rank") <= k)
    short = out.groupBy("qid").count().where(F.col("count") < k).limit(1).count()
    if short:
        raise ValueError(f"the stored truth has under {k} rows for a query")
    return out


def cluster_histogram(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """cluster, n of all clusters, empty ones too."""
    return centroids.select("cluster").join(assigned.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left").na.fill(0, ["n"])


def imbalance(histogram: DataFrame) -> DataFrame:
    """nlist * sum of squares / square of sum: 1 if all clusters are of one size."""
    return histogram.agg((F.count("*") * F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("imbalance"))


def rank_histogram(truth: DataFrame, assigned: DataFrame, ranked: DataFrame) -> DataFrame:
    """probe_rank, n: in the how many-nearest cluster of its query a true neighbour lies."""
    met = truth.select("qid", "id").join(assigned.select("id", "cluster"), "id").join(ranked.select("qid", "cluster", "probe_rank"), ["qid", "cluster"])
    return met.groupBy("probe_rank").agg(F.count("*").alias("n"))


def cumulative(histogram: DataFrame) -> DataFrame:
    """probe_rank, n, share: of the neighbours up to this rank.  The histogram has a row for each rank, at most one a cluster."""
    total = histogram.agg(F.sum("n").alias("total"))
    running = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("probe_rank").rowsBetween(Window.unboundedPreceding, 0))
    return histogram.withColumn("running", running).crossJoin(F.broadcast(total)).select("probe_rank", "n", (F.col("running") / F.col("total")).alias("share"))


def run_summary(per_query: DataFrame, seconds: float, cluster_seconds: float = 0.0) -> DataFrame:
    """Means over the queries, queries a second, and the same net of cluster search."""
    out = per_query.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))
    return out.withColumn("qps", F.col("queries") / F.lit(seconds)).withColumn("tqps", F.col("queries") / F.lit(max(seconds - cluster_seconds, 1e-9)))


def last_runs(runs: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """runs: keys, ts, qps.  Greatest and mean qps of the last n runs of each configuration."""
    recent = runs.withColumn("age", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))).where(F.col("age") <= n)
    return recent.groupBy(*keys).agg(F.max("qps").alias("max_qps"), F.avg("qps").alias("mean_qps"))


def best_at_recall(runs: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """Greatest qps and least comparisons of each key among runs of that recall or more."""
    return runs.where(F.col("recall") >= least).groupBy(*keys).agg(F.max("qps").alias("best_qps"), F.min("ncomp").alias("least_ncomp"))


def duplicate_vectors(base: DataFrame) -> DataFrame:
    """Vectors that several rows have: the number of rows and the least id."""
    return base.groupBy("embedding").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1").select("first_id", "n")


def metrics_json(per_query: DataFrame) -> DataFrame:
    return per_query.select(F.to_json(F.struct("*")).alias("json"))


def sorted_histogram(histogram: DataFrame) -> DataFrame:
    """place, n: sizes from the greatest on."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "cluster")  # one row a cluster
    return histogram.select(F.row_number().over(order).alias("place"), "cluster", "n")


def recall_at(result: DataFrame, truth: DataFrame, ks: list[int], ties: bool = True) -> DataFrame:
    """k, queries, recall, precision: means over the queries for each k."""
    out = None
    for k in ks:
        one = recall(result, truth, k, ties).agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision")).select(F.lit(k).alias("k"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place in the order within their key, from 1 on.

    Rows are dealt into ranges of key and order, ranges are counted, and a row's place is the number of its key's rows in earlier ranges and its
    place in its own: no task holds a key's rows, however many there are.  Ties beyond ``order`` are in any order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a row's range doesn't change when a task is run again
    ranged = written(rows.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    before = counts.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("__part").alias("__range"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys] + [F.col("__part") == F.col("__range")]
    numbered = ranged.withColumn("__number", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)))
    out = numbered.join(before, reduce(Column.__and__, same))
    return out.select(*rows.columns, (F.col("__number") + F.col("__before")).cast("int").alias(name))


def by_recall(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs with place: within each configuration from the least recall on, of equal ones the most queries a second first."""
    return ranked(runs, keys, [F.col("recall").asc(), F.col("qps").desc(), F.col("ts").asc()])


#: Distinct values that one task sorts in the last step of an exact quantile.
VALUES_SORTED = 1 << 20


def exact_quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """The quantile by linear interpolation, null and NaN left out; none if there are no values.

    A sketch gives a bracket that holds it, rows below the bracket are counted, and the bracket is narrowed again until it has at most
    ``VALUES_SORTED`` distinct values, which a running sum of their counts then settles."""
    values = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"))
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    place = share * (n - 1)
    wanted = int(place), min(int(place) + 1, n - 1)
    below = 0  # rows less than low
    while True:
        inside = values.where(F.col("v").between(low, high))
        if inside.agg(F.approx_count_distinct("v")).first()[0] <= VALUES_SORTED // 2:
            break
        size = inside.count()
        around = [max(0.0, (wanted[0] - below) / size - 1e-3), min(1.0, (wanted[1] - below + 1) / size + 1e-3)]
        a, b = inside.agg(F.percentile_approx("v", around, 10_000)).first()[0]
        less, upto = values.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)).first()
        if less > wanted[0] or upto <= wanted[1] or (a, b) == (low, high):  # the sketch has missed, or can't narrow it
            break
        low, high, below = a, b, less
    counts = inside.groupBy("v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("v")) + below  # one row a value of the bracket
    found = counts.withColumn("upto", upto)
    a, b = (found.where(F.col("upto") > w).agg(F.min("v")).first()[0] for w in wanted)
    return a if wanted[0] == wanted[1] else (wanted[1] - place) * a + (place - wanted[0]) * b


def quantile_summary(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row: p (the exact quantile), low, high."""
    p = exact_quantile(rows, value, share)
    return rows.agg(F.lit(p).cast("double").alias("p"), F.min(value).alias("low"), F.max(value).alias("high"))


def proposals(effort: DataFrame) -> DataFrame:
    """qid, computed, and the shares of distances computed by walks and for clusters' rows."""
    total = F.col("walked") + F.col("scanned")
    return effort.select("qid", total.alias("computed"), (F.col("walked") / F.when(total > 0, total)).alias("walk_share"), (F.col("scanned") / F.when(total > 0, total)).alias("cluster_share"), "clusters", "rounds")


def aggregated_json(per_query: DataFrame, run: dict[str, float]) -> DataFrame:
    """One row: the run's figures, and the means of all numeric columns of the queries."""
    numbers = [f.name for f in per_query.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name != "qid"]
    return per_query.agg(*[F.avg(c).alias(c) for c in numbers]).select(F.to_json(F.struct(F.struct(*numbers).alias("aggregated"), *[F.lit(v).alias(k) for k, v in run.items()])).alias("json"))
