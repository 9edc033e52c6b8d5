"""Quality rules with robust multivariate outliers (operator 4).

Counts.  Words are runs of other characters than space and U+0009 to U+000D.  Of each text:
n_words; word_chars, the code points in words; n_symbols, characters of ``#*$%&|<>``;
n_dup_lines, lines with a word that equal an earlier line; n_repeat_words, words in a window
of three words that the text has twice or more.  Base rule: a text fails with under
``min_words`` words or with over ``repeat_percent`` percent repeated words.

Outliers.  The counts of the texts that pass become a vector: log of the number of words, log
of the mean word length, and symbols, duplicate lines and repeated words as shares of the
words, each in whole units of 1 / ``UNIT``, so that sums are exact and a rerun gives the same bits however the rows lie.
For every language and source, and for every language and for all rows, the minimum-covariance-determinant estimate is
approached from several starts (scaled medians; all rows; rows drawn to a sphere; rows bent by tanh; and the thirds of
``DEALS`` deals of the rows by hash): a concentration step takes the
``SUPPORT`` nearest part of the rows, estimates mean and covariance from it, and measures again.  After two steps the ``BEST`` starts
of each group go on, until no group's rows change (or
``MOST_STEPS`` steps are done); the least determinant of all steps counts.  It may be a local minimum, as in any search but that of all subsets.  Which rows are nearest is read from a histogram of
distances with bins of 1 / ``BINS`` of their logarithm, so that rows of the last bin are taken together.
A statistic's deviation is never taken to be below its ``FLOORS`` (most are zero
in nearly all clean texts, whose covariance is singular); determinants are of these covariances.  The estimate of a language and source is
drawn towards the language's as if that were ``PRIOR`` rows of its own, and the language's towards that of all rows, at every size.
A text is rejected if its squared Mahalanobis distance is over the chi-squared quantile of
1 - ``alpha``.

Every step reads all rows; sums and histograms are made by partial aggregation, so a source with a third
of the rows is no larger than any other after the first stage.

Null text has no words and fails.  Null lang or source is a group of its own.  Repeated rows
count each; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.tables import broadcast_if_small, written

SUPPORT, MOST_STEPS, DEALS, BEST, PRIOR, BINS, UNIT = 0.75, 12, 4, 3, 100, 256, 1 << 14
P = 5
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Least standard deviation of each part of the vector.
FLOORS = (0.5, 0.08, 0.05, 0.05, 0.1)
WORDS = re.compile("[^ \t-\r]+")
SYMBOLS = re.compile("[#*$%&|<>]")
BLOCK_CHARS = 1 << 19


def counts(texts: list[str | None]) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    out = np.zeros((len(texts), 5), np.int64)
    words = [WORDS.findall(t) if t else [] for t in texts]
    n = out[:, 0] = [len(w) for w in words]
    ids: dict[str, int] = {}
    for w in words:
        for x in w:
            if x not in ids:
                ids[x] = len(ids)
    flat = np.fromiter((i for w in words for i in map(ids.__getitem__, w)), np.int64, int(np.sum(n)))
    at = 0
    for i, (t, w) in enumerate(zip(texts, words)):
        if not w:
            continue
        out[i, 1] = sum(map(len, w))
        out[i, 2] = len(SYMBOLS.findall(t))
        if "\n" in t:
            lines = [x for x in t.split("\n") if WORDS.search(x)]
            out[i, 3] = len(lines) - len(set(lines))
        if len(w) > 3:
            own = flat[at : at + len(w)]
            if len(ids) < 1 << 21:
                code = own[:-2] << 42 | own[1:-1] << 21 | own[2:]
            else:  # one very long text; numbers of its own pairs
                pair = np.unique(own[:-1] * len(ids) + own[1:], return_inverse=True)[1]
                code = pair[:-1] * len(ids) + own[2:]
            _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
            if len(count) < len(code):
                again = count[inverse] > 1
                covered = np.zeros(len(w), bool)
                for k in range(3):
                    covered[k : len(w) - 2 + k] |= again
                out[i, 4] = int(covered.sum())
        at += len(w)
    return out


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function of k/2 and x/2, by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-15:
        term *= z / (a + i)
        total += term
        i += 1
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a))) if z > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def floored(cov: np.ndarray) -> np.ndarray:
    """Covariances with deviations not below the floors, which keeps them positive definite."""
    cov = cov.copy()
    for i in range(P):
        cov[:, i, i] = np.maximum(cov[:, i, i], 0) + np.maximum(FLOORS[i] ** 2 - cov[:, i, i], 1e-9)
    return cov


def from_sums(n: np.ndarray, sums: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of rows in units, from whole-number sums; the sum of a product is high * 65536 + low."""
    n = n.astype(object)
    mean = np.array([[int(s) / (int(k) * UNIT) for s in row] for k, row in zip(n, sums)]).reshape(len(n), P)
    cov = np.empty((len(n), P, P))
    for g, k in enumerate(n):
        for c, (i, j) in enumerate(PAIRS):
            total = (int(high[g, c]) << 16) + int(low[g, c])
            cov[g, i, j] = cov[g, j, i] = (int(k) * total - int(sums[g, i]) * int(sums[g, j])) / (int(k) ** 2 * UNIT**2)
    return mean, cov


def _row(level_grp: pd.DataFrame, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Means, covariances and their inverses as columns."""
    out = level_grp.reset_index(drop=True)
    inverse = np.linalg.inv(cov) if len(cov) else cov
    more = {f"m{i}": mean[:, i] for i in range(P)} | {f"v{i}{j}": cov[:, i, j] for i, j in PAIRS} | {f"i{i}{j}": inverse[:, i, j] for i, j in PAIRS}
    return pd.concat([out, pd.DataFrame(more)], axis=1)


CONSISTENT = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, P), P + 2)
KEY = ["level", "grp"]
ESTIMATE = ", ".join([f"m{i} double" for i in range(P)] + [f"{x}{i}{j} double" for x in "vi" for i, j in PAIRS])


def concentrated(sums: pd.DataFrame) -> pd.DataFrame:
    """Of each row of sums (n, s0.., h00.., l00..) the estimate, the logarithm of its determinant, and whether the rows have changed."""
    names = [f"{i}{j}" for i, j in PAIRS]
    exact = [sums[[f"{x}{c}" for c in (range(P) if x == "s" else names)]].to_numpy() for x in "shl"]
    mean, cov = from_sums(sums["n"].to_numpy(), *exact)
    cov = floored(cov * CONSISTENT)
    out = _row(sums[[*KEY, "start", "parent", "rows"]], mean, cov)
    out["logdet"] = np.linalg.slogdet(cov)[1] if len(cov) else np.zeros(0)
    out["taken"] = sums["taken"].to_numpy()
    out["changed"] = (sums["taken"] != sums["before"]).to_numpy()
    return out


def drawn(own: pd.DataFrame, prior: float) -> pd.DataFrame:
    """Estimates with the columns of their parents' (o_..) drawn towards them by ``prior`` rows."""
    def part(prefix: str) -> tuple[np.ndarray, np.ndarray]:
        mean = own[[f"{prefix}m{i}" for i in range(P)]].to_numpy(float)
        cov = np.empty((len(own), P, P))
        for i, j in PAIRS:
            cov[:, i, j] = cov[:, j, i] = own[f"{prefix}v{i}{j}"].to_numpy(float)
        return mean, cov

    (mean, cov), (far_mean, far_cov) = part(""), part("o_")
    n = own["rows"].to_numpy(float)[:, None]
    mean = (n * mean + prior * far_mean) / (n + prior)
    cov = (n[:, :, None] * cov + prior * far_cov) / (n[:, :, None] + prior)
    return _row(own[[*KEY, "parent", "rows"]], mean, cov)


def distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    return sum((d[i] * d[j] * F.col(f"i{i}{j}") * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _group() -> Column:
    return F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})


def _lang() -> Column:
    return F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})


def _bin(d: Column) -> Column:
    return F.floor(F.log(F.greatest(d, F.lit(0.0)) + 1e-6) * BINS).cast("int")


def _reached(counts: DataFrame, key: list[str], share: float, out: str) -> DataFrame:
    """counts: key, bin, n.  The first bin up to which ``share`` of the rows lie; a group has a bounded number of bins."""
    order = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    some = counts.withColumn("up_to", F.sum("n").over(order)).withColumn("rows", F.sum("n").over(whole))
    return some.where(F.col("up_to") >= F.ceil(F.col("rows") * share)).groupBy(*key).agg(F.min("bin").alias(out), F.max("rows").alias("rows"))


def _moments() -> list[Column]:
    """Whole-number sums of rows whose x0.. are in units; products are cut in two, so that no sum is too large."""
    q = [F.col(f"q{i}") for i in range(P)]
    return [F.sum(q[i]).alias(f"s{i}") for i in range(P)] + [F.sum(F.shiftright(q[i] * q[j], 16)).alias(f"h{i}{j}") for i, j in PAIRS] + [F.sum((q[i] * q[j]).bitwiseAND(65535)).alias(f"l{i}{j}") for i, j in PAIRS]


def fit(vectors: DataFrame, prior: float = PRIOR) -> DataFrame:
    """vectors: lang, source, q0.. (in units).  Returns level (2: language and source, 1: language, 0: all), grp, m0.., i00.. ."""
    x = [(F.col(f"q{i}") / float(UNIT)).alias(f"x{i}") for i in range(P)]
    q = [f"q{i}" for i in range(P)]
    whole = F.lit("")

    def level(n: int, grp: Column, parent: Column) -> Column:
        return F.struct(F.lit(n).alias("level"), grp.alias("grp"), parent.alias("parent"))

    levels = F.array(level(2, _group(), _lang()), level(1, _lang(), whole), level(0, whole, F.lit(None).cast("string")))
    rows = vectors.select(F.explode(levels).alias("g"), *q, *x).select("g.*", *q, *[f"x{i}" for i in range(P)])

    # medians, and medians of the deviations from them: of a histogram, like the distances
    fine = 1 << 6
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.shiftright(F.col(f"q{i}"), 6).cast("int").alias("bin")) for i in range(P)])).alias("c")
    key = [*KEY, "parent", "dim"]
    counted = written(rows.select(*KEY, "parent", cells).select(*KEY, "parent", "c.*").groupBy(*key, "bin").agg(F.count("*").alias("n")), "values")
    middle = _reached(counted, key, 0.5, "m")
    away = counted.join(broadcast_if_small(written(middle.select(*KEY, "dim", "m"), "medians")), [*KEY, "dim"])
    away = away.groupBy(*key, "m", F.abs(F.col("bin") - F.col("m")).alias("bin")).agg(F.sum("n").alias("n"))
    spread = _reached(away, [*key, "m"], 0.5, "d")
    here = spread.groupBy(*KEY, "parent").pivot("dim", list(range(P))).agg(F.first("m").alias("m"), F.first("d").alias("d"), F.first("rows").alias("rows"))
    centre = [((F.col(f"{i}_m") + 0.5) * (fine / float(UNIT))).alias(f"m{i}") for i in range(P)]
    scale = [F.greatest(F.lit(f), 1.4826 * F.col(f"{i}_d") * (fine / float(UNIT))).alias(f"d{i}") for i, f in enumerate(FLOORS)]
    here = written(here.select(*KEY, *centre, *scale), "start")
    few = here.limit(1001).count() <= 1000  # groups, each with a few rows in the tables below

    def near_by(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    here = near_by(here)

    # the starts: the scaled medians, and estimates from rows as they are, drawn to a sphere, and bent
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(P)]
    radius = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    bent = {0: None, 1: z, 2: [v / F.greatest(radius, F.lit(1.0)) for v in z], 3: [F.tanh(v) for v in z]}
    seeds = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), *[F.round((F.col(f"m{i}") + v * F.col(f"d{i}")) * UNIT).cast("long").alias(f"q{i}") for i, v in enumerate(vs)]) for k, vs in bent.items() if vs])).alias("seed")
    bent_rows = rows.join(here, KEY).select(*KEY, "parent", seeds).select(*KEY, "parent", "seed.*")
    thirds = F.explode(F.array(*[4 + 3 * j + F.pmod(F.xxhash64(*q, F.lit(j)), F.lit(3)).cast("int") for j in range(DEALS)])).alias("start")
    first = bent_rows.unionByName(rows.select(*KEY, "parent", thirds, *q))
    sums = first.groupBy(*KEY, "parent", "start").agg(F.count("*").alias("n"), *_moments())
    sums = sums.select("*", F.col("n").alias("rows"), F.lit(0).cast("long").alias("taken"), F.lit(-1).cast("long").alias("before"))
    schema = f"level int, grp string, start int, parent string, rows long, {ESTIMATE}, logdet double, taken long, changed boolean"
    now = sums.mapInPandas(lambda it: (concentrated(s) for s in it), schema)
    plain = here.select(*KEY, *[f"m{i}" for i in range(P)], *[(F.col(f"d{i}") ** 2 if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in PAIRS], *[(1 / F.col(f"d{i}") ** 2 if i == j else F.lit(0.0)).alias(f"i{i}{j}") for i, j in PAIRS])
    plain = plain.select("*", F.lit(0).alias("start"), F.lit(float("inf")).alias("logdet"), F.lit(0).cast("long").alias("taken"))
    names = [*KEY, "start", *[f"m{i}" for i in range(P)], *[f"i{i}{j}" for i, j in PAIRS], "taken"]
    now = written(now.select(*names).unionByName(plain.select(*names)), "starts")
    every = []
    for step in range(MOST_STEPS):
        measured = rows.join(near_by(now), KEY).withColumn("bin", _bin(distance()))
        bins = measured.groupBy(*KEY, "start", "bin").agg(F.count("*").alias("n"))
        cut = near_by(written(_reached(bins, [*KEY, "start"], SUPPORT, "cut"), "cuts"))
        near = measured.join(cut, [*KEY, "start"]).where("bin <= cut")
        sums = near.groupBy(*KEY, "parent", "start", "rows", F.col("taken").alias("before")).agg(F.count("*").alias("n"), *_moments())
        sums = sums.withColumn("taken", F.xxhash64("n", *[c for c in sums.columns if c[0] in "shl" and c[1:].isdigit()]))
        now = written(sums.mapInPandas(lambda it: (concentrated(s) for s in it), schema), "estimates")
        every.append(now)
        if not now.where("changed").limit(1).count():
            break
        if step == 1:
            ranked = now.withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy("logdet", "start")))
            now = written(ranked.where(F.col("r") <= BEST), "best")
        now = now.select(*names)
    steps = every[0]
    for e in every[1:]:
        steps = steps.unionByName(e)
    columns = [c for c in steps.columns if c not in (*KEY, "parent", "logdet", "start", "taken", "changed")]
    least = steps.groupBy(*KEY, "parent").agg(F.min_by(F.struct(*columns), F.struct("logdet", "start", "taken")).alias("e")).select(*KEY, "parent", "e.*")
    least = written(least, "least")

    # towards the estimate above
    estimates = [c for c in least.columns if c[1:].isdigit()]
    done = least.where("level = 0").select(*KEY, "parent", "rows", *estimates)
    out = done
    for n in (1, 2):
        above = broadcast_if_small(written(done.select(F.col("grp").alias("parent"), *[F.col(c).alias(f"o_{c}") for c in estimates]), "above"))
        done = least.where(F.col("level") == n).join(above, "parent").mapInPandas(lambda it: (drawn(x, prior) for x in it), f"level int, grp string, parent string, rows long, {ESTIMATE}")
        out = out.unionByName(done)
    return written(out.select(*KEY, *[f"m{i}" for i in range(P)], *[f"i{i}{j}" for i, j in PAIRS]), "fitted")


def judge(docs: DataFrame, alpha: float = 1e-6, min_words: int = 50, repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", detail: bool = False) -> DataFrame:
    """With ``detail`` also row, the xxhash64 of the text, as ids may be null or occur twice.  id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (null if it failed), kept."""
    id_sql = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, first, size = [], 0, 0
            for i, v in enumerate(batch.column(4)):
                values.append(v.as_py())
                size += len(values[-1] or "")
                if size >= BLOCK_CHARS or i + 1 == batch.num_rows:
                    c = counts(values)
                    yield pa.RecordBatch.from_arrays([batch.column(k)[first : i + 1] for k in range(4)] + [pa.array(c[:, k]) for k in range(5)], ["id", "lang", "source", "row", *NAMES])
                    values, first, size = [], i + 1, 0

    plain = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    counted = plain.mapInArrow(run, f"id {id_sql}, lang string, source string, row long, " + ", ".join(f"{c} long" for c in NAMES))
    counted = written(counted.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))), "counts")
    n = F.greatest("n_words", F.lit(1))
    vector = [F.log1p("n_words"), F.log(F.greatest("word_chars", F.lit(1)) / n), F.col("n_symbols") / n, F.col("n_dup_lines") / n, F.col("n_repeat_words") / n]
    # 64 is far out of all clean texts; up to it sums of any number of rows fit
    vectors = counted.select("*", *[F.round(F.least(x, F.lit(64.0)) * UNIT).cast("long").alias(f"q{i}") for i, x in enumerate(vector)])
    vectors = vectors.select("*", *[(F.col(f"q{i}") / float(UNIT)).alias(f"x{i}") for i in range(P)])
    found = fit(vectors.where("not base_failed"))
    parts = [c for c in found.columns if c not in ("level", "grp")]

    def at(level: int, grp: Column, df: DataFrame) -> DataFrame:
        own = broadcast_if_small(found.where(F.col("level") == level)).select(F.col("grp").alias(f"g{level}"), F.struct(*parts).alias(f"e{level}"))
        return df.withColumn(f"g{level}", grp).join(own, f"g{level}", "left")

    out = at(2, _group(), vectors)
    out = at(1, _lang(), out)
    out = at(0, F.lit(""), out).withColumn("e", F.coalesce("e2", "e1", "e0")).select("*", "e.*")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), distance()))
    kept = F.coalesce(~F.col("base_failed") & (F.col("distance") <= chi2_quantile(1 - alpha, P)), F.lit(False))
    return out.select(F.col("id").alias(id_col), *NAMES, "base_failed", "distance", kept.alias("kept"), *(["row"] if detail else []))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
