"""Winnowing fingerprints of documents (operator 6), in DataFrame functions only.

Tokens are words in lower case: runs of letters and digits, with scripts that put no space
between words taken character by character.  The k-gram at a token is the cyclic-polynomial rolling hash of ``k``
tokens in 64 bits: the tokens' hashes, each rotated by one bit more than the next, added without carry (so that the
hash rolls on by rotating it, taking out the token that leaves and adding the one that comes; here the sums
of all places are taken at once, array by array).  Of
every ``window`` consecutive k-grams the smallest (by its upper 32 bits) is chosen, of equal ones the rightmost, and
a k-gram that several windows choose is kept once, with its position.  Two texts that share
window + k - 1 tokens in a row therefore share a chosen k-gram.

A text with fewer tokens than k has one k-gram of all of them, one with fewer k-grams than
``window`` has one window of all of them; without a token (null, empty) the fingerprint is
empty.  The likeness of two fingerprints is the share of their distinct hashes that is in
both; two empty ones have likeness 1 if the texts are equal and 0 otherwise.

The fingerprint is an array of hash and position.  The minimum over a window is found among numbers with the upper half of the
hash above the complement of the position, by doubling, not by a scan of each window.

Repeated rows have a result each; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 3, 6
#: Blocks of scripts that put no space between words (Thai to Lao, Myanmar, Khmer, kana, Han).
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]+|[{UNSPACED}]"
PLACES = 0x7FFFFFFF


def _ahead(a: Column, by: int) -> Column:
    """The array without its first ``by`` elements."""
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """The table with a column ``out``: chosen k-grams of the column ``text``, in order of position."""
    t, w, n, g = (f"__{out}_{x}" for x in ("tokens", "grams", "packed", "min"))
    df = df.withColumn(t, F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x)))
    grams: Column = F.col(t)
    for i in range(1, k):
        # a text with fewer than k tokens keeps the one k-gram that begins at its first token
        grams = F.zip_with(grams, _ahead(F.col(t), i), lambda a, b: F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long"))))
    whole = F.slice(grams, F.lit(1), F.when(F.size(t) > 0, F.greatest(F.size(t) - (k - 1), F.lit(1))).otherwise(0))
    df = df.withColumn(w, whole)
    df = df.withColumn(n, F.transform(w, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 32), 31).bitwiseOR((F.lit(PLACES) - i).cast("long"))))
    least: Column = F.col(n)
    size = 1
    while size < window:
        step = min(size, window - size)
        name = f"__{out}_least{size}"
        df = df.withColumn(name, F.zip_with(least, _ahead(least, step), lambda a, b: F.least(a, b)))
        least, size = F.col(name), size + step
    df = df.withColumn(g, F.slice(least, F.lit(1), F.when(F.size(n) > 0, F.greatest(F.size(n) - (window - 1), F.lit(1))).otherwise(0)))
    chosen = F.transform(F.array_distinct(g), lambda x: (F.lit(PLACES) - x.bitwiseAND(PLACES)).cast("int"))
    df = df.withColumn(out, F.transform(chosen, lambda i: F.struct(F.col(w)[i].alias("hash"), i.alias("position"))))
    return df.drop(*[c for c in df.columns if c.startswith(f"__{out}_")], g)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, equal.cast("double")).otherwise(both / either)


def spelt(fingerprint: Column) -> Column:
    """hash@position of every chosen k-gram, in order, separated by spaces."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit("@"), x["position"].cast("string"))), " ")


def with_next(docs: DataFrame, more: dict[str, Column], buckets: int, id_col: str, text_col: str, prepare=lambda df: df) -> DataFrame:
    """id, text, the columns that ``prepare`` adds, and the columns ``more`` of the next row, in
    descending order of id (the first row follows the last).

    The ids are dealt into ranges, each of which also gets the row that follows its last one, so
    that one window over a range, after one shuffle of the texts, sees all it needs.  Equal ids
    are ordered by text; null ids come last.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    buckets = max(1, min(buckets, 4096))
    edges = sorted({*(base.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets + 1)], 10 * buckets)).first()[0] or [])})[:-1]
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("id"))) if edges else F.lit(0)
    base = base.withColumn("bucket", F.when(F.col("id").isNull(), -1).otherwise(bucket).cast("int"))
    ends = base.groupBy("bucket").agg(F.max("id").alias("top")).orderBy(F.desc("bucket")).collect()  # one row a range
    every = base.withColumn("head", F.lit(0))
    if ends:
        before = [x for i, r in enumerate(ends) for x in (F.lit(r["bucket"]), F.lit(ends[i - 1]["bucket"]))]
        heads = base.where(F.col("id").isNull() | F.col("id").isin([r["top"] for r in ends if r["top"] is not None]))
        heads = heads.groupBy("bucket", "id").agg(F.min(F.struct(F.col("text").isNotNull(), "text"))["text"].alias("text"))
        every = every.unionByName(heads.select("id", "text", F.create_map(*before)[F.col("bucket")].alias("bucket"), F.lit(1).alias("head")))
    dealt = prepare(every.repartition("bucket"))
    order = Window.partitionBy("bucket").orderBy("head", F.desc_nulls_last("id"), F.asc("text"))
    following = F.lead(F.struct(*[c.alias(n) for n, c in more.items()])).over(order)
    return dealt.withColumn("next", following).where("head = 0").drop("bucket", "head").select("*", "next.*").drop("next")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """id, n_chars, edited (the text with its last half replaced by as much of the next document),
    fingerprint and edited_fingerprint (arrays), and their likeness near_edited and, to the next
    document's fingerprint, near_next.  Null text counts as empty."""
    spark = docs.sparkSession

    def prepare(df: DataFrame) -> DataFrame:
        df = fingerprint(df.withColumn("text", F.coalesce("text", F.lit(""))), "text", "fingerprint", k, window)
        return df.withColumn("hashes", hashes(F.col("fingerprint")))

    more = {"next_text": F.col("text"), "next_hashes": F.col("hashes")}
    df = with_next(docs, more, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), id_col, text_col, prepare)
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    df = fingerprint(df, "edited", "edited_fingerprint", k, window)
    return df.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("hashes"), hashes(F.col("edited_fingerprint")), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes"), F.col("text") == F.col("next_text")).alias("near_next"),
    )
