"""Eight-bit scalar quantisation and principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train_sq8(base: DataFrame, vector: str = "embedding") -> tuple[float, float]:
    """Least and greatest element of all vectors."""
    row = base.agg(F.min(F.array_min(vector)).alias("low"), F.max(F.array_max(vector)).alias("high")).first()
    return (0.0, 0.0) if row["low"] is None else (float(row["low"]), float(row["high"]))


def save_sq8(spark, path: str, low: float, high: float) -> None:
    spark.createDataFrame([(low, high)], "low double, high double").write.mode("overwrite").parquet(path)


def load_sq8(spark, path: str) -> tuple[float, float]:
    row = spark.read.parquet(path).first()
    return row["low"], row["high"]


def encode_sq8(x: Column, low: float, high: float) -> Column:
    """Codes 0 to 255, uniform between low and high."""
    step = (high - low) / 255 or 1.0
    return F.transform(x, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") - F.lit(low)) / F.lit(step)).cast("int"))))


def decode_sq8(codes: Column, low: float, high: float) -> Column:
    step = (high - low) / 255 or 1.0
    return F.transform(codes, lambda c: (F.lit(low) + (c + 0.5) * F.lit(step)).cast("float"))


def pca(base: DataFrame, k: int, vector: str = "embedding"):
    """A function that adds the projection of a table's vectors on k components, centred first."""
    rows = base.where(F.col(vector).isNotNull())
    means = [r["m"] for r in rows.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]  # one row a dimension
    mean = F.array(*map(F.lit, means))

    def centred(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("__centred", array_to_vector(F.zip_with(F.col(column).cast("array<double>"), mean, lambda a, b: a - b)))

    model = PCA(k=k, inputCol="__centred", outputCol="__projected").fit(centred(rows, vector))

    def project(df: DataFrame, column: str = vector, out: str = "projected") -> DataFrame:
        return model.transform(centred(df, column)).withColumn(out, vector_to_array("__projected")).drop("__centred", "__projected")

    return project
