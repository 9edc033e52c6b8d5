"""Written tables that cut lineage: Parquet in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where it is unset: on one machine a temporary folder, on a
    cluster a folder of the warehouse, which all executors share."""
    if at := spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/written-tables"
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    return spark.sparkContext.getCheckpointDir()


#: Spark then deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table once it is written and read again; no task has to be run again for it, and its shuffle files go.

    It is deleted when the application ends: what a query returns may still read it until then."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)


def broadcast_if_small(table: DataFrame, rows: int = 20_000) -> DataFrame:
    """The written table with a broadcast hint if it has few rows; otherwise as it is, for a join that Spark may split."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
