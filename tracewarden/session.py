"""Session settings and tables written between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Skewed join partitions are split at run time even when that adds a shuffle.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Rows that a Python worker gets at once; texts can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in (ADAPTIVE | BATCH).items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is taken in local mode
    only; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="tracewarden-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def freeze(df: DataFrame, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, fixes values that
    would differ between two runs of the same plan, and gives the planner
    real sizes for what follows.
    """
    spark = df.sparkSession
    target = path or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(target, compression=codec)
    return spark.read.schema(df.schema).parquet(target)
