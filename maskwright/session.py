"""Session helpers: lineage cutting in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir was not set; expected a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def work_partitions(spark: SparkSession) -> int:
    """Partitions for steps whose work per byte is high, so that small inputs are not coalesced."""
    return 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Shuffle a scan that has fewer partitions than cores before costly per-row work.

    Large tables already come in more partitions than there are cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, changed: str | None = None) -> tuple[DataFrame, int]:
    """Write `df` to the shared folder and read it back, so its lineage is cut.

    A lost executor costs nothing that is not on shared storage. With `changed`, the number of
    rows for which that boolean column is true comes from the same write, without another job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/maskwright/{uuid.uuid4().hex}"
    count = 0
    if changed is None:
        df.write.parquet(path)
    else:
        seen = Observation()
        df.observe(seen, F.coalesce(F.sum(F.col(changed).cast("long")), F.lit(0)).alias("n")).drop(changed).write.parquet(path)
        count = int(seen.get["n"])
        df = df.drop(changed)
    return spark.read.schema(df.schema).parquet(path), count
