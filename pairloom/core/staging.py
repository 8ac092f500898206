"""Intermediate tables in the folder that all executors share.

Iterative or multi-pass operators cut their lineage by writing a parquet table to
``spark.checkpoint.dir``.  A written table survives the loss of executors, keeps its column
statistics, and is read back with column pruning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only for a session on one machine.

    Raises ValueError on a cluster that names none, since a machine-local folder would be lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pairloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back.

    The table stays until ``drop_stage`` or the end of the session's shared folder, as a lazy result may read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` wrote and that no later plan reads; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_stage_path", None)
        if path:
            jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def running_sum(df: DataFrame, order: list, value: str, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in a total order, without bringing them to one task.

    Rows are range-partitioned and written; only one sum for each partition reaches the driver.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "summed")
    total, offsets = 0, []
    for part, n in sorted((r["_part"], r["n"] or 0) for r in parts.groupBy("_part").agg(F.sum(value).alias("n")).collect()):
        offsets.append((part, total))
        total += n
    start = df.sparkSession.createDataFrame(offsets, "_part int, _start bigint")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_part", "_start")


def ranked(df: DataFrame, order: list, name: str = "rank_no", stage_name: str = "ranked") -> DataFrame:
    """Number all rows 1, 2, ... in the given order without bringing them to one task.

    The rows are range-partitioned and written; only the number of rows of each partition reaches
    the driver, and each row gets its place in its partition plus what lies before.  The order
    should be total, else rows that tie get numbers in an arbitrary order.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    spark = df.sparkSession
    parts = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), stage_name)
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "_part int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + place).cast("int")).drop("_part", "_before")
